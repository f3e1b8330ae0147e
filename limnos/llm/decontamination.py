"""Benchmark decontamination: every passage queries a BM25 index of the test items by block-max WAND.

The test items are indexed by word, each score divided by the item's score against itself, so that one threshold serves
all items. Documents are read as passages of twice the longest item of a length class, half overlapping, so that every
item fits into one. A passage first passes an exact bound: common words together can give an item at most so much, so
without enough weight on its rarer words no item can reach the threshold. What passes is searched by WAND with block
maxima, which returns all items above the threshold. A retrieved item counts as leaked when enough of the word
trigrams of its question and of its answer stand in the passage or an item's length around it. Items of fewer than
``LEAST_WORDS`` words leak where their whole word sequence stands, which a trie of all of them finds.

Words are runs of letters and digits; scripts written without spaces (Chinese, Japanese, Thai, ...) count a word for each
character.

The index is sent to the tasks in blocks of ``ITEMS`` items, one round for each block; documents are never shuffled.

Defined results: null and empty documents have no passage; items without a word are matched nowhere; items of fewer than
``LEAST_WORDS`` words leak wherever they stand, by chance too (a one-word item into every document with the word); equal items are found alike; a document leaks an item once, at its best passage (ties: the
first); rows that repeat a doc_id are one document; empty tables give no rows; extra columns are untouched.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.registry import query, table
from limnos.session import bound_batches

K1, B = 1.2, 0.75
#: Share of an item's score against itself from which it is retrieved.
RETRIEVED = 0.5
#: Share of the trigrams of question and of answer that makes a leak.
OVERLAP = 0.5
GRAM = 3
#: Items of fewer words are matched as a whole, with passages of twice SHORT_STEP words.
LEAST_WORDS = 5
SHORT_STEP = 32
#: Items of an index block sent at a time; postings under one block maximum.
ITEMS = 20_000
POSTINGS = 16
#: Texts bounded together.
TEXTS = 100
_WORD = re.compile(r"\w+")
_PARTS = re.compile(r"(?<=[.!?:])\s+|(?<=[。！？：｡])|\n+")
# Thai, Lao, Myanmar, Tai Le to Khmer symbols, Tai Tham, Balinese, kana, Bopomofo, Han, Javanese, Tai Viet, and their extensions.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
_CHARACTERS = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _UNSPACED)
_MARKS = "".join(re.escape(chr(c)) for a, b in _UNSPACED if b < 0x10000 for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == "M")
_ANY_CHARACTER = re.compile(f"[{_CHARACTERS}]")
# A character keeps the vowel signs and tones written on it.
_CHARACTER_OR_WORD = re.compile(f"(?=\\w)[{_CHARACTERS}][{_MARKS}]*|[^\\W{_CHARACTERS}]+")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (_WORD if text.isascii() or not _ANY_CHARACTER.search(text) else _CHARACTER_OR_WORD).findall(text)


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before and in the last sentence; of a single sentence, the last quarter is the answer."""
    parts = [w for p in _PARTS.split(text) if (w := words_of(p))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4) if words else 0
    return words[:cut], words[cut:]


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    """Distinct n-grams; of fewer words, the whole sequence."""
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], window: list[str]) -> float:
    """Share of a part's grams that stand in a window."""
    wanted = grams(part)
    return len(wanted & grams(window, min(GRAM, len(part)))) / len(wanted) if wanted else 1.0


@dataclass
class Index:
    """Postings by term: items in order with their share of the item's own score, and maxima of blocks."""

    local: np.ndarray  # term of each word number of the vocabulary, or -1
    starts: np.ndarray
    items: np.ndarray
    shares: np.ndarray
    block_most: list[list[float]]
    most: np.ndarray  # of each term
    rare: np.ndarray  # whether a term is counted by the bound
    common: np.ndarray  # what all other terms together can give each item
    ids: list[int]
    texts: list[str]
    step: int  # half a passage

    @staticmethod
    def build(rows: list[tuple[int, str]], numbers: dict[str, int], frequency: dict[str, int], total: int, average: float, step: int) -> Index:
        """rows: id and text of the items; numbers: the vocabulary; frequency and total: items with a word, and items, in all."""
        per_term: dict[str, list[tuple[int, float]]] = {}
        for i, (_, text) in enumerate(rows):
            counts = Counter(words_of(text))
            size = sum(counts.values())
            weight = {}
            for w, tf in counts.items():
                idf = np.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
            own = sum(weight.values())
            for w, x in weight.items():
                per_term.setdefault(w, []).append((i, x / own))
        names = sorted(per_term, key=lambda w: (-len(per_term[w]), w))
        lists = [per_term[w] for w in names]
        starts = np.cumsum([0] + [len(x) for x in lists])
        items = np.array([i for x in lists for i, _ in x], np.int64)
        shares = np.array([s for x in lists for _, s in x], float)
        # The most frequent terms are common as long as they cannot reach the threshold by themselves.
        common, rare = np.zeros(len(rows)), np.ones(len(names), bool)
        for t in range(len(names)):
            part = slice(starts[t], starts[t + 1])
            if len(lists[t]) < 2 or (common[items[part]] + shares[part]).max() >= 0.6 * RETRIEVED:
                break
            common[items[part]] += shares[part]
            rare[t] = False
        blocks = [[max(s for _, s in x[i : i + POSTINGS]) for i in range(0, len(x), POSTINGS)] for x in lists]
        local = np.full(len(numbers) + 1, -1)
        local[[numbers[w] for w in names]] = np.arange(len(names))
        return Index(local, starts, items, shares, blocks, np.array([max(b) for b in blocks]), rare, common, [i for i, _ in rows], [t for _, t in rows], step)

    def live(self, terms: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Passages (numbers of their first halves) in which some item may reach the threshold.

        terms and halves: of every known word, in any number of texts; halves of one text are numbered on, and those of
        the next text start two higher.
        """
        keep = self.rare[terms]
        term, half = terms[keep], halves[keep]
        if not len(term):
            return half
        many = self.starts[term + 1] - self.starts[term]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        post = np.repeat(self.starts[term], many) + inner
        n = len(self.ids)
        key = np.repeat(half * n, many) + self.items[post]
        order = np.argsort(key, kind="stable")
        key, shares = key[order], self.shares[post][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, sums = key[first], np.add.reduceat(shares, first)
        # A passage is a half and the one after it.
        after = np.searchsorted(key, key + n)
        hit = (after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + n)
        both = sums + np.where(hit, sums[np.minimum(after, len(key) - 1)], 0.0)
        least = RETRIEVED - 1e-9 - self.common[key % n]
        # A half without the item before it belongs to the passage that starts there, too.
        return np.unique(np.concatenate([key[both >= least] // n, key[sums >= least] // n - 1]))

    def search(self, terms: list[int], least: float = RETRIEVED) -> list[tuple[int, float]]:
        """All items with a score of at least ``least`` for these distinct terms, by WAND with block maxima."""
        cursors = [[int(self.items[self.starts[t]]), t, int(self.starts[t])] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                break
            goal = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == goal:
                pivot += 1
            # Move all cursors before the pivot's item up to it, then look at the blocks they stand in.
            behind = [c for c in cursors[: pivot + 1] if c[0] < goal]
            shallow = 0.0
            for _, t, p in cursors[: pivot + 1]:
                end = int(self.starts[t + 1])
                q = p + int(np.searchsorted(self.items[p:end], goal))
                shallow += self.block_most[t][(q - int(self.starts[t])) // POSTINGS] if q < end else 0.0
            if shallow < least - 1e-12:
                # No item up to the nearest block end can reach the threshold.
                ends = [goal + 1]
                for _, t, p in cursors[: pivot + 1]:
                    first, end = int(self.starts[t]), int(self.starts[t + 1])
                    q = p + int(np.searchsorted(self.items[p:end], goal))
                    if q < end:
                        ends.append(int(self.items[min(end, first + ((q - first) // POSTINGS + 1) * POSTINGS) - 1]) + 1)
                upto = min(ends[1:], default=goal + 1)
                if pivot + 1 < len(cursors):
                    upto = min(upto, cursors[pivot + 1][0])
                cursors = self._advance(cursors, cursors[: pivot + 1], max(upto, goal + 1))
            elif behind:
                cursors = self._advance(cursors, behind, goal)
            else:
                score = sum(float(self.shares[p]) for i, _, p in cursors if i == goal)
                if score >= least - 1e-12:
                    out.append((goal, score))
                cursors = self._advance(cursors, [c for c in cursors if c[0] == goal], goal + 1)
        return out

    def _advance(self, cursors: list[list[int]], which: list[list[int]], goal: int) -> list[list[int]]:
        for c in which:
            end = int(self.starts[c[1] + 1])
            c[2] += int(np.searchsorted(self.items[c[2] : end], goal))
            c[0] = int(self.items[c[2]]) if c[2] < end else -1
        return [c for c in cursors if c[0] >= 0]


@dataclass
class Short:
    """A trie of the word sequences of short items: edges (node, word) in order, the nodes they lead to, and items that end there."""

    width: int
    edges: np.ndarray
    nodes: np.ndarray
    ends: np.ndarray  # whether an item ends at the node
    ids: dict[int, list[int]]

    @staticmethod
    def build(rows: list[tuple[int, str]], numbers: dict[str, int]) -> Short:
        """rows: id and text of the items; numbers: the vocabulary."""
        width = len(numbers) + 1
        tree: dict[int, int] = {}
        ids: dict[int, list[int]] = {}
        for item, text in rows:
            words = words_of(text)
            if 0 < len(words) < LEAST_WORDS:
                node = 0
                for w in words:
                    node = tree.setdefault(node * width + numbers[w], len(tree) + 1)
                ids.setdefault(node, []).append(item)
        edges = np.array(sorted(tree), np.int64)
        ends = np.zeros(len(tree) + 1, bool)
        ends[list(ids)] = True
        return Short(width, edges, np.array([tree[e] for e in edges.tolist()], np.int64), ends, ids)

    def search(self, found: np.ndarray, text_of: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item id, place of the first match, words) of every item in each text.

        found: number of each word of all texts, or -1; text_of and places: its text and its place there.
        """
        out = []
        start, node = np.arange(len(found)), np.zeros(len(found), np.int64)
        for depth in range(LEAST_WORDS - 1 if len(self.edges) else 0):
            inside = start + depth < len(found)
            start, node = start[inside], node[inside]
            at = start + depth
            key = node * self.width + found[at]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = (found[at] >= 0) & (text_of[at] == text_of[start]) & (self.edges[edge] == key)
            start, node = start[hit], self.nodes[edge[hit]]
            ended = self.ends[node]
            _, first = np.unique(text_of[start[ended]] * len(self.ends) + node[ended], return_index=True)
            for s, n in zip(start[ended][first].tolist(), node[ended][first].tolist(), strict=True):
                out += [(int(text_of[s]), item, int(places[s]), depth + 1) for item in self.ids[n]]
        return out


class _Numbers(dict):
    """Numbers of the vocabulary's words; -1 (the last place) for any other."""

    def __missing__(self, word: str) -> int:
        return -1


def build_indexes(rows: list[tuple[int, str]], frequency: dict[str, int], total: int, average: float) -> tuple[dict[str, int], list[Index]]:
    """The vocabulary and an index for each class of item lengths, from ``LEAST_WORDS`` words on."""
    classes: dict[int, list[tuple[int, str]]] = {}
    numbers: dict[str, int] = {}
    for item, text in rows:
        words = words_of(text)
        if len(words) >= LEAST_WORDS:
            classes.setdefault(max(32, 1 << (len(words) - 1).bit_length()), []).append((item, text))
        for w in words:
            numbers.setdefault(w, len(numbers))
    return numbers, [Index.build(c, numbers, frequency, total, average, step) for step, c in sorted(classes.items())]


def leaks_of(texts: list[str], numbers: dict[str, int], indexes: list[Index], short: Short) -> list[tuple[int, int, float, int, float, float]]:
    """(text's place, item id, score, first word of the passage, overlap of question and of answer) of every leak."""
    known = _Numbers(numbers)
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words])
    found = np.fromiter((k for w in words for k in map(known.__getitem__, w)), np.int64, sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(found >= 0)
    whose = np.repeat(np.arange(len(texts)), sizes)
    text_of = whose[at]
    best: dict[tuple[int, int], tuple[float, int, float, float]] = {}
    for k, item, place, size in short.search(found, whose, np.arange(len(found)) - firsts[whose]):
        # The first passage that holds the match.
        low = max(0, -(-(place + size) // SHORT_STEP) - 2) * SHORT_STEP
        if (k, item) not in best or low < best[k, item][1]:
            best[k, item] = (1.0, low, 1.0, 1.0)
    for index in indexes:
        term = index.local[found[at]]
        mine = term >= 0
        spans = sizes // index.step + 3
        base = np.cumsum(spans) - spans + 1
        live = index.live(term[mine], (base[text_of] + (at - firsts[text_of]) // index.step)[mine])
        for k, passage in zip(np.searchsorted(base, live + 1, "right") - 1, live, strict=True):
            low = max(0, int(passage - base[k])) * index.step
            part = index.local[found[firsts[k] + low : min(firsts[k] + low + 2 * index.step, firsts[k] + sizes[k])]]
            for i, score in index.search(np.unique(part[part >= 0]).tolist()):
                question, answer = question_and_answer(index.texts[i])
                around = len(question) + len(answer)
                window = words[k][max(0, low - around) : low + 2 * index.step + around]
                q, a = overlap(question, window), overlap(answer, window)
                key = (int(k), index.ids[i])
                if q >= OVERLAP and a >= OVERLAP and (key not in best or (score, -low) > (best[key][0], -best[key][1])):
                    best[key] = (score, low, q, a)
    return [(*key, *x) for key, x in best.items()]


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many = [list(dict.fromkeys(words_of(t or ""))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for x in many for w in x], pa.string())})


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start, question_overlap and answer_overlap of every leak (items: item_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    about = items.agg(F.count("*").alias("n"), F.avg(F.size(F.split("text", r"\W+"))).alias("average")).first()
    schema = "doc_id long, item_id long, score double, start long, question_overlap double, answer_overlap double"
    # No rows yet. (An empty list would become an RDD of Python's, for which every executor starts workers of another kind.)
    out = spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, schema.split(", "))])
    frequency = items.mapInArrow(_word_rows, "word string").groupBy("word").agg(F.count("*").alias("n"))
    rounds = -(-about["n"] // ITEMS)
    for k in range(rounds):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k)
        # One block of items and the frequencies of its words come here, and go to the tasks as an index.
        rows = [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]
        known = frequency.join(F.broadcast(block.mapInArrow(_word_rows, "word string").distinct()), "word", "left_semi") if rounds > 1 else frequency
        counts = {r["word"]: r["n"] for r in known.collect()}
        numbers, indexes = build_indexes(rows, counts, about["n"], about["average"])
        sent = spark.sparkContext.broadcast((numbers, indexes, Short.build(rows, numbers)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs_, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
                found = []
                for i in range(0, len(texts), TEXTS):
                    found += [(docs_[i + k], *x) for k, *x in leaks_of(texts[i : i + TEXTS], *sent.value)]
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
    best = F.max_by(F.struct("score", "start", "question_overlap", "answer_overlap"), F.struct("score", -F.col("start"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leak into documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
