"""Repeated runs of symbols (words or bytes) over all texts: anchors, their groups, extension and exact rest.

Anchors are chosen by content: of the seed grams in every run of ``span`` symbols the one with the least hash, so equal
runs have the same anchor at the same place. Each occurrence of an anchor is extended both ways against the first
occurrence (its hub), which settles every run that the hub shares, for groups of any size with one comparison each. A run
that the hub does not share may still be shared by two others; such runs (of anchors met three times or more) are
compared exactly by their hashes. So are all runs around the anchors of two documents that meet in a few anchors only,
where hashes are less to send than texts. Equal texts are told apart from the start: only the first of them takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.graphs import checked, staged
from limnos.llm.text import byte_views, hash_all_runs, hash_run, prefix_sums, symbol_values, word_hashes

_PLACE = np.uint64((1 << 20) - 1)
_STEP = 1 << 19
_NONE = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Unit:
    """What is counted: words or bytes; runs of ``span``, found by seeds of ``seed`` symbols; runs that are ranked together."""

    words: bool
    span: int
    seed: int
    block: int = 1

    def symbols(self, raw: np.ndarray | None) -> np.ndarray:
        if raw is None or not len(raw):
            return _NONE
        return word_hashes(raw)[0] if self.words else symbol_values(raw)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (its upper 44 bits, ties to the left) of each window, in linear time."""
    n = len(values) - width + 1
    out = np.empty(max(0, n), np.int64)
    for base in range(0, n, _STEP):
        part = values[base : min(base + _STEP, n) + width - 1]
        size = len(part)
        key = np.full(-(-size // width) * width, ~np.uint64(0))
        key[:size] = (part & ~_PLACE) | np.arange(size, dtype=np.uint64)
        rows = key.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: size - width + 1], ahead[width - 1 : size])
        out[base : base + len(least)] = base + (least & _PLACE).astype(np.int64)
    return out


def anchor_of_windows(symbols: np.ndarray, unit: Unit, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each window of the span, and the seed hashes of all places (sums: the symbols' prefix sums)."""
    if len(symbols) < unit.span:
        return np.zeros(0, np.int64), _NONE
    grams = hash_all_runs(prefix_sums(symbols) if sums is None else sums, unit.seed)
    return sliding_argmin(grams, unit.span - unit.seed + 1), grams


def _digest(symbols: np.ndarray) -> bytes:
    return hashlib.blake2b(symbols.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, n, first (smallest doc_id with these symbols) and rows (how many rows have them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit.symbols(raw) for raw in byte_views(batch.column("text"))]
            d = np.frombuffer(b"".join(map(_digest, found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in found], pa.int64()), "d1": pa.array(d[:, 0]), "d2": pa.array(d[:, 1])})

    rows = staged(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long").filter(F.col("n") >= unit.span), "repeat-profiles")
    same = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    return staged(rows.join(same, ["d1", "d2"]).select("doc_id", "n", "first", "rows"), "repeat-copies")


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """h, doc_id and pos of every anchor; a task sends rows that repeat a doc_id and its text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            h, d, p = [_NONE], [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), byte_views(batch.column("text")), strict=True):
                symbols = unit.symbols(raw)
                # Copies under another doc_id are told apart by the caller: which of them is the first, a task can't know.
                if doc is None or len(symbols) < unit.span or (mark := (doc, _digest(symbols))) in seen:
                    continue
                seen.add(mark)
                places, grams = anchor_of_windows(symbols, unit)
                places = np.unique(places)
                h.append(grams[places])
                p.append(places)
                d.append(np.full(len(places), doc))
            if p:
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(h).view(np.int64)), "doc_id": pa.array(np.concatenate(d).astype(np.int64)), "pos": pa.array(np.concatenate(p).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long, pos int")


def occurrences(docs: DataFrame, unit: Unit, copies: DataFrame) -> DataFrame:
    """h, doc_id, pos, hub (doc_id, pos of the first) and n (occurrences) of every occurrence of a repeated anchor."""
    later = copies.filter("doc_id <> first").select("doc_id").distinct()
    found = anchors(docs, unit).join(checked(later), "doc_id", "left_anti")
    # The group's first and size come from a partial aggregate and are joined back: a hot anchor stays spread.
    group = found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("hub")).filter("n > 1")
    return found.join(group, "h").select("h", "doc_id", "pos", "hub", "n")


def later_ones(found: DataFrame) -> DataFrame:
    return found.filter((F.col("doc_id") != F.col("hub.doc_id")) | (F.col("pos") != F.col("hub.pos")))


def extended(docs: DataFrame, found: DataFrame, unit: Unit, least: int = 1) -> DataFrame:
    """Runs and open windows: doc_id, start, end and w (hash of an open window, null for a settled run).

    found: later occurrences. least: anchors in which two documents must meet for their texts to be compared.
    """
    item = F.struct("pos", F.col("hub.pos").alias("at"), (F.col("n") > 2).alias("open"))
    pairs = staged(found.groupBy("doc_id", F.col("hub.doc_id").alias("hub_id")).agg(F.collect_list(item).alias("items")), "repeat-pairs")
    many = pairs.filter(F.size("items") >= least)
    few = pairs.filter(F.size("items") < least).select("doc_id", "hub_id", F.explode("items").alias("i"))
    alone = few.select("doc_id", F.col("i.pos").alias("pos")).unionByName(few.select(F.col("hub_id").alias("doc_id"), F.col("i.at").alias("pos")))
    alone = staged(alone.groupBy("doc_id").agg(F.collect_set("pos").alias("places")), "repeat-places")
    ids = many.select("doc_id").unionByName(many.select(F.col("hub_id").alias("doc_id"))).unionByName(alone.select("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(checked(staged(ids, "repeat-ids")), "doc_id", "left_semi")
    rows = many.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("hub_id"), F.col("text").alias("hub_text")), "hub_id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(byte_views(batch.column("text"))):
                x = unit.symbols(raw)
                places, _ = anchor_of_windows(x, unit)
                start = np.flatnonzero(np.isin(places, batch.column("places")[i].values.to_numpy()))
                if len(start):
                    yield _rows([(np.full(len(start), batch.column("doc_id")[i].as_py()), *_open(x, start, unit))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", _NONE)
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            size = 0
            for i, (raw, hub) in enumerate(zip(byte_views(batch.column("text")), byte_views(batch.column("hub_text")), strict=True)):
                if raw is None or hub is None:
                    continue
                if last[0] != (key := hub.tobytes()):
                    last = (key, unit.symbols(hub))
                x, y = unit.symbols(raw), last[1]
                doc = batch.column("doc_id")[i].as_py()
                got = _extend(x, y, batch.column("items")[i].values, unit)
                out += [(np.full(len(s), doc), s, e, w) for s, e, w in got]
                size += sum(len(s) for s, _, _ in got)
                if size > 200_000:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    def _rows(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, s, e, w = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc.astype(np.int64)), "start": pa.array(s.astype(np.int32)), "end": pa.array(e.astype(np.int32)), "w": pa.array(w.view(np.int64), mask=w == 0)})

    schema = "doc_id long, start int, end int, w long"
    out = rows.select("doc_id", "items", "text", "hub_text").mapInArrow(run, schema)
    if least > 1:
        out = out.unionByName(alone.join(texts, "doc_id").select("doc_id", "text", "places").mapInArrow(windows, schema))
    return staged(out, "repeat-runs")


def _open(x: np.ndarray, start: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return start, start + unit.span, hash_run(prefix_sums(x), start, unit.span) | np.uint64(1)


def _extend(x: np.ndarray, y: np.ndarray, items: pa.StructArray, unit: Unit) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, hash) of the settled runs and of the open windows."""
    pos, at = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "at"))
    # Rows that share a doc_id have other texts; their seeds don't fit here.
    fit = (pos + unit.seed <= len(x)) & (at + unit.seed <= len(y))
    shift = pos - at
    left, right = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for d in np.unique(shift[fit]):
        mine = np.flatnonzero(fit & (shift == d))
        low, high = max(0, int(d)), min(len(x), len(y) + int(d))
        apart = np.flatnonzero(x[low:high] != y[low - d : high - d]) + low
        edge = np.concatenate([[low - 1], apart, [high]])
        k = np.searchsorted(edge, pos[mine], "right")
        left[mine], right[mine] = edge[k - 1] + 1, edge[np.minimum(k, len(edge) - 1)]
    long = right - left >= unit.span
    runs = np.unique(np.stack([left[long], right[long], shift[long]], 1), axis=0)
    settled = (runs[:, 0], runs[:, 1], np.zeros(len(runs), np.uint64))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), _NONE)
    asked = items.field("open").to_numpy(zero_copy_only=False).astype(bool) & fit
    if not asked.any():
        return [settled, none]
    places, _ = anchor_of_windows(x, unit)
    order = np.argsort(pos, kind="stable")
    k = np.minimum(np.searchsorted(pos[order], places), len(pos) - 1)
    seed = order[k]
    start = np.arange(len(places))
    keep = (pos[seed] == places) & asked[seed] & ~((start >= left[seed]) & (start + unit.span <= right[seed]))
    return [settled, _open(x, start[keep], unit)]


def _merged(spans: pa.ListScalar, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans cover in a text of this size (end null: to the end)."""
    if not spans.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = (spans.values.field(k).fill_null(size).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
    end = np.minimum(end, size)
    order = np.argsort(start, kind="stable")
    order = order[start[order] < end[order]]
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(start[1:] > end[:-1]) + 1
    return start[np.concatenate([[0], new])] if len(start) else start, np.append(end[new - 1], end[-1:])


def kept_pieces(docs: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, n, n_removed, n_spans and kept_sha256 of every row (spans: doc_id, start, end; end null: to the end)."""
    by_doc = staged(spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeat-spans")
    total = by_doc.select(F.sum(F.size("spans"))).first()[0] or 0
    # Sent to all tasks while the spans are few; texts are shuffled only beyond that.
    side = F.broadcast(by_doc) if total <= 500_000 else by_doc
    rows = docs.select("doc_id", "text").join(side, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, many, sums = [], [], [], []
            for i, raw in enumerate(byte_views(batch.column("text"))):
                raw = np.zeros(0, np.uint8) if raw is None else raw
                words = raw.tobytes().split() if unit.words else None
                size = len(raw) if words is None else len(words)
                start, end = _merged(batch.column("spans")[i], size)
                # What lies before, between and behind the runs.
                pieces = zip([0, *end.tolist()], [*start.tolist(), size], strict=True)
                if words is None:
                    kept = b"".join([raw[a:b].tobytes() for a, b in pieces])
                else:
                    kept = b" ".join([w for a, b in pieces for w in words[a:b]])
                n.append(size)
                removed.append(int((end - start).sum()))
                many.append(len(start))
                sums.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(many, pa.int64()), "kept_sha256": pa.array(sums, pa.string())})

    return rows.mapInArrow(run, "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string")
