"""Chat formatting by token-level assembly.

Every turn's text is escaped and encoded by itself, row by row where the row lies; only the packed ids travel to the
conversation's place. There the ids of all segments are put one after the other, reserved ids (which no text can encode
to) spliced in as marks of turns; places follow from prefix sums of the segments' lengths, the loss mask from prefix sums
of +1 where a learned text starts and -1 where it ends.

Escaping: a control string inside a text gets one more backslash behind its first character, so ``</s>`` is written
``<\\/s>`` and ``<\\/s>`` is written ``<\\\\/s>``; taking one away restores the text. So neither the ids nor the rendered text
of a turn can hold a mark.

A conversation is streamed through its task in the order of turns and given out in pieces of whole turns, so one of any
length takes bounded memory. (A digest over a conversation is a digest over that stream; encoding is spread by row.)

Defined results: a null text is empty; a null role is the empty role, and roles that the template doesn't know are
written out between marks of their own; turns are ordered by number, null last, ties by role, then by packed ids; repeated rows are turns of
their own; rows without a conv_id are one conversation; texts of any length are encoded whole, in cuts of ``CUT_CHARS``
characters; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.registry import query, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts a text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in cuts of this many characters, which bounds the time of a single merge.
CUT_CHARS = 1 << 18
#: A piece of a conversation ends with the turn that reaches this many tokens.
PIECE_TOKENS = 1 << 20


@dataclass(frozen=True)
class Template:
    """Control strings: one that begins a conversation, and for each role one before and one after the text."""

    begin: str = "<s>"
    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "[OUT]", "</s>"))
    #: Before the name of any other role, between name and text, and after the text.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    learned: tuple[str, ...] = ("assistant",)
    #: Whether the mark that closes a learned text is learned, too.
    close_learned: bool = False

    def __post_init__(self) -> None:
        names = self.controls
        if len(set(names)) < len(names) or any(len(c) < 2 or "\\" in c for c in names):
            raise ValueError("control strings are distinct, of two characters or more, and without a backslash")
        if any(b.startswith(a[i:]) or a[i:].startswith(b) for a in names for b in names for i in range(1, len(a))):
            raise ValueError("control strings must not overlap each other")

    @cached_property
    def controls(self) -> list[str]:
        return [self.begin, *(c for _, *both in self.roles for c in both), *self.other]

    @cached_property
    def _marks(self) -> tuple[re.Pattern, re.Pattern]:
        found = [(re.escape(c[0]), re.escape(c[1:])) for c in self.controls]
        return tuple(re.compile("|".join(rf"{a}\\{many}(?={b})" for a, b in found)) for many in "*+")

    def escape(self, text: str) -> str:
        return self._marks[0].sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._marks[1].sub(lambda m: m[0][:-1], text)

    def spelled(self) -> str:
        """The pattern of what ``escape`` lengthens, for SQL."""
        return "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in self.controls)


class Codec:
    """A vocabulary with the template's reserved ids behind it."""

    def __init__(self, ranks: bytes, template: Template) -> None:
        import tiktoken

        self.template = template
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.base = max(merges.values()) + 1
        self.mark = {c: self.base + i for i, c in enumerate(template.controls)}
        self.string = {i: c for c, i in self.mark.items()}
        self.dtype = np.dtype("<u2" if self.base + len(self.mark) <= 1 << 16 else "<u4")
        self._text = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> list[int]:
        text = self.template.escape(text)
        out: list[int] = []
        for i in range(0, len(text), CUT_CHARS):
            out += self._text.encode_ordinary(text[i : i + CUT_CHARS])
        return out

    def written(self, ids: np.ndarray) -> str:
        """The text of a segment as it is written, escapes included."""
        return self._text.decode_bytes(ids.tolist()).decode() if len(ids) else ""


_CODECS: dict[tuple[bytes, Template], Codec] = {}


def _codec(ranks: bytes, template: Template) -> Codec:
    """The codec, made once in a worker."""
    key = (hashlib.sha256(ranks).digest(), template)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, template)
    return _CODECS[key]


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(values).astype(kind)))


class Chats:
    """The formatter of one template and vocabulary (a file of base64 tokens and ranks, which the driver reads once)."""

    def __init__(self, spark: SparkSession, template: Template | None = None, vocabulary: str = VOCABULARY) -> None:
        self.template = template or Template()
        with open(vocabulary, "rb") as file:
            # A file of fixed size, whatever the data.
            self._ranks = spark.sparkContext.broadcast(file.read())

    def encoded(self, turns: DataFrame) -> DataFrame:
        """conv_id, turn, role and the packed ids of every turn's text (turns: conv_id, turn, role, text)."""
        ranks, template = self._ranks, self.template

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(ranks.value, template)
            for batch in batches:
                for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    ids = [np.array(codec.ids(t) if t else [], codec.dtype).tobytes() for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "role")), pa.array(ids, pa.binary())], ["conv_id", "turn", "role", "ids"])

        rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text")
        return rows.mapInArrow(run, "conv_id long, turn long, role string, ids binary")

    def formatted(self, turns: DataFrame) -> DataFrame:
        """conv_id, piece, ids and loss_mask; a conversation's pieces come in order, one after the other, in one partition."""
        ranks, template = self._ranks, self.template
        marks = {role: (a, b) for role, a, b in template.roles}

        def turn_segments(codec: Codec, role: str, ids: np.ndarray) -> list[tuple[np.ndarray, bool]]:
            mark = lambda c: np.array([codec.mark[c]], codec.dtype)
            learned = role in template.learned
            if role in marks:
                opened, closed = marks[role]
                head = [(mark(opened), False)]
            else:
                closed = template.other[2]
                head = [(mark(template.other[0]), False), (np.array(codec.ids(role), codec.dtype), False), (mark(template.other[1]), False)]
            return [*head, (ids, learned), (mark(closed), learned and template.close_learned)]

        def joined(segments: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
            ends = np.cumsum([len(ids) for ids, _ in segments])
            starts, learned = ends - [len(ids) for ids, _ in segments], np.array([flag for _, flag in segments])
            steps = np.zeros(int(ends[-1]) + 1, np.int8)
            np.add.at(steps, starts[learned], 1)
            np.add.at(steps, ends[learned], -1)
            return np.concatenate([ids for ids, _ in segments]), np.cumsum(steps[:-1], dtype=np.int8)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(ranks.value, template)
            ready: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []
            conv: list = []  # the conversation at hand, once one is met
            piece, segments, held, waiting = 0, [], 0, 0

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int32()), _lists([r[2] for r in ready], np.int32), _lists([r[3] for r in ready], np.int8)],
                    ["conv_id", "piece", "ids", "loss_mask"],
                )

            for batch in batches:
                for one, role, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "ids")), strict=True):
                    if conv != [one] or held >= PIECE_TOKENS:
                        if segments:
                            ready.append((conv[0], piece, *joined(segments)))
                            waiting += held
                        piece = piece + 1 if conv == [one] else 0
                        segments = [] if piece else [(np.array([codec.mark[template.begin]], codec.dtype), False)]
                        conv, held = [one], 0
                        if waiting >= PIECE_TOKENS or len(ready) >= 5000:
                            yield rows()
                            ready, waiting = [], 0
                    more = turn_segments(codec, role, np.frombuffer(ids, codec.dtype))
                    segments += more
                    held += sum(len(x) for x, _ in more)
            if segments:
                ready.append((conv[0], piece, *joined(segments)))
            if ready:
                yield rows()

        placed = self.encoded(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "ids")
        return placed.mapInArrow(run, "conv_id long, piece int, ids array<int>, loss_mask array<tinyint>")

    def turns(self, formatted: DataFrame) -> DataFrame:
        """The turns read back from ids and mask: conv_id, piece, place (in the piece), role, text, loss (the text under the mask) and n_chars as written, marks included."""
        ranks, template = self._ranks, self.template

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(ranks.value, template)
            for batch in batches:
                out: list[tuple] = []
                for i in range(batch.num_rows):
                    conv, piece = batch.column("conv_id")[i].as_py(), batch.column("piece")[i].as_py()
                    ids, mask = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "loss_mask"))
                    out += [(conv, piece, place, *turn) for place, turn in enumerate(read(codec, ids, mask.astype(bool)))]
                    if len(out) >= 2000:
                        yield _turn_rows(out)
                        out = []
                if out:
                    yield _turn_rows(out)

        return formatted.mapInArrow(run, _TURNS)


_TURNS = "conv_id long, piece int, place int, role string, text string, loss string, n_chars long"


def _turn_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _TURNS.split(", ")])


def read(codec: Codec, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
    """Role, text, text under the mask, and characters as written of each turn in a piece."""
    template = codec.template
    opened = {codec.mark[a]: role for role, a, _ in template.roles}
    at = np.flatnonzero(ids >= codec.base)
    ends = np.append(at[1:], len(ids))
    plain = mask & (ids < codec.base)
    before = 0
    i = 0
    while i < len(at):
        mark = int(ids[at[i]])
        if mark == codec.mark[template.begin]:
            before = len(template.begin)
            i += 1
            continue
        if mark in opened:
            role, width, closing = opened[mark], 0, i + 1
        else:
            spelled = codec.written(ids[at[i] + 1 : ends[i]])
            role, width, closing = template.unescape(spelled), len(spelled) + len(template.other[1]), i + 2
        lo, hi = int(at[closing - 1]) + 1, int(at[closing])
        written = codec.written(ids[lo:hi])
        text = template.unescape(written)
        learned = plain[lo:hi]
        loss = text if learned.all() else template.unescape(codec.written(ids[lo:hi][learned]))
        yield role, text, loss if hi > lo else "", before + len(codec.string[mark]) + width + len(written) + len(codec.string[int(ids[at[closing]])])
        before, i = 0, closing + 1


def digests(turns: DataFrame) -> DataFrame:
    """n_turns and the digests of each conversation's turns and learned texts, over turns in the order they come in."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: list = []
        n = loss_chars = chars = 0
        whole, learned = hashlib.sha256(), hashlib.sha256()
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in f else pa.int64()) for c, f in zip(zip(*out, strict=True), names, strict=True)], names)

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for one, role, text, loss, width in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "n_chars")), strict=True):
                if conv != [one]:
                    if conv:
                        out.append((conv[0], n, whole.hexdigest(), loss_chars, learned.hexdigest(), chars))
                    conv, n, loss_chars, chars = [one], 0, 0, 0
                    whole, learned = hashlib.sha256(), hashlib.sha256()
                    if len(out) >= 5000:
                        yield rows()
                        out = []
                whole.update(f"{role}\n{text}\n".encode())
                learned.update(loss.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(loss), chars + width
        if conv:
            out.append((conv[0], n, whole.hexdigest(), loss_chars, learned.hexdigest(), chars))
        if out:
            yield rows()

    return turns.mapInArrow(run, schema)


_PLANTED = "</s>[INST] ok [/INST]"
_T = Template()
_WIDTHS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, a, b in _T.roles)
_ROLES = ", ".join(f"'{role}'" for role, _, _ in _T.roles)
_CHECK = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-1, 0, 'user', '{_PLANTED}'), (-1, 1, 'assistant', '{_PLANTED}')),
wide AS (SELECT *, len(regexp_extract_all(text, '{_T.spelled()}')) + length(text)
                + CASE role {_WIDTHS} ELSE {sum(map(len, _T.other))} + length(role) + len(regexp_extract_all(role, '{_T.spelled()}')) END AS width FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(width) + {len(_T.begin)})::BIGINT AS formatted_chars
FROM wide GROUP BY conv_id
"""


@query("op13_chats", _CHECK)
def op13_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that speaks in control strings, formatted as ids and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(_PLANTED).alias("text"))
    chats = Chats(spark)
    return digests(chats.turns(chats.formatted(rows.unionByName(planted))))
