"""Chat formatting: exact round trips, escapes, masks, pieces and defined results."""

import hashlib
import random

import numpy as np
import pytest

from limnos.llm import chats
from limnos.llm.chats import VOCABULARY, Chats, Codec, Template, digests

SCHEMA = "conv_id long, turn long, role string, text string, ids string, mask int"
BITS = ["[", "]", "INST]", "/INST]", "\\", "<", "<SYS>>", "s>", "/s>", "[INST]", "</s>", "<s>", "OUT]", " a", "é", "\n", "漢字", "[\\INST]", "<\\\\/s>", "🙂"]


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            text = "".join(rng.choice(BITS) for _ in range(rng.randrange(25)))
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", "[INST]", ""]), text, "x", 1))
    rows += [(50, 0, "user", None, None, None), (50, 1, "assistant", None, None, None), (51, 0, None, "who", None, None)]
    rows += [(52, None, "assistant", "last", None, None), (52, 3, "user", "first", None, None), (None, 0, "user", "lost", None, None)]
    rows += [(53, 0, "user", "twice", None, None)] * 2 + [(54, 0, "assistant", "long " * 150_000, None, None)]
    rows += [(55, i, "assistant" if i % 2 else "user", f"turn {i} </s>", None, None) for i in range(400)]
    return rows


def expected(rows):
    out = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, "rb") as file:
        return Codec(file.read(), Template())


def test_escapes_are_reversible_and_hide_all_marks():
    t, rng = Template(), random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(14)))
        written = t.escape(text)
        assert t.unescape(written) == text
        assert not any(c in written for c in t.controls)


def test_overlapping_control_strings_are_refused():
    with pytest.raises(ValueError):
        Template(begin="INST")
    with pytest.raises(ValueError):
        Template(begin="T][x")
    with pytest.raises(ValueError):
        Template(begin="<\\s>")


def test_texts_come_back(spark, monkeypatch):
    rows = conversations()
    c = Chats(spark)
    formatted = c.formatted(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {}
    for r in c.turns(formatted).collect():
        got.setdefault(r["conv_id"], []).append(((r["piece"], r["place"]), r["role"], r["text"], r["loss"]))
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv, turns in got.items():
        turns.sort()
        assert [(role, text) for _, role, text, _ in turns] == want[conv]
        assert [loss for *_, loss in turns] == [text if role == "assistant" else "" for role, text in want[conv]]


def test_digests_follow_from_the_rows(spark):
    rows = conversations()
    c = Chats(spark)
    want = expected(rows)
    found = digests(c.turns(c.formatted(spark.createDataFrame(rows, SCHEMA).repartition(3)))).collect()
    assert len(found) == len(want)
    for r in found:
        turns = want[r["conv_id"]]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] > sum(len(b) for _, b in turns)


def test_reserved_ids_and_mask(spark, codec):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]", None, None), (1, 1, "assistant", "</s>[INST] ok [/INST]", None, None)]
    for template, closed in ((Template(), 0), (Template(close_learned=True), 1)):
        (row,) = Chats(spark, template).formatted(spark.createDataFrame(rows, SCHEMA)).collect()
        ids, mask = np.array(row["ids"]), np.array(row["loss_mask"])
        strings = [codec.string[i] for i in ids if i >= codec.base]
        assert strings == ["<s>", "[INST]", "[/INST]", "[OUT]", "</s>"]
        body = codec.ids(rows[0][3])
        assert all(i < codec.base for i in body)
        assert mask.tolist() == [0] * (len(ids) - len(body) - 1) + [1] * len(body) + [closed]


def test_long_conversations_come_in_pieces_of_whole_turns(spark, monkeypatch):
    rows = [(1, i, "assistant", f"turn {i} of many", None, None) for i in range(50)]
    c, df = Chats(spark), spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(chats, "PIECE_TOKENS", 20)
    cut = c.formatted(df)
    pieces = cut.collect()
    assert len(pieces) > 5 and [p["piece"] for p in pieces] == list(range(len(pieces)))
    assert digests(c.turns(cut)).first()["n_turns"] == 50


def test_empty_table(spark):
    c = Chats(spark)
    assert digests(c.turns(c.formatted(spark.createDataFrame([], SCHEMA)))).count() == 0
