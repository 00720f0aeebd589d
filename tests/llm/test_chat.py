"""Chat formatting: exact round trips and the loss mask."""

import hashlib
import random

import pyarrow as pa
import pytest

from pagelib.llm import chat
from pagelib.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.001"
PARTS = ["<s>", "</s>", "[INST]", "[/INST] ", " [/INST]", "[\\INST]", "<\\\\/s>", "[OUT] ", "[ROLE:", "] ", "\\", "[", "<", "[[SYS]", "</", "s>",
         "é", "中😀", "a b", "\n", "[/ROLE]", "", "x" * 50]


def batches(turns, size):
    for i in range(0, len(turns), size):
        part = turns[i:i + size]
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in part], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))],
                                         names=["conv_id", "role", "text"])


def formatted(turns, size=7, template=chat.Template()):
    return [r for b in chat.Assembler(template).stream(batches(turns, size)) for r in b.to_pylist()]


@pytest.fixture(scope="module")
def turns():
    random.seed(3)
    out = []
    for conv in [*range(60), None]:
        for _ in range(random.choice([1, 2, 3, 9, 30])):
            text = "".join(random.choices(PARTS, k=random.randint(0, 12)))
            out.append((conv, random.choice(["user", "assistant", "system", "tool", "", "a]b/ü"]), text))
    return out


@pytest.mark.parametrize("part_bytes,block_bytes,long", [(2 << 20, 1 << 20, 4096), (300, 200, 20), (1, 1, 1)])
def test_round_trip_and_mask(monkeypatch, turns, part_bytes, block_bytes, long):
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    monkeypatch.setattr(chat, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(chat, "LONG", long)
    reader = chat.Template().reader()
    for size in (1, 7, 1000):
        rows = formatted(turns, size)
        assert [(r["conv_id"], role, text) for r in rows for role, text in reader.turns(r["formatted"])] == turns
        assert [r["n_turns"] for r in rows] == [len(list(reader.turns(r["formatted"]))) for r in rows]
        for r in rows:
            spoken = [text for role, text in reader.turns(r["formatted"]) if role == "assistant" and text]
            assert [reader.plain(r["formatted"][s["start"]:s["end"]]) for s in r["loss"]] == spoken
            assert r["formatted"].startswith("<s>") == (r["part"] == 0)
        if part_bytes > 1000:
            assert [r["part"] for r in rows] == [0] * 61
        elif part_bytes == 300:
            assert max(r["part"] for r in rows) > 1


def test_control_strings_never_stand_in_texts(turns):
    template = chat.Template()
    for conv, role, text in turns:
        whole = formatted([(conv, role, text)])[0]["formatted"]
        before, after = template.around(role)
        inside = whole[len("<s>" + before):len(whole) - len(after)]
        assert not any(mark in inside for mark in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE:", "[/ROLE]"))
    assert formatted([(1, "user", "plain [text] <b> \\n")])[0]["formatted"] == "<s>[INST] plain [text] <b> \\n [/INST]"


def test_another_template():
    template = chat.Template(begin="^", marks={"user": ("{U}", "{/U}"), "assistant": ("{A}", "{/A}")}, other=("{R:", "}", "{/R}"),
                             learned=frozenset({"user"}))
    turns = [(1, "user", "x{/U}{\\A}"), (1, "assistant", "^y"), (1, "nobody", "")]
    row, = formatted(turns, template=template)
    reader = template.reader()
    assert [(1, *t) for t in reader.turns(row["formatted"])] == turns
    assert [reader.plain(row["formatted"][s["start"]:s["end"]]) for s in row["loss"]] == ["x{/U}{\\A}"]


def expect(turns):
    told = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    loss = "".join(text or "" for role, text in turns if role == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark):
    by_id = {-1: [("user", chat.CONTROL_TEXT), ("assistant", chat.CONTROL_TEXT)]}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        by_id.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in QUERIES["op12_chat"](spark, FOLDER).collect()}
    assert {i: expect(t) for i, t in by_id.items()} == {i: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for i, r in got.items()}
    assert got[-1].formatted_chars == 3 + 15 + 10 + 2 * (len(chat.CONTROL_TEXT) + 3)


def test_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, part string, loss string"
    rows = [(1, 2, "assistant", "b", "x", "y"), (1, 1, "user", None, "x", "y"), (1, 2, "assistant", "b", "x", "y"), (1, None, None, "first", None, None),
            (None, 1, "user", "nobody's", None, None), (None, None, "assistant", "", None, None), (2, 1, "assistant", "z" * 3_000_000, None, None),
            (2, 2, "assistant", "</s>" * 3, None, None), (2, 3, "user", "", None, None)]
    turns = spark.createDataFrame(rows, schema)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert got == {1: expect([(None, "first"), ("user", None), ("assistant", "b"), ("assistant", "b")]),
                   2: expect([("assistant", "z" * 3_000_000), ("assistant", "</s>" * 3), ("user", "")]),
                   None: expect([("assistant", ""), ("user", "nobody's")])}
    assert chat.format_conversations(turns).where("conv_id = 2").count() == 2
    assert chat.format_conversations(turns.limit(0)).collect() == []
