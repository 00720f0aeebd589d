"""Chunks of page texts: blocks, packing, and cuts inside large paragraphs."""

import random

import pytest

from pagelib.operators import chunks

PARTS = ["# One\n", "## Two words ##\n", "Plain line.\n", "Another plain line,\nand its second.\n", "\n", "\n\n", "- item\n", "  - inner\n", "3) third\n",
         "    deep\n", "```py\nx = 1\n\n# no heading\n```\n", "~~~\nopen\n", "Under\n=====\n", "Line\r\n", "tail without end", "ñandú über 中文 😀\n", "* * *\n"]


def cut(spark, bodies):
    df = spark.createDataFrame([(str(i), "T", b) for i, b in enumerate(bodies)], "page_id string, title string, body string")
    out = {str(i): [] for i in range(len(bodies))}
    for r in chunks.chunk_pages(df).orderBy("page_id", "start").collect():
        out[r["page_id"]].append(r)
    return [out[str(i)] for i in range(len(bodies))]


def test_chunks_cover_any_text(spark):
    rng = random.Random(3)
    bodies = ["".join(rng.choices(PARTS, k=rng.randint(1, 30))) for _ in range(150)]
    bodies += ["".join(rng.choices(PARTS, k=600)) for _ in range(6)] + ["word " * 3000, "x" * 9000, "é中" * 3000, "# H\n\n" + "long text here " * 900, "\n \n", ""]
    for body, rows in zip(bodies, cut(spark, bodies)):
        whole = body.encode()
        assert bool(rows) == bool(body)
        covered = 0
        for r in rows:
            assert r["start"] <= covered < r["end"] <= len(whole)      # pieces of one paragraph may overlap
            whole[r["start"]:r["end"]].decode()                        # never inside a character
            covered = r["end"]
        assert not rows or covered == len(whole)
        assert len({r["id"] for r in rows}) == len(rows)


def test_heading_begins_a_chunk_and_names_the_section(spark):
    [rows] = cut(spark, ["before\n\n# First\n\ntext\n\nSecond\n---\nmore\n\n```\n# not a heading\n```\n- a\n\n  b\n\nlast\n"])
    assert [r["section"] for r in rows] == ["", "First", "Second"]


def test_blocks(spark):
    body = "text\nmore\n\n- one\n- two\n\n  inside\n\nafter\n    deep\n\n```\n- code\n\n```\n# H #\nend\n"
    df = spark.createDataFrame([("p", body)], "page_id string, body string")
    got = [(r["kind"], r["start"]) for r in chunks.page_blocks(chunks.page_lines(df)).orderBy("block").collect()]
    at = body.index
    assert got == [("paragraph", 0), ("list", at("- one")), ("paragraph", at("after")), ("deep", at("    deep")), ("fence", at("```")),
                   ("heading", at("# H")), ("paragraph", at("end"))]


@pytest.mark.parametrize("word", ["word ", "é中文😀 "])
def test_large_paragraph_is_cut_at_white_space(spark, word):
    [rows] = cut(spark, [word * 1500])
    assert len(rows) > 3
    for r, after in zip(rows, rows[1:]):
        assert chunks.LEAST < r["end"] - r["start"] <= chunks.MOST
        assert 0 < r["end"] - after["start"] <= chunks.OVERLAP
        assert (word * 1500).encode()[:r["end"]].decode().endswith(" ")


def test_hash_follows_title_section_and_text(spark):
    one, two, three = cut(spark, ["# A\n\nsame text", "# A\n\nsame text", "# B\n\nsame text"])
    assert one[0]["hash"] == two[0]["hash"] != three[0]["hash"] and one[0]["id"] != two[0]["id"]


def loop_cuts(raw: bytes):
    """Pieces of a paragraph by the rule, one after another."""
    def up(p):
        while p < len(raw) and raw[p] & 0xC0 == 0x80:
            p += 1
        return p

    at, out = 0, []
    while at < len(raw):
        limit, least = len(raw), up(at + chunks.LEAST)
        if at + chunks.MOST < len(raw):
            limit = at + chunks.MOST
            while raw[limit] & 0xC0 == 0x80:
                limit -= 1
        cut = limit
        if limit < len(raw):
            part = raw[least:limit].decode()
            ends = [i + 1 for i, c in enumerate(part) if c.isspace()]
            cut = least + len(part[:ends[-1]].encode()) if ends else limit
        out.append((at, cut))
        at = cut if cut == len(raw) else max(at + 1, up(cut - chunks.OVERLAP))
    return out


def test_long_paragraphs_equal_a_loop(spark):
    rng = random.Random(8)
    words = ["word", "é中", "😀😀", "x" * 700, "中" * 1200, "a", "longer-than-most"]
    bodies = ["".join(rng.choice(words) + rng.choice([" ", "\t", "　", "  "]) for _ in range(n)) + "end" for n in (40, 3000, 7000)]
    for body, rows in zip(bodies, cut(spark, bodies)):
        assert [(r["start"], r["end"]) for r in rows] == loop_cuts(body.encode())
    assert len(rows) > 3 * chunks.NEAR


def test_more_chunks_and_fences_than_a_list_copies(spark):
    block = "```\n" + "# code\n" * 3 + "```\n\n" + "plain words " * 60 + "\n\n"
    [rows] = cut(spark, [block * 900])
    assert len(rows) > chunks.NEAR and rows[0]["start"] == 0
    assert all(a["end"] == b["start"] and b["end"] - b["start"] <= chunks.MOST for a, b in zip(rows, rows[1:]))
    assert {r["section"] for r in rows} == {""}
