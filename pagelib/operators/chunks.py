"""Page texts cut into chunks of bounded size along their markdown blocks.

Lines are rows: what a line is follows from its own text, its neighbours (windows over one page's lines) and the code
fences around it. Runs of lines form blocks, blocks are packed into chunks by a fold over one page's blocks, and only a
paragraph that is larger than a chunk is cut inside. All places are byte offsets in UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Chunk sizes, in tokens of four bytes.
LEAST, MOST, OVERLAP = 256 * 4, 512 * 4, 32 * 4

# What the block rules of CommonMark take for a code fence, a heading, the line under a heading, a list item and
# an indented line. Chunk borders must fall where these say.
MARK = r"^ {0,3}(`{3,}|~{3,})"
HASHES = r"^ {0,3}#{1,6}(?:[ \t]|$)"
UNDERLINE = r"^ {0,3}(?:=+|-+)[ \t]*$"
ITEM = r"^[ \t]*(?:[-+*]|[0-9]+[.)])[ \t]+"
DEEP = r"^(?: {4}|\t)"
PLACE = "array<struct<start: bigint, end: bigint, section: string, cut: boolean>>"
FENCES = "array<struct<top: int, bottom: int>>"
NEAR = 256      # entries of a growing list that are copied when one is added


def empty_list(kind: str) -> Column:
    """A list for folds that grow it by `added`: adding copies NEAR entries at most, not the whole list."""
    return F.struct(F.array().cast(kind).alias("near"), F.array().cast(f"array<{kind}>").alias("far"))


def added(out: Column, item: Column) -> Column:
    one = F.array(item)
    room = F.struct(F.concat(out["near"], one).alias("near"), out["far"].alias("far"))
    return F.when(F.size(out["near"]) < NEAR, room).otherwise(
        F.struct(one.alias("near"), F.concat(out["far"], F.array(out["near"])).alias("far")))


def listed(out: Column) -> Column:
    return F.concat(F.flatten(out["far"]), out["near"])


def with_value(value: Column, then) -> Column:
    """`then(value)`, with the value computed once however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def quoted(c: Column) -> Column:
    """A string as JSON writes it."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def digest(*values: Column) -> Column:
    """SHA-256 of a compact JSON list."""
    inner = [x for i, v in enumerate(values) for x in ([F.lit(",")] if i else []) + [v]]
    return F.sha2(F.concat(F.lit("["), *inner, F.lit("]")), 256)


def shown_title(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", "none").otherwise(title)


def page_hash(title: Column, body: Column) -> Column:
    return digest(quoted(shown_title(title)), quoted(body))


def page_lines(content: DataFrame) -> DataFrame:
    """(page_id, at, line, start) of every line of a body."""
    before = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = content.select("page_id", F.posexplode(F.split("body", "\n")).alias("at", "raw"))
    return (rows.withColumn("start", F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0)).cast("long"))
            .select("page_id", "at", "start", F.regexp_replace("raw", r"\r$", "").alias("line")))


def fence_ranges(lines: DataFrame) -> DataFrame:
    """(page_id, fences): first and last line of each fenced block; one that is never closed runs to the end."""
    marks = (lines.withColumn("mark", F.regexp_extract("line", MARK, 1)).where("mark <> ''")
             .withColumn("bare", F.regexp_replace("line", MARK, "").rlike(r"^[ \t]*$")))
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("top"), F.lit("").alias("mark"), empty_list(FENCES).alias("out"))
    fence = lambda s, bottom: F.struct(s["top"].alias("top"), bottom.alias("bottom"))

    def step(s, m):
        closes = m["bare"] & (F.substring(m["mark"], 1, 1) == F.substring(s["mark"], 1, 1)) & (F.length(m["mark"]) >= F.length(s["mark"]))
        opened = F.struct(m["at"].alias("top"), m["mark"].alias("mark"), s["out"].alias("out"))
        closed = F.struct(none.alias("top"), F.lit("").alias("mark"), added(s["out"], fence(s, m["at"])).alias("out"))
        return F.when(s["top"].isNull(), opened).when(closes, closed).otherwise(s)

    last = lambda s: listed(F.when(s["top"].isNull(), s["out"]).otherwise(added(s["out"], fence(s, F.lit((1 << 31) - 1)))))
    return marks.groupBy("page_id").agg(F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "mark", "bare"))), start, step, last).alias("fences"))


def page_blocks(lines: DataFrame) -> DataFrame:
    """(page_id, block, start, kind, section): blocks of lines; a block's blank lines after it belong to it."""
    page = Window.partitionBy("page_id").orderBy("at")
    sofar = page.rowsBetween(Window.unboundedPreceding, 0)
    # Fences do not overlap: the last one that opened is the only one that can hold a line.
    opened = (fence_ranges(lines).select("page_id", F.explode("fences").alias("opened"))
              .select("page_id", F.col("opened.top").alias("at"), "opened"))
    title = F.regexp_replace(F.regexp_replace("line", r"^ {0,3}#{1,6}[ \t]*", ""), r"(?:^|[ \t]+)#+[ \t]*$", "")
    own = (F.when(F.col("fence").isNotNull(), "fence").when(F.col("line").rlike(DEEP), "deep").when(F.col("line").rlike(ITEM), "list")
           .when(F.col("line").rlike(HASHES), "heading").otherwise("paragraph"))
    rows = (lines.join(opened, ["page_id", "at"], "left").withColumn("opened", F.last("opened", ignorenulls=True).over(sofar))
            .withColumn("fence", F.when(F.col("at") <= F.col("opened.bottom"), F.col("opened"))).drop("opened")
            .withColumn("blank", F.col("line").rlike(r"^\s*$") & F.col("fence").isNull())
            .withColumn("next", F.lead("line").over(page))
            .withColumn("kind", own)
            .withColumn("underlined", (F.col("kind") == "paragraph") & ~F.col("blank") & F.coalesce(F.col("next").rlike(UNDERLINE), F.lit(False)))
            .withColumn("rule", F.coalesce(F.lag("underlined").over(page), F.lit(False)) & (F.col("kind").isin("paragraph", "list") ))
            .withColumn("kind", F.when(F.col("underlined") | F.col("rule"), "heading").otherwise(F.col("kind")))
            .withColumn("heading", F.when(F.col("kind") == "heading", F.when(F.col("underlined"), F.trim("line")).when(~F.col("rule"), F.trim(title))))
            .where(~F.col("blank")))
    gap = F.coalesce(F.col("at") - F.lag("at").over(page) > 1, F.lit(True))
    flush = ~F.col("line").rlike(r"^[ \t]")
    opens = (F.col("kind") == "fence") & (F.col("at") == F.col("fence.top"))
    ends_list = (F.col("kind") != "list") & flush & ((F.col("kind") == "heading") | opens | F.col("gap"))
    rows = (rows.withColumn("gap", gap)
            .withColumn("item_at", F.max(F.when(F.col("kind") == "list", F.col("at"))).over(sofar))
            .withColumn("end_at", F.max(F.when(ends_list, F.col("at"))).over(sofar))
            .withColumn("kind", F.when(F.col("item_at") > F.coalesce("end_at", F.lit(-1)), "list").otherwise(F.col("kind")))
            .withColumn("was", F.lag("kind").over(page)))
    begins = (F.col("was").isNull() | (F.col("kind") != F.col("was")) | ((F.col("kind") == "heading") & ~F.col("rule"))
              | opens & (F.col("kind") == "fence") | (F.col("kind") == "paragraph") & F.col("gap"))
    return (rows.withColumn("block", F.sum(begins.cast("int")).over(sofar)).groupBy("page_id", "block")
            .agg(F.min("start").alias("start"), F.min("kind").alias("kind"), F.min("heading").alias("heading"))
            .withColumn("section", F.coalesce(F.last("heading", True).over(Window.partitionBy("page_id").orderBy("block")), F.lit(""))))


def pack(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, places): blocks packed in order up to MOST bytes; a heading begins a chunk. A page without blocks is one chunk."""
    order = Window.partitionBy("page_id").orderBy("block")
    spans = (blocks.join(sizes, "page_id").withColumn("end", F.coalesce(F.lead("start").over(order), "bytes"))
             .withColumn("start", F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("start")).cast("long"))
             .groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block", "start", "end", "section", "kind"))).alias("blocks")))
    none = F.lit(None).cast("long")
    closed = F.struct(none.alias("start"), none.alias("end"), F.lit("").alias("section"))
    place = lambda x, cut: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["section"].alias("section"), cut.alias("cut"))
    settled = lambda s: F.when(s["open"]["start"].isNull(), s["out"]).otherwise(added(s["out"], place(s["open"], F.lit(False))))

    def step(s, b):
        full = (b["kind"] == "heading") | (b["end"] - s["open"]["start"] > MOST)
        large = b["end"] - b["start"] > MOST
        begins = s["open"]["start"].isNull() | full
        grown = F.struct(F.when(begins, b["start"]).otherwise(s["open"]["start"]).alias("start"), b["end"].alias("end"), b["section"].alias("section"))
        before = F.when(begins, settled(s)).otherwise(s["out"])
        alone = added(before, place(b, b["kind"] == "paragraph"))
        return F.when(large, F.struct(closed.alias("open"), alone.alias("out"))).otherwise(F.struct(grown.alias("open"), before.alias("out")))

    start = F.struct(closed.alias("open"), empty_list(PLACE).alias("out"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("bytes").alias("end"), F.lit("").alias("section"), (F.col("bytes") > MOST).alias("cut")))
    return sizes.join(spans, "page_id", "left").select(
        "page_id", F.when(F.col("blocks").isNull(), whole).otherwise(F.aggregate("blocks", start, step, lambda s: listed(settled(s)))).alias("places"))


def _inside(b: Column, p: Column) -> Column:
    """Whether byte p of b continues a character."""
    return F.coalesce(F.hex(_part(b, p, p + 1)).between("80", "BF"), F.lit(False))


def _down(b: Column, p: Column) -> Column:
    return F.when(~_inside(b, p), p).when(~_inside(b, p - 1), p - 1).when(~_inside(b, p - 2), p - 2).otherwise(p - 3)


def _up(b: Column, p: Column) -> Column:
    return F.when(~_inside(b, p), p).when(~_inside(b, p + 1), p + 1).when(~_inside(b, p + 2), p + 2).otherwise(p + 3)


def _part(b: Column, start: Column, end: Column) -> Column:
    return F.substr(b, (start + 1).cast("int"), (end - start).cast("int"))


def paragraph_cuts(b: Column) -> Column:
    """(a, b) places of the pieces of a paragraph's bytes.

    A piece ends after the last white space between LEAST and MOST bytes, or at MOST, and the next one begins OVERLAP
    bytes before that end.
    """
    size = F.octet_length(b).cast("long")
    first = F.struct(F.lit(0).cast("long").alias("at"), empty_list("array<struct<a: bigint, b: bigint>>").alias("out"))

    def last_space(start: Column, end: Column) -> Column:
        """Bytes up to the end of the last white space between two places; NULL without one."""
        part = F.decode(_part(b, start, end), "UTF-8")
        return F.nullif(F.octet_length(F.regexp_extract(part, r"(?sU)^(.*\s)", 1)), F.lit(0))

    def step(s, _):
        at = s["at"]

        def piece(cut):
            after = F.when(cut == size, size).otherwise(F.greatest(at + 1, _up(b, cut - OVERLAP)))
            return F.struct(after.alias("at"), added(s["out"], F.struct(at.alias("a"), cut.alias("b"))).alias("out"))

        limit = F.when(at + MOST >= size, size).otherwise(_down(b, at + MOST))
        cut = with_value(limit, lambda limit: with_value(_up(b, at + LEAST), lambda least: F.when(limit == size, size).otherwise(
            F.coalesce(least + last_space(least, limit), limit))))
        return F.when(at >= size, s).otherwise(with_value(cut, piece))

    steps = F.sequence(F.lit(1), F.ceil(size / (LEAST - OVERLAP)).cast("int") + 1)
    return F.aggregate(steps, first, step, lambda s: listed(s["out"]))


def placed_texts(whole: Column, places: Column) -> Column:
    """(start, end, section, text) of every chunk; a place marked `cut` gives several.

    The page's bytes are bound once: a column read inside a fold would be copied at each step.
    """
    def texts(b, start, cuts, section):
        return F.transform(cuts, lambda c: F.struct((start + c["a"]).alias("start"), (start + c["b"]).alias("end"), section.alias("section"),
                                                    F.decode(_part(b, c["a"], c["b"]), "UTF-8").alias("text")))

    def of_place(p):
        def inside(part):
            one = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length(part).cast("long").alias("b")))
            return texts(part, p["start"], F.when(p["cut"], paragraph_cuts(part)).otherwise(one), p["section"])

        return inside

    return with_value(whole, lambda b: F.flatten(F.transform(places, lambda p: with_value(_part(b, p["start"], p["end"]), of_place(p)))))


def chunk_pages(content: DataFrame) -> DataFrame:
    """(page_id, title, body) to chunk rows (id, page_id, start, end, section, hash, page_hash); empty bodies have none."""
    pages = content.where(F.length("body") > 0).select("page_id", "title", "body")
    sizes = pages.select("page_id", F.octet_length("body").cast("long").alias("bytes"))
    placed = pack(page_blocks(page_lines(pages)), sizes)
    texts = placed_texts(F.encode("body", "UTF-8"), F.col("places"))
    # Digests and texts come before the explode, so that no chunk carries the whole page along.
    whole = placed.join(pages, "page_id").select("page_id", shown_title(F.col("title")).alias("title"),
                                                 page_hash(F.col("title"), F.col("body")).alias("page_hash"), texts.alias("chunks"))
    rows = whole.select("page_id", "title", "page_hash", F.explode("chunks").alias("chunk")).select("page_id", "title", "page_hash", "chunk.*")
    return rows.select(
        digest(quoted(F.col("page_id")), F.col("start").cast("string"), F.col("end").cast("string")).alias("id"), "page_id", "start", "end",
        "section", digest(quoted(F.col("title")), quoted(F.col("section")), quoted(F.col("text"))).alias("hash"), "page_hash")
