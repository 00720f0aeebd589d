"""Text rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAME_LIMIT = 40
SNIPPET_CHARS = 200
SNIPPET_LEAD = 60
# Window kinds 0-4 and group colours 1-8.
WINDOW_KINDS = ["normal", "popup", "app", "devtools", "app_popup"]
COLOURS = ["blue", "red", "yellow", "green", "pink", "purple", "cyan", "orange"]
EPOCH_1601_MICROS = 11644473600000000


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(text) -> Column:
    return ~F.coalesce(_c(text), F.lit("")).rlike(r"\S")


def collapse(text) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))


def words_of(text) -> Column:
    """Lower case words split at whitespace."""
    return F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda w: w != "")


def fold_tag(name) -> Column:
    return F.lower(_c(name))


def normalize_tag(name) -> Column:
    """Struct (name, problem): the stored spelling, or why there is none."""
    n = collapse(name)
    problem = (F.when(n == "", "it is empty")
               .when(F.length(n) > NAME_LIMIT, "it is longer than 40 characters")
               .when(n.rlike(r"\p{Cc}"), "it contains a control character"))
    return F.struct(F.when(problem.isNull(), n).alias("name"), problem.alias("problem"))


def tag_order(name) -> list[Column]:
    """Sort keys: ignoring case, then exact."""
    return [F.lower(_c(name)), _c(name)]


def sort_name(title, url) -> Column:
    shown = F.when(is_blank(title), _c(url)).otherwise(_c(title))
    return F.regexp_replace(shown, r"^[^\p{L}\p{N}]+", "")


def decode_kind(kind) -> Column:
    k = _c(kind)
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in WINDOW_KINDS]), k.cast("int")), F.lit("unknown"))


def decode_colour(colour) -> Column:
    c = _c(colour)
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in COLOURS]), (c - 1).cast("int")), F.lit("grey"))


def chrome_time(micros) -> Column:
    """Microseconds since 1601 as a timestamp; not positive means never."""
    m = _c(micros)
    return F.when(m > 0, F.timestamp_micros(m - EPOCH_1601_MICROS))


def snippet(text, words: Column) -> Column:
    """About 200 characters around the first query word found, words tried in order."""
    t = _c(text)
    low = F.lower(t)
    hits = F.filter(F.transform(words, lambda w: F.instr(low, w)), lambda p: p > 0)
    at = F.get(hits, F.lit(0))
    start = F.greatest(at - SNIPPET_LEAD, F.lit(1))
    rest = F.substring(t, start, F.lit(SNIPPET_CHARS))
    return F.when(at.isNotNull(), F.concat(
        F.when(start > 1, "…").otherwise(""), collapse(rest),
        F.when(F.length(t) > start - 1 + SNIPPET_CHARS, "…").otherwise("")))


def plain_chars(markdown) -> Column:
    """Characters a reader sees: marks, link targets and whitespace runs left out."""
    m = _c(markdown)
    for pattern, new in [
        (r"(?m)^[ \t]*[#> ]*([-*+] )?", ""),       # heading, quote and list marks
        (r"(?<!\\)\]\([^()]*(\([^()]*\)[^()]*)*\)", ""),   # link targets
        (r"(?<!\\)!(?=\[)", ""),
        (r"(?<!\\)[*_`~\[\]|]", ""),
        (r"-{2,}", ""),
        (r"\\(?=\p{Punct})", ""),
    ]:
        m = F.regexp_replace(m, pattern, new)
    return F.length(collapse(m)).cast("long")


def _line(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{label}: "), value))


def metadata_text(title, meta) -> Column:
    """Labelled lines of a metadata struct; lines without a value are left out."""
    m = _c(meta)
    own = collapse(m["title"])
    described = F.coalesce(*[F.when(~is_blank(d), collapse(d)) for d in (
        m["description"], m["og"]["description"], m["twitter"]["description"])], F.lit(""))
    kinds = F.coalesce(F.array_join(m["jsonld_types"], ", "), F.lit(""))
    kind = F.when(kinds != "", kinds).otherwise(collapse(m["og"]["type"]))
    return F.concat_ws(
        "\n",
        F.when((own != "") & (F.lower(own) != F.lower(F.coalesce(_c(title), F.lit("")))),
               F.concat(F.lit("page title: "), own)),
        _line("description", described),
        _line("site", collapse(m["og"]["site_name"])),
        F.when((kind != "") & (kind != "website"), F.concat(F.lit("kind: "), kind)),
        _line("topics", F.coalesce(F.array_join(m["github"]["topics"], ", "), F.lit(""))),
        _line("readme", collapse(m["github"]["readme"])))
