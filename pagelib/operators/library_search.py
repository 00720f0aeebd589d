"""One search over a library: filters, ranking with fallbacks, the literal tail, and pages by cursor.

Only keys, ranks and flags travel until a page is cut: filters read metadata, words are looked for where the bodies lie, and
the result is a narrow table of (id, place, ranked) in the shared folder. Bodies, titles and chunk spans are read for the ids
of one page, which a caller bounds.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import text, urls
from pagelib.operators import library, search
from pagelib.operators.digests import set_digest
from pagelib.session import materialise

MODES = ("hybrid", "keyword")
FEW = 10_000     # a page of at most so many hits is broadcast


@dataclass(frozen=True)
class Ask:
    """What is asked. Times are ISO strings; `after` is inclusive, `before` exclusive."""

    query: str = ""
    tags: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    after: str | None = None
    before: str | None = None
    mode: str = "hybrid"

    def words(self) -> list[str]:
        return self.query.lower().split()

    def identity(self, ranking: str) -> str:
        return json.dumps({**asdict(self), "ranking": ranking}, sort_keys=True)


@dataclass(frozen=True)
class Ranking:
    """What a ranking reads. Vectors are (id, vector); `keyword` is (id, score); chunks are (page_id, id, start, end, vector,
    content_sha256)."""

    query_vector: Column
    vectors: DataFrame
    keyword: DataFrame
    images: DataFrame | None = None
    chunks: DataFrame | None = None


@dataclass(frozen=True)
class Results:
    """A whole result. `places` is (id, place, ranked), `fallback` (code, affected_pages)."""

    ask: Ask
    ranking: str
    places: DataFrame
    states: DataFrame
    best_chunks: DataFrame | None
    fallback: DataFrame


def search_library(pages: DataFrame, bodies: DataFrame, ask: Ask, ranking: Ranking | None = None) -> Results:
    """Ranked pages, then pages that hold every word, in intake order.

    `pages` has (id, url, title, tags, added_at, pos), `bodies` (id, text, content_sha256); a page without a body matches by
    title and address. Chunks count where they are of the body in hand; other pages keep their own vector and are named in
    `fallback`. Without words, without a ranking, or in keyword mode, the result is the matches alone.
    """
    if ask.mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    spark = pages.sparkSession
    allowed = library.search_filter(pages, ask.tags, ask.domains, ask.kinds, _time(ask.after), _time(ask.before))
    entries = materialise(allowed.select("id", "url", "title", "pos"), "search-entries")
    matched = search.keyword_match_apart(entries, bodies, ask.query).select(F.col("id").alias("url"))
    ranked, best, fallback = None, None, None
    states = entries.select("id", F.lit(None).cast("string").alias("chunk_status"))
    if ranking is not None and ask.words() and ask.mode == "hybrid":
        among = entries.select("id").join(ranking.vectors.select("id"), "id", "left_semi")
        ready = None
        if ranking.chunks is not None:
            hashes = entries.select("id").join(bodies.select("id", "content_sha256"), "id", "left")
            states = search.chunk_staleness(hashes, ranking.chunks).select("id", "chunk_status")
            ready = states.where("chunk_status = 'ready'").select("id")
            best = search.chunk_winner(ranking.chunks, ranking.query_vector, ready)
            fallback = search.fallback_counts(states)
        fused = search.hybrid_search(ranking.vectors, ranking.query_vector, ranking.keyword, among, ranking.images, ranking.chunks, ready)
        ranked = fused.select(F.col("id").alias("url"), F.col("place").alias("rank"))
    merged = search.merge_ranked(entries.select(F.col("id").alias("url"), "pos"), ranked, matched)
    places = search.numbered_results(merged).select(F.col("url").alias("id"), "place", "ranked")
    if fallback is None:
        fallback = spark.createDataFrame([], "code string, affected_pages long")
    return Results(ask, "keyword" if ranked is None else "hybrid", materialise(places, "search-places"), states, best, fallback)


def _time(iso: str | None) -> datetime | None:
    """A time without a zone is UTC."""
    if iso is None:
        return None
    at = datetime.fromisoformat(iso)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class Page:
    """One page of hits, and one row about it."""

    hits: DataFrame
    about: DataFrame


def result_page(results: Results, pages: DataFrame, bodies: DataFrame, limit: int, cursor: str | None = None,
                capture: DataFrame | None = None) -> Page:
    """The `limit` hits from the cursor on. A malformed cursor is an error; one of another result gives no hit and `stale`.

    A hit has its place, which fields hold a word, a snippet (of its best chunk if it has one), tags, kind, chunk state, and
    the last capture's status for web pages; `capture` is (url, status).
    """
    offset, given = 0, None
    if cursor is not None:
        m = re.fullmatch(r"v1:([0-9]+):([0-9a-f]{64})", cursor)
        if m is None:
            raise search.InvalidCursor("invalid search cursor")
        offset, given = int(m[1]), m[2]
    # One pass over the narrow result gives the digest and the number of hits.
    whole = results.places.agg(F.count(F.lit(1)).alias("total"), F.sha2(F.concat_ws(
        "|", F.lit(results.ask.identity(results.ranking)), set_digest(F.col("place"), F.col("id"))), 256).alias("digest")).first()
    total, digest = whole["total"], whole["digest"]
    stale = given is not None and (given != digest or offset > total)
    end = offset if stale else min(offset + limit, total)
    cut = results.places.where((F.col("place") > offset) & (F.col("place") <= end))
    following = f"v1:{end}:{digest}" if not stale and end < total else None
    spark = pages.sparkSession
    about = spark.createDataFrame([(results.ranking, total, end - offset, following is not None, following, stale)],
                                  "ranking string, total long, returned long, truncated boolean, next string, stale boolean")
    return Page(_hits(results, cut, end - offset <= FEW, pages, bodies, capture), about)


def _hits(results: Results, cut: DataFrame, few: bool, pages: DataFrame, bodies: DataFrame, capture: DataFrame | None) -> DataFrame:
    words = results.ask.words()
    # Bodies and titles are read for the ids of one page alone.
    ids = F.broadcast(cut) if few else cut
    shown = pages.join(ids, "id").join(bodies.join(ids.select("id"), "id", "left_semi").select("id", "text"), "id", "left")
    held = search.keyword_match(shown, results.ask.query).select("id", "matched")
    shown = shown.join(held, "id", "left").join(results.states.join(ids.select("id"), "id", "left_semi"), "id", "left")
    around = text.snippet("text", F.array(*map(F.lit, words))) if words else F.lit(None).cast("string")
    if results.best_chunks is None:
        shown = shown.withColumns({"chunk_start": F.lit(None).cast("long"), "chunk_end": F.lit(None).cast("long")})
    else:
        best = results.best_chunks.select(F.col("page_id").alias("id"), F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"))
        shown = shown.join(best, "id", "left")
    span = F.substring(F.decode(F.substring(F.encode("text", "UTF-8"), F.col("chunk_start").cast("int") + 1,
                                            (F.col("chunk_end") - F.col("chunk_start")).cast("int")), "UTF-8"), 1, text.SNIPPET_CHARS)
    kind = urls.source_kind("url")
    if capture is None:
        shown = shown.withColumn("capture_status", F.lit(None).cast("string"))
    else:
        shown = shown.join(capture.select("url", F.col("status").alias("capture_status")), "url", "left")
    return shown.select(
        "id", "url", "title", "place", "ranked", F.coalesce("matched", F.lit("")).alias("matched"),
        F.when(F.col("chunk_start").isNotNull(), span).otherwise(around).alias("snippet"), "tags", "added_at", kind.alias("kind"),
        "chunk_status", "chunk_start", "chunk_end", F.when(kind == "web", F.col("capture_status")).alias("capture_status"))
