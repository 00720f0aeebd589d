"""Registered queries against their SQL twins on the smallest tables.

A cross-section by default; PAGELIB_ALL=1 runs every query.
"""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = ["library_pages", "renumber_positions", "exclude_this_machine_stats", "library_stats", "layout_digest",
        "unchanged_snapshots", "facet_filter", "clean_key", "is_private_host", "document_key", "attempt_numbers",
        "bookmark_fold", "search_ancestry", "referrer_of", "suggestion_view", "apply_tags", "undo_tags", "import_suggestions_problems",
        "add_pages", "fetch_plan", "one_fetch_per_document", "schedule_by_host", "visible_text", "dedupe_captions",
        "thread_text", "tfidf_scores", "hybrid_search", "top_k_neighbours", "best_threshold", "average_precision",
        "stratified_folds", "cluster_report", "read_log", "latest_stream", "attempt_stream", "bookmark_stream", "change_stream"]
# Queries whose right answer on the smallest tables is no row.
EMPTY: set[str] = set()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PAGELIB_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None or (problem == "no rows" and name in EMPTY), problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
