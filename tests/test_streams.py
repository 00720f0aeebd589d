"""Streams against their batch forms, with files that come late, twice and in any order."""

import datetime
import random

import pytest

from pagelib.operators import logs
from pagelib.streaming import logs as streams, sessions

COMMANDS = ("session long, seq long, kind string, tab long, window long, index int, count int, url string, title string, "
            "flag boolean, token string, at timestamp")


def stream_of(spark, folder, parts, schema):
    """One file, and so one batch, per list of rows, in their order."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return files.parquet(folder)


def previous_differs(rows):
    last, out = {}, set()
    for browser, profile, at, i, digest in sorted(set(rows), key=lambda r: (r[2], r[3])):
        before = last.get((browser, profile))
        if before is None or digest is not None and before != digest:
            out.add(i)
        last[browser, profile] = digest
    return out


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2], [0, 2, 1, 2, 0, 3]])
def test_changes_with_late_and_repeated_files(spark, tmp_path, order):
    r = random.Random(11)
    start = datetime.datetime(2024, 3, 1)
    rows = [(r.choice(["a", "a", "b"]), r.choice([None, "p"]), start + datetime.timedelta(minutes=r.randrange(0, 4000)), i,
             r.choice(["x", "x", "x", "y", None])) for i in range(400)]
    dealt = sorted(rows, key=lambda x: x[2].day * 1440 + r.randrange(600))      # files overlap in time
    parts = [dealt[k * 100:(k + 1) * 100] for k in range(4)]
    schema = "browser string, profile string, captured_at timestamp, id long, digest string"
    captures = stream_of(spark, str(tmp_path / "in"), [parts[k] for k in order], schema)
    got = streams.change_stream(captures, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted(g["id"] for g in got) == sorted(previous_differs(rows))


def test_a_late_hour_corrects_the_next(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 3, 1, h)
    parts = [[("a", None, at(1), 1, "x"), ("a", None, at(5), 3, "x")], [("a", None, at(3), 2, "y")]]
    captures = stream_of(spark, str(tmp_path / "in"), parts, "browser string, profile string, captured_at timestamp, id long, digest string")
    got = streams.change_stream(captures, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted(g["id"] for g in got) == [1, 2, 3]


def test_tabs_of_closed_windows_go(spark, tmp_path):
    r = random.Random(6)
    kinds = (["navigation"] * 6 + ["tab_window"] * 3 + ["window_type"] * 2
             + ["selected_navigation", "prune_front", "prune_back", "prune", "tab_closed", "window_closed", "tab_index"])
    data = [(r.choice([1, 1, 2, 3]), i, r.choice(kinds), r.randrange(1, 5), r.randrange(1, 4), r.randrange(0, 4), r.randrange(0, 3),
             f"u{i}", f"t{i}", True, "g", None) for i in range(600)]
    # A window that closes after the last command of its tab, a tab without an open window, a tab that closes.
    extra = [("window_type", None, 9), ("tab_window", 50, 9), ("navigation", 50, None), ("tab_window", 51, 8), ("navigation", 51, None),
             ("window_type", None, 7), ("tab_window", 52, 7), ("navigation", 52, None), ("tab_window", 53, 7), ("navigation", 53, None),
             ("window_closed", None, 9), ("tab_closed", 53, None)]
    data += [(1, 600 + i, kind, tab, window, 0, 0, f"u{600 + i}", "t", True, "g", None) for i, (kind, tab, window) in enumerate(extra)]
    parts = [data[:200], data[200:450], data[200:450], data[450:610], data[610:]]
    stream = stream_of(spark, str(tmp_path / "in"), parts, COMMANDS)
    got = sessions.tab_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    want = sessions.session_fold(spark.createDataFrame(data, COMMANDS))["tabs"].collect()
    pick = lambda rows: sorted((x["session"], x["tab"], x["url"], x["title"], x["exact"]) for x in rows)
    assert pick(got) == pick(want) and {50, 51, 52, 53} & {x["tab"] for x in got} == {52}


def test_attempts_with_repeated_files(spark, tmp_path):
    r = random.Random(4)
    schema = "url string, seq long, status string, reason string"
    data = [(f"u{r.choice([0, 0, 1, 2])}", i, r.choice(["ok", "error", "error"]), None) for i in range(200)]
    parts = [data[:80], data[:80], data[80:], data[80:]]
    got = streams.attempt_stream(stream_of(spark, str(tmp_path / "in"), parts, schema), str(tmp_path / "out"), str(tmp_path / "state"))
    want = logs.attempt_numbers(spark.createDataFrame(data, schema))
    pick = lambda rows: sorted((x["seq"], x["attempt"], x["settled_status"]) for x in rows.collect())
    assert pick(got) == pick(want)


def test_a_batch_of_tabs_stores_one_state_each(spark, tmp_path):
    data = [(s, s * 10 + i, kind, 1, 1, 0, 0, f"u{s}-{i}", "t", True, "g", None) for s in range(300)
            for i, kind in enumerate(["window_type", "tab_window", "navigation"])]
    late = [(5, 9000, "navigation", 1, None, 1, 0, "later", "t", True, "g", None), (5, 9001, "selected_navigation", 1, None, 1, 0, "", "", True, "g", None)]
    got = sessions.tab_stream(stream_of(spark, str(tmp_path / "in"), [data, late], COMMANDS), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r["session"]: r["url"] for r in got.collect()} == {s: "later" if s == 5 else f"u{s}-2" for s in range(300)}
    states = spark.read.parquet(str(tmp_path / "out"))
    assert "fold" in states.columns      # read back by the next batch, no call for each key
    assert {r["batch"]: r["count"] for r in states.groupBy("batch").count().collect()} == {0: 600, 1: 1}


def test_attempts_keep_one_state_for_each_page_of_a_batch(spark, tmp_path):
    schema = "url string, seq long, status string, reason string"
    parts = [[("a", 0, "error", None), ("a", 1, "error", None), ("b", 2, "error", None)], [("a", 3, "error", "x"), ("a", 4, "error", None)]]
    got = streams.attempt_stream(stream_of(spark, str(tmp_path / "in"), parts, schema), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r["seq"], r["attempt"], r["settled_status"]) for r in got.collect()) == [
        (0, 1, "error"), (1, 2, "error"), (2, 1, "error"), (3, 3, "unavailable"), (4, 1, "error")]
    states = spark.read.parquet(str(tmp_path / "out" / "states"))
    assert sorted((r["batch"], r["url"], r["errors"], r["last"]) for r in states.collect()) == [(0, "a", 2, 1), (0, "b", 1, 2), (1, "a", 1, 4)]
