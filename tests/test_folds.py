"""Order-dependent folds against plain loops on small made-up logs."""

import random

from hypothesis import given, settings, strategies as st

from pagelib.operators import logs
from pagelib.streaming import sessions


def test_attempts_equal_a_loop(spark):
    r = random.Random(3)
    data = [(f"u{r.choice([0, 0, 0, 1, 2])}", i, r.choice(["ok", "error", "error", "thin"]), "HTTP 500") for i in range(600)]
    want, last = {}, {}
    for url, seq, status, _ in data:
        n = last.get(url, 0) + 1
        gave_up = status == "error" and n >= 3
        want[seq] = (n, "unavailable" if gave_up else status)
        last[url] = n if status == "error" and not gave_up else 0
    got = logs.attempt_numbers(spark.createDataFrame(data, "url string, seq long, status string, reason string")).collect()
    assert {r["seq"]: (r["attempt"], r["settled_status"]) for r in got} == want


def test_navigation_prunes():
    nav = sessions.Navigations()
    for i in range(5):
        nav.apply("navigation", i, 0, (f"u{i}", f"t{i}"))
    nav.apply("selected_navigation", 3, 0, ())
    nav.apply("prune_front", 0, 2, ())
    assert nav.selected == 1 and nav.current() == ("u3", "t3", True)
    nav.apply("prune", 1, 1, ())
    assert nav.selected == 0 and nav.current() == ("u2", "t2", True)
    nav.apply("prune_back", 1, 0, ())
    assert sorted(nav.entries) == [0]
    nav.apply("selected_navigation", 9, 0, ())
    assert nav.current() == ("u2", "t2", False)


def test_session_fold_equals_a_loop(spark):
    r = random.Random(5)
    kinds = ["navigation"] * 5 + ["selected_navigation", "prune_front", "prune_back", "prune", "tab_window", "window_type", "tab_closed", "tab_index"]
    data = [(r.choice([1, 1, 1, 2]), i, r.choice(kinds), r.randrange(1, 4), r.randrange(1, 3), r.randrange(0, 4), r.randrange(0, 3), f"u{i}",
             f"t{i}", True, "g", None) for i in range(500)]
    tabs, windows, where = {}, set(), {}
    for s, seq, kind, tab, window, index, count, url, title, *_ in data:
        if kind == "tab_closed":
            tabs.pop((s, tab), None)
            where.pop((s, tab), None)
        elif kind == "window_type":
            windows.add((s, window))
        elif kind == "tab_window":
            where[(s, tab)] = window
        elif kind in sessions.NAVIGATION:
            tabs.setdefault((s, tab), sessions.Navigations()).apply(kind, index, count, (url, title))
    want = {(s, t): n.current()[:2] for (s, t), n in tabs.items() if n.entries and (s, where.get((s, t))) in windows}
    df = spark.createDataFrame(data, "session long, seq long, kind string, tab long, window long, index int, count int, url string, "
                                     "title string, flag boolean, token string, at timestamp")
    got = sessions.session_fold(df)["tabs"].collect()
    assert {(g["session"], g["tab"]): (g["url"], g["title"]) for g in got} == want
