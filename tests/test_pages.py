"""HTML facts, classes and image rules on small pages."""

import pandas as pd
from pyspark.sql import functions as F

from pagelib.operators import content
from pagelib.plans import catalog

LONG = "<p>" + "Plain words follow each other here. " * 60 + "</p>"
PAGES = {
    "ok": f"<html lang=en><head><title>A &amp; B</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1>{LONG}</article></body></html>",
    "behind_login": "<head><title>Sign in - Site</title></head><body>x</body>",
    "behind_login2": "<head><title>T</title></head><body><form><input type=password></form></body>",
    "empty_shell": "<head><title>T</title></head><body><div id=root></div><script src=a.js></script></body>",
    "empty_shell2": "<head><title>T</title></head><body><div id=__next></div></body>",
    "empty_shell3": "<head><title>T</title></head><body>" + "words " * 80 + "Please enable JavaScript to go on</body>",
    "paywalled": "<head><title>T</title><script type='application/ld+json'>{\"isAccessibleForFree\": \"False\"}</script></head><body>"
                 + "teaser text " * 40 + "</body>",
    "thin": "<head><title>T</title></head><body><p>" + "short text " * 40 + "</p><p style='display: none'>hidden</p></body>",
}


def facts(spark):
    rows = [(k, f"https://a.com/{k}", h) for k, h in PAGES.items()]
    return content.page_facts(spark.createDataFrame(rows, "page_id string, url string, html string"))


def test_classes(spark):
    got = content.classify_pages(content.page_features(facts(spark))).select("page_id", "class").collect()
    assert {r["page_id"]: r["class"] for r in got} == {k: k.rstrip("23") for k in PAGES}


def test_visible_and_title(spark):
    f = {r["page_id"]: r for r in facts(spark).collect()}
    assert "hidden" not in f["thin"]["visible"] and f["ok"]["title"] == "A & B" and f["ok"]["lang"] == "en"
    assert f["empty_shell"]["scripts"] == 1 and f["paywalled"]["scripts"] == 0 and f["behind_login2"]["password"]


def test_main_text_has_title_once(spark):
    t = content.main_text(content.classify_pages(content.page_features(facts(spark)))).where("page_id = 'ok'").first()
    assert t["markdown"].startswith("# A & B\n") and t["markdown"].count("# A & B") == 1 and "menu" not in t["markdown"]


def test_srcset(spark):
    cases = {"a.jpg 400w, b.jpg 800w, c.jpg 1600w": ("b.jpg", 1600), "a.jpg 100w, b.jpg 500w": ("b.jpg", 500),
             "a.jpg, b.jpg 2x": ("b.jpg", None), "a.jpg": ("a.jpg", None)}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", content.choose_srcset(F.col("s")).alias("c"))
    assert {r["s"]: (r["c"]["url"], r["c"]["widest"]) for r in df.collect()} == cases


def test_resolve(spark):
    base = "https://a.com/x/y.html?q"
    cases = {"z.png": "https://a.com/x/z.png", "/z.png": "https://a.com/z.png", "//b.com/z": "https://b.com/z",
             "http://c.com/": "http://c.com/", "data:image/png;base64,x": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", content.resolve(F.lit(base), F.col("s")).alias("u"))
    assert {r["s"]: r["u"] for r in df.collect()} == cases


def test_pages_reach_python_in_batches_of_bounded_size(spark):
    catalog.QUERIES["classify_page_html"](spark, "/root/testdata/sf0.001")
    pages = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("html"))
    sizes = pages.mapInPandas(lambda batches: (pd.DataFrame({"n": [b["html"].str.len().sum()]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 60 << 20 and max(r.n for r in sizes) <= 8 << 20
