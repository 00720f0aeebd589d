"""Addresses that stand several times in a table count once."""

import datetime

from pyspark.sql import functions as F

from pagelib.operators import library, planning, visits


def test_one_record_for_a_page(spark):
    pages = spark.createDataFrame([("https://a.example/x", "a.example", "A", False)], "url string, domain string, title string, forgotten boolean")
    shown = spark.createDataFrame([("https://a.example/x", "t")], "url string, tag string")
    content = spark.createDataFrame([("https://a.example/x", "ok", "h")], "url string, status string, content_sha256 string")
    images = spark.createDataFrame([("https://a.example/x", "ok", True)] * 2, "url string, status string, kept boolean")
    lines = spark.createDataFrame([("https://a.example/x", "d"), ("https://a.example/x", "e")], "url string, lines string")
    records = library.page_records(pages, shown, content, images, lines)
    assert [(r["url"], r["text"].split("\n")[1]) for r in records.collect()] == [("https://a.example/x", "e")]
    assert library.dataset_summary(records, shown).first()["known_pages"] == 1


def test_an_address_stands_once_in_the_history(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = lambda data: spark.createDataFrame(data, "url string, signals struct<visits: long>, refreshed_at timestamp")
    previous = rows([("a", (1,), at(1)), ("a", (2,), at(2)), ("b", (3,), at(1)), ("b", (4,), at(1))])
    reading = spark.createDataFrame([("a", (7,)), ("a", (9,))], "url string, signals struct<visits: long>")
    wanted = spark.createDataFrame([("a",), ("a",)], "url string")
    merged = visits.history_merge(previous, reading, wanted, F.lit(at(5)))
    got = sorted((r["url"], r["signals"]["visits"], r["outcome"]) for r in merged.collect())
    assert got == [("a", 9, "found"), ("b", 4, "untouched")]
    assert visits.history_counts(merged).first().asDict() == {"found": 1, "kept": 0, "recorded": 2}
    assert visits.history_status(merged).first().asDict() == {"pages": 2, "not_in_history": 1}


def test_images_of_one_place_are_tried_by_address(spark):
    addresses = [f"https://i.example/{i}" for i in range(9)]
    c = spark.createDataFrame([("https://a.example/x", u, "og_image", 0) for u in addresses[::-1]], "page string, url string, source string, pos int")
    plan = planning.image_ladder(c, spark.createDataFrame([], "host string, image string"))
    assert [r["url"] for r in plan.orderBy("place").collect()] == addresses


def test_one_answer_for_a_key(spark):
    keys = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://a.example/x")], "pos long, url string")
    none = spark.createDataFrame([], "url string")
    content = spark.createDataFrame([("https://a.example/x", "kept")] * 2, "url string, text string")
    pins = spark.createDataFrame([("kmt-blob:sha256-" + "0" * 64, "fresh", None, "p")] * 2, "url string, state string, why string, text string")
    pinned = spark.createDataFrame([(3, "kmt-blob:sha256-" + "0" * 64)], "pos long, url string")
    got = planning.read_text(keys.unionByName(pinned), keys.unionByName(pinned), none, content, pins).collect()
    assert sorted((r["pos"], r["text"]) for r in got) == [(1, "kept"), (2, "kept"), (3, "p")]
