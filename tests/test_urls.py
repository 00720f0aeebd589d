"""Address rules on hand-made rows the test tables do not hold."""

import pytest
from pyspark.sql import functions as F

from pagelib.functions import urls


def values(spark, fn, addresses):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "i int, url string")
    return [r["v"] for r in df.select("i", fn("url").alias("v")).orderBy("i").collect()]


def test_private_hosts(spark):
    private = ["http://10.0.0.1/", "http://172.31.255.1/", "http://169.254.1.1/", "http://100.64.0.1/", "http://[fd00::1]/",
               "http://[fe80::1]/", "http://[::ffff:192.168.0.1]/", "http://[2001:db8::1]/", "http://router/", "http://a.lan/",
               "http://b.home.arpa./", "http://240.0.0.1/"]
    public = ["http://11.0.0.1/", "http://172.32.0.1/", "https://example.com/", "http://[2606:4700::1]/", "http://100.128.0.1/"]
    assert values(spark, urls.is_private_host, private) == [True] * len(private)
    assert values(spark, urls.is_private_host, public) == [False] * len(public)


def test_tokens_and_sign_in(spark):
    secret = ["https://u:p@a.com/", "https://a.com/?access_token=1", "https://a.com/?X-Signature=1", "https://a.com/?my-key=1",
              "https://a.com/?v=eyJ" + "a" * 40]
    plain = ["https://a.com/?keyboard=1", "https://a.com/?v=eyJa", "https://a.com/"]
    assert values(spark, urls.carries_token, secret) == [True] * len(secret)
    assert values(spark, urls.carries_token, plain) == [False] * len(plain)
    assert values(spark, urls.is_login_page, ["https://a.com/user/Log-In.aspx", "https://auth.a.com/x", "https://a.com/catalog"]) == [
        True, True, False]
    assert values(spark, urls.is_login_redirect, ["https://a.com/account/x"]) == [True]


@pytest.mark.parametrize("raw, key", [
    ("https://A.com/p/?utm_source=x&b=2#top", "https://A.com/p?b=2"),
    ("https://a.com", "https://a.com/"),
    ("https://a.com/?", "https://a.com/?"),
    ("https://a.com/x/?gclid=1", "https://a.com/x"),
    ("https://a.com/x?a=1&&b=2", "https://a.com/x?a=1&&b=2"),
    ("https://a.com/#/route", "https://a.com/#/route"),
    ("https://a.com/#!r", "https://a.com/#!r"),
    ("ftp://a.com/x/", "ftp://a.com/x/"),
    ("https://a.com/a\\b/", "https://a.com/a\\b/"),
])
def test_clean_key(spark, raw, key):
    assert values(spark, urls.clean_key, [raw, key]) == [key, key]


def test_documents(spark):
    cases = {"https://github.com/A/B/issues/7": "github:a/b#7", "https://github.com/A/B/pull/7/files": "github:a/b#7",
             "https://github.com/A/B.git": "github:a/b", "https://github.com/A/B/blob/x": "https://github.com/A/B/blob/x",
             "https://youtu.be/abcdefghijk?t=1": "youtube:abcdefghijk", "https://www.youtube.com/@c": None,
             "https://x.com/a/status/12/photo/1": urls.POST_API + "12", "https://x.com/a": None,
             "https://a.com/x#y": "https://a.com/x"}
    assert values(spark, urls.document_key, list(cases)) == list(cases.values())
    assert values(spark, urls.repo_id, ["git@h.com:o/r.git", "https://h.com:22/o/r/", "file:///x/y", "/x/y", "ssh://g@h/o/../r"]) == [
        "h.com/o/r", "h.com/o/r", None, None, None]


def test_search_results(spark):
    yes = ["https://www.google.co.uk/search?q=a", "https://duckduckgo.com/?q=a", "https://x.com/search?q=a", "https://a.com/Results?x=1"]
    no = ["https://a.com/search", "https://duckduckgo.com/?q=", "https://google.com/maps"]
    assert values(spark, urls.is_search_results, yes) == [True] * 4
    assert values(spark, urls.is_search_results, no) == [False] * 3


def test_domain(spark):
    assert values(spark, urls.domain_of, ["https://WWW.A.com/", "file:///x", "http://localhost:1/", "http://[::1]/", "about:blank", "no url",
                                          "http://app.localhost./"]) == ["a.com", None, None, None, "", "", None]
