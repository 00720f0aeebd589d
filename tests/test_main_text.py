"""Main text of pages that name no article: the holder with the most prose, without its link lists."""

import random

import pytest

from pagelib.functions import html_facts
from pagelib.operators import content


def words(mark, n, r):
    return " ".join(f"{mark}{r.randrange(10 ** 6)}" for _ in range(n))


def links(r, n):
    return "<ul>" + "".join(f"<li><a href=/x>{words('zlink', r.randrange(1, 9), r)}</a></li>" for _ in range(n)) + "</ul>"


def article(r):
    out = []
    for _ in range(r.randrange(4, 12)):
        out.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "{}<br><br>"])
                   .format(words("art", r.randrange(8, 60), r) + r.choice(["", f" <a href=/y>{words('art', 2, r)}</a>"])))
        if r.random() < 0.3:
            out.append(f"<h2>{words('art', 2, r)}</h2>")
    return "".join(out)


def page(r):
    body, side = article(r), links(r, r.randrange(8, 30))
    teaser = "".join(f"<div><a href=/t>{words('zteaser', 9, r)}</a> <span>{words('zdate', 2, r)}</span></div>" for _ in range(r.randrange(0, 8)))
    layout = r.choice([
        "<div id=top>{s}</div><div id=wrap><div id=text>{b}</div><div id=side>{s}{t}</div></div>",
        "<table><tr><td>{s}</td><td>{b}</td><td>{t}{s}</td></tr></table>",
        "<div><div><section>{b}</section></div></div><div>{t}</div><div>{s}</div>",
        "<nav>{s}</nav><div>{s}<div>{b}{s}</div></div><footer>{t}</footer>",
        "{b}<div>{s}</div>"])
    return body, f"<html><head><title>T</title></head><body>{layout.format(b=body, s=side, t=teaser)}</body></html>"


def marked(text, mark):
    return {w.strip("#>-*") for w in text.replace("<", " <").replace(">", "> ").split() if w.startswith(mark)}


def test_planted_articles(spark):
    r = random.Random(17)
    made = [page(r) for _ in range(200)]
    rows = [(i, "https://a.example/", h) for i, (_, h) in enumerate(made)]
    facts = content.page_facts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {x["page_id"]: x["article"] for x in facts.select("page_id", "article").collect()}
    found = planted = noise = shown = 0
    for i, (body, _) in enumerate(made):
        want = marked(body, "art")
        found, planted = found + len(want & marked(got[i], "art")), planted + len(want)
        noise, shown = noise + len(marked(got[i], "z")), shown + len(got[i].split())
    assert found >= 0.97 * planted, found / planted
    assert noise <= 0.02 * shown, noise / shown


LONG = "Plain words follow each other here, one after another. "


@pytest.mark.parametrize("html, want", [
    ("", ""), ("<a href=/>only a link that is long enough to be read as prose by length</a>", ""), ("<p>short</p>", ""),
    (LONG, LONG.strip()), (f"<div><p>{LONG}</p><p>End.</p>", f"{LONG.strip()}\n\nEnd."),
    (f"<div><p>{LONG}</p></div><div><p>{LONG}</p></div>", f"{LONG.strip()}\n\n{LONG.strip()}"),
    (f"<div>{LONG}<a href=/x>more</a></div><div><a href=/y>{LONG * 3}</a></div>", f"{LONG}more"),
    (f"<nav><div>{LONG * 9}</div></nav><div>{LONG}</div>", LONG.strip()),
    (f"<div hidden>{LONG * 9}</div><div>{LONG}</div>", LONG.strip()),
    (f"<article>{LONG}</article><div>{LONG * 9}</div>", LONG.strip())])
def test_holders(html, want):
    assert html_facts.facts(html)["article"] == want


def test_deep_and_long_pages_stay_linear():
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert html_facts.facts(deep)["article"] == LONG.strip()
    rows = f"<div><p>{LONG}</p><a href=/x>link</a></div>" * 20_000
    assert html_facts.facts(rows)["article"].count("Plain") == 20_000
