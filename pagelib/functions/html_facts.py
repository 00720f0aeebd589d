"""Facts of one HTML page, read in a single pass of the standard parser.

Only what SQL expressions cannot read from tag soup is done here; every rule over
the facts (fields, classes, image order) is a column expression.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

UNSEEN = {"head", "script", "style", "noscript", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CHROME = {"nav", "header", "footer", "aside"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary"}
MOUNTS = {"root", "app", "__next", "__nuxt"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "form",
          "figure", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "hr", "body"}


HEAD_TAGS = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "head", "html"}
# A start tag ends open elements of the first set, looking outward up to one of the second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
ENDS_P = BLOCKS - {"br", "body", "dt", "dd", "li", "tr"} | {"nav", "header", "footer", "aside", "fieldset", "details", "address"}
# Where a page names no article: elements that may hold the main text, and how a line of text counts for them.
HOLDERS = {"body", "div", "section", "td", "form", "center", "font"}
PROSE = 40               # characters of a line that reads as a sentence; a shorter one counts neither way
LINKED = 0.5             # share of link text above which a line counts against what holds it
P_STAYS = {"td", "th", "table", "button", "object", "template", "li"}


def collapse(text: str) -> str:
    return " ".join(text.split())


def _hidden(attrs: dict) -> bool:
    style = re.sub(r"\s", "", attrs.get("style") or "").lower()
    return ("hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true"
            or "display:none" in style or "visibility:hidden" in style)


class PageFacts(HTMLParser):
    """Collects head fields, visible text, markers and the text of article and page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title = self.lang = self.canonical = None
        self.meta, self.jsonld, self.images = [], [], []
        self.seen, self.scripts, self.password, self.mount = [], 0, False, False
        self.in_head, self.head_done = False, False
        self.open = []            # open elements: (tag, the counts it raises)
        self.area = {"article": 0, "main": 0, "chrome": 0, "pre": 0, "unseen": 0, "a": 0}
        self.parts = {"article": [], "page": []}
        self.named = False        # whether an article or main element was seen
        self.line, self.line_at = [0, 0], 0          # characters and link characters since the last block border
        self.gain, self.link_lines = 0, []           # sum over all lines so far; places of lines made of links
        self.best = (0, 0, 0)     # gain of the best holder, and its place in the page's text
        self.raw, self.raw_text, self.raw_attrs = None, [], {}

    def handle_starttag(self, tag, attributes):
        attrs = {k: (v if v is not None else "") for k, v in reversed(attributes)}
        if tag == "body" or tag not in HEAD_TAGS and self.open and self.open[-1][0] == "head":
            self.in_head, self.head_done = False, True
            self._close("head")
        self._end_implied(tag)
        self._head_tag(tag, attrs)
        if tag == "script":
            kind = attrs.get("type", "").strip().lower()
            runs = kind in ("", "module") or "javascript" in kind or "ecmascript" in kind
            self.scripts += runs
        if tag == "input" and attrs.get("type", "").lower() == "password":
            self.password = True
        self.mount = self.mount or attrs.get("id") in MOUNTS
        if tag in ("script", "style", "title", "textarea"):
            self.raw, self.raw_text, self.raw_attrs = tag, [], attrs
        if tag in VOID:
            if tag == "img" and not self.area["unseen"] and not (self.area["chrome"] and not self.area["main"]):
                self.images.append({k: attrs.get(k, "") for k in (
                    "src", "data-src", "srcset", "data-srcset", "class", "id", "alt", "width", "height")})
            if tag in ("br", "hr"):
                self._text("\n")
            return
        roles = set(attrs.get("role", "").lower().split())
        raises = [name for name in ("article", "main", "pre", "a") if tag == name]
        self.named = self.named or tag in ("article", "main")
        if tag in CHROME or roles & CHROME_ROLES:
            raises.append("chrome")
        if tag in UNSEEN or _hidden(attrs):
            raises.append("unseen")
        if tag in BLOCKS or tag in HOLDERS:
            self._border()
        self.open.append((tag, raises, (self.gain, len(self.parts["page"]))))
        for name in raises:
            self.area[name] += 1
        if tag in BLOCKS:
            self._text("\n\n")
            if re.fullmatch("h[1-6]", tag):
                self._text("#" * int(tag[1]) + " ")
            elif tag == "li":
                self._text("- ")
            elif tag == "pre":
                self._text("```\n")
            elif tag == "blockquote":
                self._text("> ")

    def _end_implied(self, tag):
        """Close what a start tag ends without an end tag of its own."""
        ended, limits = ENDS.get(tag, ((), ()))
        if ended:
            self._close_outward(ended, limits)
        if tag in ENDS_P:
            self._close_outward({"p"}, P_STAYS)

    def _close_outward(self, ended, limits):
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in limits:
                break
            if self.open[i][0] in ended:
                at = i
        if at is not None:
            self._close_from(at)

    def _close(self, tag):
        """Close the innermost open element of a tag and all inside it; an end tag without one means nothing."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close_from(i)
                return

    def _close_from(self, at):
        for tag, raises, since in reversed(self.open[at:]):
            if tag in BLOCKS or tag in HOLDERS:
                self._border()
                self._weigh(tag, since)
            for name in raises:
                self.area[name] -= 1
            if tag == "pre":
                self._text("\n```")
            if tag in BLOCKS:
                self._text("\n\n")
        del self.open[at:]

    def _border(self):
        """A line of text ends: prose counts for what holds it, a line of links against it."""
        chars, linked = self.line
        end = len(self.parts["page"])
        if linked > LINKED * chars:
            self.gain -= chars
            self.link_lines.append((self.line_at, end))
        elif chars >= PROSE:
            self.gain += chars - linked
        self.line, self.line_at = [0, 0], end

    def _weigh(self, tag, since):
        """The holder with the greatest sum stands; of equal ones the innermost, which closes first."""
        gain, start = since
        if tag in HOLDERS and self.gain - gain > self.best[0]:
            self.best = (self.gain - gain, start, len(self.parts["page"]))

    def dense(self) -> list[str]:
        """Text of the best holder without its lines of links; none if no holder has more prose than links."""
        self._border()
        for tag, _, since in reversed(self.open):
            self._weigh(tag, since)
        self._weigh("body", (0, 0))
        _, start, end = self.best
        kept, at = [], start
        for a, b in self.link_lines:
            if start <= a and b <= end:
                kept += self.parts["page"][at:a]
                at = b
        return kept + self.parts["page"][at:end]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_head, self.head_done = False, True
        if tag == self.raw:
            self._close_raw(tag)
        self._close(tag)

    def handle_data(self, data):
        if self.raw:
            self.raw_text.append(data)
        if self.raw == "title" and self.head_done is False:
            return
        if not self.area["unseen"]:
            self.seen.append(data)
            self._text(data if self.area["pre"] else re.sub(r"\s+", " ", data))

    def _text(self, text):
        if self.area["unseen"]:
            return
        if not self.area["chrome"] or self.area["main"]:
            self.parts["page"].append(text)
            chars = len(text.strip())
            self.line[0] += chars
            self.line[1] += chars if self.area["a"] else 0
        if self.area["article"] or self.area["main"]:
            self.parts["article"].append(text)

    def _head_tag(self, tag, attrs):
        if self.head_done or any(t in ("noscript", "template") for t, *_ in self.open):
            return
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang", "").strip() or None
        elif tag == "meta":
            key = next((attrs[k].strip() for k in ("property", "name", "itemprop") if attrs.get(k, "").strip()), None)
            content = attrs.get("content", "").strip()
            if key and content:
                self.meta.append((key.lower(), content))
        elif tag == "link" and self.canonical is None:
            if "canonical" in attrs.get("rel", "").lower().split():
                self.canonical = attrs.get("href", "").strip() or None

    def _close_raw(self, tag):
        text = "".join(self.raw_text)
        if tag == "title" and not self.head_done and self.title is None:
            self.title = collapse(text) or None
        if tag == "script" and self.raw_attrs.get("type", "").strip().lower() == "application/ld+json":
            self.jsonld.append(text.strip())
        self.raw = None

    @staticmethod
    def markdown(parts: list[str]) -> str:
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parts))
        return re.sub(r"\n{3,}", "\n\n", text).strip()


def facts(html: str) -> dict:
    p = PageFacts()
    p.feed(html or "")
    p.close()
    return {
        "title": p.title, "lang": p.lang, "canonical": p.canonical,
        "meta": [{"key": k, "content": c} for k, c in p.meta], "jsonld": p.jsonld,
        "visible": collapse(" ".join(p.seen)), "scripts": p.scripts, "password": p.password, "mount": p.mount,
        "article": p.markdown(p.parts["article"] if p.named else p.dense()), "page": p.markdown(p.parts["page"]), "images": p.images,
    }


FACTS_SCHEMA = (
    "title string, lang string, canonical string, meta array<struct<key: string, content: string>>, "
    "jsonld array<string>, visible string, scripts int, password boolean, mount boolean, article string, "
    "page string, images array<map<string, string>>")
