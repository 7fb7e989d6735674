"""Main text against a plain second implementation: the standard library's parser, and the rules as they are told, each looking at all blocks."""

import re
import time
from html.parser import HTMLParser

import pytest

from arbora.llm import boilerplate as B

PROSE = "the text of this one is about all that we have and it was not in the other of them as they would say to you "


class Plain(HTMLParser):
    """Blocks as (text, characters in links, names of open elements with their numbers, marked, heading)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.number, self.found, self.raw = [], 0, [], None
        self.parts = {True: [], False: []}
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        for marked, parts in self.parts.items():
            text = " ".join("".join(t for t, _, _ in parts).split())
            if text:
                links = " ".join("".join(t for t, link, _ in parts if link).split())
                path = parts[-1][2]
                block = [e[0] for e in path if e[0] not in B.INLINE]
                self.found.append((text, len(links), path, marked, any(e[0] in B.HEADINGS for e in path) and block[-1] in B.HEADINGS))
            parts.clear()

    def handle_data(self, data):
        if not self.raw:
            self.parts[any(e[2] for e in self.open)].append((data, any(e[0] == "a" for e in self.open), tuple(self.open)))

    def handle_starttag(self, name, attributes):
        if self.raw:
            return
        if name not in B.INLINE:
            self.cut()
            while self.open and (self.open[-1][0] in B.INLINE or self.open[-1][0] == "p"):
                self.open.pop()
            while name in ("li", "dd", "dt", "tr", "td", "th", "option") and self.open and self.open[-1][0] == name:
                self.open.pop()
        if name in B.RAW:
            self.raw = name
        elif name not in B.VOID:
            said = any(B.MARKED.search(v or "") for k, v in attributes if k in ("class", "id", "role"))
            self.number += 1
            self.open.append((name, self.number, name in B.OUTER or said and name not in ("html", "body", "article", "main")))

    def handle_endtag(self, name):
        if self.raw:
            self.raw = None if name == self.raw else self.raw
            return
        if name not in B.INLINE:
            self.cut()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                break
            if name in B.INLINE and self.open[i][0] not in B.INLINE:
                break


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def plain_text(page, stop):
    found = Plain(page).found
    inner = [any(e[0] in B.INNER for e in f[2]) for f in found]
    told = []
    for text, links, _, marked, _ in found:
        words = re.findall(r"[^\W\d_]+", text.lower())
        density = sum(w in stop for w in words) / max(1, len(words))
        if marked or links > 0.8 * len(text) or "©" in text[:2]:
            told.append("bad")
        elif links > 0.4 * len(text) or len(text) < 70:
            told.append("open")
        elif density < 0.12:
            told.append("few")
        else:
            told.append("good" if density >= 0.2 and len(text) > 200 else "near")

    def nearest(i, side):
        at = range(i - 1, -1, -1) if side < 0 else range(i + 1, len(found))
        for j in at:
            if told[j] in ("good", "bad"):
                return told[j], min(common(found[k][2], found[k + 1][2]) for k in range(min(i, j), max(i, j))), abs(i - j)
        return "bad", 0, i + 1 if side < 0 else len(found) - i

    def of_article(i, side):
        j = i + side
        while 0 <= j < len(found) and inner[j]:
            if told[j] in ("good", "bad") and not found[j][3]:
                return told[j]
            j += side
        return "good"

    near = [i for i, t in enumerate(told) if t == "near"]
    kept = [i for i in near if "good" not in told or inner[i] or "good" in (nearest(i, -1)[0], nearest(i, 1)[0])]
    told = [("good" if i in kept else "bad") if t == "near" else t for i, t in enumerate(told)]

    def inherited(i):
        a, b = nearest(i, -1), nearest(i, 1)
        if a[0] == b[0]:
            return a[0]
        if a[1] != b[1]:
            return a[0] if a[1] > b[1] else b[0]
        if told[i] == "few":
            return "bad"
        if found[i][4]:
            return b[0]
        return "bad" if a[2] == b[2] else a[0] if a[2] < b[2] else b[0]

    told = [inherited(i) if t == "few" and not inner[i] else t for i, t in enumerate(told)]
    out = []
    for i, t in enumerate(told):
        if t in ("open", "few"):
            t = inherited(i) if not inner[i] else "good" if "good" in (of_article(i, -1), of_article(i, 1)) else "bad"
        if t == "good":
            out.append(found[i][0])
    return "\n".join(out)


@pytest.fixture(scope="module")
def pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"])["html"].to_pylist() + pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()


def unmarked(page):
    return re.sub(r"<(/?)article\b", r"<\1div", page)


@pytest.mark.parametrize("change", [lambda p: p, unmarked, lambda p: re.sub(r'<(/?)(?:nav|article|footer|aside)\b|class="[^"]*"', lambda m: f"<{m[1]}div" if m[1] is not None else "", p)])
def test_equal_to_the_rules_as_told(pages, change):
    for page in map(change, pages):
        lang = re.search(r'<html lang="(\w+)"', page)[1]
        assert B.main_text(page) == plain_text(page, set(B.STOP_WORDS[lang]))


def test_block_rules_find_the_article_without_its_element(pages):
    words = [B.main_text(p).split() for p in pages]
    without = [B.main_text(unmarked(p)).split() for p in pages]
    assert sum(map(len, without)) >= 0.97 * sum(map(len, words))
    assert all(set(b) <= set(a) for a, b in zip(words, without, strict=True))


def test_stop_words_decide_where_markup_does_not(pages, monkeypatch):
    told = [B.main_text(unmarked(p)) for p in pages]
    monkeypatch.setattr(B, "STOP_WORDS", {k: [] for k in B.STOP_WORDS})
    monkeypatch.setattr(B, "ALL_STOP", frozenset())
    assert sum(B.main_text(unmarked(p)) == t for p, t in zip(pages, told, strict=True)) < 0.1 * len(pages)


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div><h2>Head</h2><p>{PROSE * 3}</p><p>Last.</p></div><div><p>Top</p><a href=x>{PROSE}</a></div>", f"Head\n{(PROSE * 3).strip()}\nLast."),
        (f"<p>{PROSE * 3}</p><p>One.</p><p>{PROSE}</p><table><tr><td>{'zq ' * 40}</td></tr></table><p>{PROSE * 3}", "\n".join([(PROSE * 3).strip(), "One.", PROSE.strip(), ("zq " * 40).strip(), (PROSE * 3).strip()])),
        (f"<ul><li><a href=a>{PROSE}</a></li></ul><p>{'zq ' * 40}</p><ul><li><a href=b>{PROSE}</a></li></ul><p>{PROSE * 3}</p>", (PROSE * 3).strip()),
        (f"<article><p>{PROSE * 3}</p><section class=comments><p>{PROSE * 3}</p></section></article>", (PROSE * 3).strip()),
        ("<div>" * 600 + f"<nav><p>{PROSE * 3}</p></nav><p>{PROSE * 4}</p>", (PROSE * 4).strip()),
    ],
)
def test_rules(page, text):
    assert B.main_text(page) == text


@pytest.mark.parametrize("unit", ["<div>", "<i>", "<b><p>", "<div>a", "<i></b>", "<p><i>x</b>", "</div><div>"])
def test_deep_pages_take_time_in_proportion(unit):
    start = time.monotonic()
    B.main_text("<b>" + unit * 200_000)
    assert time.monotonic() - start < 20
