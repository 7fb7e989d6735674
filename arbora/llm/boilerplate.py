"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text at the tags that break lines. The first pass looks at text alone: a block that is mostly links, or a line
that begins with a copyright sign, is bad; of the others a long one of many stop words is good, one of medium length or density near-good, and a short
one, one of many links or one of few stop words is ambiguous. The second pass decides the rest. Near-good blocks are good unless the nearest decided
neighbours on both sides are bad; where a page has no good block they are good anyway. Ambiguous blocks take the label of the nearest decided neighbours; where
these differ, that of the neighbour with which they share the innermost element. If that is the same, long blocks of few stop words, which are decided first, are
bad; of the others a heading takes the label of the text behind it, the rest that of the nearer neighbour.

Markup speaks in the second pass only. Blocks inside navigation, headers, footers, sidebars, forms, notices, adverts or reader comments, by their tags, classes, ids or
roles, are bad neighbours and bad, however good their text: no rule on text tells a reader's comment from an article. Near-good blocks within an article
element are good; its ambiguous blocks have their neighbours in it, and its edges count as good ones.

Stop words come in lists for some languages; a page uses the list of its lang attribute, and all lists together if it has
none of them. A tag whose quotes never close ends at its first `>`. A page takes time in proportion to its length, however deep it nests. Defined cases: null and empty pages, and pages without a good block, have empty texts; unclosed and
misnested tags close with their parents; repeated rows are extracted each; other columns are kept apart in a struct.
"""

from __future__ import annotations

import html
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that pages are marked up with, and frequent function words.
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text; it ends at their end tag only.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
#: Elements that are boilerplate with all they hold.
OUTER = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Elements that hold the article proper.
INNER = frozenset("article main".split())
#: Elements that don't break a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr input".split())
#: Parts of class, id and role names of boilerplate.
MARKED = regex.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|aside|widget|comment|comments|respond|reply|replies|disqus|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|pagination|pager|toolbar|search|complementary|contentinfo|dialog|disclaimer|copyright|legal)(?:$|[\s_-]|\d)",
    regex.IGNORECASE,
)
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were their been has will would who what when there we can if all one more so no out up said about than its into them only other time new some could these two may first then do any like my now over such our even most me made after also did many where before through your how because very each just those being people between under never same".split(),
    "fr": "le la les de des du un une et en est que qui dans pour pas sur au aux avec ce cette ces il elle ils elles ne se sa son ses ou par plus mais nous vous leur leurs je tu on y sont comme fait tout tous ont être avoir même sans entre si bien deux où peut aussi était après dont encore très".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wenn kann".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien".split(),
}
#: Headings: they belong to what follows.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH = 70, 200, 0.12, 0.20
#: Shares of a block's characters in links, from which on it is ambiguous and bad.
LINKS_SOME, LINKS_MOST = 0.4, 0.8

NAME = regex.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
STOPS = regex.compile(r"[>\"']")
NAMES = regex.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.IGNORECASE)
LANG = regex.compile(r"(?:^|\s)lang\s*=\s*[\"']?([A-Za-z]+)", regex.IGNORECASE)
SPACES, WORDS = regex.compile(r"\s+"), regex.compile(r"\p{L}+")
GOOD, NEAR, OPEN, FEW, BAD = "good", "near", "open", "few", "bad"


class Block(NamedTuple):
    """A block of text; linked: its characters in links; marked: inside boilerplate by markup; inner: inside the article proper; shared: elements open around it and the block before."""

    text: str
    linked: int
    marked: bool
    inner: bool
    heading: bool
    shared: int


@lru_cache(maxsize=4096)
def _boilerplate(attributes: str) -> bool:
    return any(MARKED.search(a or b or c or "") for a, b, c in NAMES.findall(attributes))


def tags(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text before the tag, its name, its attributes, whether it is an end tag); at the end the name is empty. Comments and what raw elements hold are left out."""
    at, begin, quoted = 0, 0, True  # begin: of the text that no tag has followed yet
    text: list[str] = []
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at) or page[at + 1 : at + 2] in ("!", "?"):
            close = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(close, at)
            text.append(page[begin:at])
            if close == "]]>":
                text.append(html.escape(page[at + 9 : end if end >= 0 else None], False))
            at = begin = len(page) if end < 0 else end + len(close)
            continue
        name = NAME.match(page, at + 1)
        if not name:
            at += 1
            continue
        end = name.end()
        while quoted:
            stop = STOPS.search(page, end)
            if stop and stop[0] == ">":
                end = stop.start()
                break
            end = page.find(stop[0], stop.end()) + 1 if stop else 0
            if not end:
                quoted = False  # and so are all quotes behind
        if not quoted:
            end = page.find(">", name.end())
        if end < 0:
            break
        text.append(page[begin:at])
        low = name[1].lower()
        yield "".join(text), low, page[name.end() : end], page[at + 1] == "/"
        text.clear()
        at = begin = end + 1
        if low in RAW and page[name.start()] != "/":
            close = regex.compile(rf"</{regex.escape(low)}\s*>", regex.IGNORECASE).search(page, at)
            at = begin = close.end() if close else len(page)
    yield "".join(text) + page[begin:], "", "", False


def blocks(page: str) -> tuple[list[Block], str]:
    """The blocks with text, and the page's language.

    What an inline element that is marked as boilerplate holds is a block of its own, before that of the text around it.
    """
    stack: list[tuple[str, bool, bool, bool]] = []  # name, in boilerplate, in the article, in a link
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each name in the stack; of those that break lines by ""
    out: list[Block] = []
    lang, inside, heading, shared = "", False, False, 0
    pieces: dict[bool, tuple[list[str], list[str]]] = {True: ([], []), False: ([], [])}  # by boilerplate: all, and those in links

    def close() -> None:
        nonlocal shared, heading
        for marked, (text, linked) in pieces.items():
            if text:
                whole = SPACES.sub(" ", html.unescape("".join(text))).strip()
                if whole:
                    out.append(Block(whole, len(SPACES.sub(" ", html.unescape("".join(linked))).strip()), marked, inside, heading, shared))
                    shared = len(stack)
                text.clear()
                linked.clear()
        heading = False

    def pop(k: int) -> None:
        nonlocal shared
        for gone in stack[k:]:
            places[gone[0]].pop()
            if gone[0] not in INLINE:
                places[""].pop()
        del stack[k:]
        shared = min(shared, k)

    for text, name, attributes, ends in tags(page):
        _, outer, inner, link = stack[-1] if stack else ("", False, False, False)
        if text:
            inside = inner
            heading = heading or bool(places[""]) and stack[places[""][-1]][0] in HEADINGS
            pieces[outer][0].append(text)
            if link:
                pieces[outer][1].append(text)
        if name not in INLINE:
            close()
        if ends:
            if places[name] and (name not in INLINE or not places[""] or places[""][-1] < places[name][-1]):  # an inline end tag closes nothing beyond its block
                pop(places[name][-1])
        elif name and name not in RAW and name not in VOID and not attributes.endswith("/"):
            if name == "html" and not lang and (told := LANG.search(attributes)):
                lang = told[1].lower()
            if name not in INLINE:
                while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):  # a block ends open paragraphs and what they hold
                    pop(len(stack) - 1)
                if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    while stack and stack[-1][0] == name:
                        pop(len(stack) - 1)
            above = stack[-1] if stack else ("", False, False, False)
            marked = above[1] or name in OUTER or (name not in ("html", "body", "article", "main") and _boilerplate(attributes))
            if name not in INLINE:
                places[""].append(len(stack))
            places[name].append(len(stack))
            stack.append((name, marked, above[2] or name in INNER, above[3] or name == "a"))
    return out, lang


def first_pass(block: Block, stop: frozenset[str]) -> str:
    """The label that a block's text gives it."""
    links = block.linked / len(block.text)
    if links > LINKS_MOST or "\N{COPYRIGHT SIGN}" in block.text[:2]:
        return BAD
    if links > LINKS_SOME or len(block.text) < LENGTH_LOW:
        return OPEN
    words = WORDS.findall(block.text.lower())
    density = sum(w in stop for w in words) / max(1, len(words))
    if density >= STOP_HIGH and len(block.text) > LENGTH_HIGH:
        return GOOD
    return NEAR if density >= STOP_LOW else FEW


#: A decided neighbour: its label, the elements open all the way from it, and how many blocks away it is.
Neighbour = tuple[str, int, int]


def _neighbours(found: list[Block], told: list[str], order: range) -> list[Neighbour]:
    """The nearest decided block of the page on one side of each block; the page's edges are bad."""
    out: list[Neighbour] = [(BAD, 0, 0)] * len(found)
    label, shared, away = BAD, 0, 0
    for i in order:
        if order.step > 0:
            shared = min(shared, found[i].shared)
        elif i + 1 < len(found):
            shared = min(shared, found[i + 1].shared)
        away += 1
        out[i] = label, shared, away
        if told[i] in (GOOD, BAD):
            label, shared, away = told[i], 1 << 30, 0
    return out


def _within(found: list[Block], told: list[str], order: range) -> list[str]:
    """The label of the nearest decided block of the article proper on one side of each block of it; its edges are good."""
    out, label = [GOOD] * len(found), GOOD
    for i in order:
        out[i] = label
        if not found[i].inner:
            label = GOOD
        elif told[i] in (GOOD, BAD) and not found[i].marked:
            label = told[i]
    return out


def _inherited(block: Block, label: str, before: Neighbour, after: Neighbour) -> str:
    if before[0] == after[0]:
        return before[0]
    if before[1] != after[1]:
        return max(before, after, key=lambda n: n[1])[0]
    if label == OPEN and block.heading:
        return after[0]
    return BAD if label == FEW or before[2] == after[2] else min(before, after, key=lambda n: n[2])[0]


def labels(found: list[Block], stop: frozenset[str]) -> list[str]:
    told = [BAD if b.marked else first_pass(b, stop) for b in found]
    alone = GOOD not in told
    ways = range(len(found)), range(len(found) - 1, -1, -1)
    for label in (NEAR, FEW, OPEN):
        before, after = (_neighbours(found, told, way) for way in ways)
        left, right = (_within(found, told, way) for way in ways)
        now = list(told)
        for i, b in enumerate(found):
            if label == NEAR == told[i]:
                now[i] = GOOD if alone or b.inner or GOOD in (before[i][0], after[i][0]) else BAD
            elif b.inner and label == OPEN and told[i] in (OPEN, FEW):
                now[i] = GOOD if GOOD in (left[i], right[i]) else BAD
            elif not b.inner and told[i] == label:
                now[i] = _inherited(b, label, before[i], after[i])
        told = now
    return told


ALL_STOP = frozenset(w for words in STOP_WORDS.values() for w in words)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, lang = blocks(page)
    stop = frozenset(STOP_WORDS.get(lang, ())) or ALL_STOP
    return "\n".join(b.text for b, label in zip(found, labels(found, stop), strict=True) if label == GOOD)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            text = pa.array([main_text(p) for p in part.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), text, part.column("rest")], names=["doc_id", "text", "rest"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The pages, all columns but html, which is replaced by text and n_chars (its code points)."""
    from arbora.llm import textops as T

    rows = T.packed(pages, id_col, html_col)
    out = rows.mapInArrow(_extracted, rows.schema)
    keep = [F.col("doc_id").alias(id_col)] + [F.col(f"rest.`{c}`").alias(c) for c in pages.columns if c not in (id_col, html_col, "text", "n_chars")]
    return out.select(*keep, "text", F.length("text").cast("bigint").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
