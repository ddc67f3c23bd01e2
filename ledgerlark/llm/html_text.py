"""Main text of web pages: flat blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its number of words, its
link density, those of its neighbours, and where it stands (a heading, a paragraph or an item;
inside an article; inside an element or class that names page furniture). A decision tree,
grown here from a labelled table of blocks, tells article text from the rest. The table is
built by a rule: layouts of pages whose parts are known, with and without elements and classes
that name them, so that counts and neighbours decide where no name does.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of HTML: elements that never hold visible text, that end a block, and that have no end tag.
HIDDEN = frozenset("script style head noscript template svg math iframe object canvas audio video map select textarea option datalist title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form header menu button dialog search fieldset".split())
BODY = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th dt dd".split())
#: What holds so much of a page's own words is no furniture if its name leaves room for doubt: the share, and the least number of words.
MOST, LEAST = 0.5, 60
#: Names of reader comments, which may well outgrow the article.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
_RIGHTS = re.compile(r"^\W*(?:copyright\b|©|\(c\)\s)|\ball rights reserved\b|版权所有|著作权", re.I)
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
#: Words of class, id and role attributes that name furniture, those that name the article, and those that take a name back.
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu sidebar side widget widgets footer header masthead topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies respond tags pagination pager toolbar copyright legal complementary contentinfo search".split())
BODY_WORDS = frozenset("article content post entry story main body text".split())
NEGATIONS = frozenset("no not non has have with without is hide hidden show".split())

_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_RAW = frozenset("script style textarea title noscript iframe template svg math".split())
_CLOSES = {h: re.compile(rf"</{h}(?=[\s>/]|$)", re.I) for h in _RAW}
_GAP = re.compile(r"\s+")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=4096)
def place_of(value: str) -> tuple[bool, bool]:
    """(furniture, body) of a class, id or role value, by its whole tokens.

    A token is read as words joined by - or _; one of them may name furniture unless another takes
    it back (no-sidebar, has-comments). A token that is just a body word outweighs furniture beside it.
    """
    furniture = body = plain = False
    for token in value.split():
        parts = {x.lower() for x in _PARTS.split(token)}
        if parts & NEGATIONS:
            continue
        named = bool(parts & FURNITURE_WORDS)
        furniture |= named
        body |= bool(parts & BODY_WORDS) and not named
        plain |= len(parts) == 1 and parts <= BODY_WORDS
    return furniture and not plain, body


def count_words(text: str) -> int:
    """Words between blanks; where a script is written without blanks, two of its characters count as one."""
    n = len(text.split())
    return n if text.isascii() or not _CJK.search(text) else n + len(_CJK.findall(text)) // 2


class Wrapper:
    """An element that is named as furniture: whether its name is firm (nothing but furniture) or of comments, and what it holds."""

    __slots__ = ("body", "comments", "firm", "kept", "outer", "words")

    def __init__(self, outer: Wrapper | None, firm: bool, comments: bool) -> None:
        self.outer, self.firm, self.comments, self.words, self.body, self.kept = outer, firm, comments, 0, False, True


class Block:
    __slots__ = ("furniture", "heading", "item", "link_words", "main", "paragraph", "parts", "words", "wrapper")

    def __init__(self, wrapper: Wrapper | None, main: bool, heading: bool, paragraph: bool, item: bool) -> None:
        self.wrapper, self.main, self.heading, self.paragraph, self.item = wrapper, main, heading, paragraph, item
        self.furniture = wrapper is not None
        self.parts: list[str] = []
        self.words = self.link_words = 0


class _Tags:
    """Tags of a page in order, each found by plain searches that never go back, so in linear time."""

    def __init__(self, page: str) -> None:
        self.page, self.none = page, {"\"": False, "'": False, ">": False, "-->": False, "]]>": False}

    def find(self, what: str, at: int) -> int:
        """The next place of ``what``, -1 if there is none; that is asked once only."""
        if self.none[what]:
            return -1
        found = self.page.find(what, at)
        self.none[what] = found < 0
        return found

    def end(self, at: int) -> int:
        """The place of the > that ends a tag; quoted values may hold others, a quote that never closes does not count."""
        begin = at
        while m := _STOP.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while before > begin and self.page[before].isspace():
                before -= 1
            if self.page[before] == "=":
                close = self.find(m[0], at)
                at = close + 1 if close >= 0 else at
            begin = m.start()
        return len(self.page)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(begin, end, name, closing, attributes); the name is empty for comments and declarations."""
        page, at = self.page, 0
        while (begin := page.find("<", at)) >= 0:
            if page.startswith("<!--", begin):
                stop = self.find("-->", begin + 4)
                at = stop + 3 if stop >= 0 else len(page)
                yield begin, at, "", False, ""
            elif page.startswith("<![CDATA[", begin):
                stop = self.find("]]>", begin)
                at = stop + 3 if stop >= 0 else len(page)
                yield begin, at, "", False, ""
            elif page.startswith(("<!", "<?"), begin):
                stop = self.find(">", begin)
                at = stop + 1 if stop >= 0 else len(page)
                yield begin, at, "", False, ""
            else:
                closing = page.startswith("/", begin + 1)
                name = _NAME.match(page, begin + 1 + closing)
                if name is None:
                    at = begin + 1
                    continue
                stop = self.end(name.end())
                at = min(stop + 1, len(page))
                word = name[0].lower()
                yield begin, at, word, closing, page[name.end() : stop]
                if word in _RAW and not closing and not page.endswith("/", name.end(), stop):
                    close = _CLOSES[word].search(page, at)
                    at = close.start() if close else len(page)
                    yield at, at, "", False, ""


def _settle(found: list[tuple[Block, str]], wrappers: list[Wrapper], bodies: int) -> None:
    """Take the name furniture back from wrappers of doubtful names that hold most of a page's own words, and give it to lines about rights at its end, outside of any article.

    An article or main element outside a wrapper says where the text is, so then the wrapper keeps its name. If no words at all would be left,
    doubtful names of comments are taken back as well. ``wrappers`` are in the order of their tags, outer ones first.
    """
    own = [b.words - min(b.words, b.link_words) for b, _ in found]
    total = sum(own)
    for (b, _), n in zip(found, own, strict=True):
        if b.wrapper:
            b.wrapper.words += n
    for w in reversed(wrappers):
        if w.outer:
            w.outer.words += w.words
            w.outer.body |= w.body
    for comments in (False, True):
        for w in wrappers:
            free = not w.firm and w.words >= max(LEAST, MOST * total) and (comments or not w.comments) and (w.body or not bodies)
            w.kept = not free or (w.outer is not None and w.outer.kept)
        if any(n for (b, _), n in zip(found, own, strict=True) if not (b.wrapper and b.wrapper.kept)):
            break
    for i, (b, text) in enumerate(found):
        b.furniture = (b.wrapper is not None and b.wrapper.kept) or (i >= len(found) - 3 and i > 0 and b.words <= 30 and not (b.main or b.heading) and bool(_RIGHTS.search(text)))


def blocks(page: str) -> list[tuple[Block, str]]:
    """Flat blocks of a page with their text, white space turned into one space."""
    found: list[tuple[Block, str]] = []
    # Open elements with what each adds to the tallies: link, hidden, furniture, main, heading, paragraph, item.
    stack: list[tuple[str, tuple[int, ...]]] = []
    opened: Counter[str] = Counter()
    tally = [0] * 7
    now: Block | None = None
    # Open wrappers, those of the whole page, and article and main elements outside any wrapper.
    around: list[Wrapper] = []
    wrappers: list[Wrapper] = []
    bodies = 0

    def close() -> None:
        nonlocal now
        if now is not None:
            text = _GAP.sub(" ", "".join(now.parts)).strip()
            if text:
                now.words = count_words(text)
                found.append((now, text))
        now = None

    def add(raw: str) -> None:
        nonlocal now
        if not raw or tally[1]:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if now is None:
            if not text.strip():
                return
            now = Block(around[-1] if around else None, tally[3] > 0, tally[4] > 0, tally[5] > 0, tally[6] > 0)
        now.parts.append(text)
        if tally[0]:
            now.link_words += count_words(text)

    def leave() -> str:
        name, marks = stack.pop()
        opened[name] -= 1
        for i, mark in enumerate(marks):
            tally[i] -= mark
        if marks[2]:
            around.pop()
        return name

    at, raw = 0, False
    for begin, end, name, closing, attributes in _Tags(page):
        if not raw:
            add(page[at:begin])
        at, raw = end, name in _RAW and not closing and not attributes.endswith("/")
        if name in BLOCK:
            close()
        elif name == "br":
            add(" ")
        if not name or raw:
            continue
        if closing:
            if opened[name]:
                while leave() != name:
                    pass
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        furniture, main, unseen, comments = name in FURNITURE, name in BODY, name in HIDDEN, False
        # A form may hold a whole page.
        firm = furniture and name != "form"
        if name == "header" and tally[3]:
            furniture = False
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), (a[2] or "").strip("\"'")
                if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
                    unseen = True
                elif key in ("class", "id", "role") and name not in ("body", "html"):
                    named, body = place_of(value)
                    words = {x.lower() for x in _PARTS.split(value.replace(" ", "-")) if x}
                    firm |= named and words <= FURNITURE_WORDS
                    comments |= named and not COMMENT_WORDS.isdisjoint(words)
                    furniture, main = furniture or (named and name not in BODY), main or body
        if name in ("p", "li", "a") and stack and stack[-1][0] == name:
            leave()
        marks = (int(name == "a"), int(unseen), int(furniture), int(main), int(name in HEADINGS), int(name == "p"), int(name in ITEMS))
        for i, mark in enumerate(marks):
            tally[i] += mark
        stack.append((name, marks))
        opened[name] += 1
        if name in BODY or name == "h1":
            if around:
                around[-1].body = True
            bodies += name in BODY and not around
        if furniture:
            around.append(Wrapper(around[-1] if around else None, firm, comments))
            wrappers.append(around[-1])
    if not raw:
        add(page[at:])
    close()
    _settle(found, wrappers, bodies)
    return found


FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "main", "paragraph", "item", "furniture"]


def features(found: list[tuple[Block, str]]) -> np.ndarray:
    """A row of FEATURES for each block; a missing neighbour has no words."""
    own = np.array([[b.words, min(1.0, b.link_words / max(b.words, 1))] for b, _ in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    place = np.array([[b.heading, b.main, b.paragraph, b.item, b.furniture] for b, _ in found], float).reshape(-1, 5)
    return np.concatenate([own, np.concatenate([none, own])[:-1], np.concatenate([own, none])[1:], place], 1)


# ---- the labelled table ----------------------------------------------------


class Layouts:
    """Pages made of parts whose label is known: 1 for article text, 0 for the rest."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(("of", "the", "rain", "market", "station", "early", "people", "found", "near", "water")) for _ in range(self.r.randint(low, high)))

    def text(self) -> str:
        tag = self.r.choice(["p", "div", "h4"])
        return f"<{tag}>{self.words(1, self.r.choice([8, 40, 200]))}</{tag}>"

    def links(self, item: str, low: int = 2, high: int = 8, most: int = 4) -> list[str]:
        return [f"<{item}><a href='/x'>{self.words(1, most)}</a></{item}>" for _ in range(self.r.randint(low, high))]

    def inside(self, tags: list[str], parts: list[str]) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}>{''.join(parts)}</{tag.split(' ')[0]}>"

    def menu(self) -> str:
        return self.inside(["nav", "div class='menu'", "div id='top-nav'", "ul", "div", "div role='navigation'"], self.links("li"))

    def header(self) -> str:
        return self.inside(["header", "div class='site-header'", "div id='masthead'"], [f"<p>{self.words(1, 90)}</p>"])

    def aside(self) -> str:
        """Adverts, notices, side columns, forms: all of them named by element or class."""
        named = ["div class='ad'", "div class='advert box'", "div class='cookie-notice'", "div id='consent'", "div role='alert'", "aside", "div class='sidebar'", "div class='promo'", "form", "div class='newsletter-signup'", "div class='related-posts'"]
        return self.inside(named, [self.text() for _ in range(self.r.randint(1, 3))] + (self.links("li") if self.r.random() < 0.3 else []))

    def comments(self) -> str:
        return self.inside(["div id='comments'", "section class='comments'", "div class='comment-list'"], [f"<h3>{self.words(1, 3)}</h3>", *(self.text() for _ in range(self.r.randint(1, 5)))])

    def footer(self) -> str:
        return self.inside(["footer", "div class='footer'", "div id='page-footer'"], [self.text()])

    def loose(self) -> str:
        """Dates, bylines and buttons that nothing names: short texts among links, told by their neighbours."""
        lines = [f"<div><a href='/x'>{self.words(1, 4)}</a></div>"]
        for _ in range(self.r.randint(1, 4)):
            lines += [f"<div>{self.words(1, 5)}</div>", f"<div><a href='/x'>{self.words(1, 4)}</a> {self.words(0, 1)}</div>"]
        return "".join(lines)

    def article(self) -> tuple[str, list[int]]:
        parts, labels = [f"<h1>{self.words(3, 14)}</h1>"], [1]

        def put(part: str, label: int = 1, n: int = 1) -> None:
            parts.append(part)
            labels.extend([label] * n)

        for _ in range(self.r.randint(1, 9)):
            kind = self.r.random()
            if kind < 0.56:
                put(f"<p>{self.words(12, 160)}</p>")
            elif kind < 0.62:
                put(f"<div>{self.words(1, 90)}</div>")
            elif kind < 0.72:
                put(f"<p>{self.words(1, 9)}</p>")
            elif kind < 0.8:
                put(f"<p>{self.words(8, 60)} <a href='/x'>{self.words(1, 6)}</a> {self.words(4, 30)}</p>")
            elif kind < 0.88:
                put(f"<h2>{self.words(2, 8)}</h2><p>{self.words(12, 90)}</p>", 1, 2)
            elif kind < 0.91:
                inset = self.r.choice([self.aside, self.comments, self.menu])()
                put(inset, 0, len(blocks(inset)))
            elif kind < 0.95:
                items = [f"<li>{self.words(2, 24)}</li>" for _ in range(self.r.randint(2, 6))]
                put(f"<ul>{''.join(items)}</ul>", 1, len(items))
            else:
                # A list of links to other stories.
                items = self.links("li", 2, 5, 9)
                put(f"<ul>{''.join(items)}</ul>", 0, len(items))
        tags = ["article", "main", "div class='content no-sidebar'", "div class='post has-comments'", "div class='main-col col-side text'", "div id='story'", "div", "section"]
        return self.inside(tags, parts), labels

    def page(self) -> tuple[str, list[int]]:
        """A page and the labels of its blocks."""
        before = [self.menu, self.header, self.aside, self.loose]
        after = [self.aside, self.comments, self.footer, self.menu, self.loose]
        first = [f() for f in self.r.sample(before, self.r.randint(0, 4))]
        last = [f() for f in self.r.sample(after, self.r.randint(0, 5))]
        body, labels = self.article()
        outside = lambda parts: [0] * len(blocks("".join(parts)))
        return f"<html><body>{''.join(first)}{body}{''.join(last)}</body></html>", outside(first) + labels + outside(last)


def labelled_table(seed: int, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of that many pages."""
    layouts, x, y = Layouts(seed), [], []
    for _ in range(pages):
        page, labels = layouts.page()
        x.append(features(blocks(page)))
        y.append(np.array(labels, float))
    return np.concatenate(x), np.concatenate(y)


def grow(x: np.ndarray, y: np.ndarray, least: int = 4, depth: int = 10):
    """A decision tree by Gini impurity: (feature, threshold, below, above), or the share of label 1."""
    n, ones = len(y), y.sum()
    whole = 2 * ones * (n - ones) / max(n, 1)
    if depth == 0 or n < 2 * least or whole == 0:
        return float(y.mean())
    best = None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, c = x[order, k], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (n - at >= least)]
        if not len(at):
            continue
        low, high = c[at - 1], ones - c[at - 1]
        loss = 2 * low * (at - low) / at + 2 * high * (n - at - high) / (n - at)
        i = int(np.argmin(loss))
        if best is None or loss[i] < best[0] - 1e-9:
            best = (float(loss[i]), k, float(v[at[i] - 1] + v[at[i]]) / 2)
    if best is None or best[0] >= whole - 1e-9:
        return float(y.mean())
    _, k, t = best
    low = x[:, k] <= t
    return k, t, grow(x[low], y[low], least, depth - 1), grow(x[~low], y[~low], least, depth - 1)


@lru_cache(maxsize=1)
def trained():
    """The tree of the labelled table: the blocks of 400 pages."""
    return grow(*labelled_table(11, 400))


def classify(tree, x: np.ndarray) -> np.ndarray:
    """True for rows that the tree takes for article text."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    k, t, below, above = tree
    out, low = np.zeros(len(x), bool), x[:, k] <= t
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


def main_text(page: str | None, tree=None) -> str:
    """The article of a page: its blocks in page order, joined by line ends."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = classify(tree or trained(), features(found))
    return "\n".join(text for (_, text), k in zip(found, keep, strict=True) if k)


def _rows(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index("html"))
            carried = batch.column(batch.schema.get_field_index("carried"))
            yield pa.record_batch([carried, pa.array([main_text(p.as_py(), tree) for p in pages], pa.string())], names=["carried", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(carried, text) for every row; carried is a struct of all columns but html.

    A null or empty page, or one without article text, has an empty text. Broken markup is read
    as far as it goes, in linear time. Repeated rows are extracted alike; an empty table gives an
    empty result. The tree, some hundred nodes, is grown on the driver and sent with the tasks.
    """
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c != "html"]
    flat = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried"), F.col("html").cast("string").alias("html"))
    return flat.mapInArrow(_rows(trained()), f"carried {flat.schema['carried'].dataType.simpleString()}, text string")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page.

    A null, empty or hopelessly broken page has an empty text; repeated rows, and rows without an id, are each returned; a column
    text of pages is ignored; an empty table gives no rows.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("carried.page_id", "carried.url", "text", F.length("text").cast("long").alias("n_chars"))


__all__ = ["Layouts", "blocks", "classify", "extract", "features", "grow", "labelled_table", "main_text", "op4_html_extraction", "trained"]
