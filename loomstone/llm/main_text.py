"""The main text of web pages: flat blocks, classified by a decision tree.

A page is read once, tag by tag, into flat blocks of text.  A block's row holds its
words and link density, those of the blocks before and after it, and where it stands:
inside an article or another element that names the main part, and inside elements
whose tag, role, class or id say menu, footer, advert and the like.  The tree is grown
by Gini impurity on the blocks of a small labelled table of pages (LABELLED) and
is applied to all blocks of a batch of pages as arrays.  A page is the unit: no block
leaves its task.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import common

# HTML's own element names, by what they mean for text.
RAW = frozenset("script style xmp iframe noembed noframes noscript template svg textarea title select object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav aside footer header form fieldset button dialog menu search head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar tablist toolbar".split())
#: Words of class and id names that say what a part of a page is for.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notification alert popup modal overlay sidebar sidenav widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer colophon copyright disclaimer legal login signin signup subscribe subscription newsletter share sharing social follow related recommended recommendations trending popular teaser teasers outbrain taboola tags taglist byline author-box skip print rating ratings search searchbox".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus discussion reply replies responses".split())
MAIN_WORDS = frozenset("article articlebody story storybody post postbody entry content maincontent hentry prose".split())
#: Elements that end when another of them, or the one around them, comes.
CLOSED_BY = {"p": BREAKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option", "optgroup"))}
_WITHIN = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "option": frozenset(("select",))}

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>?|<[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}

#: What is known of a block; the tree's splits name these columns.
FEATURES = ("main", "boiler", "comment", "heading", "item", "header", "words", "links", "words_before", "links_before", "words_after", "links_after")


class Part:
    """An open element: its tag, and what it and those around it say of the text inside."""

    __slots__ = ("boiler", "comment", "header", "item", "main", "tag")

    def __init__(self, tag: str, main: int, boiler: bool, comment: bool, item: bool, header: bool):
        self.tag, self.main, self.boiler, self.comment, self.item, self.header = tag, main, boiler, comment, item, header


_ROOT = Part("", 0, False, False, False, False)
#: How surely an element names the main part; only the surest kind on a page counts.
ARTICLE, MAIN, NAMED = 3, 2, 1


def _part(tag: str, attributes: str, outer: Part) -> Part:
    main, boiler, comment = outer.main, outer.boiler, outer.comment
    header = outer.header
    role, names, hidden = "", (), False
    if attributes and "=" in attributes or "hidden" in attributes:
        names = []
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "itemprop"):
                names += value.split()
            elif key == "role":
                role = value.strip().lower()
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value) is not None
    words = [[w.lower() for w in _NAME.findall(n)] for n in names]
    said = {w for ws in words if not {"has", "with", "no", "without"} & set(ws) for w in ws} | {"".join(ws) for ws in words}
    if tag == "article" or role == "article":
        main = max(main, ARTICLE)
    elif tag == "main" or role == "main":
        main = max(main, MAIN)
    elif tag not in ("html", "body") and any(ws and (ws[-1] in MAIN_WORDS or "".join(ws) in MAIN_WORDS) for ws in words):
        main = max(main, NAMED)
    comment = comment or bool(said & COMMENT_WORDS)
    if main and (tag == "header" or "header" in said):
        header = True  # of the article: its heading is text, the rest is about it
    elif tag not in ("html", "body", "main", "article") and tag not in HEADINGS:
        boiler = boiler or tag in BOILER_TAGS or role in BOILER_ROLES or bool(said & BOILER_WORDS)
    return Part(tag, main, boiler or hidden, comment, outer.item or tag in ("li", "td", "th", "dt", "dd"), header)


def blocks(page: str) -> Iterator[tuple[str, int, int, Part, bool]]:
    """(text, words, words in links, the element around it, whether it is a heading) of each block with text, in page order."""
    stack: list[Part] = [_ROOT]
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    in_link, heading, at, end = 0, 0, 0, len(page)

    def push(part: Part):
        stack.append(part)
        opened[part.tag] += 1

    def cut(k: int):
        opened.subtract(p.tag for p in stack[k:])
        del stack[k:]

    def flush():
        nonlocal text, linked
        said = " ".join(html.unescape("".join(text)).split()) if text else ""
        out = (said, said.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), stack[-1], heading > 0) if said else None
        text, linked = [], []
        return out

    def take(raw: str):
        if raw:
            text.append(raw)
            if in_link:
                linked.append(raw)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in RAW:
                if not m[2].endswith("/") or tag != "svg":
                    closing = _END_OF[tag].search(page, at)
                    at = closing.end() if closing else end
                if tag in BREAKS:
                    text.append(" ")
                continue
            if tag == "br" or tag == "img":
                text.append(" ")
                continue
            if tag == "a":
                in_link = 1
                continue
            if tag == "plaintext":
                take(html.escape(page[at:]))
                break
            if tag not in BREAKS:
                if tag not in VOID and ("hidden" in m[2] or "none" in m[2]) and _part(tag, m[2], _ROOT).boiler:
                    said = flush()
                    if said:
                        yield said
                    push(_part(tag, m[2], stack[-1]))
                continue
            said = flush()
            if said:
                yield said
            while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
                cut(len(stack) - 1)
            if tag in _WITHIN and any(opened[x] for x in CLOSED_BY if tag in CLOSED_BY[x]):  # an item that was left open inside other elements ends as well
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _WITHIN[tag] or stack[k].tag in ("article", "main", "body"):
                        break
                    if tag in CLOSED_BY.get(stack[k].tag, ()):
                        cut(k)
                        break
            if tag in HEADINGS:
                heading = 1
            if tag not in VOID:
                push(_part(tag, m[2], stack[-1]))
        elif m[3]:
            tag = m[3].lower()
            if tag == "a":
                in_link = 0
                continue
            known = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if opened[tag] else 0
            if tag in BREAKS or known:
                said = flush()
                if said:
                    yield said
            if known:
                cut(known)
            if tag in HEADINGS:
                heading = 0
    said = flush()
    if said:
        yield said


def rows_of(pages: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """(texts of each page's blocks, number of blocks of each page, one row of FEATURES for each block)."""
    texts, sizes, rows = [], [], []
    for page in pages:
        found = list(blocks(page))
        texts.append([x[0] for x in found])
        sizes.append(len(found))
        best = max((part.main for _, _, _, part, _ in found if not part.boiler and not part.comment), default=0)
        for _, words, linked, part, heading in found:
            # 1 in the surest main part, -1 outside it, 0 where the page names none
            rows.append((words, min(linked / words, 1.0), 1 if best and part.main >= best else -1 if best else 0, part.boiler, part.comment, heading, part.item, part.header))
    n = np.array(sizes, np.int64)
    own = np.array(rows, float).reshape(-1, 8)
    starts, place = common.segments(n)
    before, after = np.zeros((len(own), 2)), np.zeros((len(own), 2))
    inner = place > 0
    before[inner] = own[np.flatnonzero(inner) - 1, :2]
    inner = place < np.repeat(n, n) - 1
    after[inner] = own[np.flatnonzero(inner) + 1, :2]
    return texts, n, np.concatenate((own[:, 2:], own[:, :2], before, after), axis=1)


class Tree:
    """A binary decision tree by Gini impurity, as arrays: column and threshold of each node, its children, and the answer of its leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.column, self.threshold, self.left, self.right, self.answer = [], [], [], [], []
        self._grow(x, y, depth, least)
        self.column, self.threshold, self.left, self.right, self.answer = map(np.array, (self.column, self.threshold, self.left, self.right, self.answer))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.column)
        for part, value in zip((self.column, self.threshold, self.left, self.right, self.answer), (-1, 0.0, -1, -1, y.mean() >= 0.5), strict=True):
            part.append(value)
        best = self._split(x, y, least) if depth and 0 < y.sum() < len(y) else None
        if best:
            self.column[me], self.threshold[me] = best
            low = x[:, best[0]] <= best[1]
            self.left[me] = self._grow(x[low], y[low], depth - 1, least)
            self.right[me] = self._grow(x[~low], y[~low], depth - 1, least)
        return me

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, float] | None:
        """The column and threshold, half-way between two values, of least impurity; the first column where several are as good."""
        best, found, n = len(y) * y.mean() * (1 - y.mean()) - 1e-9, None, len(y)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, yes = x[order, j], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            at = at[(at >= least) & (n - at >= least)]
            if len(at):
                a, b = yes[at - 1], yes[-1] - yes[at - 1]
                cost = a * (1 - a / at) + b * (1 - b / (n - at))
                k = int(cost.argmin())
                if cost[k] < best - 1e-12:
                    best, found = cost[k], (j, float(v[at[k] - 1] + v[at[k]]) / 2)
        return found

    def classify(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.column[node] >= 0).any():
            at = np.flatnonzero(inner)
            low = x[at, self.column[node[at]]] <= self.threshold[node[at]]
            node[at] = np.where(low, self.left[node[at]], self.right[node[at]])
        return self.answer[node].astype(bool)


def _say(n: float, end: str = ".") -> str:
    return " ".join(["word"] * max(1, round(n))) + end


def _links(n: int, words: float = 1) -> str:
    return "".join(f'<li><a href="/{k}">{_say(words, "")}</a></li>' for k in range(n))


def _named(f: float) -> list[list[tuple[str, bool]]]:
    """Pages that name their main part, with texts of f times the usual length: there the names decide, not the lengths."""
    say = lambda n: _say(n * f)
    menu = (f"<nav><ul>{_links(5, f)}</ul></nav>", False)
    return [
        [menu, (f"<div class='ad'>{say(9)}</div>", False), (f"<article><h1>{say(8)}</h1><p>{say(60)}<p>{say(3)}<p>{say(25)}<ul><li>{say(4)}<li>{say(12)}</ul><p><a href=x>{say(4)}</a><p>{say(9)}", True), (f"</article><footer>{say(12)}</footer>", False)],
        [menu, (f"<div>{say(30)}</div><p>{say(3)}</p><h2>{say(5)}</h2><ul><li>{say(8)}</li></ul>", False), (f"<article><p>{say(60)}<p>{say(3)}<p><a href=x>{say(8)}</a> {say(2)}<h2>{say(1)}</h2><p>{say(50)}</article>", True)],
        [(f"<header><h1>{say(3)}</h1><p>{say(14)}</p></header><div>{say(15)}</div>", False), (f"<main><h2>{say(5)}</h2><p>{say(80)}</p><blockquote>{say(9)}</blockquote><p>{say(1)}</p><table><tr><td>{say(2)}<td><a href=v>{say(1)}</a></table>", True), (f"<aside><h3>{say(2)}</h3><p>{say(40)}</p><p><a href=z>{say(4)}</a></p></aside>", False), (f"<p>{say(30)}</p>", True), (f"</main><p>{say(6)}</p><h3>{say(2)}</h3><p>{say(40)}</p>", False)],
        # what stands inside the article and is not its text
        [("<article><header>", True), (f"<h1>{say(7)}</h1>", True), (f"<p>{say(5)}</p><p>{say(2)}</p>", False), (f"</header><p>{say(44)}</p>", True), (f"<div class='share-buttons'>{say(3)}<a href=x>{say(1)}</a></div><div class='ad-slot'><h4>{say(3)}</h4><p>{say(21)}</p></div>", False), (f"<p>{say(18)}</p><figure><figcaption>{say(7)}</figcaption></figure><p>{say(2)}</p>", True), (f"<form><p>{say(12)}</p><button>{say(1)}</button></form><div class='newsletter'><p>{say(33)}</p></div>", False), (f"<p>{say(30)}</p></article>", True), (f"<section class='related'><article><h2><a href=y>{say(6)}</a></h2><p>{say(20)}</p></article></section>", False)],
        # reader comments, which may be articles themselves
        [(f"<article><p>{say(50)}</p><h2>{say(3)}</h2><p>{say(50)}</p></article>", True), (f"<div id='comments'><h2>{say(2)}</h2><article><p>{say(40)}</p></article><article><p>{say(4)}</p></article><p>{say(70)}</p></div>", False)],
        [(f"<main><p>{say(20)}</p><p>{say(90)}</p>", True), (f"<section class='comment-list'><p>{say(35)}</p><p>{say(8)}</p><h3>{say(2)}</h3></section>", False), (f"<section class='comments'><li>{say(15)}</li><li><a href=u>{say(2)}</a></li></section></main>", False)],
        [(f"<div id='content'><h1>{say(5)}</h1><p>{say(47)}</p><p>{say(6)}</p><p><a href=q>{say(6)}</a></p>", True), (f"<div class='pagination'><a href=k>{say(1)}</a></div></div><p>{say(19)}</p>", False)],
    ]


#: Pages that name nothing: words and links, of a block and of those beside it, decide.
_UNNAMED: list[list[tuple[str, bool]]] = [
    [(f"<div><a href=a>{_say(2)}</a> <a href=b>{_say(1)}</a> <a href=c>{_say(3)}</a></div>", False), (f"<h1>{_say(6)}</h1><p>{_say(55)}</p><p>{_say(30)}</p><p>{_say(14)}</p><p>{_say(4)}</p><p>{_say(42)}</p>", True), (f"<div><a href=d>{_say(4)}</a></div><div><a href=d>{_say(2)}</a></div>", False)],
    [(f"<ul>{_links(8, 2)}</ul>", False), (f"<h2>{_say(4)}</h2><p>{_say(28)} <a href=e>{_say(3)}</a> {_say(20)}</p><p>{_say(12)}</p><p>{_say(70)}</p>", True), (f"<ul>{_links(4, 5)}</ul>", False)],
    [(f"<div class='cookie-notice'><p>{_say(30)}</p></div><div class='sidebar'><p>{_say(25)}</p><p>{_say(3)}</p></div>", False), (f"<p>{_say(65)}</p><p>{_say(11)}</p><p>{_say(38)}</p>", True), (f"<div class='footer'><p>{_say(22)}</p></div>", False)],
    [(f"<table><tr><td><a href=f>{_say(1)}</a><td><a href=g>{_say(1)}</a></table>", False), (f"<div>{_say(120)}</div><div>{_say(16)}</div><div>{_say(33)}</div>", True), (f"<div>{_say(2)} <a href=h>{_say(5)}</a></div><div>{_say(3)} <a href=h>{_say(9)}</a></div>", False)],
    [(f"<p>{_say(40)}</p><p>{_say(25)}</p>", True), (f"<div class='comments'><p>{_say(50)}</p><p>{_say(6)}</p></div>", False)],
    [(f"<p>{_say(120)}</p>", True)],
    [(f"<p>{_say(3)}</p>", True)],
    [(f"<h1>{_say(2)}</h1><p>{_say(9)}</p><p>{_say(1)}</p><p>{_say(5)}</p>", True)],
    [(f"<p>{_say(20)}</p><p>{_say(8)}</p>", True), (f"<ul>{_links(3, 1)}</ul>", False)],
]
#: The labelled table: pages as lists of (HTML, whether its blocks are main text).  Words do not matter, only their number.
LABELLED: list[list[tuple[str, bool]]] = [*_named(0.1), *_named(1), *_named(4), *_UNNAMED]


@lru_cache(maxsize=1)
def tree() -> Tree:
    """The tree grown on the labelled table."""
    x, y = [], []
    for page in LABELLED:
        marked = "".join(f"<wbr>{part.replace('word', 'yes' if keep else 'no')}" for part, keep in page)
        texts, _, rows = rows_of([marked])
        x.append(rows)
        y += ["yes" in t for t in texts[0]]
    return Tree(np.concatenate(x), np.array(y, float))


def main_texts(pages: list[str]) -> list[str]:
    texts, sizes, rows = rows_of(pages)
    keep = tree().classify(rows).tolist() if len(rows) else []
    out, at = [], 0
    for page, n in zip(texts, sizes.tolist(), strict=True):
        out.append(" ".join(t for t, k in zip(page, keep[at : at + n], strict=True) if k))
        at += n
    return out


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages.

    A null or empty page, or one without main text, has the empty text.  Repeated rows
    get a row each; null ids and urls are passed on; an empty table gives no rows.  A
    page is read whole, whatever its length; markup that is left open or does not
    nest ends where the next fitting tag or the page ends.  Other columns are not read.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def make(batch: pa.RecordBatch):
        for at, end, _, _ in common.chunks(batch.column(2)):
            texts = main_texts([t or "" for t in batch.column(2)[at:end].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], batch.column(1)[at:end], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["k", "u", "text", "n_chars"])

    rows = pages.select(pages[key].alias("k"), pages[url].alias("u"), pages[text].alias("h"))
    return common.per_batch(rows, make, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long").withColumnsRenamed({"k": key, "u": url})


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))
