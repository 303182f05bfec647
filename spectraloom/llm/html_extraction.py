"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of tags and words. Words score positive and tags negative; what lies below an element that labelled pages show to be
surroundings (menus, notices, adverts, comments ...) has no positive words, unless only class words say so and the page's main part is below it. The weights are log-odds counted on the labelled pages: words inside and outside the main
text per element name and per word of class, id or role, and tags inside and outside per name. One linear scan finds the contiguous run with the best sum; what
lies below surrounding elements inside it is left out.

Defined results. Null or empty html, and pages without a positive run, give the empty text. Scripts, styles, comments and markup never give text. An element left open
ends with its parent; a paragraph or list item also ends where the next begins. Time grows with the length of a page, whatever its markup: tags that never end, unclosed quotes and deep nesting included. Character references are decoded once, unknown ones stay as they are; white space inside a block
becomes one space; blocks are joined by two line feeds. Ties go to the earliest, longest run. Repeated rows give the same text; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li "
    "main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

RAW = re.compile(r"<(script|style|template|noscript|svg|iframe|object|audio|video|canvas|math)\b", re.I)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style template noscript svg iframe object audio video canvas math".split()}
TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: First words of class words that tell a state of the layout, not what the element is.
STATE = frozenset("no not has with without overflow".split())
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")

#: Labelled pages are built from these: elements that hold main text, and elements around it.
MAIN_ELEMENTS = [
    ("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("div", "article body"), ("section", "story"), ("div", "entry content"), ("div", "text"),
    ("article", "post entry"), ("div", "main article"),
]
SURROUNDINGS = [
    ("nav", ""), ("ul", "menu"), ("div", "nav"), ("div", "menu"), ("div", "navbar"), ("div", "navigation"), ("ol", "breadcrumb"), ("div", "breadcrumbs"), ("div", "toolbar"), ("div", "pagination"), ("div", "pager"),
    ("header", ""), ("div", "header"), ("div", "masthead"), ("div", "topbar"), ("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "legal"),
    ("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "recommended"), ("div", "trending"), ("ul", "tags"),
    ("div", "notice"), ("div", "cookie"), ("div", "consent"), ("div", "banner"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("div", "overlay"), ("div", "paywall"),
    ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "sponsor"), ("div", "promo"), ("ins", "adsbygoogle"),
    ("form", ""), ("div", "search"), ("div", "newsletter"), ("div", "subscribe"), ("div", "signup"), ("div", "login"), ("select", ""), ("button", ""), ("label", ""), ("fieldset", ""), ("textarea", ""),
    ("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "commentlist"), ("div", "disqus"), ("div", "replies"), ("div", "reply"), ("div", "respond"), ("div", "discussion"),
    ("div", "share"), ("div", "sharing"), ("div", "social"), ("dialog", ""), ("menu", ""), ("div", "hidden"),
    ("div", "responses"), ("div", "feedback"), ("div", "gdpr"),
]


def labelled_pages() -> list[str]:
    """Pages with the main text between ``<!--main-->`` and ``<!--/main-->``; inside it, ``<!--out-->`` marks what does not belong."""
    pages = []
    words = lambda n: " ".join(["word"] * n)
    for k, (name, classes) in enumerate(SURROUNDINGS):
        main, main_class = MAIN_ELEMENTS[k % len(MAIN_ELEMENTS)]
        attr = lambda c: f' class="{c}"' if c else ""
        around = f"<{name}{attr(classes)}><ul><li><a href='#'>{words(3)}</a></li><li><a>{words(2)}</a></li></ul><p>{words(12)}</p><div>{words(8)}</div></{name}>"
        head = f"<header><h1>{words(6)}</h1></header>" if k % 3 == 0 and main == "article" else f"<h1>{words(6)}</h1>"
        body = f"{head}<p>{words(30)} <a>{words(3)}</a> <b>{words(2)}</b><br>{words(4)}</p><h2>{words(4)}</h2><div><p>{words(25)}</p></div><ul><li>{words(5)}</li><li>{words(5)}</li></ul>"
        body += f"<blockquote>{words(9)}</blockquote><table><tr><td>{words(2)}</td></tr></table><pre>{words(6)}</pre><section><p>{words(14)}</p></section><span>{words(2)}</span>"
        inside = f"<!--out-->{around}<!--/out-->" + (f"<!--out--><footer>{words(8)}</footer><!--/out-->" if main == "article" else "")
        marked = f"<!--main--><{main}{attr(main_class)}>{body}{inside if k % 3 != 1 else ''}<p>{words(20)}</p></{main}><!--/main-->"
        pages.append(f"<html><head><title>{words(6)}</title></head><body>{around}<div>{words(1)}{marked}</div>{around}</body></html>")
    return pages


def _features(name: str, rest: str, inside: bool) -> list[str]:
    """Names an element is known by: its own (apart inside an article) and the words of its class, id and role."""
    place = "in " if inside else ""
    out = [place + name if name in ("header", "footer") else name]
    for m in ATTRIBUTE.finditer(rest):
        attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attribute in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in PART.findall(word)]
                if len(parts) > 1:
                    parts = [] if parts[0] in STATE else [p for p in parts if p != "hidden"]
                out += [f"{place}.{p}" if p == "header" else f".{p}" for p in parts]
        elif (attribute == "hidden" and value.lower() != "false") or (attribute == "aria-hidden" and value.lower() == "true") or (attribute == "style" and NOT_SHOWN.search(value)):
            out.append(HIDDEN)
    return out


HIDDEN = ".hidden mark"


class Element:
    """An open element, the one it stands in, and what is counted below it."""

    __slots__ = ("name", "features", "parent", "main", "block", "words", "heads", "firm", "outside", "listed")

    def __init__(self, name: str, features: tuple, parent: Element | None):
        self.name, self.features, self.parent = name, features, parent
        self.main = name in ("article", "main") or (parent is not None and parent.main)
        self.block = self if name in BLOCK else parent and parent.block
        self.words, self.heads, self.firm, self.outside, self.listed = 0, 0, False, False, False

    def chain(self) -> list[Element]:
        """The element and all it stands in, outermost last."""
        out, e = [], self
        while e is not None:
            out.append(e)
            e = e.parent
        return out


def _markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, rest of the tag) of each piece of the page, in time in proportion to its length.

    A tag ends at the first ``>`` outside quotes. A page with a tag whose quotes or brackets never close has its quotes ignored from there
    on, so no stretch is searched twice; without any ``>`` after it, ``<`` is text.
    """
    at, last, ragged = 0, page.rfind(">"), False
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            yield "text", page[at:end], ""
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield "note", page[at + 4 : end if end >= 0 else len(page)], ""
            at = end + 3 if end >= 0 else len(page)
            continue
        if at < last:
            if raw := RAW.match(page, at):
                closing = RAW_END[raw[1].lower()].search(page, page.find(">", at) + 1)
                at = closing.end() if closing else len(page)
                continue
            if tag := TAG.match(page, at):
                rest = None if ragged else REST.match(page, tag.end())
                ragged = rest is None
                end = rest.end() if rest else page.find(">", at) + 1
                yield "close" if tag["close"] else "open", tag["name"].lower(), page[tag.end() : end - 1]
                at = end
                continue
            if page[at + 1] in "!?/" and at + 1 < last:
                at = page.find(">", at + 2) + 1
                continue
        yield "text", "<", ""
        at += 1


def tokens(page: str) -> Iterator[tuple[str, str, Element | None]]:
    """(kind, value, innermost open element) of each token."""
    stack: list[Element] = []
    names: Counter[str] = Counter()  # of the open elements
    known: dict[tuple, tuple] = {}

    def end(at: int) -> None:
        names.subtract(e.name for e in stack[at:])
        del stack[at:]

    for kind, value, rest in _markup(page):
        if kind == "close" and names[value]:
            at = len(stack) - 1
            while stack[at].name != value:
                at -= 1
            end(at)
        elif kind == "open":
            top = stack[-1] if stack else None
            if value in BLOCK and top and (block := top.block) and _ends(block.name, value):
                at = len(stack) - 1
                while stack[at] is not block:
                    at -= 1
                end(at)
                top = stack[-1] if stack else None
            key = (value, rest, top is not None and top.main)
            if key not in known:
                known[key] = tuple(_features(*key))
            if value not in VOID and not rest.endswith("/"):
                stack.append(Element(value, known[key], top))
                names[value] += 1
        yield kind, value, stack[-1] if stack else None


def _ends(open_name: str, name: str) -> bool:
    """A new block ends an open paragraph, a new list item or cell an open one."""
    return open_name == "p" or (open_name == name and name in ("li", "dt", "dd", "td", "th", "tr", "option"))


@dataclass
class Weights:
    """Log-odds: of an element's features for words below it, and of tag names for standing inside the main text."""

    element: dict[str, float]
    tag: dict[str, float]
    word: float

    def surrounds(self, features: tuple) -> bool:
        weights = [self.element.get(f, 0.0) for f in features]
        return sum(weights) < -1.0 or any(w < -1.0 for f, w in zip(features, weights) if f != ".header")  # an article's header is its own

    def tag_cost(self, name: str) -> float:
        return self.tag.get(name, 0.0)  # tags of no labelled page tell nothing


def fit(pages: list[str]) -> Weights:
    """Count the labelled pages."""
    words: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
    tags: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
    total = [0.5, 0.5]
    for page in pages:
        main, out = False, 0
        for kind, value, around in tokens(page):
            if kind == "note":
                main = {"main": True, "/main": False}.get(value, main)
                out += {"out": 1, "/out": -1}.get(value, 0)
                continue
            label = int(main and not out)
            if kind == "text":
                n = len(value.split())
                total[label] += n
                for f in {f for e in (around.chain() if around else ()) for f in e.features}:
                    words[f][label] += n
            else:
                tags[value][label] += 1
    clip = lambda x: max(-3.0, min(3.0, x))
    element = {f: clip(math.log(a / b)) for f, (b, a) in words.items()}
    # structure that stands on both sides says nothing about the words below it
    element |= {f: 0.0 for f in ("html", "body", "div", "ul", "ol", "li", "a", "p", "section")}
    tag = {name: min(1.0, max(0.02, 0.1 * math.log1p(b / a))) for name, (b, a) in tags.items()}
    return Weights(element, tag, max(0.5, clip(math.log(total[1] / total[0]))))


def _judge(read: list[tuple[str, str, Element | None]], weights: Weights) -> None:
    """Mark what surrounds the main text: by mark or element name always, by class words only where the page's main part is not below.

    The main part is the longest main element, an article with half of its words (of the page's third, without a main), or
    what holds most of the page's words and every main element and first heading.
    """
    elements: list[Element] = []  # each after the one it stands in
    total = heads = 0
    for kind, value, e in read:
        if kind == "text":
            n = len(value.split())
            total += n
            if e:
                e.words += n
        elif kind == "open" and e and not e.listed:
            e.listed = True
            elements.append(e)
            e.firm = HIDDEN in e.features or weights.surrounds(e.features[:1]) or (e.parent is not None and e.parent.firm)
            if value in ("h1", "main"):
                heads += 1
                e.heads += 1
    for e in reversed(elements):
        if e.parent:
            e.parent.words += e.words
            e.parent.heads += e.heads
    longest = lambda name: max((e for e in elements if e.name == name and not e.firm), key=lambda e: e.words, default=None)
    main, article = longest("main"), longest("article")
    holders = set(main.chain()) if main else set()
    if article:
        above = article.chain()[1:]
        if main in above and 2 * article.words >= main.words if main else 3 * article.words >= total:
            holders.update(above)
    for e in elements:
        most = 2 * e.words > total and e.heads == heads
        spared = e.name in ("html", "body") or e in holders or most
        e.outside = e.firm or (weights.surrounds(e.features) and not spared) or (e.parent is not None and e.parent.outside)


def best_run(scores: list) -> tuple[int, int]:
    """First and past-last block of the run with the best sum of scores less the costs between its blocks; (0, 0) if none is positive."""
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, (score, before) in enumerate(scores):
        if run - before <= 0:
            run, begin = score, i
        else:
            run += score - before
        if run > best:
            best, span = run, (begin, i + 1)
    return span


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    blocks: list[list] = []  # [text parts, below surroundings, cost of the tags before]
    cost, fresh, was = 0.0, True, None
    read = list(tokens(page))
    _judge(read, weights)
    for kind, value, around in read:
        if kind == "text":
            outside = around is not None and around.outside
            if fresh or outside != was:
                blocks.append([[value], outside, cost])
                cost, fresh, was = 0.0, False, outside
            else:
                blocks[-1][0].append(value)
        elif kind != "note":
            cost += 0.0 if around is not None and around.outside else weights.tag_cost(value)
            if value in BLOCK:
                fresh = True
            elif value == "br" and blocks and not fresh:
                blocks[-1][0].append(" ")
    kept, scores = [], []
    for parts, outside, before in blocks:
        text = " ".join(references.unescape("".join(parts)).split())
        if not text:
            if scores:
                scores[-1][1] += before
            continue
        n = text.count(" ") + 1
        kept.append((text, outside))
        scores.append([0.0 if outside else n * weights.word, before])
    first, end = best_run(scores)
    return "\n\n".join(text for text, outside in kept[first:end] if not outside)


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: extract(page, weights), na_action=None)

    found = pages.select(F.col(id_col), F.col(url_col), run(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
