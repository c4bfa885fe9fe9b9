"""Main text of HTML pages by tag-path ratios.

Each page is tokenised once into text nodes, each with its root-to-leaf tag path (inline elements
left out, a mark at elements whose tag, role or class tells of menus, headers, footers, asides, forms,
adverts, notices, comments and such; inside an article not by class words that its own parts bear as
well, such as header or notice). Text length, punctuation and link text are aggregated per path; the
ratios are smoothed along the page and fused with two more features of the path, its marks and its
place in an article, to one score. Neither feature is a veto: dense text under a mark can come in, thin
text without one can stay out. Paths over a threshold are content: their nodes, and no others, are
the result. They are chosen twice: the smallest element that holds nearly all text of the first choice
leads to the main node (the outermost article, or else main, element around it, or without one the
element reached by climbing while that adds content), and lying outside it is the last feature of the
second choice. Character references are decoded once, white space inside a block is one space, blocks
are joined by one space.

Defined results: null and empty pages, and pages without text, give an empty string; broken markup
is read as far as it goes (an unclosed tag ends with its parent, an unfinished tag at the end is
dropped); equal pages give equal text; an empty table gives an empty table; extra columns are not
read. Whole pages are read: nothing is cut.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A path is content from this share of the page's mean score on (weighted by score and text length).
THRESHOLD = 0.15
#: Factors of the fused score: in an article, or under an element that looks like boilerplate, outside
#: the main node, for a path of links alone.
IN_ARTICLE, MARKED, OUTSIDE, LINKED = 6.0, 0.2, 0.4, 0.1
#: No path is content under this score: a page of menus alone has no content.
LEAST = 0.5
#: The smallest element with this share of the content text is where the main node is sought from.
HOLDS = 0.85

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math canvas object".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that end an open element of the second set.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
SCOPE = frozenset("html body article main section div aside nav footer header table td th ul ol dl form blockquote".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button select menu dialog head noscript label input".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended comment comments disqus respond reply pagination pager widget toolbar tags meta skip hidden copyright legal disclaimer".split()
)
#: Of these the words that name real parts of an article as well.
ARTICLE_WORDS = frozenset("header masthead banner notice alert legal disclaimer copyright meta tags promotion".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Stands in a path behind a tag that looks like boilerplate.
MARK = "!"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…¿¡]")


class Path:
    """A tag path: one object for all nodes of equal tags and marks. Its length is not copied from level to level."""

    __slots__ = ("inside", "label", "marked", "parent", "known")

    def __init__(self, parent: Path | None, label: str):
        self.parent, self.label = parent, label
        self.marked = label.endswith(MARK) or parent is not None and parent.marked
        self.inside = label.rstrip(MARK) in CONTENT_TAGS or parent is not None and parent.inside
        self.known: dict[str, Path] = {}

    def child(self, label: str) -> Path:
        found = self.known.get(label)
        if found is None:
            found = self.known[label] = Path(self, label)
        return found

    def __str__(self) -> str:
        labels, path = [], self
        while path.parent is not None:
            labels.append(path.label)
            path = path.parent
        return "".join(f"/{x}" for x in reversed(labels))


@dataclass(eq=False)
class Element:
    """An open tag: its number, parent, depth, path, whether it is in a link or an article, and where on the
    stack the nearest element is that bounds the search for tags to close."""

    number: int
    parent: Element | None
    depth: int
    tag: str
    path: Path
    link: bool
    inside: bool
    scope: int


@dataclass
class Node:
    """A piece of text, its block, and the element that it stands in."""

    text: str
    block: int
    element: Element

    @property
    def path(self) -> Path:
        return self.element.path

    @property
    def link(self) -> bool:
        return self.element.link


def _looks_like_boilerplate(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_content:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in BOILERPLATE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and tag not in ("h1", "h2", "h3", "p", "b", "i", "em", "strong"):
            if any(w in BOILERPLATE_WORDS and not (in_content and w in ARTICLE_WORDS) for w in re.split(r"[\s_-]+", value)):
                return True
    return False


def text_nodes(page: str) -> list[Node]:
    """Text nodes of a page in order, by one pass over its tokens; time and memory are linear in the page, at any nesting."""
    out: list[Node] = []
    stack = [Element(0, None, 0, "", Path(None, ""), False, False, 0)]
    places: dict[str, list[int]] = {}  # where on the stack each tag is open
    made, block, at, size = 0, 0, 0, len(page)

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            out.append(Node(html.unescape(raw), block, stack[-1]))
        elif raw and out and out[-1].block == block:
            out[-1].text += " "

    def unwind(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    lowered = None
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        token = _TOKEN.match(page, begin)
        if token is None:  # a sign, not a tag
            following = page.find("<", begin + 1)
            following = size if following < 0 else following
            text(page[at:following])
            at = following
            continue
        text(page[at:begin])
        at = token.end()
        if token[1] is not None:
            text(token[1].replace("&", "&amp;"))
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            block += 1
        if token[2]:
            if places.get(tag):
                unwind(places[tag][-1])
            continue
        if tag in CLOSES:
            last = max((places[t][-1] for t in CLOSES[tag] if places.get(t)), default=0)
            if last and last >= stack[-1].scope:
                unwind(last)
        if tag in VOID:
            continue
        if tag in RAW:
            if not token[0].endswith("/>"):
                lowered = page.lower() if lowered is None else lowered
                end = lowered.find(f"</{tag}", at) if len(lowered) == size else -1
                if end < 0:
                    found = re.compile(f"</{tag}", re.I).search(page, at)
                    end = found.start() if found else size
                close = page.find(">", end)
                at = size if close < 0 else close + 1
            continue
        if token[0].endswith("/>") and tag not in BLOCK and tag not in ("a", "span"):
            continue
        made += 1
        top = stack[-1]
        mark = MARK if _looks_like_boilerplate(tag, token[4], top.inside) else ""
        path = top.path.child(tag + mark) if mark or tag not in INLINE else top.path
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(made, top, top.depth + 1, tag, path, top.link or tag == "a", top.inside or tag in CONTENT_TAGS, len(stack) if tag in SCOPE else top.scope))
    return out


def path_ratios(nodes: list[Node]) -> dict[Path, float]:
    """Fused ratios of each tag path: the geometric mean of text length and punctuation a node (as logarithms), less what is link text."""
    held: dict[Path, list[float]] = {}
    for n in nodes:
        h = held.setdefault(n.path, [0.0, 0.0, 0.0, 0.0])
        size = len(n.text)
        h[0] += 1
        h[1] += size
        h[2] += len(_PUNCTUATION.findall(n.text))
        h[3] += size * n.link
    return {p: math.sqrt(math.log1p(size / count) * math.log1p(1 + signs / count) * (1 - (1 - LINKED) * linked / size)) for p, (count, size, signs, linked) in held.items()}


def path_scores(nodes: list[Node]) -> dict[Path, float]:
    """The score of each path: its ratio smoothed along the page (a node's neighbours speak for it,
    the path takes the best of its nodes), times its factors."""
    ratios = path_ratios(nodes)
    raw = [ratios[n.path] for n in nodes]
    smooth: dict[Path, float] = {}
    for i, n in enumerate(nodes):
        near = raw[max(0, i - 1) : i + 2]
        smooth[n.path] = max(0.6 * raw[i] + 0.4 * sum(near) / len(near), smooth.get(n.path, 0.0))
    return {p: s * (MARKED if p.marked else IN_ARTICLE if p.inside else 1.0) for p, s in smooth.items()}


def _sums(nodes: list[Node], value) -> tuple[list[Element], dict[int, int]]:
    """Elements that hold the nodes, parents first, and for each the sum of the nodes' values."""
    elements: dict[int, Element] = {}
    total: dict[int, int] = {}
    for n in nodes:
        e = n.element
        total[e.number] = total.get(e.number, 0) + value(n)
        while e is not None and e.number not in elements:
            elements[e.number] = e
            e = e.parent
    ordered = [elements[k] for k in sorted(elements)]  # an element's number is greater than its parent's
    for e in reversed(ordered):
        if e.parent is not None:
            total[e.parent.number] = total.get(e.parent.number, 0) + total.get(e.number, 0)
    return ordered, total


def main_node(nodes: list[Node], content: list[Node]) -> Element | None:
    """The element that holds the article."""
    if not content:
        return None
    elements, weight = _sums(content, lambda n: len(n.text))
    _, n_content = _sums(content, lambda n: 1)
    wanted = HOLDS * sum(len(n.text) for n in content)
    top = max((e for e in elements if weight[e.number] >= wanted), key=lambda e: (e.depth, -e.number))
    # A paragraph or an inline element is no main node: its parent is.
    while top.parent is not None and top.tag not in ("article", "main", "section", "div", "body", "html", "td", "center", "blockquote"):
        top = top.parent
    around: dict[str, Element] = {}  # the outermost ones
    e: Element | None = top
    while e is not None:
        if e.tag in CONTENT_TAGS:
            around[e.tag] = e
        e = e.parent
    if around:
        return around.get("article") or around["main"]
    _, n_all = _sums([m for m in nodes if not m.path.marked], lambda m: 1)
    e = top.parent
    while e is not None:
        if n_content[e.number] > n_content[top.number]:
            top = e
        elif n_all.get(e.number, 0) > n_all.get(top.number, 0):
            break
        e = e.parent
    return top


def _within(nodes: list[Node], top: Element | None) -> list[bool]:
    """Whether each node lies in the element."""
    known: dict[int, bool] = {}
    out = []
    for n in nodes:
        e, path = n.element, []
        while e is not None and e.number not in known and e is not top:
            path.append(e.number)
            e = e.parent
        inside = e is not None and (e is top or known[e.number])
        known.update(dict.fromkeys(path, inside))
        out.append(inside)
    return out


def content_nodes(nodes: list[Node]) -> list[Node]:
    """The nodes whose paths reach the threshold."""
    if not nodes:
        return []
    scores = path_scores(nodes)
    weight = [scores[n.path] * len(n.text) for n in nodes]
    least = max(LEAST, THRESHOLD * sum(scores[n.path] * w for n, w in zip(nodes, weight, strict=True)) / sum(weight))
    inside = _within(nodes, main_node(nodes, [n for n in nodes if scores[n.path] >= least]))
    return [n for n, own in zip(nodes, inside, strict=True) if scores[n.path] * (1.0 if own else OUTSIDE) >= least]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    blocks: dict[int, list[str]] = {}
    for n in content_nodes(text_nodes(page or "")):
        blocks.setdefault(n.block, []).append(n.text)
    parts = [_SPACE.sub(" ", "".join(b)).strip() for b in blocks.values()]
    return " ".join(p for p in parts if p)


def extracted(html_col: Column) -> Column:
    """Struct of text and n_chars for each page."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            found = [main_text(p) for p in pages]
            yield pd.DataFrame({"text": found, "n_chars": [len(t) for t in found]})

    return extract(html_col)
