"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of block tags (inline tags such as
``b`` or ``a`` don't count, unclosed ``p`` and ``li`` end where the next one begins). Per path the page's
blocks are aggregated: text length outside links per block (the text-to-path ratio), and
punctuation marks. The ratios are written to the sequence of blocks, smoothed over neighbours with
Gaussian weights, multiplied (the fused ratio: long, punctuated text in a frequent path is high, menus
and notices are low) and compared with a threshold from the page's own spread. The nearest ``article``
or ``main`` around the selected blocks, or else their common ancestor, is the content node; its
blocks make the text, so that headings and short paragraphs between selected ones stay.

Never content, whatever their ratio: head, scripts, styles, comments in the markup, navigation, headers and footers of
the page, asides, forms, and hidden nodes (an attribute of their own or a style says so). Nodes whose class, id or role is a word for an advert, a
menu, a notice, a sidebar or reader comments aren't content either, but the ratios overrule names: such a node that holds most of the
page's selected text keeps it. Of several articles side by side all that hold selected text are kept.

A tag ends at its ``>``, or before the next ``<`` if it has none outside quotes, and nodes deeper than ``DEEPEST`` count as their ancestor there, so the
time is linear in the page's length whatever the markup.

Null html reads as empty; a page without content gives the empty text. Each row is a page of its own, so repeated rows repeat
their result. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import column

_TOKEN = re.compile(
    r"<(?:(?P<open>!--|!\[CDATA\[)|[!?][^<>]*>?"
    r"|(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>?)")
_ENDINGS = {"!--": "-->", "![CDATA[": "]]>"}
_SPACE = re.compile(r"\s+")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I)
_HIDING = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none)|\baria-hidden\s*=\s*[\"']?true|(?:^|\s)hidden\s*=\s*(?:\"(?:hidden)?\"|'(?:hidden)?'|hidden\b)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Names of inline tags, of tags without content, and of parts that are never content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title nav footer aside form button select option menu dialog noscript object applet".split())
RAW = frozenset("script style noscript template textarea svg iframe".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|newsletter|subscribe|popup|modal|nav\w*|menu\w*|breadcrumbs?"
    r"|sidebar|side|related|recommend\w*|share|sharing|social|comments?|disqus|replies|respond|footer|masthead|pagination|pager|toolbar|widget|login|signup|search)(?:$|[\s_-])", re.I)
#: Nodes nested deeper than this count as their ancestor at this depth.
DEEPEST = 200
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIST = frozenset("ul ol dl table tbody thead section article div main body html blockquote".split())
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def blocks(html: str) -> list[tuple[tuple, str, int, tuple]]:
    """(path, text, characters inside links, named) of every block outside the parts that are never content. A path element is
    (tag, number), so that nodes of one tag can be told apart; ``named`` holds the numbers of the path's nodes whose names say that they are no content."""
    out: list[tuple[tuple, str, int, tuple]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number, never content, named as no content
    paths: dict[str, tuple] = {}  # of the open nodes, once asked for
    parts: list[str] = []
    linked = links = number = never_open = deeper = 0
    lower = ""

    def flush() -> None:
        nonlocal parts, linked
        if never_open:
            parts, linked = [], 0
            return
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            if "now" not in paths:
                paths["now"] = (tuple(x[:2] for x in stack), tuple(x[1] for x in stack if x[3]))
            out.append((paths["now"][0], text, linked, paths["now"][1]))
        parts, linked = [], 0

    def leave(i: int) -> None:
        nonlocal never_open
        never_open -= sum(x[2] for x in stack[i:])
        del stack[i:]
        paths.clear()

    at = 0
    while (m := _TOKEN.search(html, at)) is not None:
        if m.start() > at:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if m["open"]:
            end = html.find(_ENDINGS[m["open"]], at)
            at = len(html) if end < 0 else end + 3
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        attrs = m["attrs"] or ""
        closed = attrs.rstrip().endswith("/")
        if tag in RAW and not m["close"]:
            if not (closed and tag == "svg"):
                lower = lower or html.lower()
                if len(lower) != len(html):  # lower case of some letters is longer
                    lower = "".join(c.lower() if c.isascii() else c for c in html)
                end = lower.find(f"</{tag}", at)
                end = html.find(">", end) if end >= 0 else -1
                at = len(html) if end < 0 else end + 1
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag == "a":
            links = 0 if m["close"] else 1
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if m["close"]:
            if deeper:
                deeper -= 1
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    leave(i)
                    break
            continue
        if tag in _P_ENDERS and stack and stack[-1][0] == "p":
            leave(len(stack) - 1)
        ends = _ENDS.get(tag)
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    leave(i)
                    break
                if stack[i][0] in _LIST:
                    break
        if closed:
            continue
        if len(stack) >= DEEPEST:
            deeper += tag not in _ENDS  # those end without a tag of their own
            continue
        named = " ".join(x for a in _ATTR.findall(attrs) for x in a if x) if attrs else ""
        header = tag == "header" and not any(x[0] in ("article", "main") for x in stack)
        hidden = bool(attrs) and bool(_HIDDEN.search(_VALUE.sub("=", attrs)) or _HIDING.search(attrs))
        never = tag in NEVER or header or hidden
        number += 1
        stack.append((tag, number, never, bool(named and tag not in ("html", "body") and BOILERPLATE.search(named))))
        never_open += never
        paths.clear()
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def path_ratios(found: list[tuple]) -> np.ndarray:
    """The fused, smoothed ratio of each block."""
    paths = ["/".join(x[0] for x in path) for path, *_ in found]
    index = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([index[p] for p in paths])
    length = np.array([max(0, len(t) - k) for _, t, k, *_ in found], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t, *_ in found], float)
    number = np.bincount(of).astype(float)
    ratio = (np.bincount(of, length) / number)[of]
    points = ((1 + np.bincount(of, marks)) / number)[of]

    def smooth(x: np.ndarray) -> np.ndarray:
        kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
        weight = np.convolve(np.ones(len(x)), kernel, "full")[2 : len(x) + 2]
        return np.convolve(x, kernel, "full")[2 : len(x) + 2] / weight

    return smooth(ratio) * np.log1p(smooth(points)) * np.minimum(1, length / np.maximum(1, [len(t) for _, t, *_ in found]) + 0.01)


def _selected(found: list[tuple], spread: float) -> list[int]:
    fused = path_ratios(found)
    return np.flatnonzero(fused >= spread * fused.std()).tolist() or [int(fused.argmax())]


def main_text(html: str | None, spread: float = 0.3) -> str:
    """The page's main text: blocks of the content node in page order, joined by one space."""
    found = blocks(html or "")
    if not found:
        return ""
    # names count, unless the node holds most of what the ratios select
    weight: dict[int, int] = {}
    total = 0
    for i in _selected(found, spread):
        total += len(found[i][1])
        for node in found[i][3]:
            weight[node] = weight.get(node, 0) + len(found[i][1])
    keeps = {node for node, w in weight.items() if 2 * w > total}
    found = [x for x in found if keeps.issuperset(x[3])]
    if not found:
        return ""
    chosen = _selected(found, spread)
    inside = [i for i in chosen if any(tag in ("article", "main") for tag, _ in found[i][0])]
    if inside:
        nodes = {next(x for x in found[i][0] if x[0] in ("article", "main")) for i in inside}
        keep = [t for path, t, *_ in found if not nodes.isdisjoint(path)]
    else:
        common = found[chosen[0]][0]
        for i in chosen[1:]:
            path = found[i][0]
            k = 0
            while k < min(len(common), len(path)) and common[k] == path[k]:
                k += 1
            common = common[:k]
        first, last = chosen[0], chosen[-1]
        picked = set(chosen)
        heading = re.compile(r"h[1-6]")
        keep = [t for i, (path, t, *_) in enumerate(found)
                if path[: len(common)] == common and (i in picked or first <= i <= last or (path and heading.fullmatch(path[-1][0])))]
    return " ".join(keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            text = [main_text(x) for x in column(part, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(part, "page_id"), column(part, "url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and its length in code points."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
