"""Main text of web pages by tag-path ratios.

A page is cut into text blocks.  Every block has a tag path, the names of the
block elements from the root to it.  Over all blocks of a path the text length,
the punctuation marks and the length of link texts are added up; the ratio of
unlinked text to the number of its blocks and that of punctuation to blocks are
smoothed along the page with a Gaussian, multiplied, and paths at or above a
share of their standard deviation are content.  Blocks in elements that by
their name, class, id or role are menus, headers, footers, sidebars, notices,
adverts, forms or comments are never content.  The content elements' closest
common ancestor then gives the article: all its other blocks (headings, short
paragraphs, list items) belong to it, except link lists.

Defined results: null or empty html, and html without text, gives an empty
text; tags that never close end with their parent, a script or style without an end
tag with the page; ``/>`` ends no script; a quote that never closes holds no value; unknown character references
stay as they are; rows are treated one by one, whatever their other columns.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SIGMA, SHARE = 1.0, 0.5

#: Elements whose content is text up to their end tag, or else up to the end of the page.
_RAW = frozenset("script style iframe textarea xmp noembed noframes".split())
#: Elements that are left out whole where they end; without an end tag, the tag alone.
_OPAQUE = frozenset("noscript template svg math object canvas".split())
_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<other>[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*))")
_TAG_PART = re.compile(r">|=\s*([\"'])")
_ENDS = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*>?", re.I) for n in _RAW | _OPAQUE}
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title nav footer aside form button select option optgroup datalist dialog menu menuitem fieldset audio video applet map marquee".split())
#: Of ``header``, the one inside an article holds its heading.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|newsletter\w*|subscri\w*|signup|sign-up|sidebar\w*|side-?bar|side|rail|widgets?|menus?|navbar|navi?|navigation|breadcrumbs?|masthead|"
    r"site-?header|page-?header|top-?bar|header|footer|site-?footer|foot|comments?|commentlist|disqus\w*|respond|replies|reply|discussion|related|recommend\w*|share|sharing|social\w*|popup|modal|overlay|lightbox|login|search\w*|copyright|toolbar|skip-?link|pagination|pager|paywall|outbrain|taboola|teasers?)(?=$|[\s_-])",
    re.I,
)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article-?body|article|post-?content|entry-?content|main-?content|story-?body|post-?body|content-?body)(?=$|[\s_-])", re.I)
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_PUNCT = re.compile("[.,;:!?…。，；：！？、]")


def tags(page: str):
    """The markup of a page: (start, end, kind, name, attributes); kind is "open", "close",
    "cdata" or "skip".  Each character is looked at a bounded number of times: a quote that
    never closes does not hold a value, and a tag that never ends goes to the end of the page."""
    n, at, ended = len(page), 0, {}
    last = {q: page.rfind(q) for q in "\"'"}
    while (at := page.find("<", at)) >= 0:
        m = _OPEN.match(page, at)
        if m is None:
            at += 1
            continue
        if m["name"] is None:
            mark = "-->" if m["comment"] else "]]>" if m["cdata"] else ">"
            end = page.find(mark, at + 2 if m["comment"] else m.end())
            end = n if end < 0 else end + len(mark)
            yield at, end, "cdata" if m["cdata"] else "skip", "", ""
            at = end
            continue
        i = m.end()
        while True:
            part = _TAG_PART.search(page, i)
            if part is None:
                i = end = n
                break
            if part[1] is None or part.end() > last[part[1]]:
                end = part.end() if part[1] is None else page.find(">", part.end()) + 1 or n
                i = end - 1
                break
            i = page.find(part[1], part.end()) + 1
        name, attrs = m["name"].lower(), page[m.end() : i]
        kind = "close" if m["close"] else "open"
        if kind == "open" and name in _ENDS and not (name in ("svg", "math") and attrs.endswith("/")):
            kind = "skip"
            if ended.get(name, 0) is not None:
                close = _ENDS[name].search(page, end)
                ended[name] = None if close is None else 1
                end = close.end() if close else n if name in _RAW else end
            elif name in _RAW:
                end = n
        yield at, end, kind, name, attrs
        at = end


class _Node:
    __slots__ = ("dropped", "main", "name", "parent", "path")

    def __init__(self, name: str, parent: _Node | None, attrs: str = ""):
        self.name, self.parent = name, parent
        self.path = f"{parent.path}/{name}" if parent else name
        self.dropped = parent.dropped if parent else False
        self.main = parent.main if parent else False
        label, role, prop = "", "", ""
        if attrs:
            for m in _ATTR.finditer(attrs):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    label += " " + value
                elif key == "role":
                    role = value.lower()
                elif key == "itemprop":
                    prop = value.lower()
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    self.dropped = True
        if name in ("html", "body"):
            return
        if name in DROPPED or role in _ROLES or (name == "header" and not self.main):
            self.dropped = True
        elif name in ("article", "main") or role in ("main", "article") or prop == "articlebody":
            self.main = True
        elif label:
            if _CONTENT.search(label):
                self.main = True
            elif _NAMED.search(label) and name not in _HEADINGS:
                self.dropped = True


class Block:
    """A run of text in one block element: its element, text, and characters in links."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, node: _Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in their order, without those dropped by name."""
    out: list[Block] = []
    stack = [_Node("", None)]
    inline: list[tuple[str, bool]] = []  # open inline elements of the block, and whether they are dropped
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack[-1], text, linked))
            parts.clear()
        linked = 0

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].dropped and not any(d for _, d in inline):
            t = html.unescape(raw) if "&" in raw else raw
            parts.append(t)
            if any(n == "a" for n, _ in inline):
                linked += len(t.strip())

    def close_until(names: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                flush()
                del stack[k:]
                inline.clear()
                return
            if stack[k].name in scope:
                return

    at = 0
    for start, end, kind, name, attrs in tags(page):
        text_of(page[at:start])
        at = end
        if kind == "cdata":
            text_of(page[start + 9 : end].removesuffix("]]>"))
        if kind in ("cdata", "skip"):
            continue
        if kind == "close":
            if name in INLINE:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == name:
                        del inline[k:]
                        break
            elif name not in VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        flush()
                        del stack[k:]
                        inline.clear()
                        break
                else:
                    flush()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                parts.append(" ")
            continue
        if name in INLINE:
            if not attrs.endswith("/"):
                inline.append((name, bool(attrs) and _Node(name, None, attrs).dropped))
            continue
        flush()
        inline.clear()
        if name in _ENDS_P:
            close_until({"p"}, {"td", "th", "button", "table"})
            if name in _HEADINGS and stack[-1].name in _HEADINGS:
                stack.pop()
        if name in _CLOSES:
            close_until(_CLOSES[name], _SCOPE.get(name, set()))
        if name == "body":
            while len(stack) > 1 and stack[-1].name != "html":
                stack.pop()
        stack.append(_Node(name, stack[-1], attrs))
        if attrs.endswith("/") and name not in ("html", "body"):
            stack.pop()
    text_of(page[at:])
    flush()
    return out


def path_scores(found: list[Block], sigma: float = SIGMA) -> dict[str, float]:
    """The fused, smoothed ratio of each tag path."""
    total: dict[str, list[float]] = {}
    for b in found:
        t = total.setdefault(b.node.path, [0, 0, 0])
        t[0] += max(len(b.text) - b.linked, 0)
        t[1] += len(_PUNCT.findall(b.text))
        t[2] += 1
    text = np.array([total[b.node.path][0] / total[b.node.path][2] for b in found])
    punct = np.array([total[b.node.path][1] / total[b.node.path][2] for b in found])
    r = int(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()

    def smooth(x):
        return np.convolve(np.pad(x, r, mode="edge"), w, "valid")

    fused = smooth(text) * (1 + smooth(punct))
    score: dict[str, list[float]] = {}
    for b, f in zip(found, fused, strict=True):
        score.setdefault(b.node.path, []).append(float(f))
    return {p: sum(v) / len(v) for p, v in score.items()}


def _ancestors(node: _Node) -> list[_Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out[::-1]


def main_blocks(page: str, sigma: float = SIGMA, share: float = SHARE) -> list[str]:
    """The texts of the content blocks, in page order."""
    found = [b for b in blocks(page) if not b.node.dropped]
    if not found:
        return []
    # Where the page marks its article, and it holds a fair part of the text, only that counts.
    inside = [b for b in found if b.node.main]
    if inside and 3 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in found):
        found = inside
    scores = path_scores(found, sigma)
    least = share * float(np.std([scores[b.node.path] for b in found]))
    chosen = [b for b in found if scores[b.node.path] >= least and 2 * b.linked <= len(b.text)] or found
    common = _ancestors(chosen[0].node)
    for b in chosen[1:]:
        path = _ancestors(b.node)
        n = 0
        while n < min(len(common), len(path)) and common[n] is path[n]:
            n += 1
        common = common[:n]
    top = common[-1]
    if top is chosen[0].node and top.parent is not None and top.parent.name not in ("", "html"):
        top = top.parent
    whole = top.name not in ("", "html", "body") or top.main
    picked, first, last = {id(b) for b in chosen}, found.index(chosen[0]), found.index(chosen[-1])
    out = []
    for k, b in enumerate(found):
        under = any(n is top for n in _ancestors(b.node))
        if id(b) in picked or (under and 2 * b.linked <= len(b.text) and (whole or first <= k <= last or b.node.name in _HEADINGS)) or (b.node.main and under and b.node.name not in ("li", "ul")):
            out.append(b.text)
    return out


def extract(page: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    return " ".join(main_blocks(page, sigma, share)) if page else ""


def extract_pages(pages: DataFrame, sigma: float = SIGMA, share: float = SHARE) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                texts = [extract(h, sigma, share) for h in b.column(2).slice(lo, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), b.column(1).slice(lo, 256), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return shared.bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(shared.tidy(work), "page_id long, url string, text string, n_chars long")
