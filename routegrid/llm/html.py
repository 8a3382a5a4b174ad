"""Main text of web pages by tag-path ratios."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import slices

# Element names and the class, id and role tokens that mark what is hardly the article.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "canvas", "audio", "video", "select", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUTSIDE = {"head", "nav", "header", "footer", "aside", "button", "menu", "dialog", "label", "fieldset", "option", "datalist", "map"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSED_BY = {
    "p": {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
          "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "td", "th", "tr", "dt", "dd"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "notification", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets", "alert", "complementary", "contentinfo", "form", "recommended", "discussion", "feedback", "legal",
    "commentlist", "commentform",
}
WHOLE_ONLY = {"header", "banner", "form", "search", "alert", "legal", "widget", "widgets", "login", "masthead", "toolbar", "copyright"}  # not as a part: these stand at titles and bodies too
STATES = {"no", "has", "with", "without", "is", "not", "hide", "show"}  # a token that begins so tells a state of the page
SKELETON = {"nav", "header", "footer", "article", "main", "section", "h1"}  # a form around one of these is a page, not a form
READERS = {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus"}  # also on article elements
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]|['"](?=[^'"]*>))*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TO_THE_END = {"script", "style", "title", "textarea"}  # without an end tag they take the rest of the page
_PART = re.compile(r"[-_:]+")
_MARKED_SHARE = 1 / 4  # what a marked element leaves of the scores in it


def _is_marked(token: str, marks: set[str]) -> bool:
    """Whether a class, id or role is one of the marks, or begins or ends with one of them as a part."""
    if token in marks:
        return True
    parts = _PART.split(token)
    return len(parts) > 1 and parts[0] not in STATES and any(x in marks and x not in WHOLE_ONLY for x in (parts[0], parts[-1]))


def _judged(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element and all in it is no part of an article, and whether it is marked as hardly one."""
    if name in OUTSIDE:
        return True, False
    if name in ("html", "body") or not attributes or attributes.isspace():
        return False, False
    marks, marked = READERS if name in ("main", "article") else MARKED, False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true":
            return True, False
        if key in ("class", "id", "role") and any(_is_marked(x, marks) for x in value.split()):
            marked = True
    return False, marked


def blocks(page: str) -> list[tuple[tuple[int, ...], str, str, bool, tuple[int, ...]]]:
    """(elements, tag path, text, in a link, marked elements) of each block of text outside of what is no article.

    ``elements`` numbers the block elements from the root to the block; those marked as hardly
    an article have a star in the path.  Inline elements are no part of a path; white space in
    a block becomes one space.
    """
    out: list[tuple[tuple[int, ...], str, str, bool, tuple[int, ...]]] = []
    stack: list[tuple[str, int, bool, bool]] = []
    pieces: list[str] = []
    counter = linked = at = links = total = 0
    forms: set[int] = set()

    def flush() -> None:
        nonlocal links, total
        text = " ".join(html.unescape("".join(pieces)).split())
        if text and not (stack and stack[-1][2]):
            path = "/".join(n + "*" * m for n, _, _, m in stack)
            out.append((tuple(e for _, e, *_ in stack), path, text, total > 0 and 2 * links > total, tuple(e for _, e, _, m in stack if m)))
        pieces.clear()
        links = total = 0

    end = len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            piece = page[at:stop]
            pieces.append(piece)
            size = len(piece.strip())
            total += size
            links += size if linked else 0
        if not found:
            break
        at = found.end()
        if found[0].startswith("<![CDATA["):
            continue
        if not found[2]:
            continue
        closing, name = found[1], found[2].lower()
        if name in RAW and not closing and not found[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end if name in _TO_THE_END else at
            continue
        if name in INLINE:
            if name == "a":
                linked = 0 if closing else 1
            elif name in ("br", "wbr", "img"):
                pieces.append(" " if name != "wbr" else "")
            continue
        flush()
        linked = 0
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
        elif name not in VOID:
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            counter += 1
            outside, marked = _judged(name, found[3])
            if name == "form":
                forms.add(counter)
            elif name in SKELETON and forms:
                forms.difference_update(e for n, e, *_ in stack if n == "form")
            stack.append((name, counter, bool(stack and stack[-1][2]) or outside, marked))
    flush()
    return [b for b in out if forms.isdisjoint(b[0])] if forms else out


def _smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian mean over neighbouring blocks (two on either side, weights cut off at the ends)."""
    weights = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    return np.convolve(x, weights, "same") / np.convolve(np.ones(len(x)), weights, "same") if len(x) > 4 else x


def _upper(values: np.ndarray, weights: np.ndarray) -> float:
    """The least value of the upper of two clusters, or of all values if there are no two.

    Of the cuts that leave at least half of the sum above, the one with the least squares within
    both sides (of logarithms) is taken; the sides' means must differ by a factor of 2.
    """
    order = np.argsort(values)
    value, w = values[order], weights[order]
    x, below, total = np.log(value), np.cumsum(w)[:-1], w.sum()
    low = np.cumsum(w * x)[:-1] / below
    high = ((w * x).sum() - below * low) / (total - below)
    allowed = (2 * np.cumsum(w * value)[:-1] <= (w * value).sum()) & (high - low > np.log(2))
    if not allowed.any():
        return float(value[0])
    return float(value[1 + np.argmax(np.where(allowed, below * (total - below) * (high - low) ** 2, -1))])


def main_text(page: str | None) -> str:
    """The blocks of the article, in page order, joined by newlines; empty if there are none.

    Per tag path, the text length and the punctuation of its nodes are added up and divided by
    their number.  Every block takes its path's two ratios (a third of the length if its path
    is mostly links), both are smoothed over the blocks in page order and fused by their
    product (a quarter of it for every element around that class, id or role mark as hardly an
    article, so that a mark on a wrapper of all changes nothing); a path is content if its blocks' mean is in the upper of two clusters, or is the largest.

    The article is what lies in the article or main elements around content blocks, if these
    hold most of the content's score, else the innermost element that holds all content
    blocks.  Blocks in a marked element are left out, unless it holds content.
    """
    found = blocks(page or "")
    if not found:
        return ""
    paths, index = np.unique([b[1] for b in found], return_inverse=True)
    nodes = np.bincount(index)
    length = np.array([len(b[2]) for b in found], float)
    marks = np.array([len(PUNCTUATION.findall(b[2])) for b in found], float)
    linked = np.bincount(index, weights=[b[3] for b in found]) / nodes
    by_length = np.bincount(index, weights=length) / nodes * np.where(linked > 0.5, 1 / 3, 1)
    by_marks = np.bincount(index, weights=marks) / nodes
    fused = _smooth(np.log1p(by_length[index])) * (1 + _smooth(by_marks[index])) * _MARKED_SHARE ** np.array([len(b[4]) for b in found], float)
    score = np.bincount(index, weights=fused) / nodes
    content = (score >= max(score.max() - 1e-9, 0)) | (score >= _upper(score, nodes))
    content &= ~((linked > 0.5) & (score < score.max()))
    at = np.flatnonzero(content[index])
    chosen = [found[i] for i in at]
    holding = {e for b in chosen for e in b[0]}
    found = [b for b in found if holding.issuperset(b[4])]
    around = [{e for e, name in zip(b[0], b[1].split("/")) if name in ("article", "main")} for b in chosen]
    if 2 * sum(fused[i] for i, x in zip(at, around) if x) > fused[at].sum():
        inside = {min(x) for x in around if x}
        return "\n".join(b[2] for b in found if not inside.isdisjoint(b[0]))
    common = chosen[0][0]
    for elements, *_ in chosen[1:]:
        n = next((i for i, (x, y) in enumerate(zip(common, elements)) if x != y), min(len(common), len(elements)))
        common = common[:n]
    return "\n".join(b[2] for b in found if b[0][:len(common)] == common)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the article of every page, from its whole html.

    A null or empty page, or one without text outside of what is no article, has an empty text.
    Pages are read one by one; repeated rows get equal results; other columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 4 << 20):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
