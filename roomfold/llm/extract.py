"""Main text of web pages: maximum-scoring contiguous run of words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from roomfold.llm.arrow import map_chunks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PART = re.compile(r"[a-z]+|\d+")
#: Compounds that only say that something stands elsewhere on the page or is missing.
_COMPOUND = re.compile(r"(?<![a-z])(?:has|have|with|without|no|non|not)[-_]+[^\s]*")

# Element kinds of HTML.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
           "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "td", "th"}
_CONTAINERS = {"article", "aside", "body", "center", "dialog", "div", "dl", "fieldset", "figure", "footer", "form",
               "head", "header", "html", "main", "menu", "nav", "ol", "section", "svg", "table", "tr", "td", "ul", "a",
               "button", "select", "object", "canvas", "math", "details", "span", "p", "h1", "h2", "h3", "h4", "h5", "h6"}
_CONTENT = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_KINDS = {
    "head": {"head"}, "nav": {"nav", "menu"}, "footer": {"footer"}, "aside": {"aside"},
    "form": {"form", "button", "select", "fieldset", "dialog"}, "media": {"svg", "object", "canvas"},
}
_HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toolbar skip masthead topbar",
    "footer": "footer footnav colophon copyright contentinfo",
    "aside": "sidebar aside widget related recommended recommendations complementary teaser rail discussion",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe paywall",
    "form": "form search login signin signup",
    "share": "share sharing social follow",
    "comment": "comment comments reply replies respond disqus",
    "head": "hidden",
}
# Words that with a hint make a name of a part of a page (ad-box), where others make another name (related-work).
_LAYOUT = set("area bar block body bottom box btn button buttons column container content footer form fixed group header icons inner item items "
              "layout left links list module outer panel popup post posts primary right row secondary section slot sticky stories text thread top "
              "tree unit widget wrap wrapper".split())
# Hints that are also everyday names of parts of an article.
_EVERYDAY = {"notice", "notices", "alert", "discussion", "search"}
# Headings that open the comments of readers.
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader |user |recent |latest )?(?:comments?|responses|replies)(?:\s*\(?\d+\)?)?:?|leave a (?:comment|reply)|join the (?:discussion|conversation)")
_TAG_KIND = {tag: kind for kind, tags in _KINDS.items() for tag in tags}
_HINT_KIND = {word: kind for kind, words in _HINTS.items() for word in words.split()}

#: Weights before anything is learned, in units of one plain word.
PRIOR = {"word:plain": 1.0, "word:link": -0.5, "word:boilerplate": -2.0, "tag": -0.3}
_KNOWN_TAGS = _RAW | _VOID | _INLINE | _CONTAINERS | {"li", "dt", "dd", "blockquote", "pre", "figcaption", "thead",
                                                      "tbody", "tfoot", "caption", "summary", "address", "option"}


@dataclass(frozen=True)
class Node:
    """A tag, or a text with its number of words; ``content`` numbers the enclosing article or main element."""

    feature: str
    words: int
    text: str
    dropped: bool
    breaks: bool
    content: int


def _hint(value: str, inside: int) -> str | None:
    """Kind that a class, id or role hints at: one of its names holds nothing but words of hints and of layout."""
    for name in _COMPOUND.sub(" ", value).split():
        parts = [p for p in _PART.findall(name) if not p.isdigit()]
        found = [p for p in parts if p in _HINT_KIND and not (inside and p in _EVERYDAY)]
        if found and all(p in _LAYOUT or p in _HINT_KIND for p in parts):
            return _HINT_KIND[found[0]]
    return None


def _kind(tag: str, attributes: str, inside: int) -> tuple[str | None, bool]:
    """Kind of boilerplate that an element announces by its name, role, class or id, and whether it is only a hint.

    A header counts as such only outside of articles. Names of headings and compounds such as has-sidebar say nothing.
    """
    kind = _TAG_KIND.get(tag) or ("nav" if tag == "header" and not inside else None)
    if kind or not attributes or tag in ("body", "html", "main"):
        return kind, False
    hint = None
    for name, value in _ATTRIBUTE.findall(attributes.lower()):
        value = value.strip("\"'")
        if name in ("class", "id", "role"):
            if tag not in _HEADINGS or name == "role":
                hint = hint or _hint(value, inside)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and "display:none" in value.replace(" ", "")):
            return "head", False
    return hint, hint is not None


def nodes(html: str | None) -> list[Node]:
    """Tags and texts in page order, each text with the context it stands in.

    A hint of a class, id or role holds inside an article whatever its words. On a page without words of an article, an
    element that holds most plain words of the page is no boilerplate, whatever its name.
    """
    page = html or ""
    out, hints = _parse(page, frozenset())
    if any(n.content and n.words and n.feature == "word:plain" for n in out):
        return out
    plain = sum(n.words for n in out if n.feature == "word:plain") + sum(words for _, outer, words in hints if outer)
    overruled = frozenset(at for at, _, words in hints if 2 * words > plain)
    return _parse(page, overruled)[0] if overruled else out


class _Open:
    """An open element: its kind of boilerplate, its article, and for a hint the words outside of links so far."""

    __slots__ = ("tag", "kind", "content", "place", "outer", "words")

    def __init__(self, tag: str, kind: str | None, content: int, place: int | None, outer: bool, words: int):
        self.tag, self.kind, self.content, self.place, self.outer, self.words = tag, kind, content, place, outer, words


def _parse(page: str, overruled: frozenset[int]) -> tuple[list[Node], list[tuple[int, bool, int]]]:
    """The nodes, and the elements that only hints make boilerplate: place, whether outermost, words outside of links.

    Each tag is looked at once and an element is left once, so the time is linear in the page.
    """
    out: list[Node] = []
    hints: list[tuple[int, bool, int]] = []
    stack: list[_Open] = []
    depth: defaultdict[str, int] = defaultdict(int)
    contents = counted = 0
    heading: int | None = None  # first node of an open heading

    def text(value: str) -> None:
        nonlocal counted
        if not value:
            return
        decoded = entities.unescape(value)
        top = stack[-1] if stack else None
        kind = top.kind if top else None
        link = any(s.tag == "a" for s in stack[-4:])
        feature = f"word:{kind}" if kind else "word:link" if link else "word:plain"
        out.append(Node(feature, len(decoded.split()), decoded, kind is not None, False, top.content if top else 0))
        counted += 0 if link else out[-1].words

    def leave() -> None:
        gone = stack.pop()
        depth[gone.tag] -= 1
        if gone.place is not None:
            hints.append((gone.place, gone.outer, counted - gone.words))

    at = 0
    while True:
        match = _TOKEN.search(page, at)
        if match is None:
            text(page[at:])
            while stack:
                leave()
            return out, hints
        text(page[at:match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        closing = bool(match[1] or match[4])
        out.append(Node(f"tag:{tag if tag in _KNOWN_TAGS else 'other'}", 0, " " if tag in ("br", "td", "th") else "",
                        stack[-1].kind is not None if stack else False, tag not in _INLINE, stack[-1].content if stack else 0))
        if tag in _RAW:
            if not closing:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif closing:
            if depth[tag] > 0:
                while stack[-1].tag != tag:
                    leave()
                leave()
            if tag in _HEADINGS and heading is not None:
                said = " ".join("".join(n.text for n in out[heading:]).lower().split())
                if _COMMENTS.fullmatch(said) and stack and stack[-1].kind is None:
                    # what the heading opens, to the end of the element around it
                    out[heading:] = [replace(n, feature="word:comment" if n.words else n.feature, dropped=True) for n in out[heading:]]
                    stack[-1].kind = "comment"
                heading = None
        elif tag in _CONTAINERS and tag not in _VOID and not (match[3] or match[6] or "").endswith("/"):
            if tag == "p" or tag in _HEADINGS or tag in ("div", "ul", "ol", "table", "section", "form"):
                while stack and stack[-1].tag in ("p", "span", "a"):  # a block ends an open paragraph
                    leave()
            if tag in _HEADINGS:
                heading = len(out) - 1
            around, inside = (stack[-1].kind, stack[-1].content) if stack else (None, 0)
            own, hinted = _kind(tag, match[3] or match[6] or "", inside)
            place = None
            if hinted and match.start() in overruled:
                own = None
            elif hinted and all(s.kind is None or s.place is not None for s in stack[-1:]):
                place = match.start()
            kind = around or own
            if tag in _CONTENT and not depth["article"]:
                contents += 1
                inside = contents
                if kind == around != "comment":
                    kind = None  # a class of an outer element does not make an article boilerplate
            stack.append(_Open(tag, kind, inside, place, place is not None and around is None, counted))
            depth[tag] += 1


def weights(counts: dict[str, tuple[int, int]], strength: float = 50.0) -> dict[str, float]:
    """Log odds of every feature inside against outside content, drawn towards the prior where seen rarely.

    Plain words keep a positive weight and tags a negative one.
    """
    inside = sum(c[0] for c in counts.values()) + 1
    outside = sum(c[1] for c in counts.values()) + 1
    found = {}
    for name, (n, m) in counts.items():
        prior = _prior(name)
        odds = max(-3.0, min(3.0, math.log((n + 1) / inside) - math.log((m + 1) / outside)))
        value = (odds * (n + m) + prior * strength) / (n + m + strength)
        found[name] = max(0.2, value) if name == "word:plain" else max(-1.0, min(-0.05, value)) if name[:4] == "tag:" else value
    return found


def _prior(name: str) -> float:
    if name[:4] == "tag:":
        return PRIOR["tag"]
    return PRIOR.get(name, PRIOR["word:boilerplate"])


def region(found: list[Node], learned: dict[str, float]) -> tuple[int, int]:
    """First and one past the last node of the run with the largest sum; the earliest and longest of equals."""
    best, best_run, total, start = 0.0, (0, 0), 0.0, 0
    for i, node in enumerate(found):
        weight = learned.get(node.feature)
        if weight is None:
            weight = _prior(node.feature)
        score = weight * (node.words if node.feature[:5] == "word:" else 1)
        total += max(score, -0.5) if node.dropped else score  # what is left out anyway breaks no region
        if total > best or (total == best and best_run[0] == start and best > 0):
            best, best_run = total, (start, i + 1)
        elif total <= 0:
            total, start = 0.0, i + 1
    return best_run


def main_text(html: str | None, learned: dict[str, float]) -> str:
    """Blocks of the best region, one line each, and the rest of each block or article that the region touches.

    Texts that stand in menus, headers, footers, sidebars, notices, adverts, forms or comments are left out.
    """
    found = nodes(html)
    first, last = region(found, learned)
    if first < last:
        while first and not found[first - 1].breaks:
            first -= 1
        while last < len(found) and not found[last].breaks:
            last += 1
    touched = {n.content for n in found[first:last] if n.feature[:5] == "word:" and n.words and not n.dropped} - {0}
    blocks, parts = [], []
    for i, node in enumerate(found):
        if node.breaks:
            blocks.append("".join(parts))
            parts = []
        elif not node.dropped and (first <= i < last or node.content in touched):
            parts.append(node.text)
    blocks.append("".join(parts))
    lines = (" ".join(b.split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def learn(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Weights from the pages that mark their content with an article or main element.

    Counts of features (at most a few hundred names) over all such pages are added up on the executors;
    without labelled pages the prior weights remain.
    """
    marked = pages.select(F.col(html).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))

    def count(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        totals: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for part in parts:
            for page in part["html"]:
                for node in nodes(page):
                    if node.feature not in ("tag:article", "tag:main"):
                        totals[node.feature][node.content == 0] += node.words if node.feature[:5] == "word:" else 1
        yield {"feature": list(totals), "inside": [v[0] for v in totals.values()], "outside": [v[1] for v in totals.values()]}

    counted = map_chunks(marked, "html", "feature string, inside long, outside long", count).groupBy("feature").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return weights({r.feature: (r.inside, r.outside) for r in counted.collect()})


def extract(pages: DataFrame, learned: dict[str, float], key: str = "page_id", html: str = "html",
            keep: list[str] | None = None) -> DataFrame:
    """``id``, the columns ``keep`` and ``text``: the article's blocks in page order, joined by line feeds.

    A null, empty or content-free page gives an empty text; repeated rows each get theirs; unclosed and
    unknown tags are tolerated. Long pages take time in proportion. A kept column of the name ``id`` or ``text`` is left out. Character references are decoded and white space inside a block becomes
    one space. The weights (one number per feature) travel with the tasks.
    """
    keep = [c for c in keep or [] if c not in ("id", "text")]
    rows = pages.select(F.struct(F.col(key).alias("id"), *[F.col(c) for c in keep]).alias("kept"), F.col(html).alias("html"))
    kept = rows.schema["kept"].dataType.simpleString()

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            yield {"kept": part["kept"], "text": [main_text(p, learned) for p in part["html"]]}

    return map_chunks(rows, "html", f"kept {kept}, text string", run).select("kept.*", "text")
