"""HTML extraction with consensus host paths.

Each page's containers are scored by the share of the page's text they hold. A container's path is that of its
tags and classes, with digits generalised. Scores are votes, added up by host and path in Spark; the path with
most votes wins its host, and every page is extracted again from the containers on that path. Pages that have no
such container fall back on their own best.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, small_batches, written
from .vector_text import slices

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
NAME_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    """
    a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s
    samp small span strike strong sub sup time tt u var wbr
    """.split()
)
CLOSES_P = frozenset(
    """
    address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1
    h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul
    """.split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset(
    """
    article aside blockquote body button caption details div fieldset footer form header html li main nav object
    section table td th ul ol
    """.split()
)

#: Elements and names that are not the article: menus, headers, footers, sidebars, notices, adverts, forms, comments.
NOT_TAGS = frozenset(
    """
    head nav header footer aside form script style noscript template iframe svg button select option textarea
    input dialog menu object canvas audio video map datalist
    """.split()
)
NOT_ROLES = frozenset(
    """
    navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar
    """.split()
)
NOT_NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos
    promotion nav navbar navigation menu menus header masthead topbar footer sidebar sidebars aside cookie
    cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription
    signup login share sharing social comment comments commentlist disqus reply replies respond responses
    related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar widget widgets banner
    banners skip hidden copyright disclaimer form search
    """.split()
)
NOT_ENDINGS = (
    "sidebar", "navbar", "nav", "menu", "footer", "comments", "advert", "masthead", "pageheader", "siteheader"
)
NOT_BEGINNINGS = ("comment", "cookie", "advert", "sidebar", "newsletter", "sponsor")
ARTICLE_NAMES = frozenset("article content entry post story body text main maincontent articlebody prose".split())
ROOTS = frozenset("html body main article".split())
MILLION = 1_000_000
#: Characters that a path spells out; longer ones are digests, rolled on from level to level, so that all stay short.
SPELLED = 256


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(value.strip("\"'")) if value else "")
    return found


class Node:
    """An open element: what it is, whether its text counts and is a link's, and what a share of text in it weighs."""

    __slots__ = ("tag", "path", "depth", "dropped", "link", "weight")

    def __init__(self, tag: str, path: str, depth: int, dropped: bool, link: bool, weight: float) -> None:
        self.tag, self.path, self.depth, self.dropped, self.link, self.weight = tag, path, depth, dropped, link, weight


def _weight(tag: str, a: dict[str, str], names: set[str], depth: int) -> float:
    """Elements that say they are the article weigh most, whatever their depth, so that of two with the same text the
    outer one wins; others a little more the deeper they are."""
    if tag == "article" or a.get("role", "").lower() == "article" or "articlebody" in a.get("itemprop", "").lower():
        return 2.5
    if tag == "main" or a.get("role", "").lower() == "main":
        return 1.6
    if names & ARTICLE_NAMES and tag not in ROOTS:
        return 1.5
    return 1.0 + 0.1 * min(depth, 4)


def _unwanted(name: str) -> bool:
    return name in NOT_NAMES or name.endswith(NOT_ENDINGS) or (
        name.startswith(NOT_BEGINNINGS) and name != "commentary"
    )


def _open(tag: str, attributes: str, parent: Node | None) -> Node:
    a = _attributes(attributes) if attributes.strip(" \t\r\n/") else {}
    label = tag
    names: set[str] = set()
    for value in (a.get("class", ""), a.get("id", "")):
        names.update(n.lower() for n in NAME_PART.findall(value))
    if classes := a.get("class", "").split():
        label += "".join("." + c for c in sorted({re.sub("[0-9]+", "#", c) for c in classes}))
    if a.get("id"):
        label += "!" + re.sub("[0-9]+", "#", a["id"])
    role = a.get("role", "").lower()
    style = a.get("style", "").replace(" ", "").lower()
    bad = {n for n in names if _unwanted(n)}
    if bad <= {"header", "banner"} and names & ARTICLE_NAMES:
        bad = set()
    dropped = tag in NOT_TAGS or (
        tag not in ROOTS and (role in NOT_ROLES or bool(bad))
    ) or "hidden" in a or "display:none" in style or a.get("aria-hidden") == "true"
    depth = parent.depth + 1 if parent else 0
    path = label if parent is None else f"{parent.path}>{label}"
    if len(path) > SPELLED:
        path = "~" + hashlib.md5(path.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
    return Node(
        tag,
        path,
        depth,
        dropped or bool(parent and parent.dropped),
        tag == "a" or bool(parent and parent.link),
        _weight(tag, a, names, depth),
    )


def walk(html: str) -> Iterator[tuple[str, Node | None, str]]:
    """``("open", node, "")``, ``("close", node, "")``, ``("break", None, "")`` and ``("text", node, text)`` in page
    order. End tags that may be left out are put in; what a cut page leaves open is closed at its end."""
    stack: list[Node] = []
    places: dict[str, list[int]] = defaultdict(list)  # by tag where it is open, so that deep pages take no longer
    at = 0

    def popped(to: int) -> list[tuple[str, Node | None, str]]:
        out: list[tuple[str, Node | None, str]] = [("close", n, "") for n in reversed(stack[to:])]
        for _, n, _ in out:
            places[n.tag].pop()
        del stack[to:]
        return out

    def nearest(tags: set[str] | frozenset[str]) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=-1)

    def scope(tags: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> int:
        """Where the nearest of ``tags`` is open, looking out as far as the nearest of ``limits``; else -1."""
        i = nearest(tags)
        return i if i >= 0 and i >= nearest(limits) else -1

    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            rest = html[at:].removesuffix("</")  # of a page cut within an end tag
            yield "text", stack[-1] if stack else None, unescape(rest)
            break
        if m.start() > at:
            yield "text", stack[-1] if stack else None, unescape(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield "text", stack[-1] if stack else None, m[0][9:].removesuffix("]]>")
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag == "p" and scope({"p"}, SCOPE) < 0:
                yield "break", None, ""
                continue
            limits = frozenset() if tag in SCOPE else SCOPE
            if (i := scope({tag}, limits - {tag})) >= 0:
                yield from popped(i)
            continue
        if tag in CLOSES_P and (i := scope({"p"}, SCOPE)) >= 0:
            yield from popped(i)
        if tag in CLOSES:
            while (i := scope(*CLOSES[tag])) >= 0:
                yield from popped(i)
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag == "body" and (i := scope({"head"}, frozenset())) >= 0:
            yield from popped(i)
        node = _open(tag, m[3], stack[-1] if stack else None)
        if tag in VOID:
            if tag not in INLINE:
                yield "break", None, ""
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        places[tag].append(len(stack))
        stack.append(node)
        yield "open", node, ""
    yield from popped(0)


def scores(html: str) -> dict[str, int]:
    """The page's votes by container path, in millionths: the share of its text outside links that the containers on
    the path hold, times their weight."""
    chars: dict[str, int] = defaultdict(int)
    weight: dict[str, float] = {}
    whole = 0
    inside: list[tuple[Node, int]] = []  # with the text there was before it; no two that are open have one path
    for kind, node, text in walk(html):
        if kind == "open" and node.tag not in INLINE and node.tag not in (
            "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "pre", "blockquote"
        ):
            inside.append((node, whole))
        elif kind == "close" and inside and inside[-1][0] is node:
            if n := whole - inside.pop()[1]:
                chars[node.path] += n
                weight[node.path] = node.weight
        elif kind == "text" and (node is None or not (node.dropped or node.link)):
            whole += len("".join(text.split()))
    return {p: int(MILLION * weight[p] * n / whole) for p, n in chars.items()}


def extract(html: str | None, path: str | None) -> str:
    """The text of the containers on ``path``, or, if the page has none with text, on its own best path.

    Character references are decoded, white space is one space, blocks are a space apart. Null pages are empty.
    """
    if not html:
        return ""
    events = list(walk(html))

    def text_on(wanted: str | None) -> str:
        parts: list[str] = []
        outer: Node | None = None
        for kind, node, text in events:
            if kind == "open":
                if outer is None and node.path == wanted and not node.dropped:
                    outer = node
                if node.tag not in INLINE:
                    parts.append(" ")
            elif kind == "close":
                if node is outer:
                    outer = None
                if node.tag not in INLINE:
                    parts.append(" ")
            elif kind == "break":
                parts.append(" ")
            elif (outer is not None or wanted is None) and (node is None or not node.dropped):
                parts.append(text)
        return " ".join("".join(parts).split())

    if path is not None and (found := text_on(path)):
        return found
    own = scores(html)
    return text_on(min(own, key=lambda p: (-own[p], p)) if own else None)


def with_host(df: DataFrame, url: str) -> DataFrame:
    return df.withColumn(
        "__host", F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    )


def host_paths(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``__host, __path``: the path with most votes of each host, ties to the smaller. Pages whose URL has no host
    vote together. Votes are added up in each task before they are dealt, so a large host is a few rows."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 16 << 20):
            votes: dict[tuple[str, str], int] = defaultdict(int)
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, n in scores(page or "").items():
                    votes[host, path] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in votes], pa.string()),
                    pa.array([p for _, p in votes], pa.string()),
                    pa.array(list(votes.values()), pa.int64()),
                ],
                names=["__host", "path", "votes"],
            )

    cast = with_host(df, url).select("__host", html).mapInArrow(vote, "__host string, path string, votes long")
    totals = cast.groupBy("__host", "path").agg(F.sum("votes").alias("votes"))
    return totals.groupBy("__host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("__path"))


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page, from the whole page, however long or deep. Null and empty pages have an
    empty text; pages whose URL is null or has no host vote together. Keys may be null or tie; of paths with equal votes
    the smaller wins. Repeated rows vote, and are extracted, each for itself; an empty table gives no rows; extra columns
    are ignored. Paths are short, so that those of some hundred thousand hosts are broadcast; beyond ``BROADCAST_BYTES``
    pages meet them by host."""
    small_batches(df.sparkSession)
    winners = written(host_paths(df, url, html))
    rows = with_host(df.select(key, url, html), url)
    found = join_lookup(rows, winners, "__host").select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), "__path"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 16 << 20):
            texts = [extract(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["key", "url", "text", "n_chars"],
            )

    kind = df.schema[key].dataType.simpleString()
    return found.mapInArrow(
        run, f"key {kind}, url string, text string, n_chars long"
    ).withColumnRenamed("key", key).withColumnRenamed("url", url)
