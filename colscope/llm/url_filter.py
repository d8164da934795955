"""URL filters: pattern rules indexed by their rarest literal token.

A rule is written in a small filter language: plain text, ``*`` (anything), ``^`` (a separator or the end),
``||`` in front (start of a host label), ``|`` in front or behind (start or end of the URL), and ``@@`` in
front of everything for an exception that allows what other rules block. Prefix rules ``host/path`` fit a host with
its subdomains if the path starts with the rule's path; the longest one that fits decides before any pattern does.

Every rule of either kind is a regular expression filed under the one of its literal tokens that is rarest in the table
at hand; the tokens of a URL fetch candidate rules and only those run. Rules without a usable token are tried on every
URL. The index is broadcast, as it is a list of rules, not of rows, and a worker compiles a rule when it first meets it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of the query's contract.
PREFIX_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: The default pattern list of the query.
PATTERN_RULES = (
    "||casino-win.",
    "||cheap-pills.",
    "||free-bets.",
    "||ads-track.",
    "||spam-farm.",
    "/wp-login.php",
    "&affid=*&",
    "@@||spam-farm.example.net/en/about^",
)

SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Pattern:
    """One rule: its text, regular expression, whether it allows, its literal tokens, and whether it is a prefix rule.
    Patterns are matched with the URL in lower case, prefix rules with its host (in lower case) and path."""

    text: str
    regex: str
    allows: bool
    tokens: tuple[str, ...]
    prefix: bool = False


def parse_pattern(text: str) -> Pattern:
    """Read a rule. A token is usable if the rule itself bounds it on both sides, so that it is whole in any match."""
    body = text.translate(UPPER_TO_LOWER)
    if allows := body.startswith("@@"):
        body = body[2:]
    front = back = ""
    if body.startswith("||"):
        front, body = r"^[^:/?#]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        front, body = "^", body[1:]
    if body.endswith("|"):
        back, body = "$", body[:-1]
    if not body.strip("*"):
        raise ValueError(f"rule without text: {text!r}")
    regex = front + "".join({"*": ".*", "^": SEPARATOR}.get(c) or re.escape(c) for c in body) + back
    usable = []
    for m in TOKEN.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else bool(front)
        right = body[m.end()] != "*" if m.end() < len(body) else bool(back)
        if left and right:
            usable.append(m[0])
    return Pattern(text, regex, allows, tuple(dict.fromkeys(usable)))


def parse_prefix(rule: str, verdict: str) -> Pattern:
    """Read a prefix rule. A path's last token may go on in the URL, so it is none of the rule's."""
    host, slash, path = rule.partition("/")
    regex = rf"(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    tokens = TOKEN.findall(host) + [
        m[0] for m in TOKEN.finditer(path.translate(UPPER_TO_LOWER)) if m.end() < len(path)
    ]
    return Pattern(rule, regex, verdict == "allow", tuple(dict.fromkeys(tokens)), True)


def index_rules(rules: list[Pattern], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """The rules' numbers by their rarest token (ties: that of fewer rules, then the longer, then the smaller), and those
    without a token."""
    index: dict[str, list[int]] = {}
    rest = []
    used = Counter(t for p in rules for t in p.tokens)
    for i, p in enumerate(rules):
        if p.tokens:
            index.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), used[t], -len(t), t)), []).append(i)
        else:
            rest.append(i)
    return index, rest


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the contract has them; both empty for null and for a URL without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(UPPER_TO_LOWER), m[2]


class Judge:
    """What a worker needs: the rules, prefix rules first and the longest first, and their index."""

    def __init__(self, rules: list[Pattern], index: dict[str, list[int]], rest: list[int]) -> None:
        self.rules, self.index, self.rest = rules, index, rest
        self.compiled: dict[int, re.Pattern] = {}

    def fits(self, i: int, site: str, low: str) -> bool:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].regex, re.S)
        if self.rules[i].prefix:
            return self.compiled[i].match(site) is not None
        return self.compiled[i].search(low) is not None

    def verdict(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """``host, path, rule, verdict, pattern``."""
        host, path = split_url(url)
        if url is None:
            return host, path, None, "allow", None
        low = url.translate(UPPER_TO_LOWER)
        fetched = [i for t in set(TOKEN.findall(low)) for i in self.index.get(t, ())]
        hits = [self.rules[i] for i in sorted({*fetched, *self.rest}) if self.fits(i, host + path, low)]
        prefix = next((p for p in hits if p.prefix), None)
        patterns = [p for p in hits if not p.prefix]
        hit = next((p for p in patterns if p.allows), None) or next(iter(patterns), None)
        decides = prefix or hit
        return (
            host,
            path,
            prefix.text if prefix else None,
            "block" if decides and not decides.allows else "allow",
            hit.text if hit else None,
        )


_judges: list = []


def judge_of(shared: tuple[list[Pattern], dict[str, list[int]], list[int]]) -> Judge:
    """One for each worker and list of rules."""
    if not _judges or _judges[0] is not shared:
        _judges[:] = shared, Judge(*shared)
    return _judges[1]


def token_counts(df: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each rule token occurs. At most one row for each token of the rule list reaches the driver."""
    if not tokens:
        return {}
    split = F.array_distinct(F.split(F.lower(F.col(url)), "[^a-z0-9]+"))
    known = F.array_intersect(split, F.array(*[F.lit(t) for t in tokens])) if len(tokens) <= 1000 else split
    found = df.select(F.explode(known).alias("token")).groupBy("token").count()
    if len(tokens) > 1000:
        found = found.join(
            df.sparkSession.createDataFrame([(t,) for t in tokens], "token string"), "token", "left_semi"
        )
    return {r["token"]: r["count"] for r in found.collect()}


def filter_urls(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    patterns: Iterable[str] = PATTERN_RULES,
    prefixes: Iterable[tuple[str, str]] = PREFIX_RULES,
) -> DataFrame:
    """Judge every row's URL: ``id_col, host, path, rule, verdict, pattern``.

    ``rule`` is the prefix rule that decided (else null), ``pattern`` the pattern rule that did (else null): the
    first exception that matches, else the first blocking rule. A URL no rule speaks of is allowed. Null URLs and
    URLs without ``://`` have an empty host and path; patterns still see the latter. URLs may be of any length. Of prefix
    rules of one length the first decides. Repeated rows are judged each for itself, null ids stay, other columns are
    ignored, an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    rules = sorted((parse_prefix(*p) for p in prefixes), key=lambda p: -len(p.text))
    rules += dict.fromkeys(parse_pattern(p) for p in patterns)
    counts = token_counts(df, url_col, sorted({t for p in rules for t in p.tokens}))
    shared = df.sparkSession.sparkContext.broadcast((rules, *index_rules(rules, counts)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of(shared.value)
        for batch in batches:
            out = [judge.verdict(url) for url in batch.column(1).to_pylist()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.string()) for c in columns]],
                names=[id_col, "host", "path", "rule", "verdict", "pattern"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, url_col).mapInArrow(
        judged, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string"
    )
