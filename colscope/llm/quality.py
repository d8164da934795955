"""Quality rules with host-level verdicts.

Each document is measured and judged by rules of its own. Failures of each rule are then added up by host and each
host's rates are shrunk with a beta prior that is fitted to all hosts, one for each rule (method of moments). A host
whose shrunk rate of any rule lies in the upper tail of that rule's prior takes its remaining documents with it. The
verdicts are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, let, named, number, numbered, words, written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host is rejected if a shrunk rate is above the prior's mean plus so many of its deviations; but never with a
#: rate under the first bound, when most of its documents pass, and always above the second.
TAIL, BOUNDS = 2.0, (0.5, 0.8)
#: Bounds of the prior's weight in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 10_000.0

#: Documents fail by themselves by the first two rules; all four count for their host.
RULES = ("too_short", "repeats_words", "repeats_lines", "symbols")
MAX_REPEAT_LINES_PERCENT, MAX_SYMBOLS_PERCENT = 30, 10


def repeated_words(w: Column) -> Column:
    """How many words of the array lie in windows of five that occur twice or more in it.

    Windows are compared by a 64-bit hash, within one document only.
    """
    n = F.size(w)

    def covered(h: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            same = F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]),
                ),
                lambda i: i.isNotNull(),
            )
            return let(
                F.sort_array(same),
                lambda p: F.aggregate(
                    F.transform(
                        p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))
                    ),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), from_sorted)
        )

    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    )
    return F.when(n > WINDOW, let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, then a struct ``m`` with the measures and ``base_failed`` of each document."""
    content = F.coalesce(F.col(text), F.lit(""))

    def measures(w: Column) -> Column:
        lines = F.filter(F.split(content, "\n"), lambda x: F.char_length(F.translate(x, " \t\x0b\f\r", "")) > 0)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.octet_length(content) - F.octet_length(F.regexp_replace(content, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return df.withColumn("__m", let(words(F.col(text)), measures))


def judged(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """All columns, the measures as columns in front of which ``__`` stands, ``__host`` and the rules' failures."""
    m = F.col("__m")
    named = {
        "__n_words": m["n_words"],
        "__word_chars": m["word_chars"],
        "__n_symbols": m["n_symbols"],
        "__n_dup_lines": m["lines"]["dup"],
        "__n_lines": m["lines"]["all"],
        "__n_repeat_words": m["n_repeat_words"],
    }
    out = measured(df, text).withColumns(named).drop("__m").withColumn(
        "__host", F.lower(F.trim(F.coalesce(F.col(host), F.lit(""))))
    )
    failed = {
        "__too_short": F.col("__n_words") < MIN_WORDS,
        "__repeats_words": 100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"),
        "__repeats_lines": 100 * F.col("__n_dup_lines") > MAX_REPEAT_LINES_PERCENT * F.col("__n_lines"),
        "__symbols": 100 * F.col("__n_symbols") > MAX_SYMBOLS_PERCENT * F.col("__word_chars"),
    }
    return out.withColumns(failed).withColumn("__base_failed", F.col("__too_short") | F.col("__repeats_words"))


def host_rates(rows: DataFrame) -> DataFrame:
    """By host: documents, and of each rule its failures ``n_rule``, the shrunk rate ``rate_rule`` and the ``limit_rule``.

    A rule's prior is beta(m s, (1 - m) s): m is the mean of the hosts' rates, each host counting by its documents, and
    s follows from their variance beyond binomial noise. Its deviation is sqrt(m (1 - m) / (s + 1)). They are single
    figures that pass through the driver.
    """
    counts = [F.count(F.lit(1)).alias("n_docs"), *[F.count_if(f"__{r}").alias(f"n_{r}") for r in RULES]]
    hosts = written(rows.groupBy("__host").agg(*counts))
    total = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), *[F.sum(f"n_{r}").alias(r) for r in RULES]).first()
    n, k = total["n"] or 1, total["k"] or 1
    mean = {r: (total[r] or 0) / n for r in RULES}
    spread = hosts.agg(
        *[
            F.sum(F.col("n_docs") * F.pow(F.col(f"n_{r}") / F.col("n_docs") - F.lit(mean[r]), F.lit(2.0))).alias(r)
            for r in RULES
        ]
    ).first()
    out = hosts
    for r, m in mean.items():
        noise = m * (1 - m)
        extra = (spread[r] or 0.0) / n - noise * k / n
        s = min(max(noise / extra - 1, MIN_STRENGTH), MAX_STRENGTH) if extra > 0 else MAX_STRENGTH
        limit = min(max(m + TAIL * (noise / (s + 1)) ** 0.5, BOUNDS[0]), BOUNDS[1])
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s)))
        out = out.withColumn(f"limit_{r}", F.lit(limit))
    return out


def rejected_hosts(rows: DataFrame) -> DataFrame:
    """``__host, __rejected`` of the hosts whose verdict is no: the first of the rules (by ``RULES``) they break."""
    rates = host_rates(rows)
    broken = F.coalesce(*[F.when(F.col(f"rate_{r}") > F.col(f"limit_{r}"), F.lit(r)) for r in RULES])
    return written(rates.select("__host", broken.alias("__rejected")).filter("__rejected IS NOT NULL"))


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Every document's measures and verdicts: ``key, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, host_rule, kept``; ``host_rule`` is the rule that its host breaks, else null.

    Null and empty texts have no words; null hosts count as the empty one, hosts are compared trimmed and in lower
    case. Texts are measured whole, however long. Repeated rows are judged, and count for their host, each for itself;
    keys, which may be null, decide nothing. An empty table gives no rows; extra columns are ignored.
    """
    rows = written(
        judged(
            df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(host).alias("__source")),
            "__text",
            "__source",
        ).drop("__text", "__source")
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return join_lookup(rows, rejected_hosts(rows), "__host").select(
        F.col("__key").alias(key),
        F.col("__host").alias("host"),
        *[F.col(f"__{c}").alias(c) for c in names],
        F.col("__rejected").alias("host_rule"),
        (~F.col("__base_failed") & F.col("__rejected").isNull()).alias("kept"),
    )


def keep_good(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that ``quality_rules`` keeps, with their own columns, whatever their names.

    Nulls, empty and long texts and repeated rows are as there; an empty table stays empty. Documents are measured
    once and written (see ``written``), then filtered.
    """
    rows = written(judged(numbered(df), number(df, text), number(df, host)), "quality")
    out = join_lookup(rows, rejected_hosts(rows), "__host").filter("__rejected IS NULL AND NOT __base_failed")
    return named(out, df)
