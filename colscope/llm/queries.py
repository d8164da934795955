"""One query for each training-data operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, html_extract, mixing, quality, sharding, simhash, substring_dedup, top_k, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_bounded(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digests(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(table(spark, sf_dir, "documents"), max_repeats=2.0)
    return out.withColumns({c: F.round(c, 9) for c in ("weight", "epochs")})


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat_format.read_back(chat_format.format_conversations(rows))
    spoken = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_html_extraction,
        op3_sharding,
        op4_bpe,
        op5_substring_dedup,
        op6_simhash_near_dedup,
        op7_exact_top_k,
        op8_quality_rules,
        op9_mixing,
        op10_chat_formatting,
    )
}

OP1_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, url IS NOT NULL AS known,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, known, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    CASE WHEN NOT known THEN NULL
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?spam-farm\.example\.net/en/about([^a-z0-9_.%-]|$)') THEN '@@||spam-farm.example.net/en/about^'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?casino-win\.') THEN '||casino-win.'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?cheap-pills\.') THEN '||cheap-pills.'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?free-bets\.') THEN '||free-bets.'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?ads-track\.') THEN '||ads-track.'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?spam-farm\.') THEN '||spam-farm.'
    WHEN contains(low, '/wp-login.php') THEN '/wp-login.php'
    WHEN regexp_matches(low, '&affid=.*&') THEN '&affid=*&' END AS pattern
  FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN pattern IS NOT NULL AND pattern NOT LIKE '@@%' THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM r
"""

#: For pages whose article is one element `article` with nothing in it to leave out, as the given ones are.
OP2_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(replace(replace(t, '<b>', ''), '</b>', ''), '(?s)<[^>]*(>|$)', ' ', 'g') AS t FROM a),
c AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(t, '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

OP3_SQL = r"""
WITH RECURSIVE
z AS (SELECT i AS n, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) AS t(i)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM z WHERE k < 8),
y AS (SELECT list(c ORDER BY n) AS tab FROM z WHERE k = 8),
d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes,
    CAST('0x' || substr(md5(coalesce('key/' || doc_id, 'text/' || coalesce(text, ''))), 1, 15) AS BIGINT) AS position FROM documents),
e AS (
  SELECT doc_id, size, position, position % 4096 AS cell,
    xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM d CROSS JOIN y),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY text_crc32 % 64, position, doc_id, size, text_crc32) - 1 AS i FROM e),
v AS (SELECT s AS shard, sha256(s || '/' || v) AS digest FROM range(16) AS a(s) CROSS JOIN range(64) AS b(v)),
w AS (SELECT CAST(CAST('0x' || substr(digest, 1, 16) AS UBIGINT) % 4096 AS BIGINT) AS place, arg_min(shard, digest) AS shard FROM v GROUP BY 1),
o AS (SELECT cell, coalesce(arg_min(shard, place) FILTER (WHERE place >= cell), arg_min(shard, place)) AS shard FROM range(4096) AS c(cell) CROSS JOIN w GROUP BY cell),
n AS (SELECT o.cell, o.shard, count(e.cell) AS n FROM o LEFT JOIN e ON e.cell = o.cell GROUP BY o.cell, o.shard),
m AS (SELECT s AS shard, (SELECT count(*) FROM documents) // 16 + CASE WHEN s < (SELECT count(*) FROM documents) % 16 THEN 1 ELSE 0 END AS room FROM range(16) AS t(s)),
h AS (SELECT n.*, greatest(least(n, room - (sum(n) OVER (PARTITION BY n.shard ORDER BY cell) - n)), 0) AS home, sum(n) OVER (PARTITION BY n.shard ORDER BY cell) - n AS before FROM n JOIN m ON m.shard = n.shard),
x AS (SELECT cell, home, n - home AS n, row_number() OVER (ORDER BY cell) AS turn FROM h WHERE n > home),
q AS (
  SELECT turn, x.cell, list(shard ORDER BY near) AS ring
  FROM x JOIN (SELECT x.cell, o.shard, min((o.cell - x.cell - 1 + 4096) % 4096) AS near FROM x CROSS JOIN o GROUP BY x.cell, o.shard) AS f ON f.cell = x.cell GROUP BY turn, x.cell),
u AS (
  SELECT CAST(0 AS BIGINT) AS turn, list(CAST(least(room, coalesce(used, 0)) AS BIGINT) ORDER BY m.shard) AS used, list(CAST(room AS BIGINT) ORDER BY m.shard) AS room, CAST([] AS STRUCT(shard BIGINT, first BIGINT, until BIGINT, base BIGINT)[]) AS parts
  FROM m LEFT JOIN (SELECT shard, sum(n) AS used FROM n GROUP BY shard) AS k ON k.shard = m.shard
  UNION ALL
  SELECT x.turn, list_transform(range(16), lambda s: u.used[s + 1] + list_sum(list_prepend(0, list_transform(list_filter(f.parts, lambda p: p.shard = s), lambda p: p.until - p.first)))), u.room, f.parts
  FROM u JOIN x ON x.turn = u.turn + 1 JOIN q ON q.turn = x.turn
  CROSS JOIN LATERAL (
    SELECT list_transform(range(1, len(q.ring) + 1), lambda i: u.room[q.ring[i] + 1] - u.used[q.ring[i] + 1]) AS free) AS g
  CROSS JOIN LATERAL (
    SELECT list_transform(range(1, len(q.ring) + 1), lambda i: {'shard': q.ring[i],
      'first': x.home + least(x.n, list_sum(list_prepend(0, g.free[1:i - 1]))), 'until': x.home + least(x.n, list_sum(g.free[1:i])), 'base': u.used[q.ring[i] + 1]}) AS parts) AS f),
p AS (
  SELECT cell, CAST(shard AS BIGINT) AS shard, CAST(0 AS BIGINT) AS first, CAST(home AS BIGINT) AS until, CAST(before AS BIGINT) AS base FROM h WHERE home > 0
  UNION ALL SELECT x.cell, t.part.shard, t.part.first, t.part.until, t.part.base FROM u JOIN x ON x.turn = u.turn CROSS JOIN LATERAL (SELECT unnest(u.parts) AS part) AS t WHERE t.part.until > t.part.first)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p.shard AS INTEGER) AS shard, CAST(base + i - first AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN p ON p.cell = r.cell AND i >= first AND i < until
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o
    || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o || ' ' || lead(word, 8) OVER o || ' ' || lead(word, 9) OVER o
    || ' ' || lead(word, 10) OVER o || ' ' || lead(word, 11) OVER o || ' ' || lead(word, 12) OVER o AS words13
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words13) AS least FROM g WHERE words13 IS NOT NULL),
r AS (SELECT DISTINCT doc_id, i + k AS i FROM f CROSS JOIN (SELECT unnest(range(13)) AS k) AS steps WHERE least < doc_id),
k AS (
  SELECT p.doc_id, count(*) FILTER (WHERE r.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE r.i IS NULL) AS kept
  FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP7_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, lower(trim(coalesce(source, ''), ' ')) AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g WHERE five IS NOT NULL),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM c CROSS JOIN (SELECT unnest(range(5)) AS k) AS five WHERE n >= 2 GROUP BY doc_id),
l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id),
b AS (
  SELECT *, n_words < 10 AS too_short, 100 * n_repeat_words > 20 * n_words AS repeats_words,
    100 * n_dup_lines > 30 * n_lines AS repeats_lines, 100 * n_symbols > 10 * word_chars AS symbols FROM m),
a AS (SELECT host, unnest(['too_short', 'repeats_words', 'repeats_lines', 'symbols']) AS rule,
  unnest([1, 2, 3, 4]) AS place, unnest([too_short, repeats_words, repeats_lines, symbols]) AS failed FROM b),
h AS (SELECT host, rule, place, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS f FROM a GROUP BY host, rule, place),
t AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS k FROM h GROUP BY rule),
e AS (
  SELECT h.rule, any_value(t.mean) AS mean, any_value(t.mean * (1 - t.mean)) AS noise,
    sum(h.n * power(h.f / h.n - t.mean, 2)) / any_value(t.n) - any_value(t.mean * (1 - t.mean) * t.k / t.n) AS extra
  FROM h JOIN t ON t.rule = h.rule GROUP BY h.rule),
s AS (SELECT rule, mean, noise, CASE WHEN extra > 0 THEN least(greatest(noise / extra - 1, 2.0), 10000.0) ELSE 10000.0 END AS strength FROM e),
r AS (
  SELECT host, arg_min(h.rule, place) AS host_rule FROM h JOIN s ON s.rule = h.rule
  WHERE (f + mean * strength) / (n + strength) > least(greatest(mean + 2 * sqrt(noise / (strength + 1)), 0.5), 0.8) GROUP BY host)
SELECT doc_id, b.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, too_short OR repeats_words AS base_failed, host_rule,
  NOT (too_short OR repeats_words) AND host_rule IS NULL AS kept FROM b LEFT JOIN r ON r.host = b.host
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens) AS tokens FROM d GROUP BY source),
p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM t) END AS share FROM t),
x AS (SELECT max(share) / min(share) AS ratio FROM p),
b AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN power(ratio, 1 - (low + high) / 2) <= 2 THEN low ELSE (low + high) / 2 END,
    CASE WHEN power(ratio, 1 - (low + high) / 2) <= 2 THEN (low + high) / 2 ELSE high END
  FROM b CROSS JOIN x WHERE i < 48),
a AS (SELECT CASE WHEN ratio <= 2 THEN 0.0 ELSE high END AS a FROM b CROSS JOIN x WHERE i = 48),
w AS (SELECT source, tokens, coalesce(power(share, a) / (SELECT sum(power(share, a)) FROM p CROSS JOIN a), 0.0) AS weight, coalesce(power(share, a) / share / (SELECT min(power(share, a) / share) FROM p CROSS JOIN a), 1.0) AS epochs FROM p CROSS JOIN a),
e AS (SELECT *, CAST(floor(epochs + 0.000001) AS BIGINT) AS blocks FROM w),
f AS (SELECT *, greatest(round((epochs - blocks) * tokens), 0) AS part FROM e),
n AS (SELECT d.doc_id, d.source, n_tokens, weight, epochs, blocks, part, unnest(range(0, blocks + 1)) AS block FROM d JOIN f ON f.source = d.source),
k AS (SELECT *, CAST('0x' || substr(md5('0/' || CAST(block AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS order_key FROM n),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY order_key) - n_tokens AS before FROM k)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, round(epochs, 9) AS epochs, block, order_key FROM c WHERE block < blocks OR before < part
"""

OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(18 + length(replace(role, '<|', '<||')) + length(replace(text, '<|', '<||'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLE_SQL = {
    "op1_url_filters": OP1_SQL,
    "op2_html_extraction": OP2_SQL,
    "op3_sharding": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_exact_top_k": OP7_SQL,
    "op9_mixing": OP9_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_chat_formatting": OP10_SQL,
}
