"""The dealt queries against their SQL or brute force, and the pipeline against a brute-force version."""

import collections
import hashlib
import math

import numpy as np
import oracle
import pytest
from test_dealt import component_brute, hosts, quality_brute, sha, simhash_brute, substring_brute, words

import corpus_pipeline
from colscope.llm import queries, simhash
from colscope.llm.queries import tokenizer_path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    oracle.check(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.ORACLE_SQL[name])


def token_rows(rows):
    """What the library makes of whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = []
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((key, len(ids), sha(",".join(map(str, ids))), sha(decoded)))
    return sorted(out)


def test_bpe_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op4_bpe(spark, sf).collect())) == token_rows(docs)


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {k: simhash_brute(t) for k, t in docs}
    of = component_brute(
        [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4], prints
    )
    got = sorted(map(tuple, queries.op6_simhash_near_dedup(spark, sf).collect()))
    assert got == sorted((k, f"{f:016x}", of[k]) for k, f in prints.items()) and len(set(of.values())) < len(of)


def test_queries_with_rejected_hosts(spark, tmp_path):
    """The driver's documents have no host that breaks a rule; these have three."""
    rows = spark.createDataFrame(hosts(), "doc_id long, text string, source string, lang string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op8_quality_rules(spark, str(tmp_path))
    assert df.filter("host_rule IS NOT NULL").select("host_rule").distinct().count() == 3
    oracle.check(df, con, queries.ORACLE_SQL["op8_quality_rules"])


def test_sharding_of_hot_keys(spark, tmp_path, monkeypatch):
    """A third of the rows has one key, a third has none, and rows repeat by the thousand."""
    from colscope.llm import sharding

    monkeypatch.setattr(sharding, "PIECE", 100)
    rows = [(7, f"t{i}") for i in range(300)] + [(None, f"u{i % 50}") for i in range(300)] + [(i, "x") for i in range(300)]
    rows += [(9, "same")] * 1500
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    oracle.check(queries.op3_sharding(spark, str(tmp_path)), con, queries.ORACLE_SQL["op3_sharding"])


def similar_brute(texts):
    """Which of the texts stays for each: those whose fingerprints of 128 bits are close enough are linked."""
    fp = simhash.fingerprints(list(texts.values()), corpus_pipeline.SHINGLE, 2)
    most = simhash.by_similarity(len(texts), corpus_pipeline.SIMILARITY).most
    close = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2) <= most
    keys = list(texts)
    return component_brute([(keys[i], keys[j]) for i, j in np.argwhere(close) if i < j], keys)


def mixture_brute(rows, repeats=2.0):
    """How often each row is in the mixture: rows are (key, source, tokens)."""
    tokens = collections.Counter()
    for _, source, n in rows:
        tokens[source] += n
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    low, high = 0.0, 1.0
    ratio = max(share.values()) / min(share.values())
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if ratio ** (1 - middle) <= repeats else (middle, high)
    exponent = 0.0 if ratio <= repeats else high
    least = min(p ** (exponent - 1) for p in share.values())
    out = collections.Counter()
    for source, p in share.items():
        epochs = p ** (exponent - 1) / least
        blocks = math.floor(epochs + 1e-6)
        part, seen = max(round((epochs - blocks) * tokens[source]), 0), 0
        mine = [r for r in rows if r[1] == source]
        for r in mine:
            out[r[0]] += blocks
        order = sorted(mine, key=lambda r: hashlib.md5(f"0/{blocks}/{r[0]}".encode()).hexdigest()[:15])
        for key, _, n in order:
            if seen >= part:
                break
            out[key], seen = out[key] + 1, seen + n
    return out


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}

    def table(found):
        return spark.createDataFrame([tuple(r.values()) for r in found], docs.schema)

    def after(i, found):
        out = corpus_pipeline.STAGES[i][1](spark, table(found), sf)
        assert i == 4 or out.columns == docs.columns
        return sorted((r.asDict() for r in out.collect()), key=lambda r: r["doc_id"])

    good = [r for r in rows.values() if not quality_brute(r["text"])[-1]]
    assert after(0, rows.values()) == sorted(good, key=lambda r: r["doc_id"])
    of = similar_brute({r["doc_id"]: r["text"] for r in good})
    single = [r for r in good if of[r["doc_id"]] == r["doc_id"]]
    assert after(1, good) == sorted(single, key=lambda r: r["doc_id"]) and len(single) < len(good)
    left = {k: (g, t) for k, _, g, t in substring_brute([(r["doc_id"], r["text"]) for r in single])}
    cut = []
    for r in single:
        gone, text = left[r["doc_id"]]
        cut.append({**r, "text": text, "n_chars": len(text)} if gone else r)
    assert after(2, single) == sorted(cut, key=lambda r: r["doc_id"]) and cut != single
    times = mixture_brute([(r["doc_id"], r["source"], len(words(r["text"]))) for r in cut])
    mixed = [r for r in cut for _ in range(times[r["doc_id"]])]
    assert after(3, cut) == sorted(mixed, key=lambda r: r["doc_id"]) and len(mixed) > len(cut)
    want = token_rows([(r["doc_id"], r["text"]) for r in mixed])
    assert sorted(tuple(r.values()) for r in after(4, mixed)) == want
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "SimHash near-dedup",
        "substring dedup",
        "mixing sources to target weights",
        "BPE encoding and decoding",
    ]


ODD = "doc_id long, text string, lang string, source string, n_chars long, __m string, __host string, __n_words string, `c0` string, __block string, __row string, `a.b` string, __source string"


def test_stages_on_odd_tables(spark, sf):
    """Empty tables, nulls in every column, and names that operators might use themselves."""
    text = " ".join(f"word{i}" for i in range(30))
    extra = ("m", "h", "w", "c", "b", "r", "ab", "s")
    rows = [(i, f"{text} {i} {i}a {i}b" + " x" * i, "en", f"s{i % 2}", None, *extra) for i in range(6)]
    rows += [rows[1], (None, text + " z", None, None, None, *[None] * 8), (None, None, None, None, None, *extra)]
    rows += [(50, "", "", "", 0, *extra), (51, " ".join(f"long{i}" for i in range(30_000)), "en", "s0", 1, *extra)]
    whole = spark.createDataFrame(rows, ODD)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, whole.filter("false"), sf).collect() == []
        out = stage(spark, whole, sf)
        found = out.collect()
        if i == 4:
            assert len(found) == len(rows)
            continue
        assert out.columns == whole.columns and found
        for r in found:
            assert tuple(r)[5:] in (extra, (None,) * 8)
        assert any(r.doc_id == 51 and len(r.text) > 200_000 for r in found)


def test_tables_on_the_way_go(spark, sf, tmp_path, monkeypatch):
    from colscope.llm import common, quality

    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = quality.keep_good(docs)
    before = sorted(p.name for p in tmp_path.iterdir())
    with pytest.raises(RuntimeError), common.scratch(spark):
        assert quality.keep_good(docs).count() == other.count()
        raise RuntimeError
    assert sorted(p.name for p in tmp_path.iterdir()) == before and other.count() > 0
