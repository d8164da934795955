"""The training-data operators against brute force, on small inputs with odd cases."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colscope.llm import bpe, chat_format, common, html_extract, mixing, quality, sharding, simhash, substring_dedup, top_k, url_filter, vector_text
from colscope.llm.components import components
from colscope.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, size string, weight string, rank string, key string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocabulary = [
        "the", "a", "Été", "ß", "日本", "x", "naïve", "don't", "😀", "<b>", "#", "2024"
    ] + [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(1, 50))]
        if i % 3 == 0:
            a = rng.randint(0, 20)
            body[5:5] = passage[a : a + rng.randint(10, 20)]
        out.append(rng.choice([" ", "\n", " \t"]).join(body))
    out += [
        out[3],
        out[3],
        out[6] + " more",
        "",
        None,
        " \n ",
        "one",
        "spam spam spam spam spam spam spam spam spam spam spam",
        "line\nline\n\nline\nother",
    ]
    out.append(" ".join(rng.choice(vocabulary) for _ in range(20000)))
    out.append("z" * 3000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Repeated rows, null keys, texts and sources; columns whose names operators use themselves."""
    rows = [
        (i, t, f"s{i % 4}" if i % 9 else None, "9", "9", "9", "9", len(t) if t else None) for i, t in enumerate(texts)
    ]
    rows += [
        rows[2],
        rows[2],
        (None, "no key here at all", "s1", None, None, None, None, 18),
        (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_words(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {
        r.i: r.w for r in df.select("i", common.words(F.col("t")).alias("w")).collect()
    } == {i: words(t) for i, t in enumerate(texts)}


def test_joins_of_hot_keys(spark, docs, monkeypatch):
    lookup = spark.createDataFrame([(f"s{i}", i) for i in range(3)], "source string, n int")
    rows = docs.select("doc_id", "text", "source")
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    assert {r.source for r in common.hot_keys(rows, "source", 5).collect()} >= {"s1", "s2"}
    found = [sorted(f.collect(), key=repr) for f in (common.join_hot(rows, lookup, "source"), common.join_lookup(rows, lookup, "source"))]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    found.append(sorted(common.join_lookup(rows, lookup, "source").collect(), key=repr))
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()


def test_hot_rows_are_spread(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = common.join_hot(rows, lookup, "k")
    assert joined.filter("v = k * 2").count() == 30_000
    sizes = [len(p) for p in joined.filter("k = -1").repartition(64, "id").rdd.glom().collect()]
    assert sum(sizes) == 10_000
    plan = common.hot_keys(rows, "k", 1000)
    assert [r.k for r in plan.collect()] == [-1]


# 1


def test_url_filters(spark):
    urls = [
        "http://www.example.org/en/1/x",
        "https://EXAMPLE.org/es/",
        "http://a.com/fr/b?x=/de/",
        "http://com/de/",
        "http://x.free-bets.example.net/en/",
        "ftp://spam-farm.example.net/en/about?x",
        "http://nocom/fr/",
        "no scheme casino-win.",
        "",
        None,
        "http://h:80#/org/",
        "a://b://c/de/",
        "http://x.net/wp-login.php",
        "http://x.net/?q&affid=1&b",
        "HTTP://Casino-Win.example.net",
    ]
    df = spark.createDataFrame(
        [(i, u, "h", "p") for i, u in enumerate([*urls, urls[0]])],
        "page_id long, url string, host string, rule string",
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("www.example.org", "/en/1/x", "example.org/en/1", "block"), ("example.org", "/es/", "example.org/es/", "block"), ("a.com", "/fr/b", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"),
        ("x.free-bets.example.net", "/en/", None, "block"), ("spam-farm.example.net", "/en/about", None, "allow"), ("nocom", "/fr/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("h:80", "", None, "allow"), ("b:", "//c/de/", None, "allow"), ("x.net", "/wp-login.php", None, "block"), ("x.net", "/", None, "block"), ("casino-win.example.net", "", None, "block"),
    ]
    assert got[len(urls)] == got[0]
    assert url_filter.filter_urls(df.filter("false")).count() == 0


def test_url_index_misses_nothing(spark):
    rng = random.Random(1)
    bits = ["ads", "win", "x1", ".", "-", "/", "casino", "?", "&a=", "*", "^"]
    rules = []
    while len(rules) < 60:
        rule = rng.choice(["", "||", "|", "@@", "@@||"]) + "".join(
            rng.choice(bits) for _ in range(rng.randint(1, 4))
        ) + rng.choice(["", "", "|"])
        try:
            url_filter.parse_pattern(rule)
        except ValueError:
            continue
        rules.append(rule)
    rules = list(dict.fromkeys(rules))
    parsed = [url_filter.parse_pattern(r) for r in rules]
    assert any(p.tokens for p in parsed) and any(not p.tokens for p in parsed)
    urls = [
        "http://" + "".join(rng.choice([b for b in bits if b not in "*^"]) for _ in range(rng.randint(1, 6)))
        for _ in range(300)
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.filter_urls(df, patterns=rules, prefixes=()).collect():
        hits = [p for p in parsed if re.search(p.regex, urls[r.page_id].lower(), re.S)]
        first = next((p for p in hits if p.allows), None) or next(iter(hits), None)
        assert r.pattern == (first.text if first else None)


# 2


def test_html_extraction(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div id="top" class="site-header">Logo</div><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="wrap"><div class="%s">%s</div><div class="ad-slot">Buy now!</div></div><div class="cookie-notice">We use cookies</div><section id="comments"><article><p>First!</p></article></section><footer>&copy; all</footer></body></html>"""
    body = "<h1>Head &amp; more</h1><p>One <b>bo</b>ld &eacute;&#233;\n  <p>Two<br>three<script>if (a<b) x='</p>'</script><!-- no --><form>name</form><ul><li>a<li>b</ul><aside>side</aside>"
    wanted = "Head & more One bold éé Two three a b"
    rows = [(i, f"http://h/{i}", page % (f"post-{i} entry-content", body)) for i in range(5)]
    rows += [
        (5, "http://h/5", "<p>Only this &amp that"),
        (6, None, page % ("c", body)),
        (7, "http://h/7", None),
        (8, "x", ""),
        (9, "http://h/9", (page % ("post-9 entry-content", body))[: page.index("%s") + 60]),
        (0, "http://h/0", page % ("post-0 entry-content", body)),
    ]
    rows += [
        (10, "http://h/10", "just text < 3"),
        (11, "http://h/11", "<article>a<p class='x>b"),
        (12, "http://h/12", "<article>" + "<p>word</p>" * 5000 + "</article>"),
    ]
    df = spark.createDataFrame(
        [(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int"
    )
    found = html_extract.extract_text(df).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert [got[i] for i in (0, 1, 2, 3, 4, 6)] == [wanted] * 6
    assert (got[5], got[7], got[8], got[10]) == ("Only this & that", "", "", "just text < 3")
    assert wanted.startswith(got[9]) and got[12] == " ".join(["word"] * 5000)
    assert html_extract.extract_text(df.filter("false")).count() == 0
    assert html_extract.host_paths(df).filter(
        "__host = 'h'"
    ).first()["__path"] == "html>body>div.wrap>div.entry-content.post-#"


def test_html_templates():
    def best(page):
        return html_extract.extract(page, None)

    text = "".join(f"<p>Sentence {i} of the text that matters.</p>" for i in range(9))
    want = "Title " + " ".join(f"Sentence {i} of the text that matters." for i in range(9))
    frame = "<html><body><div class=topnav><a href=/>x</a> menu</div>%s<div class='leftSidebar'>side words</div><div id=user-comments><p>I disagree with all of it, at length, and so on and so on.</p></div><div class=page-footer>foot</div></body></html>"
    for inner in (
        f"<article><h1>Title</h1><div class=body>{text}</div></article>",
        f"<main><h1>Title</h1>{text}<div class=share-bar>tell</div></main>",
        f"<div class='x9'><h1>Title</h1>{text}</div>",
        f"<div id=content><article><h1>Title</h1>{text}</article><div class=related>more</div></div>",
        f"<table><tr><td class=entry><h1>Title</h1>{text}<div role=alert>!</div></td></tr></table>",
        f"<article><header>by me</header><h1>Title</h1>{text}<section class=comments><article>No!</article></section></article>",
        f"<h1>Title</h1>{text}",
    ):
        assert best(frame % inner) == want


def test_deep_html():
    deep = "<div>" * 20_000 + "<p>core</p>" + "<b>" * 20_000 + "x" + "</section>" * 20_000
    assert html_extract.extract(deep, None) == "core x"


def test_text_after_deep_html():
    deep = "<div>" * 600 + "mid" + "</div>" * 600
    page = "<body><div class=x><p>start</p>%s<p>the rest of the article</p></div></body>"
    assert html_extract.extract(page % deep, None) == "start mid the rest of the article"
    assert html_extract.extract(page % deep, "body>div.x") == "start mid the rest of the article"
    menu = "<div>" * 600 + "<nav>menu</nav><div class=comments>No!</div>" + "</div>" * 600
    assert html_extract.extract(page % menu, "body>div.x") == "start the rest of the article"
    inner = "<div>" * 600 + "<article>the article</article>" + "</div>" * 600
    assert html_extract.extract(f"<body>words{inner}</body>", None) == "the article"


def test_html_of_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(
            html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split()
        )


# 3


@pytest.mark.parametrize("epsilon", [0.0, 0.25])
def test_sharding(docs, empty, epsilon):
    rows = sharding.shard_bounded(docs, n_shards=5, vnodes=8, cells=128, epsilon=epsilon).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len(rows) == docs.count()
    sizes = [len(by_shard.get(s, [])) for s in range(5)]
    assert max(sizes) <= math.ceil((1 + epsilon) * len(rows) / 5) and (epsilon or max(sizes) - min(sizes) <= 1)
    want = sorted(
        ((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()),
        key=repr,
    )
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want
    assert sharding.shard_bounded(empty).count() == 0


def test_sharding_places_clockwise():
    rng = random.Random(2)
    for _ in range(50):
        n, cells = rng.randint(1, 6), 40
        owners = sharding.ring_owners(n, 3, cells)
        counts = [rng.choice([0, 0, 1, 5, 200]) for _ in range(cells)]
        for epsilon in (0.0, 0.3):
            segments = sharding.place(counts, owners, n, epsilon)
            placed, used = [0] * cells, [0] * n
            for cell, a, z, shard, base in segments:
                assert base == used[shard]
                used[shard] += z - a
                placed[cell] += z - a
            assert placed == counts
            total = sum(counts)
            assert max(used) <= (math.ceil((1 + epsilon) * total / n) if epsilon else -(-total // n))
            home = [sum(c for c, o in zip(counts, owners, strict=True) if o == s) for s in range(n)]
            kept = [sum(z - a for cell, a, z, shard, _ in segments if owners[cell] == shard == s) for s in range(n)]
            assert all(k == min(h, u) or k == h for k, h, u in zip(kept, home, used, strict=True))


def test_sharding_moves_little(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before, after = (
        {
            r.doc_id: r.shard
            for r in sharding.shard_bounded(df, n_shards=n, vnodes=128, cells=8192, epsilon=0.25).collect()
        }
        for n in (10, 11)
    )
    assert sum(before[i] != after[i] for i in before) < 20_000 * 0.25


# 4


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())

    def digest(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))

    want = sorted(((r.doc_id, *digest(r.text)) for r in docs.collect()), key=repr)
    for long in (bpe.LONG, 100):
        assert sorted(map(tuple, bpe.token_digests(docs, tokenizer_path(), long=long).collect()), key=repr) == want
    assert bpe.token_digests(empty, tokenizer_path()).count() == 0
    ids = bpe.encode_texts(docs, tokenizer_path(), long=500)
    assert sorted(
        ((r.doc_id, r.text) for r in bpe.decode_ids(ids, tokenizer_path()).collect()), key=repr
    ) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)


def test_tree_concatenation():
    c = bpe.Codec(open(tokenizer_path()).read())
    rng = random.Random(5)
    plain = [chr(i) for i in range(0x250) if bpe.PLAIN.fullmatch(chr(i))]
    kinds = [
        lambda n: "a" * n,
        lambda n: " " * n,
        lambda n: "".join(rng.choice("ACGT") for _ in range(n)),
        lambda n: "".join(rng.choice(plain) for _ in range(n)),
        lambda n: "".join(rng.choice("😀é日 本'ls\n") for _ in range(n)),
        lambda n: "the quick brown fox can't " * (n // 26),
        lambda n: "".join(rng.choice(["<|endoftext|>", "x", " ", "'ll"]) for _ in range(n // 4)),
    ]
    for _ in range(300):
        text = "".join(rng.choice(kinds)(rng.randint(1, 120)) for _ in range(rng.randint(1, 8)))
        got, want = bpe.tree(
            [c.encoded(p) for p in bpe.pieces(text, rng.choice([20, 50, 200]))], c.encoded
        ), c.encoded(text)
        assert got.text == text and got.ids.tolist() == want.ids.tolist() and got.start.tolist() == want.start.tolist()
        ids, decoded = c.written(text)
        assert ids == "".join(f"{i}," for i in want.ids) and decoded == c.decode(want.ids.tolist())


def test_words_are_the_librarys(monkeypatch):
    c = bpe.Codec(open(tokenizer_path()).read())
    rng = random.Random(6)
    plain = [chr(i) for i in range(0x250) if bpe.PLAIN.fullmatch(chr(i))]
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for _ in range(1000):
        text = "".join(
            rng.choice(rng.choice([plain, " \n\t'", "abcst'lmrevd", "019²¼"])) for _ in range(rng.randint(0, 60))
        )
        assert c.written(text) == ("".join(f"{i}," for i in c.encode(text)), text)
    assert len(c.ids) <= 50


# 5


def substring_brute(rows):
    first, out = {}, []
    split = [(math.inf if k is None else k, k, words(t)) for k, t in rows]
    for order, _, w in split:
        for i in range(len(w) - 12):
            x = tuple(w[i : i + 13])
            first[x] = min(first.get(x, math.inf), order)
    for order, k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < order:
                gone[i : i + 13] = [True] * 13
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring_dedup(docs, empty):
    want = substring_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(g for _, _, g, _ in want) > 100
    got = substring_dedup.substring_digests(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, n, g, sha(t)) for k, n, g, t in want), key=repr)
    assert substring_dedup.substring_digests(empty).count() == 0
    texts = {(k, t) for k, n, g, t in want if g}
    rows = substring_dedup.remove_repeats(docs)
    assert rows.schema == docs.schema or rows.columns == docs.columns
    changed = rows.join(
        docs.select("doc_id", F.col("text").alias("old")), "doc_id"
    ).filter("text <> old").select("doc_id", "text", "n_chars").distinct().collect()
    assert {(r.doc_id, r.text) for r in changed} == texts and all(r.n_chars == len(r.text) for r in changed)
    assert rows.count() == docs.count()


def test_difference_cover():
    c, p = substring_dedup.COVER, substring_dedup.PERIOD
    assert all(any((a + d) % p in c and (b + d) % p in c for d in range(p)) for a in range(p) for b in range(p))
    assert p - 1 + substring_dedup.ANCHOR <= substring_dedup.WINDOW


# 6


def simhash_brute(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_brute(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    rows = [(r.doc_id, simhash_brute(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in rows})
    of = component_brute([(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 4], prints)
    least = {c: min((k for k, f in rows if of[f] == c and k is not None), default=None) for c in set(of.values())}
    got = sorted(
        ((r.doc_id, r.fp % 2**64, r.component) for r in simhash.simhash_components(docs).collect()), key=repr
    )
    assert got == sorted(((k, f, least[of[f]]) for k, f in rows), key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_one_row_of_a_component_stays(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey")
    rows = [(7, a, "x"), (7, a, "x"), (7, a, "y"), (9, a, "x"), (None, a, "x"), (7, b, "x"), (7, b, "x")]
    rows += [(None, c, "x"), (None, c, "x"), (None, c, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted((r[:2] for r in got), key=repr) == sorted([(7, a), (7, b), (None, c)], key=repr)
    assert set(got) <= set(rows)


def links_of(fp, scheme):
    """Links between the numbers of fingerprints, found as the tasks find them."""
    found = []
    for table in scheme.tables:
        sent = list(simhash.anchors(fp, table))
        found += simhash.linked(
            np.concatenate([a for a, _, _ in sent]),
            np.concatenate([fp[w] for _, w, _ in sent]),
            np.concatenate([np.full(len(w), h) for _, w, h in sent]),
            scheme.most,
            scheme.all_pairs,
        )
    return [x for u, v in found for x in zip(u.tolist(), v.tolist(), strict=True)]


@pytest.mark.parametrize("n", [1000, simhash.MANY])
@pytest.mark.parametrize("pairs", [1 << 20, 1])
def test_anchors_find_all_links(monkeypatch, pairs, n):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(0)
    family = [rng.integers(0, 2**64, 100, dtype=np.uint64)]
    for _ in range(5):
        flipped = family[0].copy()
        for _ in range(rng.integers(1, 6)):
            flipped ^= np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)
        family.append(flipped)
    fp = np.unique(np.concatenate(family))
    links = [(a, b) for a in fp.tolist() for b in fp.tolist() if a < b and (a ^ b).bit_count() <= 4]
    got = component_brute(links_of(fp[:, None], simhash.by_distance(n)), fp.tolist())
    assert got == component_brute(links, fp.tolist()) and len(links) > 300


@pytest.mark.parametrize("n", [1000, 10**9])
def test_tables_for_a_similarity(n):
    scheme = simhash.by_similarity(n, 0.8)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, (400, 2), dtype=np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rng.permutation(128)[: scheme.most]:
            b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    links = {(min(x), max(x)) for x in links_of(np.concatenate([a, b]), scheme)}
    pairs = {
        (min(x), max(x))
        for x in zip(simhash.numbers(a).tolist(), simhash.numbers(b).tolist(), strict=True)
    }
    assert links <= pairs and len(links) > 0.9 * len(pairs)


def test_xxh64():
    rng = random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 150))) for _ in range(400)]
    ends = np.cumsum([len(t) for t in texts])
    buffer = np.frombuffer(b"".join(texts) + b"\0" * 40, np.uint8)
    assert vector_text.xxh64(buffer, ends - [len(t) for t in texts], ends).tolist() == [
        xxhash.xxh64_intdigest(t, seed=42) for t in texts
    ]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [
        (rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)
    ]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == component_brute([e for e in edges if e[0] != e[1]], nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 7


def test_top_k(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 0.013, 0.5, 0.031]) for _ in range(6)]) for i in range(-20, 90)]
    rows += [
        (100, None),
        (120, [1.0, None]),
        (140, [float("nan")]),
        (160, [float("inf")]),
        (180, []),
        (200, [0.5, 0.5]),
        (7, [9.0] * 6),
        (None, [1.0] * 6),
        rows[20],
        rows[20],
    ]
    df = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string"
    )
    valid = [(k, [math.floor(64 * float(np.float32(x))) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, v in {(k, tuple(v)) for k, v in valid if k % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in valid if j != k)[:20]
        want += [(k, i, j, -s) for i, (s, j) in enumerate(scored, 1)]
    got = [tuple(r) for r in top_k.search(df).collect()]
    assert sorted(got) == sorted(want)
    assert top_k.search(df.filter("false")).count() == 0
    assert top_k.search(df.filter("vec_id = 0")).count() <= 2


def test_top_k_prunes_nothing_it_needs():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 32))
    x = np.floor(64 * (centres[rng.integers(0, 10, 3000)] + 0.05 * rng.normal(size=(3000, 32))))
    ids = rng.permutation(3000)
    at, found, score = top_k.best(x[:40], ids[:40], x, ids, 20)
    for q in range(40):
        s = (x @ x[q]).astype(int)
        want = sorted((-s[j], ids[j]) for j in range(3000) if ids[j] != ids[q])[:20]
        assert list(
            zip((-score[at == q]).astype(int).tolist(), found[at == q].tolist(), strict=True)
        ) == [(int(a), int(b)) for a, b in want]
    for n in top_k.LEVELS:
        assert (top_k.features(x[:40], n) @ top_k.features(x, n).T + 1e-3 >= x[:40] @ x.T).all()


@pytest.mark.parametrize("times", [1, 2, 3, 40, 100])
def test_top_k_of_repeated_queries(times):
    rng = np.random.default_rng(times)
    x = np.floor(64 * rng.normal(size=(300, 16)))
    x[:times] = 3 * x[0]
    ids = np.maximum(np.arange(300) - times + 1, 0)
    for query in (0, times):
        at, found, score = top_k.best(x[[query]], ids[[query]], x, ids, 20)
        s = (x @ x[query]).astype(int)
        want = sorted((-s[j], ids[j]) for j in range(300) if ids[j] != ids[query])[:20]
        assert list(zip((-score).astype(int).tolist(), found.tolist(), strict=True)) == [
            (int(a), int(b)) for a, b in want
        ]


# 8


def quality_brute(text):
    w = words(text)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = {x: five.count(x) for x in set(five)} if len(five) < 2000 else __import__("collections").Counter(five)
    covered = {i + k for i, x in enumerate(five) if counts[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(
        re.findall("[#*$%&|<>]", text or "")
    ), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_rules(docs, empty):
    rows = quality.quality_rules(docs).collect()
    want = sorted(((r.doc_id, *quality_brute(r.text)) for r in docs.collect()), key=repr)
    assert sorted(
        (
            (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            for r in rows
        ),
        key=repr,
    ) == want
    assert all(r.kept == (not r.base_failed and r.host_rule is None) for r in rows)
    assert quality.quality_rules(empty).count() == 0 and quality.keep_good(empty).count() == 0
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in rows)


def hosts():
    fine = " ".join(f"word{i}" for i in range(20))
    rows = [(i, fine if i % 10 else "short", f"good{i % 6}") for i in range(600)] + [
        (1000 + i, "short" if i % 10 else fine, " BAD") for i in range(300)
    ] + [(5000 + i, "short", f"tiny{i}") for i in range(3)] + [(6000, fine, "tiny0")]
    rows += [(7000 + i, fine + "".join(f" #${j}|*%" for j in range(8)), "signs") for i in range(100)]
    rows += [(8000 + i, "\n".join(f"one line again\nof{j} them{i}" for j in range(4)), "lines") for i in range(100)]
    return [(k, t, s, None) for k, t, s in rows]


def test_bad_hosts_go(spark):
    df = spark.createDataFrame(hosts(), "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert [(got[i].base_failed, got[i].host_rule, got[i].kept) for i in (1, 0, 1000, 1001, 7000, 8000, 6000)] == [
        (False, None, True),
        (True, None, False),
        (False, "too_short", False),
        (True, "too_short", False),
        (False, "symbols", False),
        (False, "repeats_lines", False),
        (False, None, True),
    ]
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {k for k, r in got.items() if r.kept}
    rates = {r["__host"]: r for r in quality.host_rates(quality.judged(df)).collect()}
    assert 0.9 > rates["bad"].rate_too_short > rates["bad"].limit_too_short and rates["good1"].rate_too_short < 0.2
    assert rates["tiny1"].rate_too_short < 0.8  # one of one fails, but that is no evidence


# 9


def test_mixing(spark, docs, empty):
    rows = mixing.mixture(docs, max_repeats=1.7, seed=3).collect()
    totals, by = {}, {}
    for r in docs.collect():
        totals[r.source or ""] = totals.get(r.source or "", 0) + len(words(r.text))
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert set(by) == set(totals)
    for source, found in by.items():
        epochs = found[0].epochs
        whole = [r for r in found if r.block < int(epochs + 1e-6)]
        ids = sorted((r.doc_id for r in docs.collect() if (r.source or "") == source), key=repr)
        for b in range(int(epochs + 1e-6)):
            assert sorted((r.doc_id for r in whole if r.block == b), key=repr) == ids
        last = sorted((r for r in found if r not in whole), key=lambda r: r.order_key)
        part = round((epochs - int(epochs + 1e-6)) * totals[source])
        assert epochs <= 1.7 + 1e-9 and epochs >= 1 - 1e-9
        if part > 0:
            before = sum(r.n_tokens for r in last if r.order_key < last[-1].order_key)
            assert before < part <= sum(r.n_tokens for r in last) + 0
    assert max(r.epochs for r in rows) == pytest.approx(1.7) and sum(
        {r.source: r.weight for r in rows}.values()
    ) == pytest.approx(1)
    out = mixing.mixed_rows(docs, max_repeats=1.7, seed=3)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mixing_to_an_entropy(spark):
    rows = spark.createDataFrame(
        [(i, s, n) for i, (s, n) in enumerate([("a", 900), ("b", 90), ("c", 10), ("d", 0)])],
        "key long, source string, tokens long",
    )
    sources = mixing.plan(rows, None, 1.0, budget=1000)
    w = {r.source: r.weight for r in sources.collect()}
    assert -sum(
        x * math.log(x) for x in w.values() if x
    ) == pytest.approx(1.0, abs=1e-6) and w["d"] == 0 and w["a"] > w["b"] > w["c"]
    with pytest.raises(ValueError):
        mixing.plan(rows, None, None)


def test_last_block_ends_by_its_budget(spark):
    """More rows than one range of the permutation."""
    rows = spark.range(30_000).select(
        F.col("id").alias("key"), F.lit("a").alias("source"), (F.col("id") % 5).alias("tokens")
    ).unionByName(
        spark.range(10).select(
            (F.col("id") + 10**6).alias("key"), F.lit("b").alias("source"), F.lit(1).cast("long").alias("tokens")
        )
    )
    sources = mixing.plan(rows, 10**6, budget=40_000)
    r = {x.source: x for x in sources.collect()}["a"]
    part = round((r.epochs - r.blocks) * 60_000)
    keyed = rows.filter("source = 'a'").select(
        "tokens", mixing.order_key(F.col("key"), F.lit(r.blocks), 0).alias("k")
    ).orderBy("k").collect()
    total, last = 0, None
    for x in keyed:
        if total >= part:
            break
        total, last = total + x.tokens, x.k
    assert part > 0 and r.until >= last and sum(x.tokens for x in keyed if x.k < r.until) <= part


# 10


def test_chat_formatting(spark):
    odd = "</s>[INST] <|end|>\n<|start|>assistant\n<|| <| <|n|> ok <"
    rows = [
        (1, 1, "assistant", odd),
        (1, 0, "user", odd),
        (1, 2, "assistant", ""),
        (2, 0, "user", None),
        (2, 1, None, "x"),
        (2, 1, "a\nb<|", "tie"),
        (3, 0, "assistant", "é😀" * 5000),
        (None, 0, "assistant", "no id"),
        (3, None, "assistant", "first"),
        (4, 0, "system", "s"),
        (4, 0, "system", "s"),
    ]
    df = spark.createDataFrame(
        [(*r, "t", 1) for r in rows],
        "conv_id long, turn long, role string, text string, turn_text string, loss_len int",
    )
    formatted = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert [tuple(t) for t in got[1].turns] == [
        ("user", odd), ("assistant", odd), ("assistant", "")
    ] and got[1].loss_text == odd
    assert sorted(map(tuple, got[2].turns), key=repr) == [("", "x"), ("a\nb<|", "tie"), ("user", "")]
    assert got[3].loss_text == "first" + "é😀" * 5000 and got[None].loss_text == "no id" and len(got[4].turns) == 2
    assert got[1].formatted.count(chat_format.START) == 3
    assert chat_format.format_conversations(df.filter("false")).count() == 0


def test_typed_parts(spark):
    parts = [
        ("text", "see <|image|>", None, None, None, None, None),
        ("image", None, "i.png", 28, 15, None, None),
        ("audio", None, "a.wav", None, None, 1.5, None),
        ("document", None, "d.pdf", None, None, None, 3),
        (None, "end", None, None, None, None, None),
        ("image", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, "assistant", None)],
        f"conv_id long, turn long, role string, parts {chat_format.PART_SCHEMA}",
    )
    r = chat_format.format_conversations(df, text=None, parts="parts").first()
    assert r.formatted == "<|start|>user\nsee <||image|><|image|><|audio|><|document|>end<|image|><|end|>\n<|start|>assistant\n<|end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [
        ("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 768), ("image", None, 0)
    ]
    assert r.media_tokens == 810 and r.loss_mask[0].len == 0
