"""URL filters and top-k search against brute force; the pipeline; the registered names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumidex.llm import queries, topk_search, url_filter


def brute_url(url, blocked=frozenset(url_filter.BLOCKLIST)):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, verdict in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best
    bad = any(d in blocked for d in url_filter.domains(host)) or host + path in blocked
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://a.NET/", "https://net", "https://net/x", "https://anet/x", "http://x.example.net/en/1", "http://example.net/en", "ftp://M.Ads-Track.Example.com/es/1?x=/de/",
    "http://free-bets.example.org/fr/x", "http://free-bets.example.org/de/x", "http://example.com/de/", "http://a.example.com/de/#t", "HTTP://É.example.org:80/fr/", "http://a://b/c", "http://h?p=1", "http://h#f", "http://page.test/p/q?z",
    "http://x\ny/z", "http://org/fr/", "http://ads-track.example.com", "http://xads-track.example.com/",
]


def test_urls(spark):
    rows = [(i, u, "k", "h", "v") for i, u in enumerate(URLS)] + [(None, URLS[8], None, None, None), (3, URLS[3], None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string")
    entries = {*url_filter.BLOCKLIST, "page.test/p/q"}
    got = sorted(map(repr, [tuple(r) for r in url_filter.judge(df, blocklist=entries).collect()]))
    assert got == sorted(map(repr, [(r[0], *brute_url(r[1], entries)) for r in rows]))
    assert url_filter.judge(df.limit(0)).collect() == [] and len(url_filter.judge(df, blocklist=()).collect()) == len(rows)


def test_colliding_digests(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    names = ["aa", "bbbb", "c", "ddd"]
    array = url_filter.DigestArray(url_filter.build(names, str(tmp_path / "l")), lambda s: len(s) % 2)
    assert array.contains(["aa", "bbbb", "c", "ddd", "zz", "z", ""]).tolist() == [True] * 4 + [False] * 3


def test_a_blocklist_in_shards(spark, tmp_path):
    entries = [f"d{i}.example.test" for i in range(3000)] + ["page.test/p/q"]
    table = spark.createDataFrame([(x,) for x in [*entries, *entries[:9], None]], "entry string")
    folder = url_filter.build_table(table, str(tmp_path / "l"), 7)
    asked = [*entries, "d3000.example.test", "", "page.test/p"]
    assert url_filter.Blocklist(folder).contains(asked).tolist() == [True] * len(entries) + [False] * 3
    urls = [*URLS, "http://a.d17.example.test/x", "x://" + "h" * 100_000 + ".d5.example.test/" + "p" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for blocklist in (folder, table, url_filter.build(entries, str(tmp_path / "one"))):
        got = {r.page_id: (r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, blocklist=blocklist).collect()}
        assert got == {i: (i, *brute_url(u, set(entries))) for i, u in enumerate(urls)}


def brute_topk(rows, k):
    """rows: (id, vector)."""
    ok = [(i, [int(np.floor(256 * float(x))) for x in v], n) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q, qn in ok:
        if qi is None or qi % 50:
            continue
        score = [(-sum(a * b for a, b in zip(q, v)), i is None, i) for i, v, n in ok if n != qn and len(v) == len(q)]
        out += [(qi, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(score, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("dim,dims", [(3, 1), (40, 8), (64, 16)])
def test_topk(spark, dim, dims, monkeypatch):
    monkeypatch.setattr(topk_search, "DIMS", dims)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    rng = random.Random(dim)
    vectors = [[rng.gauss(0, 1) * (1 + 9 * (j < 4)) for j in range(dim)] for _ in range(160)]
    rows = list(enumerate(vectors)) + [(200, vectors[0]), (50, vectors[3]), (None, vectors[1]), (201, None), (202, [None] * dim), (250, [float("nan")] * dim), (203, [float("inf")] * dim), (204, []), (300, []), (205, [1.0]), (350, [1e6])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, row int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_topk(exact, 5)))
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_blocks_prune_without_loss():
    rng = np.random.default_rng(1)
    c = rng.integers(-200, 200, (3000, 64)) * np.r_[np.full(16, 8), np.ones(48, int)]
    q = rng.integers(-200, 200, (20, 64)) * np.r_[np.full(16, 8), np.ones(48, int)]
    ids = rng.permutation(3000)
    for i, at, score in topk_search.search_block(c, ids, np.arange(3000), q, np.full(20, -1), 5):
        want = sorted(zip((-(c @ q[i])).tolist(), ids.tolist()))[:5]
        assert list(zip((-score).tolist(), ids[at].tolist())) == want


def test_huge_components_stay_exact():
    c = np.array([[2**40, 1], [2**40, 2]])
    got = list(topk_search.search_block(c, np.arange(2), np.arange(2), np.array([[2**20, 1]]), np.array([-1]), 1))
    assert got[0][1].tolist() == [1] and got[0][2].tolist() == [2**60 + 2]


def test_registered():
    names = list(queries.QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.ORACLE) <= set(names)


def test_pipeline_stage_by_stage(spark, odd):
    import corpus_pipeline
    from lumidex.llm import ngram_join, quality_rules, substring_dedup

    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    shared = text(60)
    rows = [(i, text(200), "en", "ab"[i % 2], 1) for i in range(150)]
    rows += [(200, rows[0][1], "en", "a", 1), (201, rows[1][1] + " tail", "de", "b", 1), (202, "x $$$ ### " * 80, "en", "a", 1), (203, text(90) + " " + shared, "en", "a", 1), (204, text(90) + " " + shared, "en", "b", 1), (205, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality rules"](spark, docs, "").cache()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in quality_rules.judge(docs).collect() if r.kept)
    assert {202, 205} & {r.doc_id for r in good.collect()} == set()
    one = stage["n-gram Jaccard join"](spark, good, "").cache()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in good.collect()} - {200, 201} == {r.class_id for r in ngram_join.classes(good).collect()}
    cut = stage["substring dedup"](spark, one, "").cache()
    assert cut.columns == docs.columns
    words = {r.doc_id: len(r.text.split()) for r in cut.collect()}
    assert words == {r.doc_id: r.n_words - r.n_removed for r in substring_dedup.dedup(one).collect()} and words[203] == words[204] == 90
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = stage["mixing sources to target weights"](spark, cut, "").cache()
    assert mixed.columns == docs.columns and abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * sum(words.values())) < 0.02 * sum(words.values())
    ids = stage["SentencePiece encoding and decoding"](spark, mixed, "")
    assert ids.count() == mixed.count()
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, odd, "").columns == odd.columns, name


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.columns == ["doc_id", "lang", "source", "n_ids", "ids"]
