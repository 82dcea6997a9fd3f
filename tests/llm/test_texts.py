"""Operators on texts against brute force, on odd rows and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumidex.llm import _words as W
from lumidex.llm import language_id, ngram_join, quality_lm, quality_rules, sentencepiece_scan, source_mix, substring_dedup, token_store
from lumidex.llm._shared import pick
from lumidex.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, SP = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def pairs(df):
    return [tuple(r) for r in pick(df, "doc_id", "text").collect()]


@given(st.lists(st.text(st.sampled_from("ab é中\n\t\x0b\u00a0🙂"), max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_scan_finds_the_words(texts):
    found = {}
    for w in W.scan(pa.array(texts, pa.string()), block=16):
        for d in range(w.n_docs):
            lo, hi = w.bounds[d], w.bounds[d + 1]
            found[w.first + d] = [bytes(w.data[s:e]).decode() for s, e in zip(w.start[lo:hi], w.end[lo:hi])]
    assert [found[i] for i in range(len(texts))] == [WORD.findall(t) for t in texts]


def test_a_word_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 64)
    texts = ["a " + "x" * 500 + " b", "y" * 300, "z " * 200]
    got = [bytes(w.data[s:e]).decode() for w in W.scan(pa.array(texts)) for s, e in zip(w.start, w.end)]
    assert got == [x for t in texts for x in WORD.findall(t)]


# --- quality rules


def brute_stats(t):
    ws = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    c, cover = Counter(tri), set()
    for i, k in enumerate(tri):
        if c[k] > 1:
            cover |= {i, i + 1, i + 2}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def brute_base(s):
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


def test_quality_statistics(odd_rows, docs):
    texts = [r[1] for r in odd_rows] + [t for _, t in pairs(docs)] + ["x\nx\n\nx\n", "\n", "a b c a b c", "$ <b> |"]
    assert [tuple(x) for x in quality_rules.text_stats(pa.array(texts)).tolist()] == [brute_stats(t) for t in texts]


def test_quality_rules_judge_every_row(odd):
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        s = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == brute_base(s) and not (r.base_failed and r.kept)
        assert r.base_failed == (r.distance2 is None)
    assert sorted(map(repr, ((r.doc_id, r.n_words) for r in got))) == sorted(map(repr, ((i, brute_stats(t)[0]) for i, t in pairs(odd))))


def _vectors(stats):
    n, wc, sy, dl, rw = (np.array(x, dtype=float) for x in zip(*stats))
    return np.stack([np.log(wc / n), np.log1p(100 * sy / wc), np.log1p(dl), np.log1p(100 * rw / n), np.log(n)], axis=1)


def brute_mcd(x):
    """Regularised MCD as the module describes it, with the same bins; returns n, centre and scatter."""
    q = quality_rules
    floor = np.diag([f * f for _, _, f in q.VECTOR])
    far = lambda m, inv: np.maximum(np.einsum("ij,jk,ik->i", x - m, inv, x - m), 0)
    med = np.sort(x, axis=0)[(len(x) - 1) // 2]
    mad = np.sort(np.abs(x - med), axis=0)[(len(x) - 1) // 2]
    best = None
    for m, inv in ((med, np.diag(1 / ((1.4826 * mad) ** 2 + np.diag(floor)))), (x.mean(axis=0), np.linalg.inv(np.cov(x.T, bias=True) + floor))):
        for _ in range(q.C_STEPS):
            d = far(m, inv)
            cell = np.minimum(np.floor(np.log2(d + 2.0**-16) * q.PER_OCTAVE) + 16 * q.PER_OCTAVE, q.BINS - 1)
            use = cell <= np.sort(cell)[int(np.ceil(q.H * len(x))) - 1]
            cov = q.H / q.chi2_cdf(q.chi2_quantile(q.H, q.DIM), q.DIM + 2) * np.cov(x[use].T, bias=True) + floor
            m, inv = x[use].mean(axis=0), np.linalg.inv(cov)
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], m, inv
    limit = q.chi2_quantile(0.975, q.DIM)
    use = far(*best[1:]) <= limit
    if not use.any():
        use[:] = True
    return len(x), x[use].mean(axis=0), 0.975 / q.chi2_cdf(limit, q.DIM + 2) * np.cov(x[use].T, bias=True)


def brute_distances(rows):
    """rows: (vector, lang, source).  Squared distances from estimates shrunk towards the language's and that of all."""
    q = quality_rules
    x = np.array([r[0] for r in rows])

    def lean(a, b):
        w, off = a[0] / (a[0] + q.SHRINK), a[1] - b[1]
        return a[0], w * a[1] + (1 - w) * b[1], w * a[2] + (1 - w) * b[2] + w * (1 - w) * np.outer(off, off)

    floor = np.diag([f * f for _, _, f in q.VECTOR])
    top = brute_mcd(x)
    top = lean(top, (0, top[1], q.WIDE**2 * floor))
    out = np.zeros(len(rows))
    for lang in {r[1] for r in rows}:
        of = lean(brute_mcd(x[[r[1] == lang for r in rows]]), top)
        for source in {r[2] for r in rows if r[1] == lang}:
            here = np.array([r[1:] == (lang, source) for r in rows])
            _, m, cov = lean(brute_mcd(x[here]), of)
            out[here] = np.einsum("ij,jk,ik->i", x[here] - m, np.linalg.inv(cov + floor), x[here] - m)
    return out


def test_outliers_match_brute_force(spark):
    """Groups from two documents to a hundred and fifty; some documents of each larger one are junk."""
    rng = np.random.default_rng(1)
    rows = []
    for lang, source, n in (("en", "a", 150), ("en", "b", 20), ("de", "c", 10), ("de", "d", 9), ("fr", None, 2), (None, "a", 60)):
        for i in range(n):
            ws = [f"w{rng.integers(3000)}" for _ in range(int(rng.integers(60, 400)))]
            if i % 9 == 4:
                ws = [w + "$$$&&&" for w in ws]
            rows.append((len(rows), " ".join(ws), lang, source, i % 9 == 4))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    vectors = _vectors([brute_stats(r[1]) for r in rows])
    cutoff = quality_rules.chi2_quantile(1 - quality_rules.ALPHA, quality_rules.DIM)
    for r, d in zip(rows, brute_distances([(v, *r[2:4]) for v, r in zip(vectors, rows)])):
        assert got[r[0]].distance2 == pytest.approx(d, rel=0.05, abs=0.05)
        assert got[r[0]].kept == (got[r[0]].distance2 <= cutoff)
    assert {i for i, r in got.items() if not r.kept} == {r[0] for r in rows if r[4]}
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


# --- substring dedup


def brute_dedup(texts, window):
    ws = [WORD.findall(t or "") for t in texts]
    c = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if c[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substring_dedup(odd, docs, hot):
    for df in (odd, docs):
        rows = pairs(df)
        want = Counter((i, *x) for (i, _), x in zip(rows, brute_dedup([t for _, t in rows], 35)))
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, hot=hot).collect()) == want


def test_substring_dedup_small_windows(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") * (1 + rng.randrange(2)) for _ in range(rng.randrange(60)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4096, 2):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, window=7, m=3, hot=hot).collect()}
        assert got == {i: x for (i, _), x in zip(rows, brute_dedup([t for _, t in rows], 7))}


def test_colliding_hashes_are_no_repeats(monkeypatch):
    """With all word hashes equal, only the strings decide."""
    monkeypatch.setattr(W, "span_hashes", lambda data, s, e, base=0: np.ones(len(s), dtype=np.uint64))
    packed = [b"a b c d", b"a b x d", b"q a b c"]
    got = substring_dedup.count_bucket(np.zeros(3, np.int64), packed, 3)
    assert got.tolist() == [True, False, False, False, False, True]


def test_a_text_of_many_copies_gathers_its_keys_once(spark):
    base = "w" + " w".join(map(str, range(400)))
    docs = spark.range(0, 100_000, 1, 8).selectExpr("id doc_id", f"'{base}' text").unionByName(spark.createDataFrame([(-1, base[:1500] + " own tail")], "doc_id long, text string"))
    light = substring_dedup._keyed(docs, "text", 35, 8).where("key is not null").select("key", "t1").cache()
    assert light.count() < 9 * 400  # a task lists a text once
    every = light.unionByName(light).unionByName(light)
    longest = substring_dedup._shared_minimisers(every, 4096).selectExpr("max(size(keys)) n").first().n
    assert longest <= light.select("key").distinct().count()
    got = substring_dedup.dedup(docs).groupBy("n_words", "n_removed").count().collect()
    cut = base[:1500].split()
    assert {(r.n_words, r.n_removed, r["count"]) for r in got} == {(400, 400, 100_000), (len(cut) + 2, len(cut) - (cut[-1] != base.split()[len(cut) - 1]), 1)}


def test_strip_keeps_columns_and_untouched_texts(odd):
    out = substring_dedup.strip(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = [r[1] for r in out.collect()]
    assert Counter(t is None for t in texts) == Counter(t is None for _, t in pairs(odd))
    assert "x" * 200_000 in texts and " \t\n " in texts


# --- near duplicates


def brute_links(rows, n=3, threshold=0.5):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return sets, [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]


def brute_classes(rows):
    sets, links = brute_links(rows)
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    degree = Counter()
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
        top[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in members[find(i)] if rows[j][0] is not None]
        out.append((doc, min(ids) if ids else None, degree[i], len(members[find(i)])))
    return out


def test_near_duplicates(odd, docs):
    for df in (odd, docs):
        rows = pairs(df)
        got = Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in ngram_join.classes(df, degrees=True).collect())
        assert got == Counter(brute_classes(rows))
        got = Counter((r.doc_id, r.class_id, r.class_size) for r in ngram_join.classes(df).collect())
        assert got == Counter((i, c, n) for i, c, _, n in brute_classes(rows))


def test_near_duplicates_recall_near_the_threshold(spark):
    import random

    rng = random.Random(4)
    rows = []
    for g in range(60):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(150)]
        for c in range(3):
            own = [w if rng.random() > 0.05 * c else f"n{rng.randrange(10**9)}" for w in base]
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, links = brute_links(rows)
    found = sum(r.n_links for r in ngram_join.classes(df, degrees=True).collect()) / 2
    assert len(links) > 80 and 0.93 * len(links) <= found <= len(links)


def test_split_buckets_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 4)
    monkeypatch.setattr(ngram_join, "SHINGLES", 300)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in ngram_join.classes(df, degrees=True).collect()) == Counter(brute_classes(rows))
    assert {(r.class_id, r.class_size) for r in ngram_join.classes(df).collect()} == {(0, 40)}


def cluster(rng, name, size, words, edits):
    """Texts that share most words; each has ``edits`` of its own."""
    base = [f"{name}w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for at in rng.sample(range(words), edits):
            own[at] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_prefixes_are_shortened_as_the_data_need(spark):
    import random

    rng = random.Random(8)
    close = [t for g in range(80) for t in cluster(rng, f"c{g}", 2, 150, 1)]
    loose = [t for g in range(80) for t in cluster(rng, f"l{g}", 2, 150, 7)]
    depth = {}
    for name, texts in (("close", close), ("loose", loose)):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows, nodes = ngram_join._nodes(df, "doc_id", "text", 3)
        found, _, depth[name], recall = ngram_join.matched_links(df, nodes, "text", 0.5, 0.98, 3)
        _, links = brute_links(list(enumerate(texts)))
        assert len(links) > 70 and recall >= 0.98 and found.count() >= 0.95 * len(links)
    assert depth["close"] == ngram_join.DEPTH > depth["loose"]


def test_a_cluster_costs_no_pairs_of_all_its_texts(spark):
    import random

    texts = cluster(random.Random(3), "k", 400, 120, 2) + ["alone " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.classes(df).collect()
    assert {(r.class_id, r.class_size) for r in got if r.doc_id < 400} == {(0, 400)}
    assert sum(r.n_links for r in got) / 2 < 400 * 30 < 400 * 399 / 2


@pytest.mark.parametrize("bucket", [3, 4096])
def test_classes_that_meet_in_a_run_are_joined(spark, monkeypatch, bucket):
    """Chains of small steps: neighbours are linked, ends are not, so no run's least node links to all."""
    import random

    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    rng = random.Random(6)
    rows = []
    for c in range(6):
        words = [f"h{c}w{i}" for i in range(240)]
        for k in range(12):
            rows.append((len(rows), " ".join(words[k * 12 : k * 12 + 100])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in ngram_join.classes(df).collect()) == Counter((i, c, n) for i, c, _, n in brute_classes(rows))


def test_links_that_the_forest_leaves_out_are_found(spark, monkeypatch):
    """Links right at the threshold among so many close ones that the forest's recall looks met."""
    monkeypatch.setattr(ngram_join, "BUCKET", 3)
    split = []
    hot = ngram_join._hot
    monkeypatch.setattr(ngram_join, "_hot", lambda *args: split.append(1) or hot(*args))
    texts = []
    for g in range(400):
        base = [f"c{g}w{i}" for i in range(40)]
        texts += [base, [*base[:39], "x"]]
    for g in range(12):
        base = [f"l{g}w{i}" for i in range(38)]
        texts += [base, [*base[:26], *[f"o{g}w{i}" for i in range(12)]]]  # 24 of 48 shingles
    base = [f"b{i}" for i in range(60)]
    texts += [[*base[:i], f"y{i}", *base[i + 1 :]] for i in range(0, 60, 7)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert sum(n == 1 for _, _, n, _ in want) == 824
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in ngram_join.classes(df).collect()) == Counter((i, c, n) for i, c, _, n in want)
    assert Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in ngram_join.classes(df, degrees=True).collect()) == Counter(want)
    assert split


def test_the_query_counts_all_links(spark, docs):
    from lumidex.llm.queries import QUERIES

    got = QUERIES["op10_ngram_join"](spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got) == Counter(brute_classes(pairs(docs)))


def test_no_text_is_shuffled(spark):
    """The texts are much larger than what is known of them; pairs of them are far too many to be broadcast."""
    import random

    rng = random.Random(9)
    rows = []
    for g in range(60):
        base = [f"{rng.getrandbits(1600):x}" for _ in range(200)]
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join([*base[:50], "x", *base[51:]])), (3 * g + 2, " ".join(f"{rng.getrandbits(1600):x}" for _ in range(200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    try:
        got = ngram_join.classes(df, degrees=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    df.unpersist()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got) == Counter(brute_classes(rows))
    assert 0 < written() - before < sum(len(t) for _, t in rows) / 4


def test_texts_like_no_other_send_no_shingles(spark, monkeypatch):
    import random

    rng = random.Random(10)
    sent = []
    shared = ngram_join._shared
    monkeypatch.setattr(ngram_join, "_shared", lambda prefixes, threshold: sent.append(prefixes.selectExpr("coalesce(sum(length(z)), 0) n").first().n) or shared(prefixes, threshold))
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(130))) for i in range(1000)]  # shingles: just under a power of 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.class_id == r.doc_id, r.n_links) for r in ngram_join.classes(df, degrees=True).collect()} == {(True, 0)}
    assert len(sent) == 1 and sent[0] < 1000


def test_one_of_each_class_stays(odd, docs):
    for df in (odd, docs):
        rows = pairs(df)
        kept = ngram_join.keep_one(df)
        assert kept.columns == df.columns
        classes = brute_classes(rows)
        groups = {(c, n) for (_, c, _, n), (_, t) in zip(classes, rows) if t and t.strip() and c is not None}
        wordless = sum(1 for _, t in rows if not (t and t.strip()))
        loose = sum(1 for (_, c, _, n), (_, t) in zip(classes, rows) if t and t.strip() and c is None) > 0
        assert kept.count() == len({c for c, _ in groups}) + wordless + loose


def test_recall_estimate():
    assert ngram_join.recall_of([(1.0, 10**6)], 4, 0.5) > 0.999 > ngram_join.recall_of([], 3, 0.5) > 0.95 > ngram_join.recall_of([(0.5, 100)], 4, 0.5)
    m = np.random.default_rng(1).integers(0, 1 << 32, (ngram_join.TREES * ngram_join.DEPTH, 2), dtype=np.uint32)
    m[:2, 1] = m[:2, 0]
    hi, lo = ngram_join._labels(m)[:, 0, :].T
    assert ngram_join._common(hi, lo).tolist() == [2]
    m[2, 1] = m[2, 0]
    assert ngram_join._common(*ngram_join._labels(m)[:, 0, :].T).tolist() == [3]


# --- mixing


def brute_targets(sizes):
    keys = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[k] for k in keys if k not in full)
        level = (total - sum(2 * sizes[k] for k in full)) / free if free else 0
        new = {k for k in keys if k not in full and level * weight[k] > 2 * sizes[k]}
        if not new:
            return {k: float(2 * sizes[k]) if k in full else level * weight[k] for k in keys}
        full |= new


@pytest.mark.parametrize("block", [source_mix.BLOCK, 16])
def test_mix(odd, docs, block, monkeypatch):
    monkeypatch.setattr(source_mix, "BLOCK", block)
    monkeypatch.setattr(source_mix, "FAN", 3 if block == 16 else 1000)
    for df in (odd, docs):
        rows = [(r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in pick(df, "doc_id", "text", "source").collect()]
        sizes = Counter()
        for _, n, s in rows:
            sizes[s] += n
        want = brute_targets(sizes)
        got = source_mix.mix(df).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, source_mix.mix(df).collect()))
        assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((i, n, sizes[s]) for i, n, s in rows)
        taken, by_target = Counter(), defaultdict(set)
        for r in got:
            assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
            taken[(r.source_size, r.target)] += r.taken
        for s, n in sizes.items():
            by_target[n].add(round(want[s], 6))
        assert all(round(t, 6) in by_target[n] for n, t in taken)
        if df is docs:
            for (n, t), k in taken.items():
                longest = max(r["size"] for r in got if r.source_size == n)
                assert abs(k - t) <= (longest if block == 16 else 0.05 * t + 20)


def test_equal_rows_spread_over_blocks(spark):
    rows = spark.range(0, 100_000, 1, 8).selectExpr("cast(null as long) doc_id", "'a b c' text", "'s' source")
    rows = rows.unionByName(spark.range(20_000).selectExpr("id doc_id", "concat('a b ', id % 5) text", "'t' source"))
    sized, n, _ = source_mix._sized(rows, "doc_id", "text", "source", ["doc_id", "source"], None)
    assert n == 120_000 and sized.groupBy("_h").count().selectExpr("max(count) m").first().m <= 8
    first, again = (sorted(map(repr, source_mix.mix(rows).collect())) for _ in range(2))
    assert first == again
    got = source_mix.mix(rows).groupBy("source_size", "target").sum("taken").collect()
    assert len(got) == 2 and all(abs(r["sum(taken)"] - r.target) <= 3 for r in got)


def test_landing_is_balanced(spark):
    rows = [(i, "w " * (50 + i * 37 % 400), "s") for i in range(300)] + [(1000 + i, "w " * 90, "t") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(lambda: [0, 0.0])
    for r in source_mix.mix(df).collect():
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    assert all(abs(k - t) <= 90 for k, t in by.values())
    out = source_mix.resample(df)
    assert out.columns == df.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(k for k, _ in by.values())


# --- token store


def test_token_store(spark, odd, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    for df in (odd, docs):
        rows = pairs(df)
        ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x in rows]
        got = token_store.digest_rows(df, BPE).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids))
        got.sort(key=lambda r: r.start)
        known = [r.doc_id for r in got if r.doc_id is not None]
        assert known == sorted(known) and [r.doc_id for r in got[: len(got) - len(known)]] == [None] * (len(got) - len(known))
        assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


@given(st.lists(st.text(st.sampled_from("aAéÉ\u0301İſ中 \n\u00a0\u2028'stn't1½<|endoftext|>.,"), max_size=40), max_size=5))
@settings(max_examples=80, deadline=None)
def test_word_encoder_equals_the_library(texts):
    encode = token_store._encoder(BPE)
    got = {}
    for first, ids, bounds in encode(pa.array([*texts, "<|endoftext|> a<|startoftext|>b"], pa.string())):
        for d in range(len(bounds) - 1):
            got[first + d] = ids[bounds[d] : bounds[d + 1]].tolist()
    assert [got[i] for i in range(len(texts) + 1)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, "<|endoftext|> a<|startoftext|>b"]]


def test_words_of_equal_hash_keep_their_own_ids(monkeypatch):
    first = W.span_hashes
    monkeypatch.setattr(W, "span_hashes", lambda data, a, b, base=0, second=False: first(data, a, b, base, second) if second else (b - a).astype(np.uint64))
    encoder = token_store.WordEncoder(BPE)
    texts = ["one two six", "ten one", "quite another text", "six", "", "two"]
    got = {}
    for first_, ids, bounds in encoder(pa.array(texts)):
        for d in range(len(bounds) - 1):
            got[first_ + d] = ids[bounds[d] : bounds[d + 1]].tolist()
    assert got == {i: encoder.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_other_tokenizers_encode_whole_texts(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert token_store.splits_at_space(BPE) and not token_store.splits_at_space(path)
    t, few = Tokenizer.from_file(path), docs.limit(20)
    got = {r.doc_id: r.ids_crc32 for r in token_store.digest_rows(few, path).collect()}
    assert got == {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in pairs(few)}


def test_damage_is_found(spark, docs):
    import glob

    root = token_store.write_store(docs, BPE)
    read = lambda: token_store.read_store(spark, root, token_store.crc32, __import__("pyspark.sql.types").sql.types.LongType(), "c").collect()
    assert len(read()) == docs.count()
    pack = max(glob.glob(f"{root}/packs/*.bin"), key=lambda p: len(open(p, "rb").read()))
    raw = bytearray(open(pack, "rb").read())
    raw[100] ^= 1
    open(pack, "wb").write(raw)
    with pytest.raises(Exception, match="missing or damaged"):
        read()


@given(st.lists(st.integers(0, 40), max_size=3000))
@settings(max_examples=30, deadline=None)
def test_cuts_cover_and_depend_on_content(ids):
    a = np.array(ids, dtype=np.uint16)
    ends = token_store.cuts(a)
    assert ends[-1] == len(a) and all(x < y for x, y in zip(ends, ends[1:])) and all(y - x <= token_store.MAX for x, y in zip([0, *ends], ends))


# --- language


def test_language(odd, docs, spark):
    got = language_id.identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count()
    letters = Counter(bool(re.search(r"[^\W\d_]", t or "")) for _, t in pairs(odd))
    assert Counter(r.lang_pred != "und" for r in rows) == letters and all(r.score == 0 for r in rows if r.lang_pred == "und")


def test_language_backs_off_to_shorter_grams(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the thing there then", "en"), ("der die das dieser", "de")] * 20)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([("theng",), ("diesera",), ("qqq",), ("then",), ("1 2",), (None,)], "text string")
    got = [(r.lang_pred, r.score) for r in language_id.predict(ask, model, []).collect()]
    assert [x for x, _ in got] == ["en", "de", model.langs[0], "en", "und", "und"] and got[2][1] == pytest.approx(0.5)


def test_a_rare_language_keeps_its_words_in_a_huge_corpus(spark, monkeypatch):
    """Counts as of a corpus of 4e9 words: the rare language's words, counted 10 times, stay known."""
    counts = language_id._word_counts
    huge = lambda rows, langs: counts(rows, langs).selectExpr("word", f"c0 * {10**8} AS c0", "c1")
    monkeypatch.setattr(language_id, "_word_counts", huge)
    train = [("the thing there then", "en")] * 11 + [("thena therea", "xx")] * 10
    model = language_id.train(spark.createDataFrame(train, "text string, lang string"))
    assert model.langs == ["en", "xx"]
    keys = [W.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in (b"then", b"thena", b"therea")]
    assert all(language_id.Sharded(model.words).lookup(k)[0].all() for k in keys)
    ask = spark.createDataFrame([("thena",), ("then",)], "text string")
    assert [r.lang_pred for r in language_id.predict(ask, model, []).collect()] == ["xx", "en"]


# --- quality classifier


def brute_kn(texts, order=5):
    """Interpolated modified Kneser-Ney over characters, by dictionaries; a function from text to perplexity."""

    def symbols(t):
        t = re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t).removeprefix(" ")
        points = [p for c in t for p in ([48] if "0" <= c <= "9" else [ord(c)] if ord(c) < 2048 else [2048 + x for x in c.encode()])]
        return [0] * (order - 1) + points + [3]

    def grams(t):
        s = symbols(t)
        return [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]

    counts = {order: Counter(g for t in texts for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc = {n: quality_lm.discounts(*[sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]) for n, c in counts.items()}
    ctx = {n: defaultdict(lambda: [0, 0, 0, 0]) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            x = ctx[n][g[:-1]]
            x[0] += v
            x[min(v, 3)] += 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 4096
        x = ctx[n].get(g[:-1])
        if x is None:
            return p(g[1:])
        c = counts[n].get(g, 0)
        d = disc[n]
        return max(c - (d[min(c, 3) - 1] if c else 0), 0) / x[0] + sum(a * b for a, b in zip(d, x[1:])) / x[0] * p(g[1:])

    return lambda t: float(np.exp(-np.mean([np.log(p(g)) for g in grams(t)])))


def folds(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.select("i", quality_lm._fold(df["text"]).alias("f")).orderBy("i").select("f").collect()]


def test_kneser_ney_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdé中文字🙂"), int(rng.integers(1, 6)))) for _ in range(30)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100, "zzz \t qqq 17", "en"), (101, "abc abd", "en"), (102, "", "en"), (103, None, "en"), (104, "abc", "xx"), (105, "中" * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_lm.classify(df, spark.range(60)).collect()}
    fold = folds(spark, [t for _, t, _ in rows])
    want = {f: brute_kn([t for t, g in zip(texts, fold) if g != f]) for f in "0123"}
    for (i, t, _), f in zip(rows, fold):
        if not t:
            assert got[i].perplexity is None and not got[i].kept
        else:  # other languages are judged by the one there is
            assert got[i].perplexity == pytest.approx(want[f](t), rel=1e-4)
    values = sorted(got[i].perplexity for i in range(60))
    assert all(got[i].threshold == pytest.approx(values[59], rel=0.02) for i in (0, 100, 104, 105))
    assert not got[100].kept and sum(got[i].kept for i in range(60)) >= 58


def test_thresholds_are_shrunk_by_the_number_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(lang, True, float(x), float(2 * x)) for lang, n, at in (("a", 3000, 1.0), ("b", 5, 2.0)) for x in rng.normal(at, 0.1, n)]
    df = spark.createDataFrame([*rows, ("a", False, 9.0, 9.0)], "by string, left_out boolean, ppl double, worst double")
    table, rest = quality_lm.thresholds(df, 0.99)
    got = {r.by: (r.threshold, r.worst_threshold) for r in table.collect()} | {None: rest}
    for k, scale in ((0, 1), (1, 2)):
        a, b = (np.array([scale * x for lang, _, x, _ in rows if lang == name]) for name in "ab")
        off = np.quantile(np.concatenate([a - np.median(a), b - np.median(b)]), 0.99)
        assert got["a"][k] == pytest.approx(np.quantile(a, 0.99), abs=0.01 * scale)
        assert got["b"][k] == pytest.approx(0.2 * b.max() + 0.8 * (np.median(b) + off), abs=0.02 * scale)
        assert got[None][k] == pytest.approx(np.quantile(np.concatenate([a, b]), 0.99), abs=0.01 * scale)


def test_quality_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 1), (None, 1, 0), (6, 1, None), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.id for r in quality_lm.trusted_ids(labels).collect()) == [2, 6]
    got = quality_lm.classify(odd, quality_lm.trusted_ids(labels)).collect()
    assert len(got) == odd.count() and all(r.threshold is None for r in got)
    assert Counter(r.kept for r in got) == Counter(bool((t or "").strip()) for _, t in pairs(odd))


def test_some_bad_words_in_good_prose_are_found(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("aeionrst"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(260)]
    bad = [t.replace(" ", " wuckyqwk ", 1) for t in texts[220:]]  # one word of 150
    rows = [(i, t, "en") for i, t in enumerate([*texts[:220], *bad])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_lm.classify(df, spark.range(200)).collect()}
    assert not any(got[i].kept for i in range(220, 260))
    assert sum(got[i].kept for i in range(200, 220)) >= 17 and sum(got[i].kept for i in range(200)) >= 194


def test_no_row_is_judged_by_what_it_taught(spark):
    rng = np.random.default_rng(9)
    own = ["".join(rng.choice(list("abcdefgh"), 30)) for _ in range(80)]
    rows = [(i, t, "en") for i, t in enumerate(own)] + [(100 + i, "".join(rng.choice(list("abcdefgh"), 30)), "en") for i in range(80)]
    got = quality_lm.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.range(80)).collect()
    mean = lambda lo, hi: np.mean([r.perplexity for r in got if lo <= r.doc_id < hi])
    assert mean(0, 80) == pytest.approx(mean(100, 180), rel=0.05)  # trusted and unknown rows fare alike
    assert sum(r.kept for r in got if r.doc_id < 80) >= 77 and sum(r.kept for r in got if r.doc_id >= 100) >= 74


def test_worst_run():
    rng = np.random.default_rng(10)
    rows = [rng.random(n) for n in (1, 15, 16, 17, 90, 3)]
    n = quality_lm.WINDOW
    want = [max(x[i : i + n].mean() for i in range(max(1, len(x) - n + 1))) for x in rows]
    assert quality_lm._worst(np.concatenate(rows), np.cumsum([0, *map(len, rows)])) == pytest.approx(want)


# --- sentencepiece


@given(st.text(st.sampled_from("abe the  \nié中😀x'1▁"), max_size=60), st.integers(1, 25))
@settings(max_examples=60, deadline=None)
def test_scan_equals_the_library(text, chunk):
    m = sentencepiece_scan.pieces(SP)
    assert sentencepiece_scan.encode_giant(m, text, chunk) == m.sp.encode(text)


@given(st.lists(st.integers(1, 4), min_size=2, max_size=12), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_tree_of_matrices_finds_a_best_path(sizes, seed):
    rng = np.random.default_rng(seed)
    w = [rng.integers(-9, 9, (a, b)).astype(float) for a, b in zip(sizes, sizes[1:])]
    levels = sentencepiece_scan.up(w)
    ends = sentencepiece_scan.down(levels, 0, sizes[-1] - 1)
    assert all(x[1] == y[0] for x, y in zip(ends, ends[1:])) and (ends[0][0], ends[-1][1]) == (0, sizes[-1] - 1)
    best = w[0][:1]
    for m in w[1:]:
        best = sentencepiece_scan.max_plus(best, m)
    assert sum(m[a, b] for m, (a, b) in zip(w, ends)) == best[0, -1] == levels[-1][0][0, -1]


def test_giant_texts_in_levels_of_groups(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "FAN", 3)
    texts = ["Größe naïve 12345 " * 40, "x" * 700, "one two three " * 60, "q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in sentencepiece_scan.encode(df, SP, giant=10, chunk=40).collect()}
    sp = sentencepiece_scan.pieces(SP).sp
    assert got == {i: sp.encode(t) for i, t in enumerate(texts)}


def test_max_plus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.6, 0.0, -np.inf) for s in ((3, 4), (4, 5), (5, 2)))
    f = sentencepiece_scan.max_plus
    assert np.array_equal(f(f(a, b), c), f(a, f(b, c)))


@pytest.mark.parametrize("giant,chunk", [(65_536, 16_384), (300, 100)])
def test_sentencepiece_jobs(odd, giant, chunk):
    sp = sentencepiece_scan.pieces(SP).sp
    rows = pairs(odd)
    got = sentencepiece_scan.digest_rows(odd, SP, giant=giant, chunk=chunk).collect()
    want = [(i, sp.encode(t or "")) for i, t in rows]
    assert Counter((r.doc_id, r.n_ids, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert all(r.round_trip for r in got)
    out = sentencepiece_scan.encode(odd, SP, giant=giant, chunk=chunk)
    assert out.columns == [*odd.columns, "ids"]
    back = sentencepiece_scan.decode(out, SP).collect()
    assert all(r["decoded"] == r[1] if r[1] is not None else r["ids"] is None and r["decoded"] is None for r in back)


# --- empty tables


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        quality_rules.judge(none), quality_rules.keep_good(none), substring_dedup.dedup(none), substring_dedup.strip(none), ngram_join.classes(none), ngram_join.keep_one(none),
        source_mix.mix(none), source_mix.resample(none), token_store.digest_rows(none, BPE), language_id.identify(none), quality_lm.classify(none, quality_lm.trusted_ids(labels)),
        sentencepiece_scan.digest_rows(none, SP), sentencepiece_scan.encode(none, SP),
    ):
        assert out.columns and out.collect() == []
