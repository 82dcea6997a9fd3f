"""Index and search against a plain-Python model; segments; sources; streaming."""

import bz2
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumidex.functions import scalar as S
from lumidex.functions.analysis import analyzer, register_analyzer, text_analyzer
from lumidex.operators import fields as f
from lumidex.operators.fields import postings, text
from lumidex.operators.index import ConcurrentChange, Index, Store, merge
from lumidex.operators.matching import fuzzy_terms
from lumidex.operators.tables import numbered
from lumidex.plans.compile import Keyword, Range, SimpleQuery
from lumidex.plans.search import Reader, SearchConfig, Searcher
from lumidex.sources.pages import read_mediawiki, read_ndjson, write_ndjson
from lumidex.streaming.incremental import index_stream

SPECS = [f.text("body"), f.text("title"), f.keyword("tag"), f.integer("size")]
VOCABULARY = ["fox", "cat", "owl", "elk", "bee"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pick = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    return [(f"d{i:02}", pick(rng.randrange(12)) or None, pick(rng.randrange(3)) or None, rng.choice(["x", "y", None]), rng.choice([None, 1, 2, 3, 4, 9]), i) for i in range(60)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, body string, title string, tag string, size long, n long")


@pytest.fixture(scope="module")
def index(frame):
    return Index.of(frame, "id", SPECS, F.col("n"))


class Model:
    """Postings as dictionaries: field -> value -> {doc: tf}."""

    def __init__(self, rows):
        self.post, self.dl, self.n = defaultdict(lambda: defaultdict(dict)), defaultdict(dict), len(rows)
        for doc, (_, body, title, tag, size, _) in enumerate(rows):
            for name, values in (("body", (body or "").split()), ("title", (title or "").split()), ("tag", [tag] if tag else []), ("size", [size] if size is not None else [])):
                if values:
                    self.dl[name][doc] = len(values)
                for v, c in Counter(values).items():
                    self.post[name][v][doc] = c

    def hits(self, c):
        """(field, value) pairs of a clause."""
        if isinstance(c, Keyword):
            return [(n, c.value) for n in ([c.field] if c.field else self.post) if c.value in self.post[n]]
        low = lambda v: c.low is None or v > c.low or v == c.low and c.closed in ("low", "both")
        high = lambda v: c.high is None or v < c.high or v == c.high and c.closed in ("high", "both")
        return [(c.field, v) for v in self.post[c.field] if low(v) and high(v)]

    def docs(self, c):
        return {d for n, v in self.hits(c) for d in self.post[n][v]}

    def filter(self, q, every_field=True):
        if q.must:
            out = set(range(self.n))
            for c in q.must:
                fields = {n for n, _ in self.hits(c)}
                if not fields:
                    return set()
                groups = [{d for n, v in self.hits(c) if n == g for d in self.post[n][v]} for g in fields]
                for g in groups if every_field else [set().union(*groups)]:
                    out &= g
        else:
            out = set().union(*[self.docs(c) for c in q.should]) if q.should else set()
        return out - set().union(*[self.docs(c) for c in q.must_not]) if q.must_not else out

    def bm25(self, q, docs, k1=1.2, b=0.75):
        out = dict.fromkeys(docs, 0.0)
        for c in [*q.must, *q.should]:
            for n, v in self.hits(c):
                total, df = len(self.dl[n]), len(self.post[n][v])
                idf = math.log(1 + (total - df + 0.5) / (df + 0.5))
                avg = sum(self.dl[n].values()) / total
                for d, tf in self.post[n][v].items():
                    if d in out:
                        out[d] += c.boost * idf * (k1 + 1) * tf / (tf + k1 * (1 - b) + self.dl[n][d] * k1 * b / avg)
        return out


def random_query(rng):
    def clause():
        if rng.random() < 0.2:
            lo, hi = rng.choice([None, 1, 2, 3]), rng.choice([None, 2, 4, 99])
            return Range("size", lo, hi, rng.choice(["none", "low", "high", "both"]), rng.choice([1.0, 2.0]))
        return Keyword(rng.choice([*VOCABULARY, "yak"]), rng.choice([None, "body", "title", "nofield"]), rng.choice([0.0, 1.0, 2.5]))

    return SimpleQuery(*[[clause() for _ in range(rng.choice(n))] for n in ((0, 1, 2), (0, 0, 1, 2), (0, 0, 1))])


@pytest.mark.parametrize("seed", range(6))
def test_random_queries_match_the_model(index, rows, seed):
    rng, model = random.Random(seed), Model(rows)
    for scope in ("every_field", "any_field"):
        q, s = random_query(rng), Searcher(index, SearchConfig(must_scope=scope))
        want = model.filter(q, scope == "every_field")
        assert {r.doc_idx for r in s.filter(q).collect()} == want, q
        scores = {r.doc_idx: r.score for r in s.bm25(q).collect()}
        assert scores == pytest.approx(model.bm25(q, want), abs=1e-9), q
        ordered = [r.doc_idx for r in s.resolve(s.bm25(q)).collect()]
        assert [round(scores[d], 9) for d in ordered] == sorted((round(x, 9) for x in scores.values()), reverse=True)


def test_statistics(index, rows):
    model = Model(rows)
    assert {r.field: (r.n_docs, r.total_len) for r in index.stats.collect()} == {n: (len(d), sum(d.values())) for n, d in model.dl.items()}
    assert {(r.field, r.term if r.term is not None else r.num_i): r.df for r in index.lexicon.collect()} == {(n, v): len(d) for n, vs in model.post.items() for v, d in vs.items()}
    assert [r.term for r in index.seek("body", "c", 2).collect()] == ["cat", "elk"]
    assert {r.num_i for r in index.scan("size", 2, 4).collect()} == {2, 3, 4}
    assert {r.field for r in index.point("fox").collect()} == {"body", "title"}


def test_custom_parameters_and_candidates(spark, index, rows):
    model, q = Model(rows), SimpleQuery([Keyword("fox", "body"), Keyword("owl", "body", 3.0)])
    got = {r.doc_idx: r.score for r in Searcher(index, SearchConfig(k1=2.0, b=0.2)).bm25(q).collect()}
    assert got == pytest.approx(model.bm25(q, model.filter(q), 2.0, 0.2))
    some = spark.createDataFrame([(i,) for i in range(20)], "doc_idx long")
    got = {r.doc_idx: r.score for r in Searcher(index).bm25(q, some).collect()}
    assert got == pytest.approx(model.bm25(q, set(range(20)))) and 0.0 in got.values()
    near = {r.doc_idx: r.score for r in Searcher(index, SearchConfig(approximate_ln=True)).bm25(q).collect()}
    assert near == pytest.approx(model.bm25(q, model.filter(q)), rel=0.05)


def test_field_order(index, rows):
    s = Searcher(index)
    found = s.filter(SimpleQuery([Keyword("fox")]))
    want = sorted((r[4], i) for i, r in enumerate(rows) if r[4] is not None and "fox" in f"{r[1]} {r[2]}")
    n = found.count()
    got = s.field_score("size", found).collect()
    assert len(got) == n and [r.doc_idx for r in sorted(got, key=lambda r: -r.score) if r.score > 0] == [i for _, i in want]
    assert sorted((r.score for r in got if r.score > 0), reverse=True) == [float(n - k) for k in range(len(want))]
    assert s.field_score("nofield", found).collect() == []


def test_multivalued_fields_sort_by_the_least_value(spark):
    df = spark.createDataFrame([("a", [5, 9], ["p", "q q"]), ("b", [7], ["q"]), ("c", [1, 8, 8], None)], "id string, size array<long>, body array<string>")
    ix = Index.of(df, "id", [f.integer("size"), f.text("body")], F.ascii("id").cast("long"))
    s = Searcher(ix)
    got = s.resolve(s.field_score("size", ix.documents.select("doc_idx"))).collect()
    assert [(chr(r.doc_idx), r.score) for r in got] == [("c", 3.0), ("a", 2.0), ("b", 1.0)]
    assert {(r.term, chr(r.doc_idx)): (r.tf, r.dl) for r in ix.postings.where("field = 'body'").collect()} == {("p", "a"): (1, 3), ("q", "a"): (2, 3), ("q", "b"): (1, 1)}


def test_paging(index):
    r = Reader(index, "en", "body")
    whole = [x.doc_id for x in r.query_string("fox owl").collect()]
    assert len(whole) > 20 and [x.doc_id for x in r.query_string("fox owl", reverse=True).collect()] == whole[::-1]
    assert [x.doc_id for x in r.query_string("fox owl", skip=3, limit=5).collect()] == whole[3:8]
    assert r.query_string("fox owl", skip=10_000).collect() == [] and r.query_string("").collect() == [] and r.query_string("-fox").collect() == []
    assert r.query_string("fox;0").collect() == []
    assert r.searcher.count(r.compile("fox owl")).first()[0] == len(whole)


def brute_distance(a, b):
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_byte_edits(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abñ") for _ in range(rng.randrange(7))) for _ in range(60)] + ["más", "mas", "x" * 59, "x" * 60]
    df = spark.createDataFrame([(a, b) for a in words for b in words[::7] + ["x" * 60, "mas"]], "a string, b string")
    for k in (0, 1, 2, 3):
        for r in df.select("a", "b", S.levenshtein_match(F.col("a"), F.col("b"), k).alias("m")).collect():
            assert r.m == (brute_distance(r.a, r.b) <= k and max(len(r.a.encode()), len(r.b.encode())) < 60), (r, k)
    assert not df.select(S.levenshtein_match(F.col("a"), F.col("b"), 4).alias("m")).where("m").count()


def test_fuzzy_expansion(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(80)})
    ix = Index.of(spark.createDataFrame([(w, w) for w in words], "id string, w string"), "id", [f.keyword("w")])
    for word, k, m in (("ab", 1, 10), ("abca", 2, 4), ("zz", 1, 10), ("cccc", 3, 99)):
        want = [] if word in words else [w for w in words if brute_distance(w, word) <= k][:m]
        assert [r.term for r in fuzzy_terms(ix, word, k, m).orderBy("term").collect()] == want
    assert fuzzy_terms(ix, "ab", 4, 10).collect() == [] and fuzzy_terms(ix, "a" * 60, 1, 10).collect() == []
    q = SimpleQuery([Keyword("zz", None, 1.0, 2)])
    assert Searcher(ix).filter(q).count() == 0 and Searcher(ix, SearchConfig(levenshtein_max_k=2)).filter(q).count() > 0


def test_range_above_the_largest_value(index):
    q = SimpleQuery([Range("size", high=99)])
    assert Searcher(index).filter(q).count() > 0 and Searcher(index, SearchConfig(compat_range_upper=True)).filter(q).count() == 0


def test_segments_equal_one_build(spark, frame, index, tmp_path):
    store = Store(spark, str(tmp_path / "ix"))
    assert store.compact() is None
    with pytest.raises(FileNotFoundError):
        store.open()
    for lo in (0, 25, 26):
        store.append(frame.where((F.col("n") >= lo) & (F.col("n") < {0: 25, 25: 26, 26: 99}[lo])), "id", SPECS, ["n"])
    with pytest.raises(FileNotFoundError):
        store.open(strict=True)
    with pytest.raises(ValueError):
        store.append(frame.limit(1), "id", SPECS, ["n"], on_duplicate="raise")
    with pytest.raises(ValueError):
        store.append(frame.limit(1), "id", SPECS[:1])
    ask = lambda ix: [(r.doc_id, round(r.score, 9)) for r in Reader(ix, "en").query_string("fox;2 +owl size:>2 -tag:x").collect()]
    want = ask(index)
    assert want and ask(store.open()) == want
    before = store.open()
    store.compact()
    assert ask(store.open(strict=True)) == want and ask(before) == want  # readers of the old segments go on
    assert len(store.vacuum()) == 3 and store.vacuum() == [] and ask(store.open()) == want
    assert sorted(r.doc_idx for r in store.open().documents.collect()) == list(range(60))
    assert {r.field for r in store.open().restrict(["tag"]).postings.select("field").distinct().collect()} == {"tag"}
    store.drop()


def test_rows_and_documents_are_never_broadcast(spark, frame, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = numbered(frame.select("id", "n"), "k", [F.col("n")])
    assert "BuildRight" in plan(rows) and "BuildLeft" not in plan(rows) and [r.k for r in rows.orderBy("n").collect()] == list(range(60))
    store = Store(spark, str(tmp_path / "ix"))
    store.append(frame, "id", SPECS, ["n"])
    ix = store.open()
    assert "Broadcast" not in plan(ix.postings.where("term = 'fox'").select("doc_idx").join(ix.documents, "doc_idx"))
    page = plan(Reader(ix, "en").query_string("fox", limit=3))
    assert "SortMergeJoin [doc_idx" not in page.split("Scan parquet")[0]  # a page's few rows go to the documents


def test_texts_are_split_once_and_not_shuffled_by_term(spark, frame, index, tmp_path):
    texts = frame.select(F.col("n").alias("doc_idx"), "body").repartition(3, "doc_idx")
    for name in ("en", "en_stop"):
        plan = postings(texts, [f.text("body", name)])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and "RepartitionByExpression" in plan
    store = Store(spark, str(tmp_path / "ix"))
    store.append(frame, "id", SPECS, ["n"])
    for _ in range(2):  # as appended, and compacted with a second segment
        ix = store.open()
        files = ix.postings.where("field = 'body'").select("doc_idx", F.input_file_name().alias("file")).distinct().groupBy("doc_idx").count()
        assert files.where("count > 1").count() == 0 and files.count() > 0
        n = store.catalog()["docs"] // 60
        assert {r.field: (r.n_docs, r.total_len) for r in ix.stats.collect()} == {r.field: (r.n_docs * n, r.total_len * n) for r in index.stats.collect()}
        assert sorted(map(repr, ix.lexicon.withColumn("df", F.col("df") / n).collect())) == sorted(map(repr, index.lexicon.withColumn("df", F.col("df") / 1).collect()))
        store.append(frame, "id", SPECS, ["n"])
        store.compact()


def test_merge_shifts_and_adds(spark, frame, index):
    halves = [Index.of(frame.where(c), "id", SPECS, F.col("n") % 30) for c in ("n < 30", "n >= 30")]
    both = merge(*halves)
    assert {r.doc_id: r.doc_idx for r in both.documents.collect()} == {r.doc_id: r.doc_idx for r in index.documents.collect()}
    key = lambda ix: sorted(map(repr, ix.stats.select("field", "n_docs", "total_len", "avgdl").collect()))
    assert key(both) == key(index)
    assert sorted(map(repr, both.lexicon.collect())) == sorted(map(repr, index.lexicon.collect()))
    empty = Index.of(frame.limit(0), "id", SPECS, F.col("n"))
    assert merge(empty, index).documents.count() == 60


def test_writers_side_by_side_lose_nothing(spark, frame, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, str(tmp_path / "ix"))
    parts = [frame.where((F.col("n") >= lo) & (F.col("n") < lo + 15)) for lo in range(0, 60, 15)]
    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(lambda p: Store(spark, str(tmp_path / "ix")).append(p, "id", SPECS, ["n"]), parts))
    c = store.catalog()
    assert sorted(s["name"] for s in c["segments"]) == sorted(names) and c["docs"] == 60
    assert sorted(r.doc_idx for r in store.open().documents.collect()) == list(range(60))


def test_a_change_needs_the_newest_catalog(spark, frame, tmp_path):
    store = Store(spark, str(tmp_path / "ix"))
    store.append(frame.where("n < 30"), "id", SPECS, ["n"], batch=0)
    old = store.catalog()
    assert store.append(frame.where("n < 30"), "id", SPECS, ["n"], batch=0) is None  # a batch that is replayed
    store.append(frame.where("n >= 30"), "id", SPECS, ["n"], batch=1)
    with pytest.raises(ConcurrentChange):
        store._save(old)
    (tmp_path / "ix" / ".catalog-dead").write_text("{")  # a writer that died before its rename
    assert store.catalog()["stream"] == 1 and store.open().documents.count() == 60
    for _ in range(Store.KEEP + 3):
        store._save(store.catalog())
    assert len(list((tmp_path / "ix").glob("catalog-*.json"))) == Store.KEEP and store.open().documents.count() == 60


def test_analysers_of_ones_own(spark, tmp_path):
    register_analyzer("by_comma", lambda c: F.split(F.upper(c), ","), lambda s: s.upper().split(","))
    text_analyzer("en_few", "en", ["fox"])
    with pytest.raises(ValueError):
        register_analyzer("en", lambda c: c, list)
    with pytest.raises(KeyError):
        analyzer("unheard-of")
    df = spark.createDataFrame([("1", "red,big,,red", "the foxes run"), ("2", "small", "a fox"), ("3", None, "dogs")], "id string, tags string, body string")
    store = Store(spark, str(tmp_path / "ix"))
    store.append(df, "id", [text("tags", "by_comma"), text("body", "en_few")], ["id"])
    index = store.open()
    got = {(r.field, r.term, r.doc_idx): (r.tf, r.dl) for r in index.postings.collect()}
    assert got == {
        ("tags", "RED", 0): (2, 3), ("tags", "BIG", 0): (1, 3), ("tags", "SMALL", 1): (1, 1),
        ("body", "the", 0): (1, 2), ("body", "run", 0): (1, 2), ("body", "a", 1): (1, 1), ("body", "dog", 2): (1, 1),
    }
    with Reader(index, "en_few") as reader:
        assert [r.doc_id for r in reader.query_string('tags:"red"').collect()] == ["1"]
        assert reader.reset(store.open()).query_string("+dogs").count() == 1


def test_invalid_bytes_do_not_end_a_scan(spark, tmp_path):
    import base64
    import json

    rows = [(1, b"caf\xe9", b"\xff\xfe ok"), (2, "Größe".encode(), b"")]
    (tmp_path / "p.json").write_text("".join(json.dumps({"Id": i, "Title": base64.b64encode(t).decode(), "Content": base64.b64encode(c).decode()}) + "\n" for i, t, c in rows) + '{"Id": 3, "Title": "%%%", "Content": null}\n')
    got = {r.id: (r.title, r.content) for r in read_ndjson(spark, str(tmp_path / "p.json")).collect()}
    assert got[2] == ("Größe", "") and got[1][0].startswith("caf") and got[1][1].endswith(" ok") and got[3] == (None, None)


def test_sources(spark, tmp_path):
    pages = spark.createDataFrame([(1, "Ünï", "text\nof one"), (2, "b", "")], "id long, title string, content string")
    write_ndjson(pages, str(tmp_path / "p"))
    (tmp_path / "p" / "bad.json").write_text("{not json\n\n" + '{"Id": 3, "Title": "' + "x" * 6_000_000 + '"}\n')
    assert sorted(map(tuple, read_ndjson(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, pages.collect()))
    page = "<page><title>T{0}</title><id>{0}</id><revision><id>7</id><text>old</text></revision><revision><text>new {0}</text></revision></page>"
    xml = "<mediawiki>" + "".join(page.format(i) for i in (1, 2)) + "<page><title>none</title><id>3</id></page></mediawiki>"
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert sorted(map(tuple, read_mediawiki(spark, str(tmp_path / "dump.xml.bz2")).collect()), key=repr) == [(1, "T1", "new 1"), (2, "T2", "new 2"), (3, "none", None)]


def test_streams_become_segments(spark, frame, tmp_path):
    source = tmp_path / "in"
    store = Store(spark, str(tmp_path / "ix"))
    for k in (0, 1):
        frame.where(F.col("n") % 2 == k).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(frame.schema).parquet(str(source))
        index_stream(stream, store, "id", SPECS, str(tmp_path / "check"), compact_every=3).awaitTermination()
    assert len(store.catalog()["segments"]) == 2 and store.open().documents.count() == 60
    assert Reader(store.open(), "en").query_string("fox").count() > 0


def test_sortable_encodings(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 500, -500]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", S.sortable_int(F.col("v")).alias("b"))
    assert [r.v for r in df.orderBy("b").collect()] == sorted(values) and df.where(S.sortable_int_back(F.col("b")) != F.col("v")).count() == 0


def test_fast_ln(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1.5, 2, 3, 10, 1e6)], "v double").select("v", S.fast_ln(F.col("v")).alias("x"))
    assert all(abs(r.x - math.log(r.v)) < 0.02 for r in df.collect())
