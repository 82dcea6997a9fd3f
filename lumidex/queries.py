"""Registered queries of the search engine, each with its SQL counterpart for DuckDB.

Corpora: documents (body text, lang and source keywords, n_chars int), part
(several text and keyword fields, ints and floats), orders (dates, floats),
events (times).  Scores are rounded to six places, ties go to the smaller id.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions.analysis import ANALYZERS, ENGLISH_STOPS, SPANISH_STOPS, WORD, date_value, float_value, int_value, register_analyzer, stem_sql, text_analyzer, time_value, tokens_sql
from .operators import fields as f
from .operators.fields import postings
from .operators.index import Index, Store, field_stats, lexicon, merge
from .operators.matching import fuzzy_terms, hits
from .plans.compile import Keyword, Range, SimpleQuery
from .operators.tables import numbered, scratch
from .plans.search import Reader, SearchConfig, Searcher
from .sources.pages import read_mediawiki, read_ndjson, write_ndjson

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TOP = 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


# --- corpora ---------------------------------------------------------------

_PART = [f.text("name", "en", "p_name"), f.keyword("brand", "p_brand"), f.text("type", "en", "p_type"), f.integer("size", "p_size"), f.floating("price", "p_retailprice")]
_DOCS = [f.text("body", "en", "text"), f.keyword("lang"), f.keyword("source"), f.integer("n_chars")]
_EVENTS = [f.keyword("kind", "event_type"), f.time("at", "ts"), f.floating("value")]
_ORDERS = [f.keyword("priority", "o_orderpriority"), f.keyword("status", "o_orderstatus"), f.date("ordered", "o_orderdate"), f.floating("total", "o_totalprice")]


def _spread(df: DataFrame) -> DataFrame:
    """Text analysis is work for all cores, however few files the table has."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


_open: dict[tuple[str, str, str], Index] = {}
_CORPUS = {"part": ("p_partkey", _PART), "documents": ("doc_id", _DOCS), "orders": ("o_orderkey", _ORDERS), "events": ("event_id", _EVENTS)}


def built(spark: SparkSession, sf_dir: str, corpus: str) -> Index:
    """The index of a table: built once a session, in the shared scratch folder, then read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, corpus)
    if key not in _open:
        id_col, specs = _CORPUS[corpus]
        store = Store(spark, scratch(spark))
        store.append(_table(spark, sf_dir, corpus), id_col, specs, [id_col])
        _open[key] = store.open()
    return _open[key]


def _corpus(name: str) -> Callable[..., Index]:
    def get(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> Index:
        index = built(spark, sf_dir, name)
        return index.restrict(only) if only else index

    return get


parts, documents, orders, events = (_corpus(x) for x in ("part", "documents", "orders", "events"))
_CORPORA = {"part": parts, "documents": documents, "orders": orders, "events": events}
_IDS = {"part": "p_partkey", "documents": "doc_id", "orders": "o_orderkey", "events": "event_id"}


def named(index: Index, docs: DataFrame) -> DataFrame:
    """doc_idx replaced by the document's own id."""
    columns = [c for c in docs.columns if c != "doc_idx"]
    return docs.join(index.documents, "doc_idx").select(F.col("doc_id").cast("bigint").alias("id"), *columns)


_NANOS = "CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS BIGINT) * 86400000000000"


def _values_sql(corpus: str, only: tuple[str, ...]) -> str:
    """(id, field, term, num, tf, dl): postings of a corpus; num serves ints, floats and dates."""
    specs = _CORPUS[corpus][1]
    key, out = _IDS[corpus], []
    for s in specs:
        if only and s.name not in only:
            continue
        kind = s.rules.kind
        if kind == "text":
            out.append(
                f"SELECT id, '{s.name}' AS field, term, CAST(NULL AS DOUBLE) AS num, count(*) AS tf, any_value(dl) AS dl FROM "
                f"(SELECT id, unnest(t) AS term, len(t) AS dl FROM (SELECT {key} AS id, {tokens_sql(s.source, 'en', False, 'duckdb')} AS t FROM {corpus})) GROUP BY id, term"
            )
        elif kind == "keyword":
            out.append(f"SELECT {key} AS id, '{s.name}' AS field, {s.source} AS term, CAST(NULL AS DOUBLE) AS num, 1 AS tf, 1 AS dl FROM {corpus} WHERE {s.source} IS NOT NULL")
        else:
            v = {"date": _NANOS.format(s.source), "time": f"epoch_us({s.source}) * 1000"}.get(s.analyzer, s.source)
            out.append(f"SELECT {key} AS id, '{s.name}' AS field, CAST(NULL AS VARCHAR) AS term, CAST({v} AS DOUBLE) AS num, 1 AS tf, 1 AS dl FROM {corpus} WHERE {s.source} IS NOT NULL")
    return " UNION ALL ".join(out)


# --- queries of the ranked kind ----------------------------------------------


def _clause_sql(c: Keyword | Range) -> str:
    if isinstance(c, Keyword):
        v = f"term = '{c.value}'" if isinstance(c.value, str) else f"num = {c.value}"
        return f"(field = '{c.field}' AND {v})" if c.field else f"({v})"
    at = [f"field = '{c.field}'"]
    for bound, strict, loose, ends in ((c.low, ">", ">=", ("both", "low")), (c.high, "<", "<=", ("both", "high"))):
        if bound is not None:
            v = f"'{bound}'" if isinstance(bound, str) else str(bound)
            at.append(f"{'term' if isinstance(bound, str) else 'num'} {loose if c.closed in ends else strict} {v}")
    return "(" + " AND ".join(at) + ")"


def _hits_sql(clauses: list, name: str) -> str:
    if not clauses:
        return f"{name} AS (SELECT id, field, term, num, tf, dl, 0 AS clause, 1.0 AS boost FROM v WHERE false)"
    each = " UNION ALL ".join(f"SELECT id, field, term, num, tf, dl, {i} AS clause, CAST({float(c.boost)} AS DOUBLE) AS boost FROM v WHERE {_clause_sql(c)}" for i, c in enumerate(clauses))
    return f"{name} AS ({each})"


def _filter_sql(q: SimpleQuery, every_field: bool) -> str:
    """CTEs up to c(id): the matching documents."""
    parts_ = [_hits_sql(q.must, "hm"), _hits_sql(q.should, "hs"), _hits_sql(q.must_not, "hn")]
    key = "clause, field" if every_field else "clause"
    if q.must:
        base = (
            f"SELECT id FROM (SELECT DISTINCT id, {key} FROM hm) GROUP BY id HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT {key} FROM hm)) "
            f"AND (SELECT count(DISTINCT clause) FROM hm) = {len(q.must)}"
        )
    else:
        base = "SELECT DISTINCT id FROM hs"
    parts_.append(f"c AS (SELECT id FROM ({base}) WHERE id NOT IN (SELECT id FROM hn))")
    return ", ".join(parts_)


def _bm25_sql(q: SimpleQuery, k1: float, b: float) -> str:
    scored = [c for c in [*q.must, *q.should] if c.boost]
    return (
        f"{_hits_sql(scored, 'h')}, st AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT field, id, dl FROM v) GROUP BY field), "
        "df AS (SELECT field, term, num, count(DISTINCT id) AS df FROM v GROUP BY ALL), "
        "s AS (SELECT h.id, sum(h.boost * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * "
        f"({k1} + 1) * h.tf / (h.tf + {k1} * (1 - {b}) + h.dl * {k1} * {b} / st.avgdl)) AS score "
        "FROM h JOIN st ON h.field = st.field JOIN df ON h.field = df.field AND h.term IS NOT DISTINCT FROM df.term AND h.num IS NOT DISTINCT FROM df.num GROUP BY h.id)"
    )


def ranked(name: str, corpus: str, q: SimpleQuery, only: tuple[str, ...] = (), config: SearchConfig = SearchConfig(), top: int | None = TOP, skip: int = 0, reverse: bool = False, text: str | None = None, sql_query: SimpleQuery | None = None) -> None:
    """Registers a BM25 query; ``text``: run it from the query language (q is what it must compile to)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reader = Reader(_CORPORA[corpus](spark, sf_dir, only), "en", None, config)
        query = reader.compile(text) if text is not None else q
        s = reader.searcher
        scores = s.bm25(query).select("doc_idx", F.round("score", 6).alias("score")).where("score > 0")
        out = s.resolve(scores, reverse)
        out = out.offset(skip) if skip else out
        out = F.broadcast(out.limit(top)) if top else out
        return named(s.index, out)

    o = sql_query or q
    order = "score ASC, id DESC" if reverse else "score DESC, id ASC"
    sql = (
        f"WITH v AS ({_values_sql(corpus, only)}), {_filter_sql(o, config.must_scope == 'every_field')}, {_bm25_sql(o, config.k1 or S.K1, config.b or S.B)} "
        f"SELECT CAST(c.id AS BIGINT) AS id, round(s.score, 6) AS score FROM c JOIN s ON c.id = s.id WHERE round(s.score, 6) > 0 ORDER BY {order}"
    )
    sql += f" LIMIT {top}" if top else ""
    sql += f" OFFSET {skip}" if skip else ""
    _add(name, run, sql)


def matched(name: str, corpus: str, q: SimpleQuery, only: tuple[str, ...] = (), config: SearchConfig = SearchConfig()) -> None:
    """Registers the set of matching documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Searcher(_CORPORA[corpus](spark, sf_dir, only), config)
        return named(s.index, s.filter(q))

    _add(name, run, f"WITH v AS ({_values_sql(corpus, only)}), {_filter_sql(q, config.must_scope == 'every_field')} SELECT CAST(id AS BIGINT) AS id FROM c")


def sorted_by(name: str, corpus: str, field: str, q: SimpleQuery, only: tuple[str, ...] = (), reverse: bool = False) -> None:
    """Registers a query ordered by a field's value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Searcher(_CORPORA[corpus](spark, sf_dir, only))
        scores = s.field_score(field, s.filter(q)).where("score > 0")
        return s.resolve(named(s.index, scores).withColumnRenamed("id", "doc_idx"), reverse).withColumnRenamed("doc_idx", "id")

    v = "num" if field not in ("brand", "lang", "source", "priority", "status", "name", "type", "body", "kind") else "term"
    order = "score ASC, id DESC" if reverse else "score DESC, id ASC"
    sql = (
        f"WITH v AS ({_values_sql(corpus, only)}), {_filter_sql(q, True)}, "
        f"m AS (SELECT v.id, min({v}) AS x FROM v JOIN c ON v.id = c.id WHERE field = '{field}' GROUP BY v.id), "
        "r AS (SELECT id, row_number() OVER (ORDER BY x, id) AS rn FROM m) "
        f"SELECT CAST(id AS BIGINT) AS id, CAST((SELECT count(*) FROM c) - rn + 1 AS DOUBLE) AS score FROM r ORDER BY {order}"
    )
    _add(name, run, sql)


def _k(value: object, field: str | None = None, boost: float = 1.0, fuzzy: int = 0) -> Keyword:
    return Keyword(value, field, boost, fuzzy)


# --- analysers ----------------------------------------------------------------


def _tokens(analyzer: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spread(_table(spark, sf_dir, "documents")).select("doc_id", F.array_join(ANALYZERS[analyzer].column(F.col("text")), " ").alias("tokens"))

    return run


for _lang in ("en", "es"):
    _add(f"tokenize_{_lang}", _tokens(_lang), f"SELECT doc_id, array_to_string({tokens_sql('text', _lang, False, 'duckdb')}, ' ') AS tokens FROM documents")
    _add(f"tokenize_{_lang}_nostop", _tokens(f"{_lang}_stop"), f"SELECT doc_id, array_to_string({tokens_sql('text', _lang, True, 'duckdb')}, ' ') AS tokens FROM documents")

_add(
    "stem_words",
    lambda spark, d: _table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).distinct().select("word", F.expr(stem_sql("word", "en")).alias("en"), F.expr(stem_sql("word", "es")).alias("es")),
    f"SELECT DISTINCT word, {stem_sql('word', 'en', 'duckdb')} AS en, {stem_sql('word', 'es', 'duckdb')} AS es FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS word FROM benchmark)",
)
_add(
    "stopword_counts",
    lambda spark, d: _table(spark, d, "documents").select("lang", F.explode(ANALYZERS["en"].column(F.col("text"))).alias("t")).groupBy("lang").agg(
        F.sum(F.col("t").isin(*sorted(ENGLISH_STOPS)).cast("bigint")).alias("english"), F.sum(F.col("t").isin(*sorted(SPANISH_STOPS)).cast("bigint")).alias("spanish")
    ),
    f"SELECT lang, CAST(sum(CAST(t IN ({', '.join(repr(w) for w in sorted(ENGLISH_STOPS))}) AS INT)) AS BIGINT) AS english, CAST(sum(CAST(t IN ({', '.join(repr(w) for w in sorted(SPANISH_STOPS))}) AS INT)) AS BIGINT) AS spanish "
    f"FROM (SELECT lang, unnest({tokens_sql('text', 'en', False, 'duckdb')}) AS t FROM documents) GROUP BY lang",
)
_add("keyword_tokens", lambda spark, d: _table(spark, d, "part").select("p_partkey", F.array_join(ANALYZERS["keyword"].column(F.col("p_type")), "|").alias("tokens")), "SELECT p_partkey, p_type AS tokens FROM part")
_MIXED = "CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN ' 12 ' WHEN p_partkey % 4 = 2 THEN CAST(p_size AS {0}) ELSE CAST(p_partkey AS {0}) || '.5' END"
_add("int_tokens", lambda spark, d: _table(spark, d, "part").select("p_partkey", int_value(F.expr(_MIXED.format("STRING"))).alias("value")), f"SELECT p_partkey, CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN TRY_CAST(x AS BIGINT) END AS value FROM (SELECT p_partkey, {_MIXED.format('VARCHAR')} AS x FROM part)")
_add(
    "float_tokens",
    lambda spark, d: _table(spark, d, "part").select("p_partkey", float_value(F.expr(_MIXED.format("STRING"))).alias("value")),
    rf"SELECT p_partkey, CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(x AS DOUBLE) END AS value FROM (SELECT p_partkey, {_MIXED.format('VARCHAR')} AS x FROM part)",
)
_DAY = "CASE WHEN o_orderkey % 3 = 0 THEN '2020-02-30' WHEN o_orderkey % 3 = 1 THEN '2020-1-5' ELSE {} END"
_add(
    "date_tokens",
    lambda spark, d: _table(spark, d, "orders").select("o_orderkey", date_value(F.expr(_DAY.format("date_format(o_orderdate, 'yyyy-MM-dd')"))).alias("value")),
    f"SELECT o_orderkey, CASE WHEN regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {_NANOS.format('TRY_CAST(x AS DATE)')} END AS value FROM (SELECT o_orderkey, {_DAY.format(chr(39).join(['strftime(o_orderdate, ', '%Y-%m-%d', ')']))} AS x FROM orders)",
)
_add("time_tokens", lambda spark, d: _table(spark, d, "events").select("event_id", time_value(F.col("ts").cast("timestamp")).alias("value")), "SELECT event_id, epoch_us(ts) * 1000 AS value FROM events")
_add(
    "sortable_int",
    lambda spark, d: _table(spark, d, "part").select("p_partkey", F.hex(S.sortable_int((F.col("p_size") - 25).cast("bigint"))).alias("bytes"), S.sortable_int_back(S.sortable_int((F.col("p_size") - 25).cast("bigint"))).alias("back")),
    "SELECT p_partkey, printf('%016X', xor(CAST(p_size - 25 AS BIGINT), CAST(-9223372036854775808 AS BIGINT))) AS bytes, CAST(p_size - 25 AS BIGINT) AS back FROM part",
)

# --- statistics -----------------------------------------------------------------

_V_PART, _V_DOCS = _values_sql("part", ()), _values_sql("documents", ("body",))
_add(
    "term_frequency",
    lambda spark, d: documents(spark, d, ("body",)).postings.groupBy("term").agg(F.sum("tf").cast("bigint").alias("tf"), F.max("tf").cast("bigint").alias("most")),
    f"SELECT term, CAST(sum(tf) AS BIGINT) AS tf, CAST(max(tf) AS BIGINT) AS most FROM ({_V_DOCS}) GROUP BY term",
)
_add(
    "field_length",
    lambda spark, d: named(parts(spark, d), parts(spark, d, ("name", "type")).postings.select("field", "doc_idx", F.col("dl").cast("bigint").alias("dl")).distinct()),
    f"SELECT DISTINCT field, CAST(id AS BIGINT) AS id, CAST(dl AS BIGINT) AS dl FROM ({_values_sql('part', ('name', 'type'))})",
)
_add("doc_frequency", lambda spark, d: documents(spark, d, ("body",)).lexicon.select("term", "df"), f"SELECT term, count(DISTINCT id) AS df FROM ({_V_DOCS}) GROUP BY term")
_add(
    "field_stats",
    lambda spark, d: parts(spark, d).stats.select("field", "n_docs", "total_len", F.round("avgdl", 6).alias("avgdl")),
    f"SELECT field, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_len, round(avg(dl), 6) AS avgdl FROM (SELECT DISTINCT field, id, dl FROM ({_V_PART})) GROUP BY field",
)
_add("lexicon", lambda spark, d: parts(spark, d).lexicon.select("field", "term", F.coalesce(F.col("num_f"), F.col("num_i").cast("double")).alias("num"), "df"), f"SELECT field, term, num, count(DISTINCT id) AS df FROM ({_V_PART}) GROUP BY ALL")
_add(
    "posting_counts",
    lambda spark, d: parts(spark, d).postings.groupBy("field").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("doc_idx").alias("docs"), F.count_distinct("term").alias("terms")),
    f"SELECT field, count(*) AS entries, count(DISTINCT id) AS docs, count(DISTINCT term) AS terms FROM ({_V_PART}) GROUP BY field",
)
_add(
    "posting_lists",
    lambda spark, d: named(parts(spark, d), parts(spark, d, ("type",)).postings.select("doc_idx", "term")).groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("docs")),
    f"SELECT term, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS docs FROM ({_values_sql('part', ('type',))}) GROUP BY term",
)
_add(
    "idf_table",
    lambda spark, d: (lambda ix: ix.lexicon.join(ix.stats, "field").select("field", "term", F.round(S.idf(F.col("n_docs"), F.col("df")), 6).alias("idf")).where("term is not null"))(parts(spark, d, ("name", "brand", "type"))),
    f"WITH v AS ({_values_sql('part', ('name', 'brand', 'type'))}), n AS (SELECT field, count(DISTINCT id) AS n FROM v GROUP BY field), x AS (SELECT field, term, count(DISTINCT id) AS df FROM v GROUP BY ALL) "
    "SELECT x.field, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM x JOIN n ON x.field = n.field",
)
_add(
    "fast_ln",
    lambda spark, d: _table(spark, d, "orders").select("o_orderkey", F.round(S.fast_ln(F.col("o_totalprice")), 6).alias("approximate"), (F.abs(S.fast_ln(F.col("o_totalprice")) - F.log("o_totalprice")) < 0.02).alias("near")),
    "WITH x AS (SELECT o_orderkey, o_totalprice AS x, floor(log2(o_totalprice)) AS e FROM orders), m AS (SELECT *, x / pow(2.0, e) AS m FROM x) "
    "SELECT o_orderkey, round((e + (-1.0 / 3 * m + 2.0) * m - 5.0 / 3) * 0.6931471805599453, 6) AS approximate, abs((e + (-1.0 / 3 * m + 2.0) * m - 5.0 / 3) * 0.6931471805599453 - ln(x)) < 0.02 AS near FROM m",
)
_add(
    "dictionary_point",
    lambda spark, d: parts(spark, d).point("small").select("field", "term", "df"),
    f"SELECT field, term, count(DISTINCT id) AS df FROM ({_V_PART}) WHERE term = 'small' GROUP BY ALL",
)
_add(
    "dictionary_seek",
    lambda spark, d: parts(spark, d, ("name",)).seek("name", "m", 3).select("term", "df"),
    f"SELECT term, count(DISTINCT id) AS df FROM ({_values_sql('part', ('name',))}) WHERE term >= 'm' GROUP BY term ORDER BY term LIMIT 3",
)
_add(
    "dictionary_scan",
    lambda spark, d: parts(spark, d, ("size",)).scan("size", 10, 20).select(F.col("num_i").cast("double").alias("num"), "df"),
    f"SELECT num, count(DISTINCT id) AS df FROM ({_values_sql('part', ('size',))}) WHERE num >= 10 AND num <= 20 GROUP BY num",
)

# --- ranking ---------------------------------------------------------------------

_B = ("body",)
ranked("bm25_should_1", "documents", SimpleQuery([_k("the", "body")]), _B)
ranked("bm25_should_3", "documents", SimpleQuery([_k("the", "body"), _k("of", "body"), _k("der", "body")]), _B)
ranked("bm25_must", "documents", SimpleQuery(must=[_k("the", "body"), _k("of", "body"), _k("and", "body")]), _B)
ranked("bm25_combined", "documents", SimpleQuery([_k("to", "body")], [_k("the", "body")], [_k("der", "body")]), _B)
ranked("bm25_selective", "documents", SimpleQuery([_k("of", "body")], [_k("the", "body"), _k("fr", "lang")]), ("body", "lang"))
ranked("bm25_all_hits", "documents", SimpleQuery([_k("the", "body"), _k("que", "body")]), _B, top=None)
ranked("bm25_boost", "part", SimpleQuery([_k("small", "name", 3.0), _k("red", "name")]), ("name",))
ranked("bm25_zero_boost", "part", SimpleQuery([_k("ring", "name")], [_k("small", "name", 0.0)]), ("name",))
ranked("bm25_custom_k1_b", "part", SimpleQuery([_k("small"), _k("widget")]), ("name", "type"), SearchConfig(k1=2.0, b=0.3))
ranked("field_keyword", "part", SimpleQuery([_k("Brand#11", "brand"), _k(7, "size")]), ("brand", "size"))
ranked("unscoped_multi_field", "part", SimpleQuery([_k("small")]), ("name", "type", "brand"))
ranked("range_must_scored", "part", SimpleQuery([], [Range("size", low=10, high=15, closed="both")]), ("size",))
ranked("skip_limit", "part", SimpleQuery([_k("small"), _k("red")]), ("name", "type"), top=10, skip=15)
ranked("skip_past_end", "part", SimpleQuery([_k("small", "name")]), ("name",), skip=1_000_000)
ranked("reverse", "part", SimpleQuery([_k("small"), _k("red")]), ("name", "type"), reverse=True, top=25)
ranked("score_positive", "part", SimpleQuery([_k("red", "name", 0.0), _k("small", "name")]), ("name",), top=None)

# --- sets ------------------------------------------------------------------------

matched("must_every_field", "part", SimpleQuery(must=[_k("small")]), ("name", "type", "brand"))
matched("must_any_field", "part", SimpleQuery(must=[_k("small")]), ("name", "type", "brand"), SearchConfig(must_scope="any_field"))
matched("must_not_only", "part", SimpleQuery(must_not=[_k("small")]), ("name",))
matched("missing_must", "part", SimpleQuery([_k("small")], [_k("nosuchword")]), ("name",))
matched("missing_field", "part", SimpleQuery([_k("small", "nosuchfield"), Range("nosuchfield", low=1)]), ("name",))
matched("must_not_filter", "part", SimpleQuery([_k("red")], [], [_k("small")]), ("name", "type"))
matched("must_overrides_should", "part", SimpleQuery([_k("red", "name"), Range("size", high=5, closed="both")], [_k("small", "name")]), ("name", "size"))
_R = ("size",)
matched("range_gt", "part", SimpleQuery([Range("size", low=40, closed="none")]), _R)
matched("range_ge", "part", SimpleQuery([Range("size", low=40)]), _R)
matched("range_lt", "part", SimpleQuery([Range("size", high=10, closed="none")]), _R)
matched("range_le", "part", SimpleQuery([Range("size", high=10)]), _R)
matched("range_two_sided", "part", SimpleQuery([Range("size", 10, 20, "low")]), _R)
matched("range_above_max", "part", SimpleQuery([Range("size", high=9999, closed="none")]), _R)
matched("range_string", "part", SimpleQuery([Range("brand", "Brand#13", "Brand#2", "high")]), ("brand",))
matched("range_float", "part", SimpleQuery([Range("price", 920.0, 930.5, "none")]), ("price",))
_D95 = ANALYZERS["date"].local("1995-03-15")[0]
matched("range_date", "orders", SimpleQuery([Range("ordered", low=_D95)], [_k("1-URGENT", "priority")]), ("ordered", "priority"))
_T1, _T2 = (ANALYZERS["time"].local(x)[0] for x in ("2024-01-05", "2024-01-09"))
matched("range_time", "events", SimpleQuery([Range("at", _T1, _T2, "low")], [_k("click", "kind")]), ("at", "kind"))
_add("range_above_max_compat", lambda spark, d: named(parts(spark, d), Searcher(parts(spark, d, ("size",)), SearchConfig(compat_range_upper=True)).filter(SimpleQuery([Range("size", high=9999)]))), "SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE false")
_add("match_count", lambda spark, d: Searcher(parts(spark, d, ("name",))).count(SimpleQuery([_k("small", "name")])), f"SELECT count(DISTINCT id) AS n_docs FROM ({_values_sql('part', ('name',))}) WHERE term = 'small'")


def _set_query(how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = parts(spark, sf_dir, ("name", "type"))
        a, b = (hits(ix, [_k(w)]).select("doc_idx") for w in ("small", "red"))
        return named(ix, {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[how]())

    return run


for _how in ("union", "intersect", "except"):
    _v = f"WITH v AS ({_values_sql('part', ('name', 'type'))}) "
    _add(f"set_{_how}", _set_query(_how), f"{_v} SELECT CAST(id AS BIGINT) AS id FROM v WHERE term = 'small' {_how.upper()} SELECT CAST(id AS BIGINT) AS id FROM v WHERE term = 'red'")

# --- order by field -----------------------------------------------------------------

sorted_by("field_sort_int", "part", "size", SimpleQuery([_k("small", "name")]), ("name", "size"))
sorted_by("field_sort_float", "part", "price", SimpleQuery([_k("small", "name")]), ("name", "price"), reverse=True)
sorted_by("field_sort_date", "orders", "ordered", SimpleQuery([_k("1-URGENT", "priority")]), ("priority", "ordered"))
sorted_by("field_sort_time", "events", "at", SimpleQuery([_k("error", "kind")]), ("kind", "at"), reverse=True)
sorted_by("field_sort_multivalued", "part", "name", SimpleQuery([Range("size", 10, 12)]), ("name", "size"))
sorted_by("field_sort_ties", "part", "brand", SimpleQuery([_k("small", "name")]), ("name", "brand"))
sorted_by("field_sort_unknown", "part", "nosuchfield", SimpleQuery([_k("small", "name")]), ("name",))

# --- fuzzy ---------------------------------------------------------------------------


def _near_sql(word: str, k: int, m: int) -> str:
    return (
        f"SELECT term FROM (SELECT DISTINCT term FROM v) WHERE strlen(term) < 60 AND abs(strlen(term) - strlen('{word}')) <= {k} AND levenshtein(term, '{word}') <= {k} "
        f"AND NOT EXISTS (SELECT 1 FROM v WHERE term = '{word}') ORDER BY term LIMIT {m}"
    )


for _name_, _word, _kk, _mm in (("fuzzy_k1", "smal", 1, 10), ("fuzzy_k2", "widgit", 2, 10), ("fuzzy_cap_m", "th", 2, 3), ("fuzzy_exact_wins", "the", 2, 10)):
    _corpus, _only = ("documents", ("body",)) if _word.startswith("th") else ("part", ("name",))

    def _run(spark: SparkSession, sf_dir: str, corpus: str = _corpus, only: tuple = _only, word: str = _word, k: int = _kk, m: int = _mm) -> DataFrame:
        s = Searcher(_CORPORA[corpus](spark, sf_dir, only), SearchConfig(levenshtein_m=m, levenshtein_max_k=k))
        return named(s.index, s.filter(SimpleQuery([_k(word, only[0], 1.0, k)])))

    _add(_name_, _run, f"WITH v AS ({_values_sql(_corpus, _only)}), n AS ({_near_sql(_word, _kk, _mm)}) SELECT DISTINCT CAST(id AS BIGINT) AS id FROM v WHERE term = '{_word}' OR term IN (SELECT term FROM n)")
_add("fuzzy_terms", lambda spark, d: fuzzy_terms(documents(spark, d, ("body",)), "anr", 1, 10).select("term"), f"WITH v AS ({_V_DOCS}) {_near_sql('anr', 1, 10)}")
_add(
    "levenshtein_match",
    lambda spark, d: _table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().select("word", *[S.levenshtein_match(F.col("word"), F.lit("rínd"), k).alias(f"within_{k}") for k in (0, 1, 2, 3)]),
    "SELECT word, " + ", ".join(f"levenshtein(word, 'rínd') <= {k} AND strlen(word) < 60 AS within_{k}" for k in (0, 1, 2, 3)) + " FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)",
)

# --- query language ---------------------------------------------------------------------

_P = ("name", "type", "brand", "size", "price")
for _n, _text, _q in (
    ("word", "small", SimpleQuery([_k("small")])),
    ("must", "+small +red", SimpleQuery(must=[_k("small"), _k("red")])),
    ("must_not", "red -small", SimpleQuery([_k("red")], [], [_k("small")])),
    ("phrase", '"small widgets"', SimpleQuery([_k("small"), _k("widget")])),
    ("field", "name:red +brand:Brand#12", SimpleQuery([_k("red", "name")], [_k("Brand#12", "brand")])),
    ("boost", "small;2.5 red;0.5", SimpleQuery([_k("small", None, 2.5), _k("red", None, 0.5)])),
    ("range", "+size:>=45 small", SimpleQuery([_k("small")], [Range("size", low=45)])),
    ("range_strict", "+size:<4 -size:1", SimpleQuery([], [Range("size", high=4, closed="none")], [_k(1, "size")])),
    ("float_range", "price:>990.5", SimpleQuery([Range("price", low=990.5, closed="none")])),
    ("negative", 'size:>"-10" +red', SimpleQuery([Range("size", low=-10, closed="none")], [_k("red")])),
    ("untokenised", "+size:abc red", SimpleQuery([_k("red")])),
    ("empty", "", SimpleQuery()),
):
    ranked(f"dsl_{_n}", "part", _q, _P, SearchConfig(must_scope="any_field"), text=_text)
ranked("dsl_date", "orders", SimpleQuery([], [Range("ordered", low=_D95), _k("F", "status")]), ("ordered", "status"), text="+ordered:>=1995-03-15 +status:F")
ranked("dsl_documents", "documents", SimpleQuery([_k("of", None, 2.0)], [_k("the")], [_k("es", "lang")]), ("body", "lang"), SearchConfig(must_scope="any_field"), text="+the of;2 -lang:es")


def _all_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Reader(parts(spark, sf_dir, ("name", "type")), "en", "name")
    return named(r.searcher.index, r.searcher.filter(r.compile("+small")))


_add("dsl_all_field", _all_field, f"SELECT DISTINCT CAST(id AS BIGINT) AS id FROM ({_values_sql('part', ('name', 'type'))}) WHERE field = 'name' AND term = 'small'")


def _dsl_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Reader(parts(spark, sf_dir, ("name",)), "en", None, SearchConfig(levenshtein_max_k=1))
    return named(r.searcher.index, r.searcher.filter(r.compile("+widgt~1")))


_add("dsl_fuzzy", _dsl_fuzzy, f"WITH v AS ({_values_sql('part', ('name',))}), n AS ({_near_sql('widgt', 1, 10)}) SELECT DISTINCT CAST(id AS BIGINT) AS id FROM v WHERE term IN (SELECT term FROM n)")


def _reader_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Reader(parts(spark, sf_dir, ("name", "type")), "en", None, SearchConfig(must_scope="any_field")).query_string("+small red", skip=2, limit=8)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))


_rq = SimpleQuery([_k("red")], [_k("small")])
_add(
    "reader_page",
    _reader_ids,
    f"WITH v AS ({_values_sql('part', ('name', 'type'))}), {_filter_sql(_rq, False)}, {_bm25_sql(_rq, S.K1, S.B)} SELECT CAST(c.id AS BIGINT) AS doc_id, round(s.score, 6) AS score FROM c JOIN s ON c.id = s.id ORDER BY s.score DESC, c.id LIMIT 8 OFFSET 2",
)

# --- segments ------------------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> Index:
    rows = _table(spark, sf_dir, "part")
    specs = [s for s in _PART if s.name in ("name", "size")]
    halves = [numbered(rows.where(c), "_n", [F.col("p_partkey")]) for c in ("p_partkey % 2 = 0", "p_partkey % 2 = 1")]
    return merge(*[Index.of(h, "p_partkey", specs, F.col("_n")) for h in halves])


def _merged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _halves(spark, sf_dir)
    s = Searcher(ix)
    scores = s.bm25(SimpleQuery([_k("small", "name"), _k("red", "name")])).join(ix.documents, "doc_idx")
    return scores.select(F.col("doc_id").cast("bigint").alias("id"), F.round("score", 6).alias("score"))


_mq = SimpleQuery([_k("small", "name"), _k("red", "name")])
_add(
    "segments_equal_single",
    _merged_query,
    f"WITH v AS ({_values_sql('part', ('name', 'size'))}), {_filter_sql(_mq, True)}, {_bm25_sql(_mq, S.K1, S.B)} SELECT CAST(c.id AS BIGINT) AS id, round(s.score, 6) AS score FROM c JOIN s ON c.id = s.id",
)
_add(
    "merge_stats",
    lambda spark, d: _halves(spark, d).stats.select("field", "n_docs", "total_len", F.round("avgdl", 6).alias("avgdl")),
    f"SELECT field, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_len, round(avg(dl), 6) AS avgdl FROM (SELECT DISTINCT field, id, dl FROM ({_values_sql('part', ('name', 'size'))})) GROUP BY field",
)
_add(
    "merge_doc_offset",
    lambda spark, d: _halves(spark, d).documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "doc_idx"),
    "SELECT CAST(p_partkey AS BIGINT) AS doc_id, row_number() OVER (ORDER BY p_partkey % 2, p_partkey) - 1 AS doc_idx FROM part",
)

# --- stored segments: appended one by one, compacted, opened ---------------------------

_stored: dict[tuple[str, str], tuple[Store, Store]] = {}


def _segments(spark: SparkSession, sf_dir: str) -> tuple[Store, Store]:
    """A store of three segments, and the same compacted."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        specs = [s for s in _PART if s.name in ("name", "size")]
        both = Store(spark, scratch(spark)), Store(spark, scratch(spark))
        for store in both:
            for part in range(3):
                store.append(_table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 == part), "p_partkey", specs, ["p_partkey"])
        both[1].compact()
        both[1].vacuum()
        _stored[key] = both
    return _stored[key]


def _scored(index: Index) -> DataFrame:
    scores = Searcher(index).bm25(_mq).join(index.documents, "doc_idx")
    return scores.select(F.col("doc_id").cast("bigint").alias("id"), F.round("score", 6).alias("score"))


_add("store_append_many", lambda spark, d: _scored(_segments(spark, d)[0].open()), ORACLE["segments_equal_single"])
_add("store_compact", lambda spark, d: _scored(_segments(spark, d)[1].open(strict=True)), ORACLE["segments_equal_single"])
_add(
    "store_open_strict",
    lambda spark, d: _segments(spark, d)[1].open(strict=True).documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "doc_idx"),
    "SELECT CAST(p_partkey AS BIGINT) AS doc_id, row_number() OVER (ORDER BY p_partkey % 3, p_partkey) - 1 AS doc_idx FROM part",
)
_add(
    "store_postings",
    lambda spark, d: _segments(spark, d)[0].open().postings.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tokens"), F.count_distinct("doc_idx").alias("n_docs")),
    f"SELECT field, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT id) AS n_docs FROM ({_values_sql('part', ('name', 'size'))}) GROUP BY field",
)

# --- analysers and stop lists of one's own -------------------------------------------


def _own_analysers() -> None:
    register_analyzer("by_blank", lambda c: F.split(F.lower(c), "[ \n\t]+"), lambda s: re.split("[ \n\t]+", s.lower()))
    text_analyzer("en_own", "en", ["the", "and", "small"])


def _own_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    _own_analysers()
    rows = _table(spark, sf_dir, "part").withColumn("doc_idx", F.col("p_partkey"))
    return lexicon(postings(rows, [f.text("blank", "by_blank", "p_name"), f.text("own", "en_own", "p_type")])).select("field", "term", "df")


_add(
    "custom_analyzers",
    _own_lexicon,
    f"""SELECT 'blank' AS field, t AS term, count(DISTINCT id) AS df FROM (SELECT p_partkey AS id, unnest(regexp_split_to_array(lower(p_name), '[ \n\t]+')) AS t FROM part) WHERE t <> '' GROUP BY t
UNION ALL SELECT 'own' AS field, t AS term, count(DISTINCT id) AS df FROM (SELECT p_partkey AS id, unnest({tokens_sql('p_type', 'en', False, 'duckdb')}) AS t FROM part) WHERE t NOT IN ('the', 'and', 'small') GROUP BY t""",
)


def _own_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same analyser on both sides of the engine."""
    _own_analysers()
    index = Index.of(_table(spark, sf_dir, "part"), "p_partkey", [f.text("name", "by_blank", "p_name")], F.col("p_partkey"))
    return Reader(index, "by_blank").query_string('+name:"SMALL"').select(F.col("doc_id").cast("bigint").alias("id"))


_add("custom_analyzer_query", _own_query, "SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[ \n\t]+'), 'small')")

# --- sources and sinks -----------------------------------------------------------------


def _ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_ndjson(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("html").alias("content")), path)
    return read_ndjson(spark, path)


_add("ndjson_roundtrip", _ndjson, "SELECT CAST(page_id AS BIGINT) AS id, url AS title, html AS content FROM pages")


def _mediawiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a MediaWiki export, scanned; texts are compared by their words, since an export trims them."""
    path = scratch(spark)
    old, new = (F.struct(F.lit(k).alias("id"), F.col(c).alias("text")) for k, c in ((1, "url"), (2, "html")))
    pages = _table(spark, sf_dir, "pages").select(F.col("url").alias("title"), F.col("page_id").alias("id"), F.array(old, new).alias("revision"))
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return read_mediawiki(spark, path).select("id", "title", F.size(F.regexp_extract_all("content", F.lit("[a-z]+"), F.lit(0))).cast("bigint").alias("n_words"))


_add("mediawiki_scan", _mediawiki, "SELECT CAST(page_id AS BIGINT) AS id, url AS title, CAST(len(regexp_extract_all(html, '[a-z]+')) AS BIGINT) AS n_words FROM pages")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return QUERIES["dsl_documents"](spark, sf_dir)


__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "field_stats", "lexicon"]
