"""Exact top-k by inner product: columnar branch and bound.

Components become floor(256 * x), so scores are exact integers.  Candidates lie
in vertical layout (one contiguous row a dimension), dimensions ordered by the
queries' mass.  For a query, partial scores are accumulated one block of
dimensions after another; what is left of a candidate is bounded by the product
of the remaining norms of query and candidate (remaining mass).  Candidates whose
upper bound falls below the k-th best lower bound are compacted away before the
next block.

Scale: candidates are never moved: every task takes its own rows in blocks of
BLOCK vectors and streams the queries, written once as Parquet into the shared
folder, past each block.  A task holds one candidate block and one query block,
whatever the table's size.  A block hands on k rows a query at most; the merge
is a grouped window with a group limit on both sides of its shuffle.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part, as query or candidate.  Vectors of another length than the
query's are no candidates of it.  Ties go to the smaller id, null ids last.
Repeated rows are candidates of their own; a query leaves out just its own row,
not another of the same id.  A null id is no query.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh, local_path, pick, ship, tidy, written

SCALE = 256
DIMS = 16
BLOCK = 1 << 15
QUERIES = 1 << 12


def quantised(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, v (array of long), row (unique): valid vectors only."""
    v = F.col(f"`{vector}`")
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return df.where(ok).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), q.alias("v"), F.monotonically_increasing_id().alias("row"))


def _by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids' validity, rows, matrix) for each vector length."""
    v = batch.column("v")
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    off = v.offsets.to_numpy()
    flat = v.values.to_numpy()
    size = np.diff(off)
    ids = batch.column("vec_id")
    valid = np.asarray(ids.is_valid())
    ids = np.asarray(ids.fill_null(np.iinfo(np.int64).max))
    rows = np.asarray(batch.column("row"))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield ids[at], valid[at], rows[at], flat[off[at][:, None] + np.arange(n)]


def _tails(m: np.ndarray, step: int) -> list[np.ndarray]:
    """Norms of what is left of each row before every block of ``step`` columns."""
    sq = m.astype(np.float64) ** 2
    return [np.sqrt(sq[:, i:].sum(axis=1)) for i in range(0, m.shape[1], step)] + [np.zeros(len(m))]


def search_block(cand: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, query: np.ndarray, q_rows: np.ndarray, k: int, dims: int = DIMS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its best k candidates of the block, as (query, positions, scores), ties to the smaller id."""
    n, d = cand.shape
    order = np.argsort(-(query.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    cand, query = cand[:, order], query[:, order]
    top = max(1.0, float(np.abs(cand).max(initial=0)))
    exact = top * max(1.0, float(np.abs(query).max(initial=0))) * max(1, d) < 2.0**52  # sums of doubles stay exact integers
    kind = np.float64 if exact else np.int64
    vertical = np.ascontiguousarray(cand.T.astype(kind))
    q = query.astype(kind)
    c_tail, q_tail = _tails(cand, dims), _tails(query, dims)
    slack = 1 + 1e-12
    for i in range(len(q)):
        alive: np.ndarray | None = None
        score = np.zeros(n, dtype=kind)
        for b, lo in enumerate(range(0, d, dims)):
            part = vertical[lo : lo + dims]
            score = score + q[i, lo : lo + dims] @ (part if alive is None else part[:, alive])
            if lo + dims >= d or len(score) <= 4 * k:
                continue
            left = q_tail[b + 1][i] * (c_tail[b + 1] if alive is None else c_tail[b + 1][alive]) * slack
            floor = np.partition(score - left, len(score) - k - 1)[len(score) - k - 1]  # one more than k: the query's own row may be among them
            keep = score + left >= floor
            if 2 * np.count_nonzero(keep) <= len(keep):
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                score = score[keep]
        at = np.arange(n) if alive is None else alive
        own = c_rows[at] != q_rows[i]
        at, score = at[own], score[own]
        if len(at) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= kth], score[score >= kth]
        best = np.lexsort((c_ids[at], -score))[:k]
        yield i, at[best], score[best].astype(np.int64)


def top_k(df: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k best other rows.  ``is_query`` reads the column vec_id."""
    spark = df.sparkSession
    ship(spark)
    table = written(quantised(pick(df, id_col, vector), id_col, vector), "vectors")
    path = fresh(spark, "queries")
    table.where(is_query & F.col("vec_id").isNotNull()).write.option("maxRecordsPerFile", QUERIES).parquet(path)
    where = local_path(path)

    def against(block: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = [(g[0], g[1], g[2], g[3]) for g in _by_length(block)]
        for qb in ds.dataset(where, format="parquet").to_batches(batch_size=QUERIES):
            if not len(qb):
                continue
            for q_ids, _, q_rows, q in _by_length(qb):
                for c_ids, c_ok, c_rows, c in groups:
                    if c.shape[1] != q.shape[1]:
                        continue
                    out: list[list[np.ndarray]] = [[], [], [], [], []]
                    for i, at, score in search_block(c, c_ids, c_rows, q, q_rows, k):
                        for col, x in zip(out, (np.full(len(at), q_ids[i]), np.full(len(at), q_rows[i]), c_ids[at], c_ok[at], score)):
                            col.append(x)
                    qi, qr, ci, ok, s = (np.concatenate(x) for x in out)
                    yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(qr), pa.array(ci, mask=~ok.astype(bool)), pa.array(s)], names=["query_id", "query_row", "vec_id", "score"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                held.append(b.slice(lo, BLOCK))
                n += len(held[-1])
                if n >= BLOCK:
                    yield from against(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield from against(pa.Table.from_batches(held))

    found = table.mapInArrow(tidy(go), "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Five best of each query whose id 50 divides.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
