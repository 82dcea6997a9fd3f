"""Scores: BM25 over hits, and ranks by a field's value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import K1, B, bm25
from ..plans.compile import SimpleQuery
from .index import Index
from .matching import hits
from .tables import numbered


def bm25_scores(index: Index, query: SimpleQuery, candidates: DataFrame | None = None, k1: float = K1, b: float = B, ln=F.log, **options: object) -> DataFrame:
    """(doc_idx, score) of the candidates: the sum over the hits of musts and shoulds.

    Hits with boost 0 add nothing.  Document frequencies come from the lexicon,
    lengths from the postings, so besides candidates and hits nothing is joined
    but one row a term and one row a field.
    """
    clauses = [c for c in [*query.must, *query.should] if c.boost]
    found = hits(index, clauses, **options)
    if candidates is not None:
        found = found.join(candidates, "doc_idx", "left_semi")
    terms = index.lexicon
    if clauses:
        from functools import reduce

        from .matching import condition

        terms = terms.where(reduce(Column.__or__, [condition(index, c, **options) for c in clauses]))
    terms = terms.select("field", *[F.col(c).alias(f"_{c}") for c in ("term", "num_i", "num_f")], "df")
    found = found.join(terms, (found["field"] == terms["field"]) & F.col("term").eqNullSafe(F.col("_term")) & F.col("num_i").eqNullSafe(F.col("_num_i")) & F.col("num_f").eqNullSafe(F.col("_num_f"))).drop(terms["field"])
    found = found.join(index.stats.select("field", "n_docs", "avgdl"), "field")
    s = bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl"), F.col("boost"), k1, b, ln)
    scores = found.groupBy("doc_idx").agg(F.sum(s).alias("score"))
    if candidates is None:
        return scores
    return candidates.join(scores, "doc_idx", "left").select("doc_idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def field_scores(index: Index, field: str, candidates: DataFrame) -> DataFrame:
    """(doc_idx, score): n - rank + 1 by ascending value, ties by doc_idx; the least value of several; 0 without the field.

    A field that no document has gives no rows.
    """
    spec = index.spec(field)
    kind = spec.rules.kind if spec else "keyword"
    col = "num_f" if kind == "float" else "term" if kind in ("text", "keyword") else "num_i"
    values = index.postings.where((F.col("field") == field) & F.col(col).isNotNull())
    least = values.join(candidates, "doc_idx", "left_semi").groupBy("doc_idx").agg(F.min(col).alias("v"))
    ranked = numbered(least, "rank", [F.col("v").asc(), F.col("doc_idx").asc()])
    known = index.postings.where(F.col("field") == field).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    total = candidates.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = candidates.join(ranked.select("doc_idx", "rank"), "doc_idx", "left").where(known > 0)
    return out.select("doc_idx", F.when(F.col("rank").isNotNull(), total - F.col("rank")).otherwise(F.lit(0)).cast("double").alias("score"))


def resolve(scores: DataFrame, reverse: bool = False) -> DataFrame:
    """Scores in order: best first, ties by doc_idx; reversed as a whole."""
    order = (F.col("score").asc(), F.col("doc_idx").desc()) if reverse else (F.col("score").desc(), F.col("doc_idx").asc())
    return scores.orderBy(*order)
