"""Clauses to documents: one pass over the postings finds the hits of all clauses of a bucket."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EDIT_BYTES, EDIT_MAX, levenshtein_match
from ..plans.compile import Clause, Keyword, Range, SimpleQuery
from .index import Index


def _equals(value: object) -> Column:
    if isinstance(value, float):
        return F.col("num_f") == value
    if isinstance(value, int):
        return F.col("num_i") == value
    return F.col("term") == value


def _value(bound: object) -> Column:
    return F.col("num_f" if isinstance(bound, float) else "num_i" if isinstance(bound, int) else "term")


def fuzzy_terms(index: Index, value: str, k: int, m: int, field: str | None = None) -> DataFrame:
    """(field, term): the first m terms, in byte order, within k byte edits of ``value``, in each field that lacks it."""
    if not 0 < k <= EDIT_MAX or len(value.encode()) >= EDIT_BYTES:
        return index.lexicon.where(F.lit(False)).select("field", "term")
    lex = index.lexicon.where(F.col("term").isNotNull())
    if field is not None:
        lex = lex.where(F.col("field") == field)
    near = lex.where(levenshtein_match(F.col("term"), F.lit(value), k))
    has = lex.where(F.col("term") == value).select("field")
    rank = F.row_number().over(Window.partitionBy("field").orderBy("term"))
    return near.join(has, "field", "left_anti").withColumn("_rank", rank).where(F.col("_rank") <= m).select("field", "term")


def condition(index: Index, clause: Clause, max_k: int = 0, m: int = 10, compat_upper: bool = False) -> Column:
    """Whether a posting belongs to a clause.

    Fuzzy clauses read their few expansions (at most m a field) from the lexicon
    here.  ``compat_upper``: a range whose upper bound lies above every value of
    the field is empty.
    """
    if isinstance(clause, Keyword):
        at = _equals(clause.value)
        if clause.field is not None:
            at = (F.col("field") == clause.field) & at
        k = min(max_k, clause.fuzzy)
        if k > 0 and isinstance(clause.value, str):
            asked = (clause.value, k, m, clause.field)
            if asked not in index.expansions:  # once a query, though filter, hits and lexicon all ask
                index.expansions[asked] = fuzzy_terms(index, *asked).collect()
            for r in index.expansions[asked]:
                at = at | ((F.col("field") == r.field) & (F.col("term") == r.term))
        return at
    at = F.col("field") == clause.field
    if clause.low is not None:
        v = _value(clause.low)
        at &= v >= clause.low if clause.closed in ("both", "low") else v > clause.low
    if clause.high is not None:
        v = _value(clause.high)
        at &= v <= clause.high if clause.closed in ("both", "high") else v < clause.high
        if compat_upper:
            top = index.lexicon.where(F.col("field") == clause.field).agg(F.max(v).alias("top")).first()["top"]
            if top is None or clause.high > top:
                at &= F.lit(False)
    return at


def hits(index: Index, clauses: Sequence[Clause], **options: object) -> DataFrame:
    """Postings of the clauses, with clause (its number) and boost; a posting of several clauses appears once for each."""
    if not clauses:
        return index.postings.where(F.lit(False)).select("*", F.lit(0).alias("clause"), F.lit(1.0).alias("boost"))
    conds = [condition(index, c, **options) for c in clauses]
    which = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("n"), F.lit(float(q.boost)).alias("boost"))) for i, (c, q) in enumerate(zip(conds, clauses))]), lambda x: x.isNotNull())
    found = index.postings.where(reduce(Column.__or__, conds))
    return found.select("*", F.explode(which).alias("_c")).select(*found.columns, F.col("_c.n").alias("clause"), F.col("_c.boost").alias("boost"))


def _must(index: Index, clauses: Sequence[Clause], every_field: bool, **options: object) -> DataFrame:
    """Documents of all groups: (clause, field) pairs that have hits at all, or clauses."""
    found = hits(index, clauses, **options)
    keys = ["clause", "field"] if every_field else ["clause"]
    groups = found.select(*keys).distinct()
    have = found.select("doc_idx", *keys).distinct().groupBy("doc_idx").agg(F.count(F.lit(1)).alias("n"))
    need = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    met = groups.agg(F.count_distinct("clause").alias("n")).scalar()
    return have.where((F.col("n") == need) & (met == len(clauses))).select("doc_idx")


def filter_documents(index: Index, query: SimpleQuery, must_scope: str = "every_field", **options: object) -> DataFrame:
    """doc_idx of the matching documents.

    Musts define the set where there are any, else shoulds; must-nots are taken
    away.  ``every_field``: a must without a field holds in each field whose
    lexicon has it; ``any_field``: in one of them.
    """
    if query.must:
        docs = _must(index, query.must, must_scope == "every_field", **options)
    elif query.should:
        docs = hits(index, query.should, **options).select("doc_idx").distinct()
    else:
        return index.documents.select("doc_idx").where(F.lit(False))
    if query.must_not:
        docs = docs.join(hits(index, query.must_not, **options).select("doc_idx"), "doc_idx", "left_anti")
    return docs


__all__ = ["Keyword", "Range", "SimpleQuery", "condition", "filter_documents", "fuzzy_terms", "hits"]
