"""Searcher: programmatic queries.  Reader: query strings, paging, ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import K1, B, fast_ln
from ..operators.index import Index
from ..operators.matching import filter_documents
from ..operators.scoring import bm25_scores, field_scores, resolve
from .compile import SimpleQuery, compile_query


@dataclass(frozen=True)
class SearchConfig:
    """k1 and b of BM25 (0: default); most expansions of a fuzzy term in a field, and most edits (0: no fuzzy search)."""

    k1: float = K1
    b: float = B
    levenshtein_m: int = 10
    levenshtein_max_k: int = 0
    must_scope: str = "every_field"
    compat_range_upper: bool = False
    approximate_ln: bool = False


class Searcher:
    def __init__(self, index: Index, config: SearchConfig = SearchConfig()) -> None:
        self.index, self.config = index, config

    @property
    def _options(self) -> dict:
        c = self.config
        return {"max_k": c.levenshtein_max_k, "m": c.levenshtein_m, "compat_upper": c.compat_range_upper}

    def filter(self, query: SimpleQuery) -> DataFrame:
        """doc_idx of the matching documents."""
        return filter_documents(self.index, query, self.config.must_scope, **self._options)

    def count(self, query: SimpleQuery) -> DataFrame:
        return self.filter(query).agg(F.count(F.lit(1)).alias("n_docs"))

    def bm25(self, query: SimpleQuery, candidates: DataFrame | None = None) -> DataFrame:
        """(doc_idx, score) of the candidates, by default the matching documents."""
        c = self.config
        return bm25_scores(self.index, query, self.filter(query) if candidates is None else candidates, c.k1, c.b, fast_ln if c.approximate_ln else F.log, **self._options)

    def field_score(self, field: str, candidates: DataFrame) -> DataFrame:
        return field_scores(self.index, field, candidates)

    def resolve(self, scores: DataFrame, reverse: bool = False) -> DataFrame:
        return resolve(scores, reverse)


class Reader:
    """Runs query strings against an index.  ``default`` analyses bare words, ``all_field`` is where they are sought."""

    def __init__(self, index: Index, default: str | None = None, all_field: str | None = None, config: SearchConfig = SearchConfig()) -> None:
        self.searcher, self.default, self.all_field = Searcher(index, config), default, all_field

    def reset(self, index: Index) -> Reader:
        """Goes on with another index, such as a newer state of the same store; what was cached of the old one is freed."""
        self.close()
        self.searcher = Searcher(index, self.searcher.config)
        return self

    def close(self) -> None:
        """Frees what is cached of the index."""
        self.searcher.index.close()

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def compile(self, text: str) -> SimpleQuery:
        return compile_query(text, {s.name: s.analyzer for s in self.searcher.index.specs}, self.default, self.all_field)

    def query_string(self, text: str, sort_field: str | None = None, skip: int = 0, limit: int | None = None, reverse: bool = False) -> DataFrame:
        return self.query(self.compile(text), sort_field, skip, limit, reverse)

    def query(self, query: SimpleQuery, sort_field: str | None = None, skip: int = 0, limit: int | None = None, reverse: bool = False) -> DataFrame:
        """(doc_id, score) in order, of documents that score above 0; reversed order is the exact reverse."""
        s = self.searcher
        found = s.filter(query)
        scores = s.field_score(sort_field, found) if sort_field else s.bm25(query, found)
        out = resolve(scores.where("score > 0"), reverse)
        if skip:
            out = out.offset(skip)
        if limit is not None:
            out = out.limit(limit)
            out = F.broadcast(out) if limit <= 10_000 else out
        named = out.join(s.index.documents, "doc_idx")
        return resolve(named, reverse).select("doc_id", "score")
