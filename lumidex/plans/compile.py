"""Terms of the query language to clauses, by the analysers of the index."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions.analysis import Analyzer, analyzer
from .dsl import Term, parse


@dataclass(frozen=True)
class Keyword:
    """A value anywhere (field None) or in one field; fuzzy: byte edits allowed where the value itself is absent."""

    value: object
    field: str | None = None
    boost: float = 1.0
    fuzzy: int = 0


@dataclass(frozen=True)
class Range:
    """Values of a field between two bounds; None is open, ``closed`` tells which bounds belong to it."""

    field: str
    low: object = None
    high: object = None
    closed: str = "both"  # none, low, high, both
    boost: float = 1.0


Clause = Keyword | Range


@dataclass
class SimpleQuery:
    should: list[Clause] = field(default_factory=list)
    must: list[Clause] = field(default_factory=list)
    must_not: list[Clause] = field(default_factory=list)


def compile_query(query: str | list[Term], fields: Mapping[str, str], default: str | None = None, all_field: str | None = None) -> SimpleQuery:
    """``fields``: analyser of each field; ``default``: of bare words and other fields; ``all_field``: where bare words are sought.

    Each token of a value is a clause of its own, in the bucket of the term's
    sign.  A value without tokens disappears, with a warning.
    """
    out = SimpleQuery()
    for t in parse(query) if isinstance(query, str) else query:
        bucket = {"+": out.must, "-": out.must_not}.get(t.sign, out.should)
        boost = 1.0 if t.boost is None else t.boost
        before = len(bucket)
        if t.match is None:
            for tok in analyzer(default).local(t.word) if default else [t.word]:
                bucket.append(Keyword(tok, all_field, boost, t.fuzzy or 0))
        else:
            rules: Analyzer = analyzer(fields.get(t.word) or default or "keyword")
            for tok in rules.local(t.match.value):
                c = t.match.compare
                if not c:
                    bucket.append(Keyword(tok, t.word, boost, t.fuzzy or 0))
                elif c[0] == ">":
                    bucket.append(Range(t.word, low=tok, closed="both" if c == ">=" else "none", boost=boost))
                else:
                    bucket.append(Range(t.word, high=tok, closed="both" if c == "<=" else "none", boost=boost))
        if len(bucket) == before:
            warnings.warn(f"{t.match.value if t.match else t.word!r} has no tokens and is left out", stacklevel=2)
    return out
