"""Analysers: text to tokens, as column expressions and, for query strings, on the driver.

An analyser maps a string column to an array of tokens (text, keyword) or to a
typed value (int, float, date, time).  Text analysers split words, stem, fold
case and optionally leave out stop words; both sides of the engine, index and
query, use the same rules.  Everything runs inside the JVM as SQL expressions;
the driver-side twins serve the handful of words of a query.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters and digits; . , : / - only between two digits.  Free of look-around, so other engines can run it.
WORD = r"[\p{L}\p{Nd}]*\p{Nd}[.,:/\-](?:\p{Nd}(?:[\p{L}\p{Nd}]*\p{Nd})?[.,:/\-])*\p{Nd}[\p{L}\p{Nd}]*|[\p{L}\p{Nd}]+"

ENGLISH_STOPS = frozenset(
    """
    a about above across after again against all along already also am among an and any are around as at back be
    because been before behind below between beyond both but by can could did do done down dur each either even every
    except far few for from further get got ha had hav have he her here hi him how i if in into is it just let many may
    me might more most much must my near need neither never no nor not now of off often on only onto or other our out
    over own quite rather really same shall she should since so some still such than that the their them then ther
    they thi tho though through thu to too toward under unless until up upon us very wa we well were what when wher
    which while who why will with within without would yet you your
    """.split()
)
SPANISH_STOPS = frozenset(
    """
    a al ante aqui asi aunque bajo bien cada como con contra cual cuando cuya cuyo de del desde donde durante e el ella
    ello en entre era es esa ese esta este esto fue ha hacia han hasta hay la las le les lo los mas me mediante mi
    mientras mis muy ni no nos o os otro para pero por porque que se segun ser si sin sino sobre solo son su sus tal te
    toda todo tu tus u un una y ya yo
    """.split()
)

_DOUBLING = "abcdefghijkmnopqrtuvwxy0123456789"  # a doubled one of these loses its second


def _undouble(p: str) -> str:
    return f"CASE WHEN length({p}) >= 2 AND right({p}, 1) = substr({p}, length({p}) - 1, 1) AND strpos_('{_DOUBLING}', right({p}, 1)) > 0 THEN substr({p}, 1, length({p}) - 1) ELSE {p} END"


def stem_sql(word: str, language: str, dialect: str = "spark") -> str:
    """The stem of ``word`` as SQL; suffix rules look at the byte length of the word as written."""
    low = f"lower({word})"
    n = f"octet_length({word})" if dialect == "spark" else f"strlen({word})"

    def cut(k: int) -> str:
        return f"substr({low}, 1, length({low}) - {k})"

    def ends(s: str) -> str:
        return f"right({low}, {len(s)}) = '{s}'"

    def voiced(p: str) -> str:
        return f"{p} <> translate({p}, 'aeiouy', '')"

    if language == "en":
        rules = [
            (f"{n} > 4 AND {ends('sses')}", cut(2)),
            (f"{n} > 4 AND {ends('ies')}", cut(2)),
            (f"{n} > 4 AND {ends('ing')} AND {voiced(cut(3))}", _undouble(cut(3))),
            (f"{n} > 3 AND {ends('ed')} AND {voiced(cut(2))}", _undouble(cut(2))),
            (f"{n} > 4 AND {ends('ly')}", cut(2)),
            (f"{n} > 3 AND {ends('es')}", cut(2)),
            (f"{n} > 3 AND {ends('ss')}", low),
            (f"{n} > 2 AND {ends('s')}", cut(1)),
        ]
    else:
        rules = [(f"{n} > 6 AND {ends('mente')}", cut(5)), (f"{n} > 4 AND {ends('es')}", cut(2)), (f"{n} > 3 AND {ends('s')}", cut(1))]
    sql = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {low} END"
    if language == "es":
        sql = f"translate({sql}, 'áéíóúü', 'aeiouu')"
    return re.sub(r"strpos_\(", "instr(" if dialect == "spark" else "strpos(", sql)


def tokens_sql(text: str, language: str, stops: bool, dialect: str = "spark") -> str:
    """Tokens of a text as a SQL array; ``stops``: leave stop words out."""
    if dialect == "spark":
        words = "regexp_extract_all({}, '{}', 0)".format(text, WORD.replace("\\", "\\\\"))
        sql = f"transform({words}, w -> {stem_sql('w', language)})"
    else:
        words = f"regexp_extract_all({text}, '{WORD}')"
        sql = f"list_transform({words}, lambda w: {stem_sql('w', language, dialect)})"
    if stops:
        out = ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOPS if language == "en" else SPANISH_STOPS))
        sql = f"filter({sql}, t -> t NOT IN ({out}))" if dialect == "spark" else f"list_filter({sql}, lambda t: t NOT IN ({out}))"
    return sql


def _stem(word: str, language: str) -> str:
    low, n = word.lower(), len(word.encode())

    def voiced(p: str) -> bool:
        return any(c in "aeiouy" for c in p)

    def undouble(p: str) -> str:
        return p[:-1] if len(p) >= 2 and p[-1] == p[-2] and p[-1] in _DOUBLING else p

    if language == "es":
        if n > 6 and low.endswith("mente"):
            low = low[:-5]
        elif n > 4 and low.endswith("es"):
            low = low[:-2]
        elif n > 3 and low.endswith("s"):
            low = low[:-1]
        return low.translate(str.maketrans("áéíóúü", "aeiouu"))
    if n > 4 and low.endswith(("sses", "ies")):
        return low[:-2]
    if n > 4 and low.endswith("ing") and voiced(low[:-3]):
        return undouble(low[:-3])
    if n > 3 and low.endswith("ed") and voiced(low[:-2]):
        return undouble(low[:-2])
    if n > 4 and low.endswith("ly") or n > 3 and low.endswith("es"):
        return low[:-2]
    if n > 3 and low.endswith("ss"):
        return low
    return low[:-1] if n > 2 and low.endswith("s") else low


def split_words(text: str) -> list[str]:
    """Driver-side twin of WORD."""
    out, i, n = [], 0, len(text)

    def digit(c: str) -> bool:
        return unicodedata.category(c) == "Nd"

    def wordy(c: str) -> bool:
        return digit(c) or unicodedata.category(c)[0] == "L"

    while i < n:
        if not wordy(text[i]):
            i += 1
            continue
        j = i + 1
        while j < n and (wordy(text[j]) or text[j] in ".,:/-" and digit(text[j - 1]) and j + 1 < n and digit(text[j + 1])):
            j += 1
        out.append(text[i:j])
        i = j
    return out


@dataclass(frozen=True)
class Analyzer:
    """``column``: string column to array of tokens or typed value; ``local``: the same for one string."""

    name: str
    kind: str  # text, keyword, int, float, date
    column: Callable[[Column], Column]
    local: Callable[[str], list]
    #: Where every word gives one token: the words of a text, and a word's token.  Exploded words are
    #: then stemmed in generated code, which lambdas over arrays are not.
    words: Callable[[Column], Column] | None = None
    token: Callable[[Column], Column] | None = None


def _text(name: str, language: str, stops: bool | frozenset[str]) -> Analyzer:
    """``stops``: whether the language's stop words go, or which words do."""
    out = stops if isinstance(stops, frozenset) else ENGLISH_STOPS if language == "en" else SPANISH_STOPS

    def column(c: Column) -> Column:
        words = F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
        stems = F.transform(words, lambda w: _stem_column(w, language))
        return F.filter(stems, lambda t: ~t.isin(*sorted(out))) if stops else stems

    def local(s: str) -> list:
        stems = [_stem(w, language) for w in split_words(s)]
        return [t for t in stems if t not in out] if stops else stems

    if stops:
        return Analyzer(name, "text", column, local)
    return Analyzer(name, "text", column, local, lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: _stem_column(w, language))


def _stem_column(w: Column, language: str) -> Column:
    """The rules of :func:`stem_sql` over a lambda's variable."""
    low, n = F.lower(w), F.octet_length(w)

    def cut(k: int) -> Column:
        return F.substr(low, F.lit(1), F.length(low) - k)

    def voiced(p: Column) -> Column:
        return p != F.translate(p, "aeiouy", "")

    def undouble(p: Column) -> Column:
        last = F.right(p, F.lit(1))
        twice = (F.length(p) >= 2) & (last == F.substr(p, F.length(p) - 1, F.lit(1))) & F.lit(_DOUBLING).contains(last)
        return F.when(twice, F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(p)

    if language == "es":
        stem = F.when((n > 6) & low.endswith("mente"), cut(5)).when((n > 4) & low.endswith("es"), cut(2)).when((n > 3) & low.endswith("s"), cut(1)).otherwise(low)
        return F.translate(stem, "áéíóúü", "aeiouu")
    return (
        F.when((n > 4) & (low.endswith("sses") | low.endswith("ies")), cut(2))
        .when((n > 4) & low.endswith("ing") & voiced(cut(3)), undouble(cut(3)))
        .when((n > 3) & low.endswith("ed") & voiced(cut(2)), undouble(cut(2)))
        .when(((n > 4) & low.endswith("ly")) | ((n > 3) & low.endswith("es")), cut(2))
        .when((n > 3) & low.endswith("ss"), low)
        .when((n > 2) & low.endswith("s"), cut(1))
        .otherwise(low)
    )


def _int(s: str) -> list:
    return [int(s)] if re.fullmatch(r"[+-]?[0-9]+", s) and -(2**63) <= int(s) < 2**63 else []


def _float(s: str) -> list:
    return [float(s)] if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", s) else []


def _date(s: str) -> list:
    try:
        return [(datetime.date.fromisoformat(s) - datetime.date(1970, 1, 1)).days * 86_400 * 10**9] if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", s) else []
    except ValueError:
        return []


def int_value(c: Column) -> Column:
    """A whole decimal number of 64 bits, else null."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def float_value(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def date_value(c: Column) -> Column:
    """Midnight UTC of a YYYY-MM-DD date in nanoseconds, else null."""
    day = F.try_to_date(c, "yyyy-MM-dd")
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.unix_date(day).cast("bigint") * F.lit(86_400_000_000_000))


def time_value(c: Column) -> Column:
    """A timestamp in nanoseconds since 1970 (UTC)."""
    return F.unix_micros(c) * F.lit(1000)


ANALYZERS = {
    a.name: a
    for a in (
        _text("en", "en", False),
        _text("en_stop", "en", True),
        _text("es", "es", False),
        _text("es_stop", "es", True),
        Analyzer("keyword", "keyword", lambda c: F.array(c), lambda s: [s]),
        Analyzer("int", "int", int_value, _int),
        Analyzer("float", "float", float_value, _float),
        Analyzer("date", "date", date_value, _date),
        Analyzer("time", "time", time_value, _date),
    )
}

BUILT_IN = frozenset(ANALYZERS)


def analyzer(name: str) -> Analyzer:
    """A built-in or registered analyser."""
    if name not in ANALYZERS:
        raise KeyError(f"analyser {name!r} is not registered in this session")
    return ANALYZERS[name]


def register_analyzer(name: str, column: Callable[[Column], Column], local: Callable[[str], list]) -> Analyzer:
    """Makes an analyser of text known: ``column`` maps a string column to an array of tokens, ``local`` does the same for a string.

    Indexes store its name only, so it must be registered wherever they are
    read or queried.  Empty tokens drop out.  Built-in names cannot be taken.
    """
    if name in BUILT_IN:
        raise ValueError(f"{name!r} is a built-in analyser")
    ANALYZERS[name] = Analyzer(name, "text", column, lambda s: [t for t in local(s) if t])
    return ANALYZERS[name]


def text_analyzer(name: str, language: str, stops: Iterable[str] | None = None) -> Analyzer:
    """Registers the stemming analyser of a language ("en", "es") with a stop list of one's own; stop words are compared after stemming."""
    if language not in ("en", "es"):
        raise ValueError(f"no stemmer for {language!r}")
    if name in BUILT_IN:
        raise ValueError(f"{name!r} is a built-in analyser")
    ANALYZERS[name] = _text(name, language, frozenset(stops or ()))
    return ANALYZERS[name]
