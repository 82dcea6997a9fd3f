"""The query language: terms with + and -, field:value with comparisons, ;boost and ~fuzziness.

    query  = term*
    term   = ["+" | "-"] word [":" [">=" | "<=" | ">" | "<"] value] [";" number] ["~" int]

Words and values are dates, decimals, integers, "phrases" or keywords.  A lexer
rule that comes first wins, so ``42abc`` is two words and ``10-5`` excludes 5.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_LETTER = "A-Za-z0-9" + "áéíóúñ" + "ÁÉÍÓÚÑ"
_RULES = re.compile(
    "|".join(
        f"(?P<{name}>{rule})"
        for name, rule in (
            ("space", r"[ \t\r\n]+"),
            ("mark", r"[:;~]"),
            ("sign", r"[-+]"),
            ("compare", r"[<>]=?"),
            ("date", r'[0-9]{4}(?:-[0-9]{2}){2}|"[0-9]{4}(?:-[0-9]{2}){2}"'),
            ("float", r'[0-9]+[.][0-9]+|"[0-9]+[.][0-9]+"'),
            ("int", r'[0-9]+|"[0-9]+"'),
            ("phrase", r'"(?:\\"|[^"])*"'),
            ("keyword", rf"[{_LETTER}](?:[{_LETTER}]|[!-/<-@\[-`{{-}}])*"),
        )
    )
)
_VALUES = ("date", "float", "int", "phrase", "keyword")
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}


class QueryError(ValueError):
    """The text is no query."""


@dataclass(frozen=True)
class Match:
    value: str
    compare: str = ""


@dataclass(frozen=True)
class Term:
    word: str
    sign: str = ""
    match: Match | None = None
    boost: float | None = None
    fuzzy: int | None = None


def _unquote(s: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU":
            return chr(int(c[1:], 16))
        if c in _ESCAPES:
            return _ESCAPES[c]
        raise QueryError(f"unknown escape \\{c}")

    body = s[1:-1]
    if "\n" in body:
        raise QueryError("line break in a phrase")
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, body)


def tokens(text: str) -> list[tuple[str, str]]:
    """(rule, text) of every token but white space."""
    out, i = [], 0
    while i < len(text):
        m = _RULES.match(text, i)
        if not m:
            raise QueryError(f"nothing known at {text[i : i + 10]!r}")
        if m.lastgroup != "space":
            raw = m[0]
            if m.lastgroup == "phrase":
                raw = _unquote(raw)
                if raw.startswith('"'):  # quotes that were escaped at both ends go as well
                    raw = raw[1:-1]
            out.append((m.lastgroup, raw))
        i = m.end()
    return out


def parse(text: str) -> list[Term]:
    """The terms of a query; an empty text has none."""
    seq = tokens(text)
    i = 0

    def peek() -> tuple[str, str]:
        return seq[i] if i < len(seq) else ("end", "")

    def value() -> str:
        nonlocal i
        kind, raw = peek()
        if kind not in _VALUES:
            raise QueryError(f"a word or value is missing before {raw!r}" if raw else "a word or value is missing at the end")
        i += 1
        return raw[1:-1] if kind in ("date", "float", "int") and raw.startswith('"') else raw

    out = []
    while i < len(seq):
        sign, match, boost, fuzzy = "", None, None, None
        if peek()[0] == "sign":
            sign = peek()[1]
            i += 1
        word = value()
        if peek() == ("mark", ":"):
            i += 1
            compare = ""
            if peek()[0] == "compare":
                compare = peek()[1]
                i += 1
            match = Match(value(), compare)
        if peek() == ("mark", ";"):
            i += 1
            kind, raw = peek()
            if kind not in ("float", "int") or raw.startswith('"'):
                raise QueryError("a boost is a number")
            boost = float(raw)
            i += 1
        if peek() == ("mark", "~"):
            i += 1
            kind, raw = peek()
            if kind != "int" or raw.startswith('"'):
                raise QueryError("a fuzziness is a whole number")
            fuzzy = int(raw)
            i += 1
        out.append(Term(word, sign, match, boost, fuzzy))
    return out
