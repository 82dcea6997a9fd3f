"""Scalar expressions: BM25 parts, byte edit distance, sortable encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Edit distances are only defined below this many bytes, and up to three edits.
EDIT_BYTES, EDIT_MAX = 60, 3


def fast_ln(x: Column) -> Column:
    """Natural logarithm by exponent and a quadratic in the mantissa of [1, 2); off by up to 5e-4."""
    e = F.floor(F.log2(x)).cast("double")
    m = x / F.pow(F.lit(2.0), e)
    return (e + (F.lit(-1.0 / 3) * m + 2.0) * m - F.lit(5.0 / 3)) * F.lit(0.6931471805599453)


def idf(n: Column, df: Column, ln=F.log) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)); 0 where df exceeds n or n is 0."""
    return F.when((n <= 0) | (df > n), F.lit(0.0)).otherwise(ln(1 + (n - df + 0.5) / (df + 0.5)))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, boost: Column | float = 1.0, k1: float = K1, b: float = B, ln=F.log) -> Column:
    """Score of one term of one document.  0 for k1 or b stands for the default."""
    k1, b = k1 or K1, b or B
    boost = boost if isinstance(boost, Column) else F.lit(float(boost))
    return boost * idf(n, df, ln) * (k1 + 1) * tf / (tf + k1 * (1 - b) + dl * (k1 * b) / avgdl)


def byte_string(c: Column) -> Column:
    """A string of one character per UTF-8 byte, so that character functions count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def byte_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance over bytes, -1 where above k."""
    return F.levenshtein(byte_string(a), byte_string(b), k)


def levenshtein_match(a: Column, b: Column, k: int) -> Column:
    """Whether a and b are within k <= 3 byte edits; false from 60 bytes on."""
    if not 0 <= k <= EDIT_MAX:
        return F.lit(False)
    short = (F.octet_length(a) < EDIT_BYTES) & (F.octet_length(b) < EDIT_BYTES)
    return short & (F.abs(F.octet_length(a) - F.octet_length(b)) <= k) & (byte_distance(a, b, k) >= 0)


def sortable_int(c: Column) -> Column:
    """Eight big-endian bytes whose order is the numbers' order."""
    return F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def sortable_int_back(c: Column) -> Column:
    return F.conv(F.hex(c), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(2**63)))
