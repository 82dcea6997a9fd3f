"""Field specifications and the projection of rows to postings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import ANALYZERS, Analyzer, analyzer

POSTINGS = ("field", "term", "num_i", "num_f", "doc_idx", "tf", "dl")


@dataclass(frozen=True)
class FieldSpec:
    """A field of the index: the column it comes from (or an array of values) and its analyser."""

    name: str
    analyzer: str = "en"
    column: str | None = None

    @property
    def source(self) -> str:
        return self.column or self.name

    @property
    def rules(self) -> Analyzer:
        return analyzer(self.analyzer)

    @property
    def value(self) -> str:
        """The column of the postings that has its values."""
        return {"text": "term", "keyword": "term", "float": "num_f"}.get(self.rules.kind, "num_i")

    def as_dict(self) -> dict:
        return asdict(self)


def text(name: str, analyzer: str = "en", column: str | None = None) -> FieldSpec:
    return FieldSpec(name, analyzer, column)


def keyword(name: str, column: str | None = None) -> FieldSpec:
    return FieldSpec(name, "keyword", column)


def integer(name: str, column: str | None = None) -> FieldSpec:
    return FieldSpec(name, "int", column)


def floating(name: str, column: str | None = None) -> FieldSpec:
    return FieldSpec(name, "float", column)


def date(name: str, column: str | None = None) -> FieldSpec:
    return FieldSpec(name, "date", column)


def time(name: str, column: str | None = None) -> FieldSpec:
    return FieldSpec(name, "time", column)


def _typed(df: DataFrame, spec: FieldSpec, many: bool) -> DataFrame:
    """(doc_idx, v): values of a numeric, date or time field, one row a value."""
    kind = df.schema[spec.source].dataType
    c = F.explode(spec.source) if many else F.col(f"`{spec.source}`")
    rows = df.select("doc_idx", c.alias("v"))
    raw = (kind.elementType if many else kind).simpleString()
    v = F.col("v")
    if spec.analyzer == "float":
        v = v.cast("double") if raw != "string" else ANALYZERS["float"].column(v)
    elif spec.analyzer == "time":
        v = F.unix_micros(v.cast("timestamp")) * 1000 if raw != "bigint" else v
    elif spec.analyzer == "date":
        v = ANALYZERS["date"].column(v) if raw == "string" else v if raw == "bigint" else F.unix_date(v.cast("date")).cast("bigint") * 86_400_000_000_000
    else:
        v = v.cast("bigint") if raw != "string" else ANALYZERS["int"].column(v)
    return rows.select("doc_idx", v.alias("v")).where("v is not null")


def single(df: DataFrame, spec: FieldSpec) -> bool:
    """Whether a row has one value of the field at most, so that nothing is counted."""
    return spec.rules.kind != "text" and df.schema[spec.source].dataType.typeName() != "array"


def by_document(df: DataFrame, parts: int) -> DataFrame:
    """df spread by doc_idx, so that the tokens of a document are counted where its text is and never shuffled for it."""
    return df.repartition(parts, "doc_idx")


def postings(df: DataFrame, specs: Iterable[FieldSpec]) -> DataFrame:
    """Postings of all fields: field, term | num_i | num_f, doc_idx, tf (times in the document), dl (length of the field).

    df holds doc_idx.  Tokens are counted by a partial aggregation before they
    are shuffled, so repeats within a document never travel; where df is
    partitioned by doc_idx (:func:`by_document`), no token does.
    """
    out = None
    for s in specs:
        many = df.schema[s.source].dataType.typeName() == "array"
        kind = s.rules.kind
        if kind in ("text", "keyword"):
            col = F.col(f"`{s.source}`")
            stem = s.rules.token if kind == "text" and not many else None
            if stem:
                toks = s.rules.words(col)
            elif many:
                toks = F.flatten(F.transform(col, s.rules.column)) if kind == "text" else col
            else:
                toks = s.rules.column(col)
            rows = df.where(col.isNotNull()).select("doc_idx", toks.alias("t"))
            if kind == "text" and not stem:
                rows = rows.select("doc_idx", F.filter("t", lambda x: x != "").alias("t"))
            if kind == "text":  # a filter on the size, which explode has too, would split the texts once more, before they are spread
                rows = rows.select("doc_idx", F.size("t").alias("dl"), F.explode_outer("t").alias("term")).where("term is not null")
            else:
                rows = rows.where(F.size("t") > 0).select("doc_idx", F.size("t").alias("dl"), F.explode("t").alias("term"))
            if stem:
                rows = rows.select("doc_idx", "dl", stem(F.col("term")).alias("term"))
            if kind == "keyword" and not many:
                rows = rows.withColumn("tf", F.lit(1))
            else:
                rows = rows.groupBy("doc_idx", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
            part = rows.select(F.lit(s.name).alias("field"), "term", F.lit(None).cast("bigint").alias("num_i"), F.lit(None).cast("double").alias("num_f"), "doc_idx", "tf", "dl")
        else:
            rows = _typed(df, s, many)
            if many:
                rows = rows.groupBy("doc_idx", "v").agg(F.count(F.lit(1)).cast("int").alias("tf"))
                total = rows.groupBy("doc_idx").agg(F.sum("tf").cast("int").alias("dl"))
                rows = rows.join(total, "doc_idx")
            else:
                rows = rows.select("doc_idx", "v", F.lit(1).alias("tf"), F.lit(1).alias("dl"))
            real = kind == "float"
            part = rows.select(
                F.lit(s.name).alias("field"), F.lit(None).cast("string").alias("term"), (F.lit(None) if real else F.col("v")).cast("bigint").alias("num_i"),
                (F.col("v") if real else F.lit(None)).cast("double").alias("num_f"), "doc_idx", "tf", "dl",
            )
        out = part if out is None else out.unionByName(part)
    return out

