"""Page sources and sinks: newline-delimited JSON and MediaWiki XML dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest JSON line that is read; longer ones count as malformed.
LINE_LIMIT = 5 * 1024 * 1024

_JSON = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Title", T.StringType()), T.StructField("Content", T.StringType())])
_XML = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("revision", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
    ]
)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """id, title, content of pages, one JSON object a line, title and content in base64; bad lines are left out.

    Base64 that is none gives null, bytes that are no UTF-8 become replacement characters.
    """
    lines = spark.read.text(path).where(F.octet_length("value") <= LINE_LIMIT)
    page = lines.select(F.from_json("value", _JSON, {"mode": "PERMISSIVE"}).alias("p")).where("p.Id is not null")
    text = lambda c: F.make_valid_utf8(F.try_to_binary(F.col(c), F.lit("base64")).cast("string"))
    return page.select(F.col("p.Id").alias("id"), text("p.Title").alias("title"), text("p.Content").alias("content"))


def write_ndjson(pages: DataFrame, path: str) -> None:
    """The inverse of :func:`read_ndjson`; pages hold id, title, content."""
    code = lambda c: F.base64(F.encode(F.col(c), "UTF-8"))
    pages.select(F.col("id").cast("bigint").alias("Id"), code("title").alias("Title"), code("content").alias("Content")).write.json(path)


def read_mediawiki(spark: SparkSession, path: str) -> DataFrame:
    """id, title, content (text of the last revision) of a MediaWiki export, plain or compressed."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(_XML).load(path)
    return pages.select("id", "title", F.try_element_at("revision", F.lit(-1))["text"].alias("content")).where("id is not null")
