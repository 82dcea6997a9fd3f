"""Written intermediate tables and distributed row numbers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_temporary: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder named by spark.checkpoint.dir; in a folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = tempfile.mkdtemp(prefix="lumidex-")
            atexit.register(shutil.rmtree, _temporary[app], ignore_errors=True)
        base = "file://" + _temporary[app]
    return f"{base.rstrip('/')}/lumidex-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    local = path[7:] if path.startswith("file://") else path
    if os.path.isdir(local):
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, order: list[Column] | None = None, start: int = 0) -> DataFrame:
    """df with dense row numbers from ``start``, in ``order`` or as the rows come.

    Rows are range-partitioned and written once; a count per partition then turns
    positions within partitions into numbers, so no task sees all rows.  The counts
    are broadcast: their size is unknown to the planner, which would send the rows instead.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if order:
        df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    marked = written(df.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    rows, base = [], start
    for r in sorted(marked.groupBy("_part").count().collect()):  # a row a partition
        rows.append((r["_part"], base))
        base += r["count"]
    if not rows:
        return marked.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    parts = df.sparkSession.createDataFrame(rows, "_part int, _base bigint")
    return marked.join(F.broadcast(parts), "_part").select(*df.columns, (F.col("_base") + F.col("_pos")).alias(name))
