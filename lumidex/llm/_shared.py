"""Folder shared by all executors, tables written into it, and shipping of this package."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where the setting is absent (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lumidex-")
            atexit.register(shutil.rmtree, local_path(_own[app]), ignore_errors=True)
        where = _own[app]
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def local_path(uri: str) -> str:
    """Path of a mounted shared folder; an error for storage that is not mounted, since workers map files from it."""
    scheme = uri.partition(":/")[0] if ":/" in uri else ""
    if scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a folder that all executors have mounted, not {uri}")
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    where = f"{shared_dir(spark).rstrip('/')}/lumidex-{name}-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, local_path(where), ignore_errors=True)
    return where


def written(df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = fresh(spark, name)
    out = df.write
    if by:
        out = out.partitionBy(by)
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lumidex_path = path
    return back


def forget(df: DataFrame) -> None:
    """Removes what :func:`written` wrote, once nothing reads it any more."""
    path = getattr(df, "_lumidex_path", None)
    if path:
        shutil.rmtree(local_path(path), ignore_errors=True)


#: Rows of a batch that goes to a Python worker.  Rows are whole texts here, and Spark counts rows, not bytes.
BATCH = 1000


def tidy(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Has a worker give back freed memory when a task ends; workers live on and would keep it."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from each(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python path need not hold it, and makes batches small where the session sets no size."""
    own = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(own):
        spark.conf.set(own, BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_lumidex_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = local_path(fresh(spark, "code"))
    os.makedirs(target, exist_ok=True)
    with zipfile.ZipFile(f"{target}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(f"{target}/{root.name}.zip")
    sc._lumidex_shipped = True


def estimated_bytes(df: DataFrame) -> int:
    """The size of df that its plan's statistics give (files: theirs); 0 where they know nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, found by exact name whatever other columns are called."""
    names = df.columns
    inner = df.toDF(*[f"u{i}" for i in range(len(names))])
    return inner.select(*[F.col(f"u{names.index(c)}").alias(c) for c in dict.fromkeys(columns)])


def isolate(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """df with its columns called u0, u1, ..., what ``columns`` are called there, and the way back to the old names.

    Operators that carry all columns work on the inner names, so none clashes with their own.
    """
    names = df.columns
    inner = [f"u{i}" for i in range(len(names))]

    def back(out: DataFrame) -> DataFrame:
        more = [c for c in out.columns if c not in inner]
        return out.select(*inner, *more).toDF(*names, *more)

    return df.toDF(*inner), [f"u{names.index(c)}" for c in columns], back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
