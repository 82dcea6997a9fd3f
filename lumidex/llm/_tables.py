"""Sharded tables of 64-bit keys with float vectors: written by tasks, mapped by readers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, local_path, ship, tidy


def write_sharded(df: DataFrame, key: str, values: list[str], name: str, shards: int | None = None) -> tuple[str, int, int]:
    """Writes (key, values) in ``shards`` files by the key's leading bits, each sorted by key; returns a handle for :class:`Sharded`.

    A shard appears by rename, so a task can run twice.  Keys are distinct.
    """
    spark = df.sparkSession
    ship(spark)
    root = local_path(fresh(spark, name))
    os.makedirs(root)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = F.col(key)
    part = F.shiftright(F.shiftrightunsigned(k, 32) * n, 32).cast("int")
    rows = df.select(part.alias("p"), k.alias("k"), *[F.col(v).cast("float").alias(f"v{i}") for i, v in enumerate(values)])
    rows = rows.repartition(n, "p").sortWithinPartitions("p", F.col("k") < 0, "k")
    width = len(values)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = TaskContext.get().taskAttemptId()
        now, files, total = None, (), 0

        def close() -> None:
            for f in files:
                f.close()
            if now is not None:
                for ext in ("val", "key"):
                    os.replace(f"{root}/{now:05d}.{ext}.{tag}", f"{root}/{now:05d}.{ext}")

        for b in batches:
            p, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            v = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1).astype(np.float32)
            total += len(b)
            for lo, hi in _runs(p):
                if p[lo] != now:
                    close()
                    now = int(p[lo])
                    files = tuple(open(f"{root}/{now:05d}.{ext}.{tag}", "wb") for ext in ("key", "val"))
                files[0].write(k[lo:hi].tobytes())
                files[1].write(np.ascontiguousarray(v[lo:hi]).tobytes())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    rows.mapInArrow(tidy(go), "n long").agg(F.sum("n")).collect()
    return root, n, width


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(x):
        cut = np.flatnonzero(np.diff(x)) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(x)])


class Sharded:
    """Mapped tables of :func:`write_sharded`."""

    def __init__(self, handle: tuple[str, int, int]) -> None:
        self.root, self.n, self.width = handle
        self.open: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

    def _shard(self, p: int) -> tuple[np.ndarray, np.ndarray] | None:
        if p not in self.open:
            stem = f"{self.root}/{p:05d}"
            if not os.path.exists(f"{stem}.key"):
                self.open[p] = None
            else:
                keys = np.memmap(f"{stem}.key", dtype=np.uint64, mode="r")
                self.open[p] = keys, np.memmap(f"{stem}.val", dtype=np.float32, mode="r").reshape(len(keys), self.width)
        return self.open[p]

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: ascending uint64.  (found, values; zero where not found)."""
        found = np.zeros(len(keys), dtype=bool)
        values = np.zeros((len(keys), self.width), dtype=np.float32)
        part = ((keys >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)
        for lo, hi in _runs(part):
            shard = self._shard(int(part[lo]))
            if shard is None:
                continue
            at = np.minimum(np.searchsorted(shard[0], keys[lo:hi]), len(shard[0]) - 1)
            hit = shard[0][at] == keys[lo:hi]
            found[lo:hi] = hit
            values[lo:hi][hit] = shard[1][at[hit]]
        return found, values
