"""Mixing sources to target weights by balanced sampling (cube method).

Sources, in code point order with null last, weigh WEIGHTS, repeating, and
share SHARE of all words.  A target stops at CAP times its source's words; the
excess is shared again by weight until no target is above (:func:`targets`).
A document is taken floor(r) times for certain, r being its source's target
divided by the source's words, and once more with probability r - floor(r).

The flight phase of the cube method moves these fractional probabilities along
the null space of two constraints, the source's token total and its document
total: three fractional documents at a time, until one of them is decided.
Every block of documents does this for each source by itself and leaves at most
two documents of a source undecided, with both totals kept.  What is left of
FAN blocks forms a block of the next level.  The last level lands the at most
two documents of a source by the rounding that misses the token total least,
then exchanges a taken for an untaken document, a few times, while that misses
it less.

Scale: blocks are drawn by a hash of the document and hold about BLOCK
documents, however large a source is; a source that holds a third of all rows
just lies in more of them.  Equal rows are numbered within their partition, so
they spread over the blocks too.  Random choices are hashes of the document, so
reruns over the same files agree.

Defined cases: null text has size 0.  A null source is a source of its own.
Repeated rows are documents of their own.  A source without words gets target 0
and nothing is taken.  An empty table gives an empty result.  Other columns are
ignored by :func:`mix` and carried by :func:`resample`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import forget, isolate, pick, ship, tidy, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 4_000
FAN = 1000
#: Exchanges of a taken for an untaken document that may end a landing.
EXCHANGES = 16
SEED = b"mix-1"


def with_size(docs: DataFrame, text: str, keep: list[str], size: str, same: list[str], squeeze_to: str | None = None) -> DataFrame:
    """``keep`` of docs, the number of words of ``text``, a hash ``_h`` and the text compressed where asked for.

    The hash is one of the columns ``same`` and of how many rows that agree in
    them came before in the partition, so it tells equal rows apart: no more of
    them share a hash than there are partitions.
    """
    ship(docs.sparkSession)
    extra = [T.StructField(size, T.LongType()), T.StructField("_h", T.LongType())] + ([T.StructField(squeeze_to, T.BinaryType())] if squeeze_to else [])
    schema = T.StructType([docs.schema[c] for c in keep] + extra)
    names = [f.name for f in schema]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        met: dict[int, int] = {}
        for b in batches:
            column = b.column(len(keep))
            n = [np.diff(w.bounds) for w in W.scan(column, hashes=False)]
            h = b.column(len(keep) + 1).to_numpy()
            before = np.zeros(len(h), dtype=np.uint64)
            for i, x in enumerate(h.tolist()):
                before[i] = met.get(x, 0)
                met[x] = int(before[i]) + 1
            h = W.mix(h.view(np.uint64) + before * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            arrays = [b.column(i) for i in range(len(keep))] + [pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(h)]
            if squeeze_to:
                data, off = W.string_buffers(column)
                z = [squeeze(data[lo:hi].tobytes()) if ok else None for lo, hi, ok in zip(off[:-1].tolist(), off[1:].tolist(), column.is_valid().to_pylist())]
                arrays.append(pa.array(z, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"), F.xxhash64(*[F.col(f"`{c}`") for c in same]).alias("_same")).mapInArrow(tidy(go), schema)


def source_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes: skey, words (one row a source).  Adds target; a written table of one row a source.

    Keys of sources start with ``=``, the null key is ``~`` and sorts behind
    them.  Ranks come from a range partitioning, the level of the targets from
    rounds of one aggregation each.
    """
    spark = sizes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = written(
        sizes.repartitionByRange(n, "skey").sortWithinPartitions("skey").select("skey", "words", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos")),
        "sources",
    )
    per = sorted(ranked.groupBy("pid").count().collect())  # a row a partition
    base, rows = 0, []
    for r in per:
        rows.append((r["pid"], base))
        base += r["count"]
    starts = spark.createDataFrame(rows, "pid int, base long")
    rank = (F.col("base") + F.col("pos")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank + 1).cast("int"))
    table = written(ranked.join(starts, "pid").select("skey", "words", weight.alias("weight")), "sources")
    forget(ranked)
    total = table.agg(F.sum("words").alias("t"), F.sum("weight").alias("w")).first()
    want = share * float(total["t"] or 0)
    level = want / total["w"] if total["w"] else 0.0
    while True:
        full = F.col("weight") * level >= F.col("words") * cap
        r = table.agg(F.sum(F.when(full, F.col("words"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        new = (want - cap * float(r["full"] or 0)) / r["free"] if r["free"] else level
        if new <= level or not r["free"]:
            break
        level = new
    return table.select("skey", F.col("words").alias("source_size"), F.least(F.col("weight") * level, F.col("words") * cap).alias("target"))


def _uniform(h: int, p: float) -> float:
    raw = hashlib.blake2b(b"%d|%r" % (h, p), digest_size=8, key=SEED).digest()
    return (int.from_bytes(raw, "little") >> 11) * 2.0**-53


def _step(units: list[list]) -> None:
    """Moves the probabilities of three units along the null space until one is 0 or 1.  Unit: [row, size, p, hash]."""
    (_, a, _, _), (_, b, _, _), (_, c, _, _) = units
    u = (b - c, c - a, a - b)
    if u == (0, 0, 0):
        u = (1, -1, 0)
    up = min((1 - x[2]) / v if v > 0 else x[2] / -v for x, v in zip(units, u) if v)
    down = min(x[2] / v if v > 0 else (1 - x[2]) / -v for x, v in zip(units, u) if v)
    move = up if _uniform(units[0][3] ^ units[1][3] ^ units[2][3], units[0][2]) * (up + down) < down else -down
    for x, v in zip(units, u):
        x[2] = min(1.0, max(0.0, x[2] + move * v))
        if x[2] < 1e-9:
            x[2] = 0.0
        elif x[2] > 1 - 1e-9:
            x[2] = 1.0


def _land(units: list[list], miss: float) -> float:
    """Rounds the last units of a source so that the token total is missed least; ``miss`` is what the decided ones exceed it by."""
    best = None
    for bits in range(1 << len(units)):
        take = [(bits >> i) & 1 for i in range(len(units))]
        off = miss + sum(x[1] * (t - x[2]) for x, t in zip(units, take))
        key = (abs(off), abs(sum(t - x[2] for x, t in zip(units, take))))
        if best is None or key < best[0]:
            best = key, take, off
    for x, t in zip(units, best[1]):
        x[2] = float(t)
    return best[2]


def _exchange(sizes: np.ndarray, taken: np.ndarray, off: float) -> tuple[int, int] | None:
    """A taken and an untaken unit whose exchange brings ``off`` nearest to zero, if any brings it nearer."""
    ins, outs = np.flatnonzero(taken), np.flatnonzero(~taken)
    if not len(ins) or not len(outs):
        return None
    outs = outs[np.argsort(sizes[outs], kind="stable")]
    want = sizes[ins] - off  # size of the unit to take instead
    at = np.searchsorted(sizes[outs], want)
    left, right = np.maximum(at - 1, 0), np.minimum(at, len(outs) - 1)
    near = np.where(np.abs(sizes[outs[left]] - want) <= np.abs(sizes[outs[right]] - want), left, right)
    gap = np.abs(sizes[outs[near]] - want)
    k = int(np.argmin(gap))
    return (int(ins[k]), int(outs[near[k]])) if gap[k] < abs(off) else None


def _flight(df: DataFrame, last: bool) -> DataFrame:
    """Decides documents of each (_block, skey) run of sorted partitions: _p becomes 0 or 1 but for at most two a run.

    The last level also lands those two; its runs hold about BLOCK rows at most,
    being one block or what FAN blocks left open.
    """
    names = df.columns
    k, s, p, h, blk = (names.index(c) for c in ("skey", "_size", "_p", "_h", "_block"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, units, held, members = None, [], [], []
        begin = None

        def settle() -> None:
            if last and members:
                miss = sum(size * (e[1][j] - prob) for e, j, size, prob in members)
                off = _land(units, miss)
                for (e, j), _, q, _ in units:
                    e[1][j] = q
                sizes = np.array([m[2] for m in members], dtype=float)
                taken = np.array([m[0][1][m[1]] for m in members]) > 0.5
                for _ in range(EXCHANGES):
                    swap = _exchange(sizes, taken, off)
                    if not swap:
                        break
                    off += sizes[swap[1]] - sizes[swap[0]]
                    for i, value in zip(swap, (False, True)):
                        taken[i] = value
                        members[i][0][1][members[i][1]] = float(value)
            units.clear()
            members.clear()

        def release(until: list | None) -> Iterator[pa.RecordBatch]:
            while held and held[0] is not until:
                b, cells = held.pop(0)
                col = pa.array(cells, pa.float64())
                yield pa.RecordBatch.from_arrays([col if i == p else b.column(i) for i in range(len(names))], names=names)

        for b in batches:
            if not len(b):
                continue
            entry = [b, b.column(p).to_pylist()]
            held.append(entry)
            for i, (key, size, prob, hsh, bl) in enumerate(zip(b.column(k).to_pylist(), b.column(s).to_pylist(), list(entry[1]), b.column(h).to_pylist(), b.column(blk).to_pylist())):
                if (bl, key) != run:
                    settle()
                    run, begin = (bl, key), entry
                if not 0 < prob < 1:
                    continue
                if last:
                    members.append((entry, i, size, prob))
                units.append([(entry, i), size, prob, hsh])
                while len(units) == 3:
                    _step(units)
                    for (e, j), _, q, _ in units:
                        e[1][j] = q
                    units[:] = [x for x in units if 0 < x[2] < 1]
            yield from release(begin)
        settle()
        yield from release(None)

    return df.mapInArrow(tidy(go), df.schema)


def _decide(rows: DataFrame, n_rows: int, skey_sizes: DataFrame) -> DataFrame:
    """rows: skey, _size, _h and others.  Adds source_size, target, _times: how often each row is taken."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    r = rows.join(skey_sizes, "skey").withColumn("_r", ratio)
    frac = F.col("_r") - F.floor("_r")
    r = r.withColumn("_base", F.floor("_r").cast("int") + F.when(frac > 1 - 1e-9, 1).otherwise(0)).withColumn("_p", F.when((frac < 1e-9) | (frac > 1 - 1e-9), 0.0).otherwise(frac)).drop("_r")
    blocks = max(1, math.ceil(n_rows / BLOCK))
    todo = r.withColumn("_block", F.pmod(F.xxhash64("_h", F.lit(9)), F.lit(blocks)).cast("int"))
    done: DataFrame | None = None
    open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
    while True:
        last = blocks == 1
        part = todo.repartition("_block").sortWithinPartitions("_block", "skey", "_h", "_size")
        level = written(_flight(part, last), "flight")
        sure = level.where(~open_)
        done = sure if done is None else done.unionByName(sure)
        if last:
            break
        blocks = math.ceil(blocks / FAN)
        todo = level.where(open_).withColumn("_block", F.pmod(F.col("_block"), F.lit(blocks)))
    return done.withColumn("_times", F.col("_base") + F.col("_p").cast("int"))


def _sized(docs: DataFrame, id_col: str, text: str, source: str, keep: list[str], squeeze_to: str | None) -> tuple[DataFrame, int, DataFrame]:
    rows = with_size(docs, text, keep, "_size", [id_col, source, text], squeeze_to)
    rows = rows.select("*", source_key(F.col(f"`{source}`")).alias("skey"))
    rows = written(rows, "sizes")
    sizes = rows.groupBy("skey").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, "sources")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    return rows, n, targets(sizes.select("skey", "words"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: id, size, source_size, target, taken (words, repeats counted)."""
    docs = pick(docs, id_col, text, source).toDF("u0", "u1", "u2")
    rows, n, goal = _sized(docs, "u0", "u1", "u2", ["u0", "u2"], None)
    out = _decide(rows, n, goal)
    return out.select(F.col("u0").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).alias("taken"))


def resample(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    docs, (id_col, text, source), back = isolate(docs, id_col, text, source)
    names = docs.columns
    keep = [c for c in names if c != text]
    rows, n, goal = _sized(docs, id_col, text, source, keep, "_z")
    out = _decide(rows, n, goal).where("_times > 0").select(*[F.col(f"`{c}`") for c in keep], "_z", "_times")
    schema = docs.schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            text_col = pa.array([None if z is None else unpack(z) for z in b.column(len(keep)).to_pylist()], pa.binary()).cast(pa.string())
            t = pa.RecordBatch.from_arrays([text_col if c == text else b.column(keep.index(c)) for c in names], names=names)
            yield t.take(pa.array(np.repeat(np.arange(len(b)), b.column(len(keep) + 1).to_numpy())))

    return back(out.mapInArrow(tidy(go), schema))
