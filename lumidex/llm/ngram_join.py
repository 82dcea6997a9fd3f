"""N-gram Jaccard join: near duplicates by a MinHash LSH forest and an exact join of what it leaves out.

A text's set holds the hashes of its N-word shingles (of all its words if they
are fewer).  Two rows are linked if the Jaccard similarity of their sets is at
least ``threshold``; a class is a connected component of links.

1. One narrow pass gives every row a digest of its set, TREES labels of DEPTH
   minima, and a signature (a byte of each minimum).  Rows of equal sets become
   one node; from here on copies cost nothing.
2. The labels of each tree are sorted once, over the whole cluster
   (:func:`forest`): a sorted array is a prefix trie, its runs of equal prefixes
   are the trie's nodes.  Neighbours tell how long a prefix each label shares with
   any other; only labels with company go on.
3. Matched prefixes start at full length.  At a length, every member of a run is
   paired with the run's least node (:func:`_stars`), which is linear in the run,
   and the pairs are verified.  From the verified links follows the recall that
   this length has on these data: a link of similarity s shares a prefix of
   length d in some tree with chance 1 - (1 - s^d)^TREES, so each found link
   stands for the inverse of that (:func:`recall_of`).  While that recall misses
   the target, prefixes are shortened by one.
4. Where it is met, the runs whose members still belong to several classes are
   gone through (:func:`_crosses`): pairs of members of different classes whose
   signatures allow the threshold are verified.  Members of one class are not
   paired again, so a cluster of n near copies costs about n pairs, not n^2.
   Runs of more than BUCKET members are split into blocks, and pairs of blocks
   are tasks: none is capped.
5. What chance left out is found exactly (:func:`rest`).  All sets are put in one
   order, about from rare to frequent shingles; two sets whose similarity is at
   least the threshold share a shingle before the last ones, as many as the
   threshold demands.  Sets are joined by those first shingles, sizes and places
   leave few pairs over, and these are verified.  Any order is right; the
   frequencies, counted in SLOTS bytes at most, only make it fast.  Shingles of a
   single set, told by BITS bits at most, come first and are not sent: a text that
   is like no other mostly sends nothing.
6. Verification is on the texts themselves.  They lie compressed in packs in the
   shared folder (:func:`_packs`) and are read from there, so none is shuffled.
   Nodes are grouped by their least neighbour and blocks of SHINGLES shingles, so
   a text is read once for each group it has pairs in, not once a pair, and a
   task's memory is bounded.

So classes are those of all links.  ``degrees=True`` also finds the links within
a class, so that ``n_links`` is complete; that is n^2 in a cluster of n different
texts.  The exact join then goes through all pairs, of one class or not, so step 4
is left to it.

Defined cases: a text without words (null included) has an empty set: it is
linked to nothing and is a class of its own.  Repeated rows are copies.  Null
ids take part and count last for the class id; a class of null ids alone has a
null class id.  Empty tables give empty results.  Other columns are ignored by
:func:`classes` and carried by :func:`keep_one`.
"""

from __future__ import annotations

import math
import os
import shutil
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import forget, fresh, isolate, local_path, pick, ship, tidy, written

N = 3
THRESHOLD = 0.5
RECALL = 0.98
TREES, DEPTH = 24, 4
#: Members of a run that one block holds.
BUCKET = 4096
#: Shingles of the texts that one block of a verification task holds.
SHINGLES = 1 << 21
#: Standard errors by which a pair's signature may miss the threshold before the pair is left out; None verifies all.
SCREEN = 5.0
SEEN = 1 << 18
#: Slots of the table of shingle frequencies and of the finer one that tells shingles of a single set, at most; slots of the latter that are summed up at once.
SLOTS, BITS, PIECE = 1 << 27, 1 << 34, 1 << 23
#: Packs of texts that a task has open at once.
OPEN = 128
#: Shingles or pairs that a task gathers before it sends them on.
GATHER = 1 << 20

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def share(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that two sets of this similarity share a prefix of ``depth`` minima in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def recall_of(similarities: Iterable[tuple[float, int]], depth: int, threshold: float) -> float:
    """Share of all links that prefixes of ``depth`` find, judged by the found ones: (similarity, how many).

    One more link, right at the threshold, is assumed, so that few links prove little.
    """
    found, all_ = 1.0, 1 / share(threshold, depth)
    for s, n in similarities:
        found += n
        all_ += n / share(s, depth)
    return found / all_


def shingle_sets(texts: pa.Array | pa.ChunkedArray, n: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, bounds): the hashes of each row ascend and are distinct."""
    for w in W.scan(texts):
        key, at = W.window_hashes(w.hashes, w.bounds, n)
        doc = np.searchsorted(w.bounds, at, side="right") - 1
        size = np.diff(w.bounds)
        few = np.flatnonzero((size > 0) & (size < n))
        if len(few):
            extra = []
            for d in few.tolist():
                h = int(size[d])
                for x in w.hashes[w.bounds[d] : w.bounds[d + 1]].tolist():
                    h = (h * 0x9FB21C651E98DF25 + x) % (1 << 64)
                extra.append(h)
            key, doc = np.append(key, W.mix(np.array(extra, dtype=np.uint64))), np.append(doc, few)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        yield w.first, key, np.searchsorted(doc, np.arange(w.n_docs + 1))


def _minima(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of each non-empty set, 32 bits each."""
    out = np.empty((len(_MUL), len(bounds) - 1), dtype=np.uint32)
    buffer = np.empty(len(key), dtype=np.uint64)
    for i, (a, x) in enumerate(zip(_MUL, _XOR)):
        np.bitwise_xor(key, x, out=buffer)
        np.multiply(buffer, a, out=buffer)
        high = buffer.view(np.uint32)[1::2]
        out[i] = np.minimum.reduceat(high, bounds[:-1])
    return out


def _labels(minima: np.ndarray) -> np.ndarray:
    """Labels of each set, one a tree: rows x TREES x 2, int64.  Tree, first and second minimum; third and fourth."""
    m = [minima[d::DEPTH].astype(np.uint64) for d in range(DEPTH)]
    tree = np.arange(TREES, dtype=np.uint64)[:, None] << np.uint64(58)
    out = np.empty((minima.shape[1], TREES, 2), dtype=np.uint64)
    out[:, :, 0] = (tree | (m[0] >> np.uint64(3)) << np.uint64(29) | m[1] >> np.uint64(3)).T
    out[:, :, 1] = (m[2] << np.uint64(32) | m[3]).T
    return out.view(np.int64)


def _prefix(depth: int) -> list[Column]:
    """The prefix of a label (hi, lo) as two columns."""
    hi, lo = F.col("hi"), F.col("lo")
    zero = F.lit(0).cast("long")
    return [(hi, lo), (hi, F.shiftrightunsigned(lo, 32)), (hi, zero), (F.shiftrightunsigned(hi, 29), zero)][DEPTH - depth]


_ROWS = "id long, tid binary, set binary, n long, keys binary, sig binary"


def _rows(docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = W.string_buffers(b.column(1))
            for first, key, bounds in shingle_sets(b.column(1), n):
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                keys: list[bytes] = [b""] * len(size)
                sigs: list[bytes] = [b""] * len(size)
                if len(full):
                    m = _minima(key, np.append(bounds[full], len(key)))
                    lab = _labels(m)
                    sig = np.ascontiguousarray((m.T & 255).astype(np.uint8))
                    for i, d in enumerate(full.tolist()):
                        keys[d], sigs[d] = lab[i].tobytes(), sig[i].tobytes()
                sets = [xxhash.xxh3_128_digest(key[lo:hi].tobytes()) for lo, hi in zip(bounds[:-1], bounds[1:])]
                tids = [xxhash.xxh3_128_digest(data[off[first + d] : off[first + d + 1]].tobytes()) for d in range(len(size))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(size)), pa.array(tids, pa.binary()), pa.array(sets, pa.binary()), pa.array(size), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["id", "tid", "set", "n", "keys", "sig"],
                )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(go), _ROWS)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _common(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Length of the prefix that each label shares with the next one."""
    x, y = hi[1:] ^ hi[:-1], lo[1:] ^ lo[:-1]
    same = x == 0
    return np.where(same & (y == 0), 4, np.where(same & (y.view(np.uint64) >> np.uint64(32) == 0), 3, np.where(same, 2, np.where(x.view(np.uint64) >> np.uint64(29) == 0, 1, 0))))


def forest(nodes: DataFrame) -> DataFrame:
    """nodes: nid, keys.  (hi, lo, nid, matched): labels of all trees that share a prefix with another, and its greatest length.

    All labels are sorted once, by ranges; a hot prefix may span several of them.
    A label at the edge of a range does not see one of its neighbours and counts
    as matched in full: it goes along, alone or not.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                key = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[::2]), pa.array(key[1::2]), pa.array(np.repeat(b.column(0).to_numpy(), TREES))], names=["hi", "lo", "nid"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, DEPTH  # the last label, and what it shares with the one before

        def some(cols: list[np.ndarray], matched: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(matched)
            return pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in cols], pa.array(matched[at].astype(np.int32))], names=["hi", "lo", "nid", "matched"])

        for b in batches:
            if not len(b):
                continue
            cols = [b.column(i).to_numpy() for i in range(3)]
            if held is not None:
                cols = [np.append(h, c) for h, c in zip(held, cols)]
            common = _common(cols[0], cols[1])
            left = np.append(before, common)
            yield some([c[:-1] for c in cols], np.maximum(left[:-1], common))
            held, before = [c[-1:] for c in cols], int(left[-1])
        if held is not None:
            yield some(held, np.array([DEPTH]))

    labels = nodes.select("nid", "keys").mapInArrow(tidy(expand), "hi long, lo long, nid long")
    ordered = labels.repartitionByRange(_parts(nodes), "hi", "lo", "nid").sortWithinPartitions("hi", "lo", "nid")
    return written(ordered.mapInArrow(tidy(match), "hi long, lo long, nid long, matched int"), "forest", by="matched")


def _members(trie: DataFrame, depth: int) -> DataFrame:
    """(p, q, nid): the run (p, q) of its prefix of ``depth`` for each label that may share it."""
    p, q = _prefix(depth)
    return trie.where(F.col("matched") >= depth).select(p.alias("p"), q.alias("q"), "nid")


def _stars(trie: DataFrame, depth: int, done: DataFrame | None) -> DataFrame:
    """(a, b): the least node of each run with each other member, but for pairs that are ``done``."""
    rows = _members(trie, depth)
    least = rows.groupBy("p", "q").agg(F.min("nid").alias("a"))
    pairs = rows.join(least, ["p", "q"]).where("nid <> a").select("a", F.col("nid").alias("b")).distinct()
    return pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")


def _runs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of different classes in each cell (key, bi, bj) of sorted partitions whose signatures allow a similarity of ``least``.

    In a cell of two blocks (bi <> bj) only members of different blocks are paired.
    """
    width = TREES * DEPTH
    need = math.ceil(width * (least * (1 - 1 / 256) + 1 / 256))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            n = t.num_rows
            if n < 2:
                return
            run = np.cumsum(np.append(0, (np.diff(t["key"].to_numpy()) != 0) | (np.diff(t["bi"].to_numpy()) != 0) | (np.diff(t["bj"].to_numpy()) != 0)))
            cross = (t["bi"].to_numpy() != t["bj"].to_numpy())
            own, nid, label = t["own"].to_numpy(), t["nid"].to_numpy(), t["label"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint64).reshape(n, width // 8)
            ends = np.searchsorted(run, run, side="right")
            at = np.arange(n)
            for step in range(1, n):
                at = at[at + step < ends[at]]
                if not len(at):
                    break
                for lo in range(0, len(at), 1 << 16):
                    i = at[lo : lo + (1 << 16)]
                    j = i + step
                    ok = (label[i] != label[j]) & (~cross[i] | (own[i] != own[j]))
                    i, j = i[ok], j[ok]
                    same = (sig[i].view(np.uint8) == sig[j].view(np.uint8)).sum(axis=1, dtype=np.int16)
                    hit = same >= need
                    a, b = nid[i[hit]], nid[j[hit]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += len(b)
            if size < 10_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from flush(t.slice(0, cut))
                t = t.slice(cut)
            held, size = t.to_batches(), t.num_rows
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    return rows.select("key", "bi", "bj", "own", "nid", "label", "sig").mapInArrow(tidy(go), "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (p, q, nid, label, ...) of the runs (p, q) that hold several classes, and how many blocks each has (bm, bo).

    Within a run the class of its least node (often all of the run; ``mine``) is
    not paired with itself: its members and the others are cut into blocks of BUCKET.
    """
    each = rows.groupBy("p", "q", "label").agg(F.count(F.lit(1)).alias("c"), F.min("nid").alias("least"))
    ends = each.groupBy("p", "q").agg(F.min(F.struct("least", "label", "c")).alias("f"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = ends.select("p", "q", F.col("f.label").alias("first"), F.ceil(F.col("f.c") / BUCKET).cast("int").alias("bm"), F.ceil((F.col("c") - F.col("f.c")) / BUCKET).cast("int").alias("bo"))
    return rows.join(blocks, ["p", "q"]).withColumn("mine", F.col("label") == F.col("first"))


def _cells(spots: DataFrame) -> DataFrame:
    """Every other block of a run meets each block of either kind in a cell (bi, bj) of its own; ``own`` is the row's block."""
    other = F.pmod(F.xxhash64("nid"), F.col("bo")).cast("int")
    spots = spots.withColumn("own", F.when(F.col("mine"), -1 - F.pmod(F.xxhash64("nid"), F.col("bm")).cast("int")).otherwise(other))
    others = F.sequence(F.lit(0), F.col("bo") - 1)
    cell = F.when(F.col("mine"), others).otherwise(F.concat(others, F.transform(F.sequence(F.lit(1), F.col("bm")), lambda x: -x)))
    return spots.withColumn("with", F.explode(cell)).withColumn("bi", F.least("own", "with")).withColumn("bj", F.greatest("own", "with"))


def _crosses(trie: DataFrame, depth: int, nodes: DataFrame, labels: DataFrame | None, least: float, done: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of members of a run that belong to different classes, but for those that are ``done``.

    labels: (nid, label); a node without one is a class of its own.
    """
    rows = _members(trie, depth)
    if labels is None:
        rows = rows.withColumn("label", F.col("nid"))
    else:
        rows = rows.join(labels, "nid", "left").select("p", "q", "nid", F.coalesce("label", "nid").alias("label"))
    spots = _blocks(rows).groupBy("nid", "label").agg(F.collect_list(F.struct("p", "q", "mine", "bm", "bo")).alias("k"))
    spots = nodes.select("nid", "sig").join(spots, "nid").select("nid", "sig", "label", F.inline("k"))
    spots = _cells(spots).select("nid", "sig", "label", "own", "bi", "bj", F.xxhash64("p", "q").alias("key"))
    spots = spots.repartition(_parts(nodes), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return written(_runs(spots, least).distinct().join(done, ["a", "b"], "left_anti"), "crosses")


def _verify(work: DataFrame, root: str, threshold: float, n: int) -> DataFrame:
    """work: (task, kind, a, b, pack, at, size) sorted by (task, kind): texts of a task (kind 0), then its candidate pairs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _reader(root) as read:
            yield from judge(batches, read)

    def judge(batches: Iterator[pa.RecordBatch], read: Callable[[int, int, int], bytes]) -> Iterator[pa.RecordBatch]:
        task, sets = None, {}
        waiting: list[tuple[int, list[int]]] = []

        def settle() -> None:
            if waiting:
                column = pa.array([read(*x) for _, x in waiting], pa.binary()).cast(pa.string())
                for first, key, bounds in shingle_sets(column, n):
                    for d in range(len(bounds) - 1):
                        sets[waiting[first + d][0]] = key[bounds[d] : bounds[d + 1]].copy()
                waiting.clear()

        for batch in batches:
            out: list[list] = [[], [], []]
            for t, kind, a, b, *place in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if t != task:
                    task = t
                    sets.clear()
                    waiting.clear()
                if kind == 0:
                    waiting.append((a, place))
                    continue
                settle()
                x, y = sets[a], sets[b]
                if len(x) > len(y):
                    x, y = y, x
                if len(x) < threshold * len(y):
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = len(y) - 1
                both = int(np.count_nonzero(y[at] == x))
                similarity = both / (len(x) + len(y) - both)
                if similarity >= threshold:
                    for c, v in zip(out, (a, b, similarity)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])

    return work.mapInArrow(tidy(go), "a long, b long, similarity double")


def _packs(docs: DataFrame, nodes: DataFrame, text: str) -> tuple[DataFrame, str]:
    """((nid, pack, at, size), folder): where in the packs of the folder the compressed text of each node lies.

    Each attempt of a task writes a pack of its own, so rows only point into packs
    that were ended.  A copy seen before in the same task is left out.
    """
    root = local_path(fresh(docs.sparkSession, "packs"))
    os.makedirs(root)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        squeeze = zstandard.ZstdCompressor(level=1).compress
        pack, end = TaskContext.get().taskAttemptId(), 0
        with open(f"{root}/{pack}", "wb", buffering=1 << 20) as f:
            for b in batches:
                data, off = W.string_buffers(b.column(0))
                tid, at, size = [], [], []
                for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
                    raw = data[lo:hi].tobytes()
                    key = xxhash.xxh3_128_digest(raw)
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.pop(next(iter(seen)))
                    seen[key] = None
                    z = squeeze(raw)
                    f.write(z)
                    tid.append(key)
                    at.append(end)
                    size.append(len(z))
                    end += len(z)
                yield pa.RecordBatch.from_arrays([pa.array(tid, pa.binary()), pa.array([pack] * len(tid), pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["tid", "pack", "at", "size"])

    places = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidy(go), "tid binary, pack long, at long, size long").dropDuplicates(["tid"])
    return written(places.join(nodes.select("nid", "tid"), "tid").select("nid", "pack", "at", "size"), "places"), root


@contextmanager
def _reader(root: str) -> Iterator[Callable[[int, int, int], bytes]]:
    """A function that reads a text: its pack, where it begins there, and its size."""
    files: dict[int, int] = {}
    unpack = zstandard.ZstdDecompressor().decompress

    def read(pack: int, at: int, size: int) -> bytes:
        if pack not in files:
            if len(files) >= OPEN:
                os.close(files.pop(next(iter(files))))
            files[pack] = os.open(f"{root}/{pack}", os.O_RDONLY)
        return unpack(os.pread(files[pack], size, at))

    try:
        yield read
    finally:
        for f in files.values():
            os.close(f)


def links(store: DataFrame, root: str, nodes: DataFrame, pairs: DataFrame, threshold: float, n: int) -> DataFrame:
    """Verified links (a < b, similarity) among the pairs.  store: nid and the place of its text in the packs of ``root``; nodes: nid, n (shingles)."""
    both = pairs.select(F.col("a").alias("nid"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("nid"), F.col("a").alias("o")))
    near = both.groupBy("nid").agg(F.least("nid", F.min("o")).alias("g")).join(nodes.select("nid", "n"), "nid")
    block = near.groupBy("g").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("blocks"))
    near = near.join(block, "g").select("nid", F.xxhash64("g", F.pmod(F.xxhash64("nid"), F.col("blocks"))).alias("g"))
    a, b = near.select(F.col("nid").alias("a"), F.col("g").alias("ga")), near.select(F.col("nid").alias("b"), F.col("g").alias("gb"))
    tasks = written(pairs.join(a, "a").join(b, "b").select("a", "b", F.xxhash64(F.least("ga", "gb"), F.greatest("ga", "gb")).alias("task")), "tasks")
    needs = tasks.select("task", F.col("a").alias("nid")).unionByName(tasks.select("task", F.col("b").alias("nid"))).distinct()
    places = ["pack", "at", "size"]
    work = store.join(needs, "nid").select("task", F.lit(0).alias("kind"), F.col("nid").alias("a"), F.lit(None).cast("long").alias("b"), *places).unionByName(
        tasks.select("task", F.lit(1).alias("kind"), "a", "b", *[F.lit(None).cast("long").alias(c) for c in places])
    )
    work = work.repartition(_parts(nodes), "task").sortWithinPartitions("task", "kind", "pack", "at")
    out = written(_verify(work.select("task", "kind", "a", "b", *places), root, threshold, n), "links")
    forget(tasks)
    return out


def _in_order(store: DataFrame) -> DataFrame:
    """Each task gets texts that lie side by side, in the order in which they lie."""
    return store.repartitionByRange(_parts(store), "pack", "at").sortWithinPartitions("pack", "at")


def _sets(batches: Iterator[pa.RecordBatch], root: str, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, shingle hashes, bounds) of batches whose last three columns are the places of texts."""
    with _reader(root) as read:
        for b in batches:
            if len(b):
                column = pa.array([read(*x) for x in zip(*[c.to_pylist() for c in b.columns[-3:]])], pa.binary()).cast(pa.string())
                for first, key, bounds in shingle_sets(column, n):
                    yield b.slice(first, len(bounds) - 1), key, bounds


def _frequencies(store: DataFrame, root: str, slots: int, bits: int, n: int) -> str:
    """Path of two tables over the shingles of the nodes.

    One of ``bits`` bits (``path``.bits): whether more than one falls into each of so
    many slots.  One of ``slots`` bytes: on a log scale, how many fall into the
    fullest of neighbouring slots of the former; equal shares of them have a byte.
    """
    spark = store.sparkSession
    path = local_path(fresh(spark, "frequencies"))
    for name, size in ((path, slots), (f"{path}.bits", bits // 8)):
        with open(name, "wb") as f:
            f.truncate(size)
    width, each = min(PIECE, bits // 64), bits // slots
    kind = np.uint32 if bits <= 1 << 32 else np.uint64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def send(held: list[np.ndarray]) -> pa.RecordBatch:
            slot, c = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(slot, np.arange(0, bits + 1, width, dtype=np.uint64))
            some = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if hi > lo]
            z = []
            for i, lo, hi in some:
                steps = np.diff(slot[lo:hi], prepend=kind(i * width)).astype(np.uint32)
                z.append(squeeze(np.concatenate([steps, c[lo:hi].astype(np.uint32)]).view(np.uint8).reshape(-1, 4).T.tobytes()))  # byte by byte: most are 0
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in some], pa.int32()), pa.array(z, pa.binary())], names=["piece", "z"])

        held, size = [], 0
        for _, key, _ in _sets(batches, root, n):
            held.append((key & np.uint64(bits - 1)).astype(kind))
            size += len(key)
            if size >= GATHER:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, total = None, np.zeros(width, np.int64)

        def put() -> None:
            coarse = total.reshape(-1, each).max(axis=1)
            level = np.where(coarse < 2, coarse, np.minimum(255, 1 + np.ceil(8 * np.log2(np.maximum(coarse, 1)))))
            for name, at, table in ((path, now * len(coarse), level.astype(np.uint8)), (f"{path}.bits", now * (width // 8), np.packbits(total > 1, bitorder="little"))):
                with open(name, "r+b") as f:
                    f.seek(at)
                    f.write(table.tobytes())

        done = 0
        for b in batches:
            for piece, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if piece != now:
                    if now is not None:
                        put()
                    now, done = piece, done + 1
                    total[:] = 0
                steps, c = np.frombuffer(unpack(z), dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(2, -1)
                total[np.cumsum(steps, dtype=np.int64)] += c
        if now is not None:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    counted = _in_order(store).select("pack", "at", "size").mapInArrow(tidy(count), "piece int, z binary").repartition(min(bits // width, _parts(store)), "piece").sortWithinPartitions("piece")
    counted.mapInArrow(tidy(add), "done long").agg(F.sum("done")).collect()
    return path


def _prefixes(store: DataFrame, root: str, path: str, slots: int, bits: int, threshold: float, n: int) -> DataFrame:
    """store: nid, label and the places of texts.  (bucket, z): packed (shingle, nid, label, place, shingles, the shingle before) of the first shingles of each set.

    All sets are in one order, rare shingles first.  The first shingle that two
    linked sets have in common lies before all those that the threshold demands,
    so only shingles with that many behind them are sent.  A shingle alone in its
    finer slot is in no other set; it counts as the rarest and is not sent.
    """
    parts = _parts(store)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, more = np.memmap(path, np.uint8, "r"), np.memmap(f"{path}.bits", np.uint8, "r")
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def send(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, nid, label, place, size, before = [np.concatenate(c) for c in zip(*held)]
            bucket = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(parts + 1))
            ids, z = [], []
            for i, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                if hi > lo:
                    at = order[lo:hi]
                    steps = [np.diff(c[at], prepend=0) for c in (nid, label, size)]
                    ids.append(i)
                    z.append(squeeze(b"".join([*[c.astype(np.int64).tobytes() for c in steps], before[at].tobytes(), key[at].astype(np.uint32).tobytes(), place[at].astype(np.uint32).tobytes()])))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(z, pa.binary())], names=["bucket", "z"])

        held, many = [], 0
        for rows, key, bounds in _sets(batches, root, n):
            size = np.diff(bounds)
            doc = np.repeat(np.arange(len(size)), size)
            slot = (key & np.uint64(bits - 1)).view(np.int64)
            rare = np.where(more[slot >> 3] >> (slot & 7).astype(np.uint8) & 1, level[slot // (bits // slots)], np.uint8(1))
            order = np.argsort(doc << 8 | rare, kind="stable")  # keys ascend within a row
            place = np.arange(len(key)) - bounds[doc]
            at = np.flatnonzero((size[doc] - place >= np.ceil(threshold * size - 1e-6)[doc]) & (rare[order] != 1))
            nid, label = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            held.append([key[order[at]], nid[doc[at]], label[doc[at]], place[at], size[doc[at]], key[order[at - 1]].view(np.int64)])
            many += len(at)
            if many >= GATHER:
                yield send(held)
                held, many = [], 0
        if many:
            yield send(held)

    return _in_order(store).select("nid", "label", "pack", "at", "size").mapInArrow(tidy(go), "bucket int, z binary")


def _meet(run: np.ndarray, nid: np.ndarray, label: np.ndarray, place: np.ndarray, size: np.ndarray, before: np.ndarray, threshold: float, own: np.ndarray | None = None, cross: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes in a run (ascending; sizes ascend within it) that may still have enough shingles in common from there on.

    Where both have the same shingle before, this is not the first one in common, at which the pair is given.
    """
    ends = np.searchsorted(run, run, side="right")
    at, step, held, many = np.arange(len(run)), 0, [], 0

    def send() -> pa.RecordBatch:
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))
        a, b = pairs[new].T
        return pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], names=["a", "b"])

    while True:
        step += 1
        at = at[at + step < ends[at]]
        at = at[size[at] >= threshold * size[at + step] - 1e-6]
        if not len(at):
            break
        for lo in range(0, len(at), 1 << 16):
            i = at[lo : lo + (1 << 16)]
            j = i + step
            common = np.minimum(size[i] - place[i], size[j] - place[j])
            ok = (common >= threshold / (1 + threshold) * (size[i] + size[j]) - 1e-6) & (label[i] != label[j])
            ok &= (before[i] != before[j]) | (place[i] == 0) | (place[j] == 0)
            if own is not None:
                ok &= ~cross[i] | (own[i] != own[j])
            i, j = nid[i[ok]], nid[j[ok]]
            held.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
            many += len(i)
            if many >= GATHER:
                yield send()
                held, many = [], 0
    if many:
        yield send()


def _shared(prefixes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that share a shingle of their prefixes; of runs of more than BUCKET sets the members, b being null, go along instead."""
    names = ["a", "b", "key", "label", "place", "size", "before"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def flush(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for z in held:
                raw = unpack(z)
                m = len(raw) // 40
                for c, x in zip(cols, np.frombuffer(raw, np.int64, 3 * m).reshape(3, m).cumsum(axis=1)):
                    c.append(x)
                cols[3].append(np.frombuffer(raw, np.int64, m, 24 * m))
                for c, x in zip(cols[4:], np.frombuffer(raw, np.uint32, 2 * m, 32 * m).reshape(2, m)):
                    c.append(x)
            nid, label, size, before, key, place = [np.concatenate(c) for c in cols]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(key[order].astype(np.int64)) != 0))
            count = np.diff(np.append(first, len(key)))
            mixed = np.minimum.reduceat(label[order], first) != np.maximum.reduceat(label[order], first)
            order = order[np.repeat(mixed, count)]
            order = order[np.lexsort((size[order], key[order]))]
            hot = np.repeat(count[mixed] > BUCKET, count[mixed])
            nid, label, size, before, key, place = nid[order], label[order], size[order], before[order], key[order].astype(np.int64), place[order].astype(np.int64)
            few = ~hot
            for b in _meet(key[few], nid[few], label[few], place[few], size[few], before[few], threshold):
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(len(b), pa.int64())] * 5], names=names)
            if hot.any():
                cols = [nid[hot], None, bucket << 32 | key[hot], label[hot], place[hot], size[hot], before[hot]]
                yield pa.RecordBatch.from_arrays([pa.nulls(int(hot.sum()), pa.int64()) if c is None else pa.array(c) for c in cols], names=names)

        now, held = None, []
        for b in batches:
            for bucket, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != now:
                    if held:
                        yield from flush(now, held)
                    now, held = bucket, []
                held.append(z)
        if held:
            yield from flush(now, held)

    rows = prefixes.repartition(_parts(prefixes), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(tidy(go), ", ".join(f"{c} long" for c in names))


def _hot(spots: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs in the cells (key, bi, bj) of sorted partitions, sizes ascending."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, bi, bj, own, nid, label, place, size, before = [t[c].to_numpy() for c in t.column_names]
            yield from _meet(_cell_numbers(key, bi, bj), nid, label, place, size, before, threshold, own, bi != bj)

        held, many = [], 0
        for b in batches:
            held.append(b)
            many += len(b)
            if many < 10_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            run = _cell_numbers(*[t[c].to_numpy() for c in t.column_names[:3]])
            cut = int(np.searchsorted(run, run[-1]))
            if cut:
                yield from flush(t.slice(0, cut))
                t = t.slice(cut)
            held, many = t.to_batches(), t.num_rows
        if many:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    return spots.select("key", "bi", "bj", "own", "nid", "label", "place", "size", "before").mapInArrow(tidy(go), "a long, b long")


def _cell_numbers(key: np.ndarray, bi: np.ndarray, bj: np.ndarray) -> np.ndarray:
    return np.cumsum(np.append(0, (np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)))


def rest(store: DataFrame, root: str, labels: DataFrame | None, shingles: int, threshold: float, n: int, done: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) among which are all links of different classes, but for those that are ``done``.

    store: nid and the place of its text in the packs of ``root``; labels: (nid, label), None for every node a class of its own.
    Prefixes of sets in one order are joined by shingle, which misses no link.
    """
    about = 1 << max(shingles - 1, 1).bit_length()
    slots, bits = (max(1 << 16, min(x)) for x in ((SLOTS, about // 8), (BITS, 4 * about)))
    path = _frequencies(store, root, slots, bits, n)
    own = store.withColumn("label", F.col("nid")) if labels is None else store.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    shared = written(_shared(_prefixes(own, root, path, slots, bits, threshold, n), threshold), "shared")
    os.remove(path)
    os.remove(f"{path}.bits")
    pairs = shared.where("b is not null").select("a", "b")
    hot = shared.where("b is null").select(F.col("key").alias("p"), F.lit(0).alias("q"), F.col("a").alias("nid"), "label", "place", "size", "before")
    if hot.limit(1).count():
        spots = _cells(_blocks(hot)).withColumnRenamed("p", "key").repartition(_parts(store), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "size")
        pairs = pairs.unionByName(_hot(spots, threshold))
    out = written(pairs.distinct().join(done, ["a", "b"], "left_anti"), "rest")
    forget(shared)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(nid, label) of every node of an edge; label is the least node of its component.

    Rounds of least neighbour label and pointer jumping, until nothing changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "nid")
    labels = labels.withColumn("was", F.lit(None).cast("long"))
    old = None
    while True:
        up = labels.select(F.col("nid").alias("label"), F.col("label").alias("top"))
        new = written(labels.join(up, "label").select("nid", F.col("top").alias("label"), F.col("top").eqNullSafe(F.col("was")).alias("same")), "labels")
        if old is not None:
            forget(old)
        if not new.where("not same").limit(1).count():
            forget(both)
            out = new.select("nid", "label")
            out._lumidex_path = new._lumidex_path
            return out
        old = new
        low = both.join(old.select(F.col("nid").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low")).withColumnRenamed("a", "nid")
        labels = old.join(low, "nid").select("nid", F.col("label").alias("was"), F.least("label", "low").alias("label"))


def matched_links(docs: DataFrame, nodes: DataFrame, text: str, threshold: float, recall: float, n: int, degrees: bool = False) -> tuple[DataFrame, DataFrame, int, float]:
    """(links between nodes, classes of linked nodes, length to which the forest's prefixes were shortened, its estimated recall).

    docs: the texts; nodes: nid, tid, n, keys, sig.  The links settle all classes; with ``degrees`` they are all there are.
    """
    width = TREES * DEPTH
    least = 0.0 if SCREEN is None else max(0.0, threshold - SCREEN * math.sqrt(threshold * (1 - threshold) / width))
    trie = forest(nodes)
    store, root = _packs(docs, nodes, text)
    found = done = labels = None

    def add(one: DataFrame | None, more: DataFrame) -> DataFrame:
        return more if one is None else one.unionByName(more)

    def judged(depth: int) -> float:
        near = found.groupBy(F.round("similarity", 3).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()  # a thousand rows at most
        return recall_of([(max(r["s"], threshold), r["n"]) for r in near], depth, threshold)

    for depth in range(DEPTH, 0, -1):
        pairs = written(_stars(trie, depth, done), "stars")
        done, found = add(done, pairs), add(found, links(store, root, nodes, pairs, threshold, n))
        got = judged(depth)
        if depth > 1 and got < recall:
            continue
        if degrees:  # rest() goes through pairs of one class and of several
            break
        labels = components(found)
        pairs = _crosses(trie, depth, nodes, labels, least, done)
        if pairs.limit(1).count():
            done, more = add(done, pairs), links(store, root, nodes, pairs, threshold, n)
            if more.limit(1).count():
                found = add(found, more)
                labels, got = components(found), judged(depth)
        if depth == 1 or got >= recall:
            break
    forget(trie)
    shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = rest(store, root, labels, shingles, threshold, n, done)
    if pairs.limit(1).count():
        more = links(store, root, nodes, pairs, threshold, n)
        if more.limit(1).count():
            found, labels = add(found, more), None
    if labels is None:
        labels = components(found)
    forget(store)
    shutil.rmtree(root, ignore_errors=True)
    return found, labels, depth, got


def _nodes(docs: DataFrame, id_col: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, tid, set, n; nodes: a row per set that is not empty)."""
    ship(docs.sparkSession)
    wide = written(_rows(docs, id_col, text, n), "wide")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("tid")))
    nodes = wide.where("n > 0").groupBy("set").agg(F.count(F.lit(1)).alias("copies"), first.alias("f"), F.max("n").alias("n"), F.min("keys").alias("keys"), F.min("sig").alias("sig"))
    nodes = written(nodes.select("set", "copies", F.col("f.id").alias("id"), F.col("f.tid").alias("tid"), "n", "keys", "sig", F.monotonically_increasing_id().alias("nid")), "nodes")
    rows = written(wide.select("id", "tid", "set", "n"), "rows")
    forget(wide)
    return rows, nodes


def _solve(docs: DataFrame, id_col: str, text: str, threshold: float, recall: float, n: int, degrees: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows: id, tid, set, n; nodes: set, copies, links, class label and the class's kept (id, set))."""
    rows, nodes = _nodes(docs, id_col, text, n)
    found, label, _, _ = matched_links(docs, nodes, text, threshold, recall, n, degrees)
    weight = nodes.select("nid", "copies")
    there = found.select(F.col("a").alias("x"), F.col("b").alias("nid")).unionByName(found.select(F.col("b").alias("x"), F.col("a").alias("nid")))
    degree = there.join(weight, "nid").groupBy("x").agg(F.sum("copies").alias("others"), F.count(F.lit(1)).alias("texts")).withColumnRenamed("x", "nid")
    slim = nodes.select("nid", "set", "copies", "id", "tid").join(degree, "nid", "left").join(label, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    slim = written(slim, "classes")
    head = slim.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("set"))).alias("h"), F.sum("copies").alias("class_size"))
    full = slim.join(head, "label").select(
        "set", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"), "class_size",
        F.col("h.id").alias("class_id"), F.col("h.set").alias("class_set"),
    )
    return rows, full


def classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, degrees: bool = False) -> DataFrame:
    """Per row: id, class_id (least id of its class, its representative), n_links (other rows known to be linked to it,
    copies included), n_texts (other shingle sets known to be linked to its own), class_size.

    Links are known where they were verified: enough to settle every class, and all there are with ``degrees``.
    """
    rows, full = _solve(pick(docs, id_col, text), id_col, text, threshold, recall, n, degrees)
    joined = rows.where("n > 0").select("id", "set").join(full, "set").select(F.col("id").alias(id_col), "class_id", "n_links", "n_texts", "class_size")
    alone = rows.where("n = 0").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"), F.lit(1).cast("long").alias("class_size"))
    return joined.unionByName(alone)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """docs with one row of each class, that of the least id; all columns stay.

    Rows are found again by id and digest of the text, so the texts are shuffled
    once.  Rows without words all stay.
    """
    docs, (id_col, text), back = isolate(docs, id_col, text)
    rows, full = _solve(docs, id_col, text, threshold, recall, n)
    best = rows.where("n > 0").join(full, "set").where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("set") == F.col("class_set")))
    best = best.groupBy("set", "class_id").agg(F.min("tid").alias("_tid")).select("_tid", F.col("class_id").alias("_id"))
    again = rows.select(F.col("id").alias("_i"), F.col("tid").alias("_t")).join(best, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tid")))
    best = written(again.groupBy("_tid", "_id").agg((F.count(F.lit(1)) > 1).alias("_twice")).withColumnRenamed("_tid", "_kept"), "kept")
    names = docs.columns
    words = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = _with_tid(docs.where(words), text)
    stays = keyed.join(best, (F.col("_tid") == F.col("_kept")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_id")))
    if best.where("_twice").limit(1).count():  # repeated rows: any of them
        stays = stays.dropDuplicates(["_tid", "_id"])
    return back(stays.select(*names).unionByName(docs.where(~words)))


def _with_tid(docs: DataFrame, text: str) -> DataFrame:
    names = docs.columns
    at = names.index(text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = W.string_buffers(b.column(at))
            tid = [xxhash.xxh3_128_digest(data[lo:hi].tobytes()) for lo, hi in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tid, pa.binary())], names=[*names, "_tid"])

    return docs.mapInArrow(tidy(go), T.StructType([*docs.schema, T.StructField("_tid", T.BinaryType())]))
