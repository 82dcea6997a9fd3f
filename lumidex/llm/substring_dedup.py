"""Substring dedup by super-k-mers: words covered by a repeated window of WINDOW words are removed.

A window is WINDOW consecutive words of one text; it is repeated if the same
word sequence starts anywhere else, in this text or another.  Every window has
a minimiser, the smallest hash among its M-word grams.  Consecutive windows of
one text with the same minimiser form a super-k-mer, which travels as one
packed string to its minimiser's bucket, where all windows are sorted and
counted; equal hashes count as equal windows only after their bytes compare
equal.

Steps, each a distributed job:

1. One narrow pass gives (minimiser, text key) pairs; minimisers of a single
   super-k-mer in the whole corpus are dropped (unless it may repeat itself),
   since equal windows have equal minimisers.  Nothing else of these windows has to travel.
2. Texts meet their surviving minimisers, pack those super-k-mers, and send
   them to their buckets.  A bucket is a sorted run of one partition and holds
   at most HOT super-k-mers.  Windows of a minimiser that occurs more often
   (boilerplate in much of the corpus) do not go to a bucket: each travels as a
   128-bit digest and is counted by partial aggregation, so no task sees them all.
3. Repeated spans return to their texts, keyed by a 128-bit digest of the text.

Copies: a text that occurs twice as a whole has only repeated windows; it lists
and packs its super-k-mers once per task, however many copies there are, and
the minimisers that reach it are a set.

Defined cases: null text has no words.  A text with fewer than WINDOW words
loses nothing.  Repeated rows lose all words, if they have a window at all.
Empty tables give empty results.  Null or repeated ids are allowed: rows are
matched by text, never by id.  Other columns are ignored by :func:`dedup` and
returned untouched by :func:`strip`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import forget, isolate, pick, ship, tidy, written

WINDOW = 35
M = 8
#: Super-k-mers of one minimiser that one bucket may hold.
HOT = 4096
#: Digests of texts that a task remembers, so that copies pack once.
SEEN = 1 << 18


def _minimisers(h: np.ndarray, bounds: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a group of texts: minimiser, first window's word index, number of windows, whether it may repeat itself.

    Two windows of one super-k-mer can be equal only if it goes on behind its
    first occurrence of the minimiser, that is if a window other than its last
    begins with the minimiser.
    """
    n = len(h)
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, np.zeros(0, dtype=bool))
    if n < window:
        return nothing
    g = np.zeros(n - m + 1, dtype=np.uint64)
    for k in range(m):
        g = g * W.U(0x9FB21C651E98DF25) + (h[k : k + len(g)] ^ W.U(0x2545F4914F6CDD1D))
    g = W.mix(g)
    span, low = 1, g
    want = window - m + 1
    while span * 2 <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < want:
        low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
    ok = np.ones(len(low), dtype=bool)
    for b in bounds[1:]:
        ok[max(0, b - window + 1) : b] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return nothing
    v = low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begins = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(g[at] == v, out=begins[1:])
    return v[first].view(np.int64), at[first], count, begins[first + count - 1] > begins[first]


def _text_key(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _texts(w: W.Words) -> Iterator[bytes]:
    for a, b in zip(w.offsets[:-1], w.offsets[1:]):
        yield w.data[a:b].tobytes()


def _keyed(docs: DataFrame, text: str, window: int, m: int) -> DataFrame:
    """A row (minimiser, first half of the text's digest, null) per super-k-mer and a row (null, null, digest) per text.

    A copy of a text that the task has met gives the latter row only: all its
    windows are repeated anyway, and its partners have met the first.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        for b in batches:
            for w in W.scan(b.column(0)):
                key, at, _, again = _minimisers(w.hashes, w.bounds, window, m)
                key, at = np.append(key, key[again]), np.append(at, at[again])
                tids = [_text_key(raw) for raw in _texts(w)]
                doc = np.searchsorted(w.bounds, at, side="right") - 1
                new = _first_met(tids, seen)
                key, doc = key[new[doc]], doc[new[doc]]
                t1 = np.frombuffer(b"".join(tids), dtype=np.int64)[::2][doc]
                k, n = len(key), len(tids)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(t1), pa.nulls(k, pa.binary())], names=["key", "t1", "tid"])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(tids, pa.binary())], names=["key", "t1", "tid"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidy(go), "key long, t1 long, tid binary")


def _first_met(tids: list[bytes], seen: dict[bytes, None]) -> np.ndarray:
    """Whether each digest is not yet among ``seen``, which keeps the last SEEN."""
    new = np.ones(len(tids), dtype=bool)
    for i, tid in enumerate(tids):
        if tid in seen:
            new[i] = False
            continue
        if len(seen) >= SEEN:
            seen.pop(next(iter(seen)))
        seen[tid] = None
    return new


def _packed_texts(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(t1, compressed text) of texts with a window; a copy seen before in the same task is left out."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for w in W.scan(b.column(0), hashes=False):
                t1, z = [], []
                for raw, n in zip(_texts(w), np.diff(w.bounds)):
                    if n < window or (key := _text_key(raw)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.pop(next(iter(seen)))
                    seen[key] = None
                    t1.append(int.from_bytes(key[:8], "little", signed=True))
                    z.append(squeeze(raw))
                yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(z, pa.binary())], names=["t1", "z"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidy(go), "t1 long, z binary")


_SUPER = "key long, tid binary, at int, n int, hot boolean, packed binary"


def _super_kmers(matched: DataFrame, window: int, m: int) -> DataFrame:
    """matched: z and the surviving (keys, hots) of its text.  Hot windows leave one by one, as digests."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            size = max(1, min(len(b), 512))
            for lo in range(0, len(b), size):
                part = b.slice(lo, size)
                texts = [unpack(z.as_py()) for z in part.column(0)]
                column = pa.array(texts, pa.binary()).cast(pa.string())
                keys, hots = part.column(1), part.column(2)
                for w in W.scan(column):
                    key, at, n, _ = _minimisers(w.hashes, w.bounds, window, m)
                    doc = np.searchsorted(w.bounds, at, side="right") - 1
                    out: list[list] = [[], [], [], [], [], []]
                    cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
                    for d in range(w.n_docs):
                        i = w.first + d
                        own = np.asarray(keys[i].values)
                        hot_of = np.asarray(hots[i].values)
                        order = np.argsort(own)
                        lo_, hi_ = cut[d], cut[d + 1]
                        pos = np.minimum(np.searchsorted(own, key[lo_:hi_], sorter=order), len(own) - 1)
                        hit = own[order[pos]] == key[lo_:hi_]
                        raw, base = texts[i], int(w.offsets[d])
                        tid = _text_key(raw)
                        for k, p, c, h in zip(key[lo_:hi_][hit].tolist(), at[lo_:hi_][hit].tolist(), n[lo_:hi_][hit].tolist(), hot_of[order[pos]][hit].tolist()):
                            first = p - int(w.bounds[d])
                            if h:
                                for j in range(c):
                                    s = b" ".join([raw[x - base : y - base] for x, y in zip(w.start[p + j : p + j + window].tolist(), w.end[p + j : p + j + window].tolist())])
                                    row = (k, tid, first + j, 1, True, xxhash.xxh3_128_digest(s))
                                    for col, x in zip(out, row):
                                        col.append(x)
                                continue
                            row = (k, tid, first, c, False, raw[w.start[p] - base : w.end[p + c + window - 2] - base])
                            for col, x in zip(out, row):
                                col.append(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["key", "tid", "at", "n", "hot", "packed"]
                    )

    return matched.select("z", "keys", "hots").mapInArrow(tidy(go), _SUPER)


def count_bucket(key: np.ndarray, packed: list[bytes], window: int) -> np.ndarray:
    """For all windows of the packed strings, row by row, whether the window occurs twice or more.

    Rows of one key are together.  Windows are sorted by (key, hash); runs of
    windows that match a leader are then compared byte for byte.
    """
    column = pa.array(packed, pa.binary()).cast(pa.string())
    flags = []
    for w in W.scan(column, block=1 << 40):
        hs, at = W.window_hashes(w.hashes, w.bounds, window)
        row = np.searchsorted(w.bounds, at, side="right") - 1
        k = key[w.first + row]
        order = np.lexsort((at, hs, k))
        ks, ho = k[order], hs[order]
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (ks[1:] == ks[:-1]) & (ho[1:] == ho[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        leader = np.empty(len(order), dtype=np.int64)
        leader[order] = order[head]
        twice = np.zeros(len(order), dtype=bool)
        follow = np.flatnonzero(leader != np.arange(len(order)))
        twice[follow] = True
        twice[leader[follow]] = True
        if len(follow):
            lead = leader[follow]
            run = np.ones(len(follow), dtype=bool)
            run[1:] = (follow[1:] != follow[:-1] + 1) | (lead[1:] != lead[:-1] + 1) | (row[follow[1:]] != row[follow[:-1]]) | (row[lead[1:]] != row[lead[:-1]])
            first = np.flatnonzero(run)
            last = np.append(first[1:], len(follow)) - 1
            a0, a1 = at[follow[first]], at[follow[last]] + window - 1
            b0, b1 = at[lead[first]], at[lead[last]] + window - 1
            if not _same_words(w, a0, a1, b0, b1):
                twice = _exact(w, at, k, window)
        flags.append(twice)
    return np.concatenate(flags) if flags else np.zeros(0, bool)


def _same_words(w: W.Words, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> bool:
    data = w.data.tobytes()
    for i, j, k, m in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist()):
        if data[w.start[i] : w.end[j]] != data[w.start[k] : w.end[m]]:
            p = [data[s:e] for s, e in zip(w.start[i : j + 1], w.end[i : j + 1])]
            q = [data[s:e] for s, e in zip(w.start[k : m + 1], w.end[k : m + 1])]
            if p != q:
                return False
    return True


def _exact(w: W.Words, at: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """The same flags from the strings alone, after a hash collision."""
    data = w.data.tobytes()
    words = [data[s:e] for s, e in zip(w.start, w.end)]
    names = [(k, tuple(words[p : p + window])) for k, p in zip(key.tolist(), at.tolist())]
    count: dict = {}
    for x in names:
        count[x] = count.get(x, 0) + 1
    return np.array([count[x] > 1 for x in names])


def _spans(tid: np.ndarray, at: np.ndarray, n: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """Runs of repeated windows of each row, as (text, first window, last window)."""
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.flatnonzero(flags)
    r, p = row[hit], pos[hit]
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    if not len(hit):
        first = last = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(tid[r[first]].tolist(), pa.binary()), pa.array((at[r[first]] + p[first]).astype(np.int32)), pa.array((at[r[first]] + p[last]).astype(np.int32))], names=["tid", "a", "b"]
    )


def _buckets(rows: DataFrame, window: int) -> DataFrame:
    """Counts the windows of every bucket: a run of equal keys in a partition that is sorted by key."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            key = table["key"].to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            single = np.diff(edge) == 1
            tid, at, n = np.array(table["tid"].to_pylist(), dtype=object), table["at"].to_numpy(), table["n"].to_numpy()
            packed = table["packed"].to_pylist()
            # a lone super-k-mer repeats no window of another; it may repeat its own
            lone = np.repeat(single, np.diff(edge)) & (n == 1)
            use = np.flatnonzero(~lone)
            if len(use):
                yield _spans(tid[use], at[use], n[use], count_bucket(key[use], [packed[i] for i in use], window))

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            held_bytes += b.nbytes
            if held_bytes < 2 << 20:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from flush(table.slice(0, cut))
                rest = table.slice(cut)
                held = rest.to_batches()
                held_bytes = rest.nbytes
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    return rows.select("key", "tid", "at", "n", "packed").mapInArrow(tidy(go), "tid binary, a int, b int")


def _shared_minimisers(light: DataFrame, hot: int) -> DataFrame:
    """light: (key, t1), a row per super-k-mer.  Per text, the set of its keys that occur twice or more, and whether each is hot.

    A set: tasks combine the copies of a text before they shuffle, and what
    arrives is no longer than the text, however many copies there are.
    """
    often = light.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", (F.col("c") > hot).alias("hot"))
    mine = light.join(often, "key").groupBy("t1").agg(F.collect_set(F.struct("key", "hot")).alias("k"))
    return mine.select("t1", F.col("k.key").alias("keys"), F.col("k.hot").alias("hots"))


def repeated_spans(docs: DataFrame, text: str = "text", *, window: int = WINDOW, m: int = M, hot: int = HOT) -> DataFrame:
    """Per text that has any: tid (128-bit digest of the text), whole (several rows have it), spans of repeated windows.

    A whole text may be too short for a window; then it loses nothing.
    """
    ship(docs.sparkSession)
    both = written(_keyed(docs, text, window, m), "minimisers")
    light = both.where("key is not null").select("key", "t1")
    copies = both.where("tid is not null").groupBy("tid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tid", F.lit(True).alias("whole"))
    matched = _packed_texts(docs, text, window).join(_shared_minimisers(light, hot), "t1")
    supers = written(_super_kmers(matched, window, m), "superkmers", by="hot")
    normal = supers.where("not hot").repartition("key").sortWithinPartitions("key")
    spans = _buckets(normal, window)
    hot_rows = supers.where("hot")
    again = hot_rows.groupBy("packed").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("packed")
    spans = spans.unionByName(hot_rows.join(again, "packed").select("tid", F.col("at").alias("a"), F.col("at").alias("b")))
    spans = spans.groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    marks = written(spans.join(copies, "tid", "full_outer").select("tid", "spans", F.coalesce("whole", F.lit(False)).alias("whole")), "spans")
    forget(supers)
    forget(both)
    return marks


def _with_tid(docs: DataFrame, text: str) -> DataFrame:
    """All columns of docs, _tid of its text, and the text compressed as _z (null if it is null)."""
    names = docs.columns
    at = names.index(text)
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField("_tid", T.BinaryType()), T.StructField("_z", T.BinaryType())])
    out_names = [f.name for f in schema]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            tid, z = [], []
            data, offsets = W.string_buffers(b.column(at))
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                raw = data[lo:hi].tobytes()
                tid.append(_text_key(raw))
                z.append(squeeze(raw))
            valid = b.column(at).is_valid().to_pylist()
            z = [x if ok else None for x, ok in zip(z, valid)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names)) if i != at] + [pa.array(tid, pa.binary()), pa.array(z, pa.binary())], names=out_names)

    return docs.mapInArrow(tidy(go), schema)


def _joined(docs: DataFrame, text: str, window: int, m: int, hot: int) -> DataFrame:
    marks = repeated_spans(docs, text, window=window, m=m, hot=hot).select(F.col("tid").alias("_tid"), F.col("spans").alias("_spans"), F.col("whole").alias("_whole"))
    return _with_tid(docs, text).join(marks, "_tid", "left")


def _removed(w: W.Words, spans: pa.Array, whole: list, window: int) -> np.ndarray:
    """Flags of the removed words of a group of texts."""
    cover = np.zeros(len(w.start) + 1, dtype=np.int64)
    for d in range(w.n_docs):
        i = w.first + d
        lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
        if whole[i] and hi - lo >= window:
            cover[lo] += 1
            cover[hi] -= 1
        elif not whole[i] and spans[i].is_valid:
            s = spans[i].values
            np.add.at(cover, np.asarray(s.field(0)) + lo, 1)
            np.add.at(cover, np.asarray(s.field(1)) + lo + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _finish(joined: DataFrame, keep: list[str], window: int, schema: T.StructType, as_text: str | None) -> DataFrame:
    cols = [*keep, "_z", "_spans", "_whole"]
    names = [f.name for f in schema]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            k = len(keep)
            column = pa.array([None if z is None else unpack(z) for z in b.column(k).to_pylist()], pa.binary()).cast(pa.string())
            whole = b.column(k + 2).to_pylist()
            n_words, n_removed, texts = [], [], []
            for w in W.scan(column, hashes=False):
                gone = _removed(w, b.column(k + 1), whole, window)
                n_words += np.diff(w.bounds).tolist()
                total = np.zeros(len(gone) + 1, dtype=np.int64)
                np.cumsum(gone, out=total[1:])
                removed = np.diff(total[w.bounds])
                n_removed += removed.tolist()
                if as_text:
                    raw = w.data.tobytes()
                    for d, r in enumerate(removed.tolist()):
                        texts.append(raw[w.offsets[d] : w.offsets[d + 1]] if not r else b" ".join(_kept(w, gone, d, raw)))
                else:
                    raw = w.data.tobytes()
                    texts += [hashlib.sha256(b" ".join(_kept(w, gone, d, raw))).hexdigest() for d in range(w.n_docs)]
            if as_text:
                valid = column.is_valid().to_pylist()
                new = pa.array([t if ok else None for t, ok in zip(texts, valid)], pa.binary()).cast(pa.string())
                arrays = [new if c == as_text else b.column(cols.index(c)) for c in names if c not in ("_n", "_r")] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            else:
                arrays = [b.column(i) for i in range(k)] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(tidy(go), schema)


def _kept(w: W.Words, gone: np.ndarray, d: int, raw: bytes) -> list[bytes]:
    lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
    stay = np.flatnonzero(~gone[lo:hi]) + lo
    return [raw[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())]


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, m: int = M, hot: int = HOT) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    docs = pick(docs, id_col, text).toDF("u0", "u1")
    schema = T.StructType([docs.schema["u0"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return _finish(_joined(docs, "u1", window, m, hot), ["u0"], window, schema, None).withColumnRenamed("u0", id_col)


def strip(docs: DataFrame, *, text: str = "text", window: int = WINDOW, m: int = M, hot: int = HOT) -> DataFrame:
    """docs with the repeated passages taken out of the text; all columns stay.

    A text that loses nothing keeps its exact bytes; in another the kept words
    are joined by one space.
    """
    docs, (text,), back = isolate(docs, text)
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.schema, T.StructField("_n", T.LongType()), T.StructField("_r", T.LongType())])
    return back(_finish(_joined(docs, text, window, m, hot), keep, window, schema, text).drop("_n", "_r"))


#: Every window as one string; the words of a text that a repeated one covers are left out.
ORACLE = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM t WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS s FROM p),
m AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS at FROM k JOIN m USING (s)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM t),
y AS (
  SELECT x.doc_id, count(c.at) AS gone, string_agg(CASE WHEN c.at IS NULL THEN word END, ' ' ORDER BY x.at) AS kept
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.at = c.at GROUP BY x.doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN y USING (doc_id)
"""
