"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

Ordinary texts go through the library, batch by batch.  A text of GIANT
characters or more is cut into chunks of CHUNK characters that are encoded
independently:

* The encoding of a text by a merge (BPE) model is the one path through the
  lattice of vocabulary pieces on which every two neighbours are compatible, that
  is, merging the characters of both gives just these two.  Weighing compatible
  steps 0 and others minus infinity makes encoding a longest-path problem.
* The state at a chunk boundary is the piece that covers the character before
  it.  Each chunk gives the matrix of best weights from the states at its left to
  those at its right boundary, without knowing what lies before it.
* Matrices combine associatively in max-plus algebra (:func:`max_plus`): up a
  tree, neighbours are combined to the matrix of both (:func:`up`); down the tree,
  the states at the ends of a pair give the state between its two
  (:func:`down`), each pair by itself.  Groups of FAN matrices are a task's
  tree, and groups of groups the levels above, so no task holds more than FAN
  matrices, however long the text.
* Each chunk is then traced back by itself between its two states.

A place where no piece can cross (a word begin, if no piece of the vocabulary
holds one inside) is a certain boundary; between the first and the last of a
chunk the library encodes, so lattices are small where there is white space.

Defined cases: null text has null ids in :func:`encode`, an empty text none.
Repeated rows are encoded alike, giant copies once.  Ids that are null are
allowed.  An empty table gives an empty result.  Other columns are carried by
:func:`encode`.  Models with user-defined symbols, or of another kind than BPE,
send giant texts through the library whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import isolate, pick, ship, tidy, written

GIANT = 65_536
CHUNK = 16_384
#: Texts the library encodes at a time; their ids are Python lists for a moment.
GROUP = 64
#: Matrices that one task combines.
FAN = 256
_SPACE = "▁"


class Pieces:
    """Merge rules of a model, read through the library."""

    def __init__(self, path: str) -> None:
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id, self.score = {}, {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                self.id[sp.id_to_piece(i)], self.score[sp.id_to_piece(i)] = i, sp.get_score(i)
        self.longest = max(map(len, self.id), default=1)
        self.words = all(_SPACE not in p.lstrip(_SPACE) for p in self.id)
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = bytes_ if all(sp.is_byte(i) for i in bytes_) else None
        self.heads = {}
        for p in self.id:
            self.heads.setdefault(p[0], set()).add(len(p))
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.whole = lru_cache(1 << 16)(lambda p: self.merge(p) == [p])

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string: the best-scored pair merges first, the leftmost at ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: str, b: str) -> bool:
        return self.merge(a + b) == [a, b]

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.sp.unk_id()]

    def at(self, t: str, p: int) -> Iterator[int]:
        """Ends of the pieces that begin at p and merge to themselves; an unknown character is a piece."""
        yield p + 1
        for n in self.heads.get(t[p], ()):
            if n > 1 and p + n <= len(t):
                s = t[p : p + n]
                if s in self.id and self.whole(s):
                    yield p + n

    def certain(self, t: str, p: int) -> bool:
        return self.words and p < len(t) and t[p] == _SPACE and p > 0 and t[p - 1] != _SPACE

    def scannable(self) -> bool:
        """Whether this class merges as the library does (probed; user-defined symbols or another model kind fail)."""
        probe = "The quick brown fox, 12345 jumps; 'tis non-trivial  Größeé中\U0001f600"
        got = [i for p in self.merge(self.sp.normalize(probe)) for i in self.ids(p)]
        return got == self.sp.encode(probe)


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One a worker process."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def states(m: Pieces, t: str, p: int) -> list[tuple[int, int]]:
    """Pieces (begin, end) of t that cover the character before p; the one state (0, 0) where p is 0."""
    if p == 0:
        return [(0, 0)]
    return [(b, e) for b in range(max(0, p - m.longest), p) for e in m.at(t, b) if e >= p]


def _walk(m: Pieces, t: str, begin: dict[tuple[int, int], int], stop: int, free: bool) -> tuple[dict[tuple[int, int], int], dict]:
    """Moves sets of states (bit masks) along compatible pieces up to those that end at ``stop`` or behind it.

    ``free``: the first step needs no compatible neighbour.  Returns the final
    pieces with their masks, and every piece's (neighbour, mask) pairs.
    """
    by_end: dict[int, dict[tuple[int, int], int]] = {}
    back: dict[tuple[int, int], list] = {}
    final: dict[tuple[int, int], int] = {}
    for s, mask in begin.items():
        if s[1] >= stop and not (free and s[0] == s[1]):
            final[s] = final.get(s, 0) | mask
        else:
            by_end.setdefault(s[1], {})[s] = mask
    while by_end:
        p = min(by_end)
        ending = by_end.pop(p)
        if p >= stop:
            for s, mask in ending.items():
                final[s] = final.get(s, 0) | mask
            continue
        for e in m.at(t, p):
            new, piece = (p, e), t[p:e]
            mask = 0
            for s, got in ending.items():
                if s[0] == s[1] or m.compatible(t[s[0] : s[1]], piece):
                    mask |= got
                    back.setdefault(new, []).append((s, got))
            if mask:
                if e >= stop:
                    final[new] = final.get(new, 0) | mask
                else:
                    by_end.setdefault(e, {})[new] = mask
    return final, back


def _trace(back: dict, first: tuple[int, int], last: tuple[int, int]) -> list[tuple[int, int]]:
    """Pieces behind ``first`` up to and with ``last``, of a walk from ``first`` alone."""
    out = []
    while last != first:
        out.append(last)
        last = next(s for s, mask in back[last] if mask)
    return out[::-1]


def _edges(m: Pieces, t: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last certain boundary of [lo, hi)."""
    if not m.words:
        return None
    a = lo
    while a < hi and not m.certain(t, a):
        a = t.find(_SPACE, a + 1, hi)
        if a < 0:
            return None
    if a >= hi:
        return None
    b = hi - 1
    while not m.certain(t, b):
        b = t.rfind(_SPACE, a, b)
    return a, b


def transfer(m: Pieces, t: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """States at lo, states at hi, and the max-plus matrix between them: 0 where a compatible path leads, else minus infinity."""
    left, right = states(m, t, lo), states(m, t, hi)
    out = np.full((len(left), len(right)), -np.inf)
    where = {s: j for j, s in enumerate(right)}
    edges = _edges(m, t, lo, hi)
    if edges is None:
        final, _ = _walk(m, t, {s: 1 << i for i, s in enumerate(left)}, hi, False)
        for s, mask in final.items():
            if s in where:
                for i in range(len(left)):
                    if mask >> i & 1:
                        out[i, where[s]] = 0.0
        return left, right, out
    a, b = edges
    head, _ = _walk(m, t, {s: 1 << i for i, s in enumerate(left)}, a, False)
    come = 0
    for s, mask in head.items():
        if s[1] == a:
            come |= mask
    tail, _ = _walk(m, t, {(b, b): 1}, hi, True)
    for i in range(len(left)):
        if come >> i & 1:
            for s in tail:
                if s in where:
                    out[i, where[s]] = 0.0
    return left, right, out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


def up(matrices: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Levels of the tree of products: the matrices, those of neighbouring pairs, and so on to that of all."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        w = levels[-1]
        levels.append([max_plus(w[i], w[i + 1]) if i + 1 < len(w) else w[i] for i in range(0, len(w), 2)])
    return levels


def down(levels: list[list[np.ndarray]], first: int, last: int) -> list[tuple[int, int]]:
    """The states (rows and columns of the matrices) at both ends of each matrix, on a best path from ``first`` to ``last``."""
    ends = [(first, last)]
    for w in reversed(levels[:-1]):
        new = []
        for i, (a, b) in enumerate(ends):
            if 2 * i + 1 == len(w):
                new.append((a, b))
            else:
                mid = int(np.argmax(w[2 * i][a] + w[2 * i + 1][:, b]))
                new += [(a, mid), (mid, b)]
        ends = new
    return ends


def _final(right: list[tuple[int, int]], w: np.ndarray, length: int) -> int:
    """The state at the end of a text that the path from its start reaches."""
    return next(j for j, s in enumerate(right) if s[1] == length and w[0, j] == 0)


def resolve(matrices: list[tuple[list, list, np.ndarray]], length: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The states at the two boundaries of every chunk of a text of ``length``."""
    levels = up([w for _, _, w in matrices])
    found = down(levels, 0, _final(matrices[-1][1], levels[-1][0], length))
    return [(left[a], right[b]) for (left, right, _), (a, b) in zip(matrices, found)]


def chunk_ids(m: Pieces, t: str, lo: int, hi: int, first: tuple[int, int], last: tuple[int, int]) -> list[int]:
    """Ids of the pieces behind state ``first`` at lo up to and with state ``last`` at hi."""
    if first == last:
        return []
    edges = _edges(m, t, lo, hi)
    if edges is None:
        final, back = _walk(m, t, {first: 1}, hi, False)
        return [i for b, e in _trace(back, first, last) for i in m.ids(t[b:e])]
    a, b = edges
    out: list[int] = []
    if first[1] < a:
        final, back = _walk(m, t, {first: 1}, a, False)
        end = next(s for s in final if s[1] == a)
        out += [i for x, y in _trace(back, first, end) for i in m.ids(t[x:y])]
    if b > a:
        raw = t[a + 1 : b].replace(_SPACE, " ")
        if m.sp.normalize(raw) == t[a:b]:
            out += m.sp.encode(raw)
        else:
            final, back = _walk(m, t, {(a, a): 1}, b, True)
            end = next(s for s in final if s[1] == b)
            out += [i for x, y in _trace(back, (a, a), end) for i in m.ids(t[x:y])]
    final, back = _walk(m, t, {(b, b): 1}, hi, True)
    return out + [i for x, y in _trace(back, (b, b), last) for i in m.ids(t[x:y])]


def encode_giant(m: Pieces, text: str, chunk: int = CHUNK) -> list[int]:
    """The scan in one process; the jobs below run the same steps chunk by chunk."""
    t = m.sp.normalize(text)
    if not t:
        return []
    cuts = [*range(0, len(t), chunk), len(t)]
    spans = list(zip(cuts, cuts[1:]))
    found = resolve([transfer(m, t, lo, hi) for lo, hi in spans], len(t))
    return _join(m, [chunk_ids(m, t, lo, hi, *s) for (lo, hi), s in zip(spans, found)])


def _join(m: Pieces, parts: list[list[int]]) -> list[int]:
    ids = [i for p in parts for i in p]
    if m.bytes is None:  # unknown neighbours are one id
        ids = [x for k, x in enumerate(ids) if not (x == m.sp.unk_id() and k and ids[k - 1] == x)]
    return ids


_CHUNKS = "tid binary, k int, n int, base int, lo int, hi int, total int, t string"


def _chunks(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """Chunks of giant texts (normalised), with a margin of one piece on both sides; lo, hi and base are places in the whole."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        seen: set[bytes] = set()
        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                tid = xxhash.xxh3_128_digest(text.encode())
                if tid in seen:
                    continue
                seen.add(tid)
                t = m.sp.normalize(text)
                cuts = [*range(0, len(t), chunk), len(t)]
                out = []
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    a, z = max(0, lo - m.longest - 1), min(len(t), hi + m.longest + 1)
                    out.append((tid, k, len(cuts) - 1, a, lo, hi, len(t), t[a:z]))
                cols = list(zip(*out)) if out else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.binary(), *[pa.int32()] * 6, pa.string()))], names=["tid", "k", "n", "base", "lo", "hi", "total", "t"])

    return texts.mapInArrow(tidy(go), _CHUNKS)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[n for n, _ in schema])


_STATES = [("tid", pa.binary()), ("k", pa.int32()), ("total", pa.int32()), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("w", pa.binary())]
_FOUND = [("tid", pa.binary()), *[(c, pa.int32()) for c in "kabcd"]]
_TRACED = [("tid", pa.binary()), ("k", pa.int32()), ("ids", pa.list_(pa.int32()))]


def _matrices(chunks: DataFrame, path: str) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                left, right, w = transfer(pieces(path), r["t"], r["lo"] - r["base"], r["hi"] - r["base"])
                rows.append((r["tid"], r["k"], r["total"], [x + r["base"] for s in left for x in s], [x + r["base"] for s in right for x in s], np.packbits(w == 0).tobytes()))
            yield _batch(rows, _STATES)

    return chunks.mapInArrow(tidy(go), "tid binary, k int, total int, left array<int>, right array<int>, w binary")


def _unpacked(t: pa.Table) -> tuple[list[dict], list[tuple[list, list, np.ndarray]]]:
    """Rows of a table of matrices in order, and (states, states, matrix) of each."""
    rows = t.sort_by("k").to_pylist()
    parts = []
    for r in rows:
        left, right = [tuple(x) for x in np.reshape(r["left"], (-1, 2)).tolist()], [tuple(x) for x in np.reshape(r["right"], (-1, 2)).tolist()]
        bits = np.unpackbits(np.frombuffer(r["w"], np.uint8))[: len(left) * len(right)].reshape(len(left), len(right))
        parts.append((left, right, np.where(bits == 1, 0.0, -np.inf)))
    return rows, parts


def _resolved(matrices: DataFrame, most: int) -> DataFrame:
    """(tid, k, a, b, c, d): the states (a, b) and (c, d) at the boundaries of each chunk.  ``most``: chunks of the longest text."""

    def product(t: pa.Table) -> pa.Table:
        rows, parts = _unpacked(t)
        w = up([p[2] for p in parts])[-1][0]
        flat = [[x for s in states for x in s] for states in (parts[0][0], parts[-1][1])]
        return pa.Table.from_batches([_batch([(rows[0]["tid"], rows[0]["k"] // FAN, rows[0]["total"], *flat, np.packbits(w == 0).tobytes())], _STATES)])

    def solve(t: pa.Table) -> pa.Table:
        rows, parts = _unpacked(t)
        levels = up([p[2] for p in parts])
        if "a" in t.column_names:  # a part of a text, between states that are known
            first, last = parts[0][0].index((rows[0]["a"], rows[0]["b"])), parts[-1][1].index((rows[0]["c"], rows[0]["d"]))
        else:
            first, last = 0, _final(parts[-1][1], levels[-1][0], rows[0]["total"])
        found = [(left[a], right[b]) for (left, right, _), (a, b) in zip(parts, down(levels, first, last))]
        return pa.Table.from_batches([_batch([(r["tid"], r["k"], *f, *s) for r, (f, s) in zip(rows, found)], _FOUND)])

    group = F.floor(F.col("k") / FAN).cast("int")
    levels = [matrices]
    while most > FAN:
        levels.append(written(levels[-1].groupBy("tid", group.alias("g")).applyInArrow(product, matrices.schema), "states"))
        most = -(-most // FAN)
    schema = "tid binary, k int, a int, b int, c int, d int"
    found = levels.pop().groupBy("tid").applyInArrow(solve, schema)
    while levels:
        below = levels.pop().withColumn("g", group).join(found.withColumnRenamed("k", "g"), ["tid", "g"])
        found = below.groupBy("tid", "g").applyInArrow(solve, schema)
    return found


def _traced(chunks: DataFrame, path: str) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                lo, hi, a, b_, c, d = (r[x] - r["base"] for x in ("lo", "hi", "a", "b", "c", "d"))
                rows.append((r["tid"], r["k"], chunk_ids(pieces(path), r["t"], lo, hi, (a, b_), (c, d))))
            yield _batch(rows, _TRACED)

    return chunks.mapInArrow(tidy(go), "tid binary, k int, ids array<int>")


def giant_ids(texts: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """texts: one column of giant texts.  (tid, ids): tid is the 128-bit xxh3 digest of the text."""
    ship(texts.sparkSession)
    chunks = written(_chunks(texts, path, chunk).dropDuplicates(["tid", "k"]), "chunks")  # copies that several tasks met
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(n, "tid", "k")
    matrices = written(_matrices(spread, path), "states")
    most = matrices.agg(F.max("k")).first()[0]
    found = written(_resolved(matrices, 0 if most is None else most + 1), "states")
    traced = _traced(chunks.join(found, ["tid", "k"]).repartition(n, "tid", "k"), path)
    whole = traced.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))
    return whole.select("tid", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def _encoded(docs: DataFrame, text: str, path: str, giant: int, chunk: int, each: Callable, fields: list[T.StructField], keep: list[str]) -> DataFrame:
    """``keep`` of docs and what ``each`` makes of (texts, id lists); giant texts bring their ids along."""
    scanned = _giant(docs, text, path, giant, chunk)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_t"))
    long_ = F.length("_t") >= giant
    schema = T.StructType([*[docs.schema[c] for c in keep], *fields])
    names = [f.name for f in schema]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(path).sp
        for b in batches:
            for lo in range(0, len(b), GROUP):
                s = b.slice(lo, GROUP)
                texts = s.column(len(keep)).to_pylist()
                ids = sp.encode([x or "" for x in texts], num_threads=1)
                yield pa.RecordBatch.from_arrays([*s.columns[: len(keep)], *each(sp, texts, ids)], names=names)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(path).sp
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *each(sp, b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist())], names=names)

    if scanned is None:
        return rows.mapInArrow(tidy(go), schema)
    small = rows.where(F.coalesce(~long_, F.lit(True))).mapInArrow(tidy(go), schema)
    big = _with_digest(rows.where(long_)).join(scanned, F.col("_d") == F.col("tid")).select(*[F.col(f"`{c}`") for c in keep], "_t", "ids").mapInArrow(tidy(given), schema)
    return small.unionByName(big)


def _with_digest(rows: DataFrame) -> DataFrame:
    names = rows.columns
    at = names.index("_t")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [xxhash.xxh3_128_digest(x.encode()) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d, pa.binary())], names=[*names, "_d"])

    return rows.mapInArrow(tidy(go), T.StructType([*rows.schema, T.StructField("_d", T.BinaryType())]))


def _giant(docs: DataFrame, text: str, path: str, giant: int, chunk: int) -> DataFrame | None:
    ship(docs.sparkSession)
    if not Pieces(path).scannable():
        return None
    t = F.col(f"`{text}`")
    return written(giant_ids(docs.where(F.length(t) >= giant).select(t.alias("t")), path, chunk), "giant")


def _ids(sp: sentencepiece.SentencePieceProcessor, texts: list, ids: list) -> list[pa.Array]:
    return [pa.array([None if t is None else i for t, i in zip(texts, ids)], pa.list_(pa.int32()))]


def _digests(sp: sentencepiece.SentencePieceProcessor, texts: list, ids: list) -> list[pa.Array]:
    back = sp.decode(ids, num_threads=1)
    crc = [zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in ids]
    return [pa.array([len(i) for i in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array([(t or "") == b for t, b in zip(texts, back)], pa.bool_())]


def encode(docs: DataFrame, model: str, *, text: str = "text", ids: str = "ids", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """docs with the column ``ids``: the ids of its text.  A column of that name is replaced."""
    names = docs.columns
    if ids in names and ids != text:
        docs = pick(docs, *[c for c in names if c != ids])
    docs, (text,), back = isolate(docs, text)
    return back(_encoded(docs, text, model, giant, chunk, _ids, [T.StructField(ids, T.ArrayType(T.IntegerType()))], docs.columns))


def decode(df: DataFrame, model: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the column ``text``: what its ids stand for; null for null."""
    ship(df.sparkSession)
    df, (ids,), back_ = isolate(df, ids)
    names = df.columns
    at = names.index(ids)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model).sp
        for b in batches:
            lists = b.column(at).to_pylist()
            back = sp.decode([x or [] for x in lists], num_threads=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else y for x, y in zip(lists, back)], pa.string())], names=[*names, text])

    return back_(df.mapInArrow(tidy(go), T.StructType([*df.schema, T.StructField(text, T.StringType())])))


def digest_rows(docs: DataFrame, model: str, *, id_col: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Per row: id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text)."""
    fields = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return _encoded(pick(docs, id_col, text), text, model, giant, chunk, _digests, fields, [id_col])

