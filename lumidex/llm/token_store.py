"""Token ids in a content-addressed store: encode, write, verify, read back.

Encoding
    The tokenizers library encodes every distinct white-space word once per
    worker; a text's ids are the concatenation of its words' ids.  That equals
    encoding the whole text for a tokenizer whose pre-tokenizer matches no white
    space and whose normaliser does not join across it (:func:`splits_at_space`
    checks the file); for any other tokenizer whole texts are encoded.

Store (a folder all executors see; files appear by atomic rename, so a task can
run twice)
    packs/PPPPP.bin   ids of the pack's chunks, one after another, little endian,
                      2 bytes an id for vocabularies up to 65,536, else 4
    packs/PPPPP.idx   the pack's chunk digests in ascending order (16 bytes each)
                      and, behind them, int64 offsets in ids, one more than chunks
    recipes/NNNNN.arrow  documents in ascending id order: id, n_tokens, start in
                      this part, chunk digests, Merkle leaf
    recipes/NNNNN.root   root of the part's Merkle tree
    manifest.json     parts with their first id position, root of the roots

    A polynomial rolling hash over the last ROLL ids cuts a document's ids into
    chunks of MIN to MAX ids.  A chunk's name is its 128-bit BLAKE2b digest, whose
    leading bits name its pack, so a reader finds any chunk by itself: pack from
    the name, binary search in the mapped index, slice of the mapped ids.

Scale: each text is encoded once; ids are shuffled once, by chunk name, after
every task has dropped the chunks it has already sent; recipes (16 bytes a
chunk) are range-sorted by id.  The number of packs and parts is a parameter; it
follows the input's size (PACK bytes of it a pack), and is no less than
spark.sql.shuffle.partitions.

Defined cases: null text counts as empty; an empty text has the end id alone.
Rows of equal id follow one another in the order of their content; null ids come
first.  Repeated rows share all chunks.  An empty table gives an empty store.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import _words as W
from ._shared import estimated_bytes, forget, fresh, local_path, pick, ship, tidy, written

ROLL, MASK, MIN, MAX = 16, 255, 64, 2048
DIGEST = 16
#: Bytes of text whose unknown words enter the table at once; each entry costs a copy of the table.
LEARN = 1 << 21
#: Words a worker remembers with their ids.
CACHE = 1 << 21
#: Bytes of input, as its plan estimates them, that a pack stands for.
PACK = 64 << 20
#: Chunk names a task remembers, so that copies are sent once.
SEEN = 1 << 18
_GEAR = np.uint64(0x9FB21C651E98DF25)
_GEAR_INV = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


def splits_at_space(path: str) -> bool:
    """Whether a tokenizer file is known to treat white-space words one by one."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    norm = j.get("normalizer") or {}
    kinds = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
    pre = j.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return set(kinds) <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and pattern == known and first.get("behavior") == "Removed" and first.get("invert") is True and j.get("post_processor") is None


class WordEncoder:
    """Ids of whole texts through a growing table of word hash -> ids.

    A word is found by one 64-bit hash and confirmed by a second, independent
    one, occurrence by occurrence.  Where two words share the first hash, the
    texts at hand are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_space(path)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.proof = np.zeros(0, np.uint64)
        self.off = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, w: W.Words, key: np.ndarray, at: np.ndarray) -> None:
        """Encodes the words at index ``at`` and enters them under ``key`` (ascending)."""
        words = [w.data[s:e].tobytes().decode() for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]
        offs, lens, pools = [], [], []
        base = len(self.pool)
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            size = np.fromiter(map(len, part), np.int64, len(part))
            begin = np.cumsum(size + 1) - size - 1
            pos = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            cut = np.append(np.searchsorted(pos, begin), len(pos))
            offs.append(cut[:-1] + base)
            lens.append(np.diff(cut))
            pools.append(np.array(e.ids, dtype=np.uint32))
            base += len(pos)
        where = np.searchsorted(self.key, key)
        self.key = np.insert(self.key, where, key)
        self.proof = np.insert(self.proof, where, w.second[at])
        self.off = np.insert(self.off, where, np.concatenate(offs))
        self.len = np.insert(self.len, where, np.concatenate(lens))
        self.pool = np.concatenate([self.pool, *pools])

    def _whole(self, column: pa.Array, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, text in enumerate(column):
            ids = np.array(self.tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids, dtype=np.uint32)
            yield first + i, ids, np.array([0, len(ids)])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (first document, ids of some documents on end, bounds)."""
        if not self.by_word:
            yield from self._whole(column, 0)
            return
        for w in W.scan(column, block=LEARN, second=True):
            uniq, first, inv = np.unique(w.hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(self.key, uniq)
            known = np.zeros(len(uniq), dtype=bool)
            inside = at < len(self.key)
            known[inside] = self.key[at[inside]] == uniq[inside]
            if not known.all():
                if len(self.key) > CACHE:
                    self.clear()
                    known[:] = False
                self._learn(w, uniq[~known], first[~known])
                at = np.searchsorted(self.key, uniq)
            if (self.proof[at][inv] != w.second).any():
                yield from self._whole(column.slice(w.first, w.n_docs), w.first)
                continue
            n = self.len[at][inv]
            total = np.zeros(len(n) + 1, dtype=np.int64)
            np.cumsum(n, out=total[1:])
            ids = self.pool[np.repeat(self.off[at][inv] - total[:-1], n) + np.arange(total[-1])]
            yield w.first, ids, total[w.bounds]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of a document's chunks, by content."""
    n = len(ids)
    if n <= MIN:
        return [n]
    inv = np.full(n + 1, _GEAR_INV, dtype=np.uint64)
    inv[0] = 1
    fwd = np.full(n + 1, _GEAR, dtype=np.uint64)
    fwd[0] = 1
    inv, fwd = np.multiply.accumulate(inv), np.multiply.accumulate(fwd)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(W.mix(ids.astype(np.uint64) + np.uint64(1)) * fwd[:n], out=s[1:])
    roll = (s[ROLL:] - s[:-ROLL]) * inv[: n - ROLL + 1]
    good = np.flatnonzero((W.mix(roll) & np.uint64(MASK)) == 0) + ROLL
    out, last = [], 0
    while n - last > MIN:
        i = int(np.searchsorted(good, last + MIN))
        nxt = min(int(good[i]) if i < len(good) else n, last + MAX, n)
        out.append(nxt)
        last = nxt
    if last < n:
        out.append(n)
    return out


def _pack_of(digest: bytes, packs: int) -> int:
    return int.from_bytes(digest[:4], "big") * packs >> 32


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def leaf(doc_id: int | None, n_tokens: int, recipe: bytes) -> bytes:
    return hashlib.blake2b(b"%d|%d|" % (-1 if doc_id is None else doc_id, n_tokens) + (b"" if doc_id is not None else b"null|") + recipe).digest()[:32]


class Merkle:
    """Root of a binary tree over leaves that arrive one by one; holds one node a level."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []

    def add(self, node: bytes, level: int = 0) -> None:
        while self.stack and self.stack[-1][0] == level:
            node = hashlib.blake2b(self.stack.pop()[1] + node).digest()[:32]
            level += 1
        self.stack.append((level, node))

    def root(self) -> bytes:
        stack = list(self.stack)
        if not stack:
            return bytes(32)
        node = stack.pop()[1]
        while stack:
            node = hashlib.blake2b(stack.pop()[1] + node).digest()[:32]
        return node


_ROWS = "p int, name binary, ids binary, doc_id long, n_tokens long, recipe binary"


def _encode(docs: DataFrame, tokenizer: str, end_id: int, packs: int, width: int) -> DataFrame:
    """A row per chunk new to the task (pack, name, ids) and a row per document (its recipe)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        seen: dict[bytes, None] = {}
        kind = np.uint16 if width == 2 else np.uint32
        for b in batches:
            ids_of = b.column(0).to_pylist()
            for first, ids, bounds in encode(b.column(1)):
                cols: list[list] = [[], [], [], [], [], []]
                for d in range(len(bounds) - 1):
                    own = np.append(ids[bounds[d] : bounds[d + 1]], end_id).astype(kind)
                    raw, recipe, last = own.tobytes(), [], 0
                    for cut in cuts(own):
                        chunk = raw[last * width : cut * width]
                        name = _digest(chunk)
                        recipe.append(name)
                        last = cut
                        if name not in seen:
                            if len(seen) >= SEEN:
                                seen.pop(next(iter(seen)))
                            seen[name] = None
                            for c, x in zip(cols, (_pack_of(name, packs), name, chunk, None, None, None)):
                                c.append(x)
                    doc = ids_of[first + d]
                    for c, x in zip(cols, (-1 - (first + d) % packs, None, None, doc, len(own), b"".join(recipe))):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["p", "name", "ids", "doc_id", "n_tokens", "recipe"])

    return docs.mapInArrow(tidy(go), _ROWS)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder a worker process: its table of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _write_packs(rows: DataFrame, root: str, width: int) -> DataFrame:
    """Writes each pack once, from rows sorted by (p, name); hands the recipes on."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"p": None}
        tag = TaskContext.get().taskAttemptId()

        def close() -> None:
            if state["p"] is None:
                return
            state["f"].close()
            stem = f"{root}/packs/{state['p']:05d}"
            with open(f"{stem}.idx.{tag}", "wb") as f:
                f.write(b"".join(state["names"]))
                f.write(np.cumsum([0, *state["sizes"]], dtype=np.int64).tobytes())
            os.replace(f"{stem}.bin.{tag}", f"{stem}.bin")
            os.replace(f"{stem}.idx.{tag}", f"{stem}.idx")

        for b in batches:
            p = b.column(0).to_numpy()
            out = np.flatnonzero(p < 0)
            if len(out):
                yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(out)) for i in (3, 4, 5)], names=["doc_id", "n_tokens", "recipe"])
            lo = len(out)  # recipes have negative pack numbers, so they come first
            for q, name, ids in zip(p[lo:].tolist(), b.column(1).slice(lo).to_pylist(), b.column(2).slice(lo).to_pylist()):
                if q != state["p"]:
                    close()
                    state = {"p": q, "f": open(f"{root}/packs/{q:05d}.bin.{tag}", "wb", buffering=1 << 20), "names": [], "sizes": [], "last": None}
                if name == state["last"]:
                    if ids != state["ids"]:
                        raise ValueError(f"two chunks have the name {name.hex()}")
                    continue
                state["f"].write(ids)
                state["names"].append(name)
                state["sizes"].append(len(ids) // width)
                state["last"], state["ids"] = name, ids
        close()

    return rows.mapInArrow(tidy(go), "doc_id long, n_tokens long, recipe binary")


_PART = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("recipe", pa.binary()), ("leaf", pa.binary())])


def _write_recipes(ordered: DataFrame, root: str) -> DataFrame:
    """Writes each sorted partition as one part, with its Merkle root; returns (part, n_docs, n_tokens, root)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, tag = context.partitionId(), context.taskAttemptId()
        stem = f"{root}/recipes/{part:05d}"
        tree, docs, tokens, sink = Merkle(), 0, 0, None
        for b in batches:
            if not len(b):
                continue
            if sink is None:
                f = pa.OSFile(f"{stem}.arrow.{tag}", "wb")
                sink = pa.ipc.new_stream(f, _PART)
            n = b.column(1).to_numpy()
            leaves = [leaf(i, k, r) for i, k, r in zip(b.column(0).to_pylist(), n.tolist(), b.column(2).to_pylist())]
            for x in leaves:
                tree.add(x)
            start = tokens + np.cumsum(n) - n
            sink.write_batch(pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start), b.column(2), pa.array(leaves, pa.binary())], schema=_PART))
            docs += len(b)
            tokens += int(n.sum())
        if sink is not None:
            sink.close()
            f.close()
            with open(f"{stem}.root.{tag}", "wb") as r:
                r.write(tree.root())
            os.replace(f"{stem}.arrow.{tag}", f"{stem}.arrow")
            os.replace(f"{stem}.root.{tag}", f"{stem}.root")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])

    return ordered.mapInArrow(tidy(go), "part int, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", end_id: int = 2, root: str | None = None, packs: int | None = None) -> str:
    """Encodes docs into a store; returns its folder.  ``root`` must be a path all executors have mounted."""
    spark = docs.sparkSession
    ship(spark)
    root = root or local_path(fresh(spark, "store"))
    os.makedirs(f"{root}/packs")
    os.makedirs(f"{root}/recipes")
    packs = packs or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(estimated_bytes(docs) / PACK))
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    rows = _encode(pick(docs, id_col, text).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), tokenizer, end_id, packs, width)
    recipes = written(_write_packs(rows.repartition(packs, "p").sortWithinPartitions("p", "name"), root, width), "recipes")
    keyed = recipes.withColumn("h", F.xxhash64("recipe")).withColumn("u", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(packs, "doc_id", "h", "u").sortWithinPartitions("doc_id", "h", "u").select("doc_id", "n_tokens", "recipe")
    parts = sorted(_write_recipes(ordered, root).collect())  # a row a partition
    forget(recipes)
    base, listed, tree = 0, [], Merkle()
    for r in parts:
        listed.append({"part": r.part, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": base, "root": bytes(r.root).hex()})
        tree.add(bytes(r.root))
        base += r.n_tokens
    with open(f"{root}/manifest.json.new", "w") as f:
        json.dump({"width": width, "packs": packs, "n_tokens": base, "root": tree.root().hex(), "parts": listed}, f)
    os.replace(f"{root}/manifest.json.new", f"{root}/manifest.json")
    return root


class Packs:
    """Mapped packs of a store; finds chunks by name."""

    def __init__(self, root: str, packs: int, width: int) -> None:
        self.root, self.packs, self.kind, self.open = root, packs, np.uint16 if width == 2 else np.uint32, {}

    def _pack(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading halves of its chunk names, offsets, ids."""
        if p not in self.open:
            if len(self.open) > 4096:
                self.open.clear()
            raw = np.memmap(f"{self.root}/packs/{p:05d}.idx", dtype=np.uint8, mode="r")
            n = (len(raw) - 8) // (DIGEST + 8)
            high = np.ascontiguousarray(raw[: n * DIGEST].reshape(n, DIGEST)[:, :8]).view(">u8").ravel().astype(np.uint64)
            off = np.frombuffer(raw[n * DIGEST :].tobytes(), dtype=np.int64)
            self.open[p] = high, off, np.memmap(f"{self.root}/packs/{p:05d}.bin", dtype=self.kind, mode="r")
        return self.open[p]

    def fetch(self, names: np.ndarray) -> list[np.ndarray]:
        """names: n x 16 bytes.  Ids of each, checked against its name."""
        high = np.ascontiguousarray(names[:, :8]).view(">u8").ravel().astype(np.uint64)
        pack = ((high >> np.uint64(32)) * np.uint64(self.packs) >> np.uint64(32)).astype(np.int64)
        out: list = [None] * len(names)
        order = np.lexsort((high, pack))
        cut = np.flatnonzero(np.diff(pack[order], prepend=-1))
        for lo, hi in zip(cut, np.append(cut[1:], len(order))):
            own = order[lo:hi]
            index, off, ids = self._pack(int(pack[own[0]]))
            at = np.searchsorted(index, high[own])
            for i, a in zip(own.tolist(), at.tolist()):
                want = names[i].tobytes()
                while a < len(index) and index[a] == high[i]:
                    chunk = ids[off[a] : off[a + 1]]
                    if _digest(chunk.tobytes()) == want:
                        out[i] = chunk
                        break
                    a += 1
                if out[i] is None:
                    raise ValueError(f"chunk {want.hex()} is missing or damaged")
        return out


def read_store(spark: SparkSession, root: str, each: Callable[[np.ndarray], object], kind: T.DataType, name: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ``each(ids)`` as column ``name``, from the files alone.

    Chunks are checked against their names, recipes against their leaves, parts
    against their Merkle roots; damage raises an error.
    """
    ship(spark)
    with open(f"{root}/manifest.json") as f:
        m = json.load(f)
    packs, width = m["packs"], m["width"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])
    arrow_kind = pa.int64() if isinstance(kind, T.LongType) else pa.list_(pa.int32()) if isinstance(kind, T.ArrayType) else pa.string()
    parts = spark.createDataFrame([(p["part"], p["start"], p["root"]) for p in m["parts"]], "part int, base long, root string")
    parts = parts.repartition(max(1, min(len(m["parts"]), 1 << 16)), "part")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Packs(root, packs, width)
        for b in batches:
            for part, base, want in zip(*[b.column(i).to_pylist() for i in range(3)]):
                tree = Merkle()
                with pa.memory_map(f"{root}/recipes/{part:05d}.arrow") as f:
                    for r in pa.ipc.open_stream(f):
                        for lo in range(0, len(r), 256):
                            s = r.slice(lo, 256)
                            recipes = s.column(3).to_pylist()
                            sizes = [len(x) // DIGEST for x in recipes]
                            chunks = store.fetch(np.frombuffer(b"".join(recipes), dtype=np.uint8).reshape(-1, DIGEST))
                            at, values = 0, []
                            for doc, n, recipe, k, have in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), recipes, sizes, s.column(4).to_pylist()):
                                ids = np.concatenate(chunks[at : at + k])
                                at += k
                                node = leaf(doc, len(ids), recipe)
                                if node != have or len(ids) != n:
                                    raise ValueError(f"document {doc} in part {part} is damaged")
                                tree.add(node)
                                values.append(each(ids))
                            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(s.column(2).to_numpy() + base), s.column(1), pa.array(values, arrow_kind)], names=["doc_id", "start", "n_tokens", name])
                if tree.root().hex() != want:
                    raise ValueError(f"part {part} does not match its root")

    return parts.mapInArrow(tidy(go), schema)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def digest_rows(docs: DataFrame, tokenizer: str, **options: object) -> DataFrame:
    """Writes a store and reads it back: doc_id, start, n_tokens, ids_crc32."""
    root = write_store(docs, tokenizer, **options)
    return read_store(docs.sparkSession, root, crc32, T.LongType(), "ids_crc32")
