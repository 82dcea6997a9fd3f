"""Language identification by word-first backoff.

A word that the training rows know scores by its log frequency in each language.
An unknown word falls back to its character n-grams (with word edges), of the
longest length, 5 to 1, of which any is known: it scores by their mean.  The
language of the greatest sum wins, the more frequent one at ties.

Words are runs of ASCII letters and non-ASCII characters of the lower-cased text.
A word or n-gram is known if it was counted MIN_COUNT times, however many
training words there are; n-grams are counted over all training words.

Scale: tasks count words in batches before they shuffle them; n-grams come from
the table of distinct words, not from the texts; the model is a sharded table of
64-bit keys that workers map, so nothing is broadcast and it may grow with the
corpus: a language keeps its words however little of the corpus it is.

Defined cases: text null or without a letter: ``und``, score 0.  With no
training rows at all every row is ``und``.  Texts of unknown scripts go to the
most frequent language, with an even score.  Repeated rows count as often as
they occur.  An id that is null is not held out.  Empty tables are fine.  Other
columns, whatever their names, are ignored; a prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import forget, pick, ship, tidy, written
from ._tables import Sharded, write_sharded

MIN_COUNT = 3
ORDERS = (5, 4, 3, 2, 1)
ALPHA = 0.5
#: Weight of an unknown word beside a known one.
UNKNOWN = 0.5
#: Distinct words or n-grams a task gathers before it sends their counts.
GATHER = 1 << 20

_BREAK = np.ones(256, dtype=bool)
_BREAK[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _words(texts: pa.Array) -> Iterator[W.Words]:
    return W.scan(pc.utf8_lower(pc.fill_null(texts, "")), space=_BREAK)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each first is, summed counts (rows of a matrix)."""
    uniq, first, inv = np.unique(keys, return_index=True, return_inverse=True)
    out = np.stack([np.bincount(inv, weights=counts[:, i], minlength=len(uniq)) for i in range(counts.shape[1])], axis=1)
    return uniq, first, out


def _word_counts(train: DataFrame, langs: list[str]) -> DataFrame:
    """word, c0..: counts of each language, of all training rows."""
    where = {x: i for i, x in enumerate(langs)}
    cols = [f"c{i}" for i in range(len(langs))]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def send() -> pa.RecordBatch:
            keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            words = pa.concat_arrays([p[2] for p in parts])
            _, first, total = _sum_by(keys, counts)
            return pa.RecordBatch.from_arrays([words.take(pa.array(first)), *[pa.array(total[:, i].astype(np.int64)) for i in range(len(cols))]], names=["word", *cols])

        for b in batches:
            lang = np.array([where[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            for w in _words(b.column(1)):
                uniq, first, inv = np.unique(w.hashes, return_index=True, return_inverse=True)
                cell = inv * len(cols) + np.repeat(lang[w.first : w.first + w.n_docs], np.diff(w.bounds))
                counts = np.bincount(cell, minlength=len(uniq) * len(cols)).reshape(-1, len(cols))
                parts.append((uniq, counts, W.gather(w.data, w.start[first], w.end[first])))
                size += len(uniq)
                if size >= GATHER:
                    yield send()
                    parts, size = [], 0
        if parts:
            yield send()

    rows = train.mapInArrow(tidy(go), "word binary, " + ", ".join(f"{c} long" for c in cols))
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in cols])


def _points(words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of `` w1 w2 ... `` and the index of the word at each place (edges belong to the word before)."""
    flat = pa.array(words, pa.binary()) if isinstance(words, list) else words
    raw = b" " + b" ".join(flat.to_pylist()) + b" "
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return points, np.cumsum(points == 32) - 1


def _grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that hold no word edge inside, and where they begin."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = points == 32
    ok = np.ones(m, dtype=bool)
    for k in range(n):
        if n == 1 or 0 < k < n - 1:
            ok &= ~edge[k : k + m]
    if n == 2:
        ok &= ~(edge[:m] & edge[1 : m + 1])
    at = np.flatnonzero(ok)
    key = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        key = key * np.uint64(0x9FB21C651E98DF25) + points[at + k]
    return W.mix(key), at


def _gram_counts(words: DataFrame, n_langs: int) -> DataFrame:
    """key, o (order), c0..: counts of all n-grams, each word as often as it was counted."""
    cols = [f"c{i}" for i in range(n_langs)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            points, word = _points(pa.concat_arrays([b.column(0) for b in held]))
            counts = np.stack([np.concatenate([b.column(1 + i).to_numpy() for b in held]) for i in range(n_langs)], axis=1)
            for n in ORDERS:
                key, at = _grams(points, n)
                uniq, _, total = _sum_by(key, counts[word[at]])
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(np.full(len(uniq), n, np.int32)), *[pa.array(total[:, i].astype(np.int64)) for i in range(n_langs)]], names=["key", "o", *cols])

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= GATHER // 4:
                yield from send()
                held, size = [], 0
        if size:
            yield from send()

    rows = words.mapInArrow(tidy(go), "key long, o int, " + ", ".join(f"{c} long" for c in cols))
    return rows.groupBy("key").agg(F.first("o").alias("o"), *[F.sum(c).alias(c) for c in cols])


def _hashed(words: DataFrame, n_langs: int) -> DataFrame:
    cols = [f"v{i}" for i in range(n_langs)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                data, off = W.string_buffers(b.column(0).cast(pa.string()))
                lo, hi = int(off[0]), int(off[-1])
                key = W.span_hashes(data[lo:hi], off[:-1], off[1:], lo)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns[1:]], names=["key", *cols])

    return words.mapInArrow(tidy(go), "key long, " + ", ".join(f"{c} double" for c in cols))


class Model:
    """Languages, most frequent first, and handles of the word and n-gram tables."""

    def __init__(self, langs: list[str], words: tuple | None, grams: tuple | None) -> None:
        self.langs, self.words, self.grams = langs, words, grams


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """Learns from every row of docs that has text and language."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").collect()]  # a row a language
    if not langs:
        return Model([], None, None)
    cols = [f"c{i}" for i in range(len(langs))]
    words = written(_word_counts(rows, langs), "words")
    total = words.agg(F.count(F.lit(1)).alias("v"), *[F.sum(c).alias(c) for c in cols]).first()
    sums = [float(total[c] or 0) for c in cols]

    def logs(v: float, t: list) -> list[Column]:
        return [F.log((F.col(c) + ALPHA) / F.lit(x + ALPHA * v)).alias(f"v{i}") for i, (c, x) in enumerate(zip(cols, t))]

    count = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    known = words.where(count >= MIN_COUNT).select("word", *logs(float(total["v"]), sums))
    word_table = write_sharded(_hashed(known, len(langs)), "key", [f"v{i}" for i in range(len(langs))], "model-words")
    grams = written(_gram_counts(words, len(langs)).where(count >= MIN_COUNT), "grams")
    by_order = {r["o"]: r for r in grams.groupBy("o").agg(F.count(F.lit(1)).alias("v"), *[F.sum(c).alias(c) for c in cols]).collect()}  # a row an order
    value = [F.lit(0.0)] * len(langs)
    for o, r in by_order.items():
        value = [F.when(F.col("o") == o, x).otherwise(y) for x, y in zip(logs(float(r["v"]), [float(r[c]) for c in cols]), value)]
    gram_table = write_sharded(grams.select("key", *[v.alias(f"v{i}") for i, v in enumerate(value)]), "key", [f"v{i}" for i in range(len(langs))], "model-grams")
    forget(words)
    forget(grams)
    return Model(langs, word_table, gram_table)


def _unknown(words: pa.Array, grams: Sharded) -> np.ndarray:
    """Scores of words by their n-grams of the longest known length; zero where none is known."""
    out = np.zeros((len(words), grams.width))
    open_ = np.arange(len(words))
    for n in ORDERS:
        if not len(open_):
            break
        points, word = _points(words.take(pa.array(open_)))
        key, at = _grams(points, n)
        uniq, inv = np.unique(key, return_inverse=True)
        found, value = grams.lookup(uniq)
        hit = found[inv]
        w = word[at][hit]
        size = np.bincount(w, minlength=len(open_))
        got = size > 0
        for i in range(grams.width):
            out[open_[got], i] = np.bincount(w, weights=value[inv[hit], i], minlength=len(open_))[got] / size[got]
        open_ = open_[~got]
    return out


def predict(docs: DataFrame, model: Model, keep: list[Column], *, text: str = "text") -> DataFrame:
    """``keep`` and lang_pred, score of each row."""
    ship(docs.sparkSession)
    letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, letter.alias("_letter"), F.col(f"`{text}`").alias("_text"))
    k = len(rows.columns) - 2
    langs, words, grams = model.langs, model.words, model.grams
    names = rows.columns[:k] + ["lang_pred", "score"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, back = (Sharded(words), Sharded(grams)) if langs else (None, None)
        for b in batches:
            letter = b.column(k).to_numpy(zero_copy_only=False)
            pred, score = np.full(len(b), "und", dtype=object), np.zeros(len(b))
            for w in _words(b.column(k + 1)) if langs else ():
                uniq, first, inv = np.unique(w.hashes, return_index=True, return_inverse=True)
                found, value = table.lookup(uniq)
                value = value.astype(np.float64)
                new = np.flatnonzero(~found)
                if len(new):
                    value[new] = UNKNOWN * _unknown(W.gather(w.data, w.start[first[new]], w.end[first[new]]), back)
                doc = w.doc
                total = np.stack([np.bincount(doc, weights=value[inv, i], minlength=w.n_docs) for i in range(len(langs))], axis=1)
                size = np.maximum(1, np.diff(w.bounds))
                best = total.argmax(axis=1)
                e = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(size)[:, None])
                at = slice(w.first, w.first + w.n_docs)
                ok = letter[at].astype(bool)
                pred[at] = np.where(ok, np.array(langs, dtype=object)[best], "und")
                score[at] = np.where(ok, 1 / e.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(pred.tolist(), pa.string()), pa.array(score)], names=names)

    schema = T.StructType([*rows.schema.fields[:k], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(go), schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out, predicts all: id, held_out, lang_pred, score."""
    docs = pick(docs, id_col, text, lang)
    out = held_out(F.col(f"`{id_col}`"))
    model = train(docs.where(~out).select(F.col(f"`{text}`"), F.col(f"`{lang}`")), text=text, lang=lang)
    return predict(docs, model, [F.col(f"`{id_col}`"), out.alias("held_out")], text=text)
