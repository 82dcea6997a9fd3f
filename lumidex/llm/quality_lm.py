"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, thresholds by language.

The model counts n-grams of ORDER symbols of trusted rows, a model a language.
White space runs are one blank, digits are one class, characters below 2048 are
symbols of their own, and others are spelled by their UTF-8 bytes, which are
symbols too: no two characters are ever taken for one another.  A symbol has 12
bits, so an n-gram is one integer and contexts and suffixes are shifts and masks
of it.  Count tables are joined by (language, context) and (language, suffix) to
probabilities and back-off weights, order by order; these go to a sharded table
that workers map.  A document's perplexity is that of its symbols and its end;
its worst perplexity is that of its worst run of WINDOW of them.  It is kept if
neither exceeds its language's threshold, the ``quantile`` of trusted rows' values.

A model likes what it learnt from, so no row is judged by what it taught.  Rows
go to FOLDS folds by their text (copies stay together), and there is a model for
each fold, trained on the trusted rows of the others.  Every row, trusted or not,
is judged once, by the model of its fold, and the trusted rows' values, all of
models that had not seen them, give the thresholds: what is compared comes from
models of equal size.

Thresholds are shrunk: a language's own quantile weighs n / (n + SHRINK), n being
its judged trusted rows; the rest is its median times the quantile, over all
languages, of the ratio of value and median.  So rare languages have thresholds
too, and nothing changes at a fixed number of rows.

Scale: tasks sum counts of whole batches before they shuffle them, so what
travels is distinct n-grams, not occurrences; the tables are sharded by key
throughout and no part of the model is broadcast.  Trusted ids are a sharded
table as well: texts find out where they lie whether they are trusted, so no
text is shuffled, whatever the number of labels.

Defined cases: text null or without characters: perplexity null, not kept.  A
language (null is one) that taught its fold's model nothing is judged by the
fold's other models, by the one that likes the text best, and held to that
one's threshold; the same goes for trusted rows, which then set no threshold.
Where a fold has no model at all, those of other folds serve.  A language whose
trusted rows set no threshold takes the quantile of all languages' rows.  Without
any trusted row that a model can judge there is no threshold, and all texts with
a character are kept.  Repeated rows count as often as they occur.  A row with
several labels is trusted if all of them say so.  Empty tables are fine.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import forget, pick, ship, tidy, written
from ._tables import Sharded, write_sharded

ORDER = 5
BITS = 12
VOCABULARY = 1 << BITS
#: Characters from here on are spelled: a symbol for each byte.
SPELLED = 2048
PAD, END = 0, 3
GATHER = 1 << 21
QUANTILE = 0.99
FOLDS = 4
#: Trusted rows of a language at which its own quantile weighs as much as that of all languages.
SHRINK = 20
#: Characters of a run that is judged by itself: a word or two in bad prose.
WINDOW = 16


def _mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


def _pieces(column: pa.Array, block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ORDER-grams of some rows on end, bounds): one gram a character and one a row's end."""
    data, off = W.string_buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block, side="right")) - 1)
        raw = data[off[i] : off[j]].tobytes()
        cuts = off[i : j + 1] - off[i]
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            parts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts[:-1], cuts[1:])]
            raw, cuts = b"".join(parts), np.cumsum([0, *map(len, parts)])
            text = raw.decode()
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        bytes_ = np.frombuffer(raw, np.uint8)
        lead = (bytes_ & 0xC0) != 0x80
        begins = np.zeros(len(raw) + 1, dtype=np.int64)
        if len(points) and int(points.max()) >= SPELLED:  # a symbol a byte for these
            far = np.repeat(points >= SPELLED, np.diff(np.append(np.flatnonzero(lead), len(bytes_))))
            lead = lead | far
            own = np.empty(len(bytes_), dtype=np.uint32)
            own[lead & ~far] = points[points < SPELLED]
            own[far] = SPELLED + bytes_[far].astype(np.uint32)
            points = own[lead]
        np.cumsum(lead, out=begins[1:])
        char = begins[cuts]
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        before = np.append(True, blank[:-1])
        before[char[:-1][char[:-1] < len(points)]] = True  # leading white space goes
        keep = ~(blank & before)
        sym = np.where(blank, 32, np.where((points >= 48) & (points <= 57), 48, points)).astype(np.uint64)[keep]
        total = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(keep, out=total[1:])
        start = total[char]
        rows = np.arange(j - i)
        size = np.diff(start)
        out = np.zeros(len(sym) + ORDER * len(rows), dtype=np.uint64)
        out[np.arange(len(sym)) + np.repeat(ORDER * rows + ORDER - 1, size)] = sym
        ends = start[1:] + ORDER * (rows + 1) - 1
        out[ends] = END
        event = np.ones(len(out), dtype=bool)
        pads = (start[:-1] + ORDER * rows)[:, None] + np.arange(ORDER - 1)
        event[pads.ravel()] = False
        gram = np.zeros(len(out) - ORDER + 1, dtype=np.uint64)
        for k in range(ORDER):
            gram = (gram << np.uint64(BITS)) | out[k : k + len(gram)]
        yield i, gram[event[ORDER - 1 :]], np.cumsum(np.append(0, size + 1))
        i = j


def _lang(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def _id_keys(ids: DataFrame, name: str) -> tuple[str, int, int]:
    """A sharded table of ids (a column of longs, distinct), under one-to-one mixed keys."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = W.mix(b.column(0).to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(len(b)))], names=["key", "v"])

    return write_sharded(ids.mapInArrow(tidy(go), "key long, v double"), "key", ["v"], name)


def _among(table: Sharded, ids: pa.Array) -> np.ndarray:
    valid = np.asarray(ids.is_valid())
    key = W.mix(np.asarray(ids.fill_null(0)).view(np.uint64))
    order = np.argsort(key)
    out = np.zeros(len(key), dtype=bool)
    out[order] = table.lookup(key[order])[0]
    return out & valid


def _count(rows: DataFrame, trusted: tuple[str, int, int]) -> DataFrame:
    """rows: id, lang, text, with the fold as first character of lang.  (lang, g, c): counts of ORDER-grams in the rows whose id the table ``trusted`` holds."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        table = Sharded(trusted)

        def send() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                uniq, inv = np.unique(keys, return_inverse=True)
                c = np.bincount(inv, weights=counts).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(uniq), pa.string()), pa.array(uniq.view(np.int64)), pa.array(c)], names=["lang", "g", "c"])
            held.clear()

        for b in batches:
            pick = pa.array(np.flatnonzero(_among(table, b.column(0))))
            langs = b.column(1).take(pick).to_pylist()
            for first, gram, bounds in _pieces(b.column(2).take(pick)):
                own = np.array(langs[first : first + len(bounds) - 1], dtype=object)
                for lang in set(own.tolist()):
                    pair = np.unique(gram[np.repeat(own == lang, np.diff(bounds))], return_counts=True)
                    held.setdefault(lang, []).append(pair)
                    size += len(pair[0])
                if size >= GATHER:
                    yield from send()
                    size = 0
        yield from send()

    return rows.mapInArrow(tidy(go), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; defaults where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


def _tables(counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n, kind, g, v): log probabilities (kind 0) and log back-off weights (kind 1) of all orders."""
    level, out, made = counts, None, []
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        level = written(level.groupBy("lang", F.col("g").bitwiseAND(_mask(n)).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"order{n}")
        levels[n] = level
        made.append(level)
    prob = None
    for n in range(1, ORDER + 1):
        t = levels[n]
        stat = t.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()  # a row a language
        d = {r["lang"]: discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for r in stat}
        drow = t.sparkSession.createDataFrame([(k, *v) for k, v in d.items()], "lang string, d1 double, d2 double, d3 double")
        of = [F.col("c") == 1, F.col("c") == 2, F.col("c") >= 3]
        context = t.withColumn("h", F.shiftright("g", BITS)).groupBy("lang", "h").agg(F.sum("c").alias("total"), *[F.sum(x.cast("long")).alias(f"k{i}") for i, x in enumerate(of)])
        context = context.join(F.broadcast(drow), "lang").withColumn("gamma", (F.col("d1") * F.col("k0") + F.col("d2") * F.col("k1") + F.col("d3") * F.col("k2")) / F.col("total"))
        context = written(context.select("lang", "h", "total", "gamma", "d1", "d2", "d3"), f"context{n}")
        cut = F.when(of[0], F.col("d1")).when(of[1], F.col("d2")).otherwise(F.col("d3"))
        p = t.withColumn("h", F.shiftright("g", BITS)).join(context, ["lang", "h"]).withColumn("own", (F.col("c") - cut) / F.col("total"))
        if n == 1:
            p = p.withColumn("p", F.col("own") + F.col("gamma") / VOCABULARY)
        else:
            low = prob.select("lang", F.col("g").alias("s"), F.col("p").alias("q"))
            p = p.withColumn("s", F.col("g").bitwiseAND(_mask(n - 1))).join(low, ["lang", "s"]).withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        prob = written(p.select("lang", "g", "p"), f"p{n}")
        made += [context, prob]
        rows = prob.select("lang", F.lit(n).alias("n"), F.lit(0).alias("kind"), "g", F.log("p").alias("v")).unionByName(
            context.select("lang", F.lit(n - 1).alias("n"), F.lit(1).alias("kind"), F.col("h").alias("g"), F.log("gamma").alias("v"))
        )
        out = rows if out is None else out.unionByName(rows)
    return out, made


def _key(g: np.ndarray, lang: int, n: int, kind: int) -> np.ndarray:
    return W.mix(g * W.U(0x9FB21C651E98DF25) + W.mix(np.array([lang * 16 + n * 2 + kind + 1], dtype=np.uint64)))


class Model:
    """Keys of the models (the fold that was left out, and the language), the handle of their table and that of the trusted ids."""

    def __init__(self, langs: list[str], table: tuple | None, trusted: tuple) -> None:
        self.langs, self.table, self.trusted = langs, table, trusted


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("string")


def _leave_out(counts: DataFrame) -> DataFrame:
    """Counts by fold and language to those of all folds but one, named by that one."""
    fold = F.substring("lang", 1, 1)
    models = F.filter(F.array(*[F.lit(str(k)) for k in range(FOLDS)]), lambda m: m != fold)
    rows = counts.select(F.explode(models).alias("m"), F.substring("lang", 2, 1 << 30).alias("lang"), "g", "c")
    return rows.groupBy(F.concat("m", "lang").alias("lang"), "g").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, ids: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from the rows of docs whose id is in ``ids`` (one column of longs, distinct)."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.concat(_fold(F.col(f"`{text}`")), _lang(F.col(f"`{lang}`"))).alias("lang"), F.col(f"`{text}`").alias("text"))
    trusted = _id_keys(ids, "trusted")
    folds = written(_count(rows, trusted), "folds")
    counts = written(_leave_out(folds), "grams")
    forget(folds)
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # a row a language
    if not langs:
        return Model([], None, trusted)
    rows, made = _tables(counts)
    where = {x: i for i, x in enumerate(langs)}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([where[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            tag = lang * 16 + b.column(1).to_numpy() * 2 + b.column(2).to_numpy() + 1
            key = W.mix(b.column(3).to_numpy().view(np.uint64) * W.U(0x9FB21C651E98DF25) + W.mix(tag.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(4)], names=["key", "v"])

    table = write_sharded(rows.mapInArrow(tidy(go), "key long, v double"), "key", ["v"], "model-kn")
    for t in [counts, *made]:
        forget(t)
    return Model(langs, table, trusted)


def log_probabilities(grams: np.ndarray, lang: int, table: Sharded) -> np.ndarray:
    """Natural log of each ORDER-gram's last character given the others."""

    def find(g: np.ndarray, n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        key = _key(g, lang, n, kind)
        order = np.argsort(key)
        found, value = np.zeros(len(g), dtype=bool), np.zeros(len(g))
        f, v = table.lookup(key[order])
        found[order], value[order] = f, v[:, 0]
        return found, value

    out = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    for n in range(ORDER, 0, -1):
        g = grams[open_] & np.uint64(_mask(n))
        found, value = find(g, n, 0)
        out[open_[found]] += value[found]
        open_, g = open_[~found], g[~found]
        if not len(open_):
            return out
        out[open_] += find(g >> np.uint64(BITS), n - 1, 1)[1]  # an unknown context weighs 1
    out[open_] -= np.log(VOCABULARY)
    return out


def _worst(surprise: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Greatest mean of WINDOW values on end in each row; the mean of a shorter row.  Rows are not empty."""
    total = np.append(0, np.cumsum(surprise))
    size = np.diff(bounds)
    mean = np.full(len(surprise), -np.inf)
    if len(surprise) >= WINDOW:
        mean[: len(surprise) - WINDOW + 1] = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
    mean[np.arange(len(surprise)) + WINDOW > np.repeat(bounds[1:], size)] = -np.inf
    return np.where(size < WINDOW, (total[bounds[1:]] - total[bounds[:-1]]) / size, np.maximum.reduceat(mean, bounds[:-1]))


def _best(gram: np.ndarray, size: np.ndarray, rows: np.ndarray, models: list[int], table: Sharded) -> np.ndarray:
    """For each of the rows, the model that gives it the greatest probability."""
    here = np.isin(np.repeat(np.arange(len(size)), size), rows)
    uniq, inv = np.unique(gram[here], return_inverse=True)
    of = np.repeat(np.arange(len(rows)), size[rows])
    total = np.stack([np.bincount(of, weights=log_probabilities(uniq, m, table)[inv], minlength=len(rows)) for m in models])
    return np.array(models)[np.argmax(total, axis=0)]


def score(docs: DataFrame, model: Model, keep: list[Column], *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep``, by (language of the model that judges the row), events (symbols and end), logp, worst (mean of a run's
    negative logarithms), left_out (a trusted row that its own language's model, without it, judges).  by, logp and worst
    are null without a model or characters."""
    rows = docs.select(*keep, _lang(F.col(f"`{lang}`")).alias("_lang"), F.col(f"`{id_col}`").cast("long").alias("_id"), _fold(F.col(f"`{text}`")).alias("_fold"), F.col(f"`{text}`").alias("_text"))
    k = len(rows.columns) - 4
    where = {x: i for i, x in enumerate(model.langs)}
    spare = {str(f): [i for x, i in where.items() if x[0] == str(f)] or list(where.values()) for f in range(FOLDS)}
    handle, trusted = model.table, model.trusted
    names = rows.columns[:k] + ["by", "events", "logp", "worst", "left_out"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = Sharded(handle) if handle else None, Sharded(trusted)
        tags = np.array([x[1:] for x in where] + [None], dtype=object)
        for b in batches:
            langs, folds = b.column(k).to_pylist(), b.column(k + 2).to_pylist()
            among = _among(ids, b.column(k + 1))
            own = np.array([where.get((f or "") + x, -1) for x, f in zip(langs, folds)], dtype=np.int64)
            home = own >= 0
            events, value = np.zeros(len(b), dtype=np.int64), np.full((2, len(b)), np.nan)
            for first, gram, bounds in _pieces(b.column(k + 3)):
                size = np.diff(bounds)
                at = slice(first, first + len(size))
                events[at] = size - 1
                judge = own[at]
                judge[size < 2] = -1
                for f in {folds[first + d] for d in np.flatnonzero((judge < 0) & (size > 1)).tolist()}:
                    lost = np.array([d for d in np.flatnonzero((judge < 0) & (size > 1)).tolist() if folds[first + d] == f])
                    if spare[f]:
                        judge[lost] = _best(gram, size, lost, spare[f], table)
                surprise = np.zeros(len(gram))
                for m in set(judge.tolist()) - {-1}:
                    here = np.flatnonzero(np.repeat(judge == m, size))
                    uniq, inv = np.unique(gram[here], return_inverse=True)
                    surprise[here] = -log_probabilities(uniq, m, table)[inv]
                mine = np.flatnonzero(judge >= 0)
                total = -np.bincount(np.repeat(np.arange(len(size)), size), weights=surprise, minlength=len(size))
                value[0, first + mine] = total[mine]
                value[1, first + mine] = _worst(surprise, bounds)[mine]
            by = pa.array(tags[own].tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:k], by, pa.array(events), *[pa.array(v, from_pandas=True) for v in value], pa.array(among & home & (events > 0))], names=names)

    double = [T.StructField(x, T.DoubleType()) for x in ("logp", "worst")]
    schema = T.StructType([*rows.schema.fields[:k], T.StructField("by", T.StringType()), T.StructField("events", T.LongType()), *double, T.StructField("left_out", T.BooleanType())])
    return rows.mapInArrow(tidy(go), schema)


def thresholds(scored: DataFrame, quantile: float) -> tuple[DataFrame, tuple[float | None, float | None]]:
    """scored: by, left_out and logarithms of perplexity and worst perplexity (ppl, worst).

    Per language with trusted rows: by, threshold, worst_threshold (logarithms); and those of all others.
    """
    rows = scored.where("left_out").select("by", "ppl", "worst")
    two = {x: F.percentile_approx(x, [0.5, quantile], 10000).alias(x) for x in ("ppl", "worst")}
    own = written(rows.groupBy("by").agg(F.count(F.lit(1)).alias("n"), *two.values()), "limits")
    rows = rows.join(own.select("by", *[F.col(x)[0].alias(f"m_{x}") for x in two]), "by")
    off = [F.percentile_approx(F.col(x) - F.col(f"m_{x}"), quantile, 10000).alias(f"d_{x}") for x in two]
    r = rows.agg(*off, *[F.percentile_approx(x, quantile, 10000).alias(x) for x in two]).first()
    weight = F.col("n") / (F.col("n") + SHRINK)
    limit = [weight * F.col(x)[1] + (1 - weight) * (F.col(x)[0] + F.lit(r[f"d_{x}"]).cast("double")) for x in two]
    return written(own.select("by", limit[0].alias("threshold"), limit[1].alias("worst_threshold")), "limits"), (r["ppl"], r["worst"])


def classify(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Per row: id, n_chars_scored (symbols), perplexity, threshold, worst_perplexity, worst_threshold, kept.

    ``trusted``: one column, ids of trusted rows, distinct.
    """
    ship(docs.sparkSession)
    docs, ids = pick(docs, id_col, text, lang), trusted.toDF("id")
    model = train(docs, ids, id_col=id_col, text=text, lang=lang)
    scored = score(docs, model, [F.col(f"`{id_col}`").cast("long").alias("id")], id_col=id_col, text=text, lang=lang)
    scored = written(scored.select("id", "by", "events", (-F.col("logp") / (F.col("events") + 1)).alias("ppl"), "worst", "left_out"), "scores")
    limit, rest = thresholds(scored, quantile)
    judged = F.col("ppl").isNotNull()
    of = {x: F.exp(F.when(judged, F.coalesce(x, F.lit(r).cast("double")))).alias(x) for x, r in zip(("threshold", "worst_threshold"), rest)}
    out = scored.join(limit, "by", "left").select("id", "events", F.exp("ppl").alias("perplexity"), of["threshold"], F.exp("worst").alias("worst_perplexity"), of["worst_threshold"])
    good = (F.col("perplexity") <= F.col("threshold")) & (F.col("worst_perplexity") <= F.col("worst_threshold"))
    kept = (F.col("events") > 0) & F.coalesce(good, F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("events").alias("n_chars_scored"), "perplexity", "threshold", "worst_perplexity", "worst_threshold", kept.alias("kept"))


def trusted_ids(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Ids that all labels call good and not toxic."""
    labels = pick(labels, id_col, "quality", "toxic")
    ok = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(F.min(F.coalesce(ok, F.lit(False))).alias("ok")).where("ok").select("id")
