"""Quality rules: text statistics, fixed base rules and robust multivariate outliers.

Every text gives five counts (see :func:`text_stats`).  A document fails the
base rules if it has fewer than ``MIN_WORDS`` words or if more than half of its
words lie in repeated three-word windows.  The others become a transformed
vector (:data:`VECTOR`), and a regularised minimum-covariance-determinant
estimate of centre and scatter is made per language and source.  A document
whose squared Mahalanobis distance exceeds the chi-square quantile of
``1 - alpha`` is rejected.

Estimates: two deterministic starts (medians with scaled absolute deviations;
means with covariances), distributed concentration steps that keep the H share
of smallest distance until no determinant falls any more (C_STEPS at most), the
start of the smaller determinant, and a last step that keeps what lies within
the 97.5 % chi-square quantile.  The same is done for every language and for
all documents, and an estimate of n documents is shrunk towards the next wider
one with weight SHRINK / (n + SHRINK), that of all towards a wide scatter.  So
every source is judged by an estimate of its own, whatever its size; a small one
leans on its language.

Scale: one narrow pass over the texts writes a statistics table of fixed width;
each concentration step is one partial aggregation of it to (group, distance
bin) cells, at most ``BINS`` a group, so a group that holds a third of all rows
is combined before it is shuffled.  No group is ever gathered.

Defined cases: null text counts as empty (no words, base_failed).  Null lang or
source is a group of its own.  Repeated rows are judged one by one, alike.  An
empty table gives an empty result.  Other columns, whatever their names, are
ignored by :func:`judge` and returned untouched by :func:`keep_good`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import forget, isolate, pick, ship, tidy, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents at which an estimate of its own weighs as much as the wider one.
SHRINK = 30
#: Spread, in smallest spreads, towards which the estimate of all documents is shrunk.
WIDE = 3.0
#: Source of the estimate of a whole language, language of that of all; other keys begin otherwise.
WHOLE = "*"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics, the smallest spread each of them is credited with.
VECTOR = (
    ("mean word length, log", "ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.06),
    ("symbols per 100 characters, log", "ln(1 + 100.0 * n_symbols / greatest(word_chars, 1))", 0.25),
    ("repeated lines, log", "ln(1.0 + n_dup_lines)", 0.5),
    ("repeated words per 100, log", "ln(1 + 100.0 * n_repeat_words / greatest(n_words, 1))", 1.0),
    ("words, log", "ln(greatest(n_words, 1))", 0.5),
)
DIM = len(VECTOR)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
H = 0.75
C_STEPS = 8
#: Fall of a log determinant that asks for another step.
FALL = 1e-2
BINS = 1024
PER_OCTAVE = 32
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= y / n
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def _count(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets - offsets[0]])


def _dup_lines(w: W.Words) -> np.ndarray:
    lo, hi = int(w.offsets[0]), int(w.offsets[-1])
    part = w.data[lo:hi]
    breaks = np.flatnonzero(part == 10) + lo
    start = np.union1d(w.offsets[:-1], breaks + 1)
    start = start[start < hi]
    start = start[w.data[start] != 10]
    stops = np.union1d(w.offsets[1:], breaks)
    end = stops[np.searchsorted(stops, start, side="right")]
    wordy = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[wordy], end[wordy]
    doc = np.searchsorted(w.offsets, start, side="right") - 1
    key = W.span_hashes(part, start, end, lo)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    again = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[1:][again], minlength=w.n_docs)


def _repeat_words(w: W.Words, n: int = 3) -> np.ndarray:
    key, at = W.window_hashes(w.hashes, w.bounds, n)
    doc = w.doc
    key = key + W.mix(doc[at].astype(np.uint64) + np.uint64(7))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(doc) + n, dtype=bool)
    for j in range(n):
        covered[at[twice] + j] = True
    return np.bincount(doc[covered[: len(doc)]], minlength=w.n_docs)


def text_stats(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Counts of each text, in the order of STATS.

    Words are runs outside 0x20 and 0x09-0x0D.  Lines and windows are compared
    by 64-bit hashes within one document only.
    """
    out = [np.zeros((0, len(STATS)), dtype=np.int64)]
    for w in W.scan(texts):
        part = w.data[int(w.offsets[0]) : int(w.offsets[-1])]
        chars = ~W.SPACE[part] & ((part & 0xC0) != 0x80)
        out.append(np.stack([np.diff(w.bounds), _count(chars, w.offsets), _count(_SYMBOL[part], w.offsets), _dup_lines(w), _repeat_words(w)], axis=1))
    return np.concatenate(out)


def with_stats(df: DataFrame, text: str, keep: list[str], prefix: str = "") -> DataFrame:
    """``keep`` of df and the five counts of ``text``, the latter named with ``prefix``."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(prefix + s, T.LongType()) for s in STATS])
    cols = list(dict.fromkeys([*keep, text]))
    at, names = cols.index(text), [f.name for f in schema]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = text_stats(b.column(at))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(s[:, i]) for i in range(len(STATS))], names=names)

    return df.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(tidy(go), schema)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def _vector(prefix: str) -> list[Column]:
    out = []
    for _, sql, _ in VECTOR:
        for s in STATS:
            sql = sql.replace(s, prefix + s)
        out.append(F.expr(sql))
    return out


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIM)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col(f"p{i}{j}") * d[i] * d[j] * (1 if i == j else 2)
    return total


_FLOOR = np.diag([f * f for _, _, f in VECTOR])
_MOMENTS = ", ".join([*[f"m{i} double" for i in range(DIM)], *[f"p{i}{j} double" for i, j in PAIRS]])
_PARAMS = f"gl string, gs string, start long, n double, det double, fall double, {_MOMENTS}"


def _moments(t: pa.Table, chosen: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter (times ``factor``) of the chosen cells."""
    n = float(t["n"].to_numpy()[chosen].sum())
    mean = np.array([t[f"s{i}"].to_numpy()[chosen].sum() for i in range(DIM)]) / n
    cov = np.zeros((DIM, DIM))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = factor * (t[f"q{i}{j}"].to_numpy()[chosen].sum() / n - mean[i] * mean[j])
    return mean, cov


def _row(t: pa.Table, mean: np.ndarray, matrix: np.ndarray, det: float, fall: float) -> pa.Table:
    row = {"gl": t["gl"][0].as_py(), "gs": t["gs"][0].as_py(), "start": t["start"][0].as_py(), "n": float(t["n"].to_numpy().sum()), "det": det, "fall": fall}
    row |= {f"m{i}": mean[i] for i in range(DIM)} | {f"p{i}{j}": matrix[i, j] for i, j in PAIRS}
    return pa.Table.from_pylist([row])


def _solver(last: bool, factor: float) -> Callable[[pa.Table], pa.Table]:
    """A concentration step of a group: the inverse of the scatter, or (last) the scatter itself, without the smallest spread."""

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell")
        cell, n = t["cell"].to_numpy(), t["n"].to_numpy()
        if last:
            chosen = cell == 0 if (cell == 0).any() else np.ones(len(cell), dtype=bool)
        else:
            chosen = np.arange(len(cell)) <= np.searchsorted(np.cumsum(n), math.ceil(H * int(n.sum())))
        mean, cov = _moments(t, chosen, factor)
        det = float(np.linalg.slogdet(cov + _FLOOR)[1])
        return _row(t, mean, cov if last else np.linalg.inv(cov + _FLOOR), det, t["det"][0].as_py() - det)

    return solve


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]]


def _starts(stats: DataFrame) -> DataFrame:
    """Both starts of each group."""
    med = stats.groupBy("gl", "gs").agg(*[F.expr(f"percentile_approx(x{i}, 0.5, 1000)").alias(f"m{i}") for i in range(DIM)])
    mad = stats.join(med, ["gl", "gs"]).groupBy("gl", "gs").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIM)], *[F.expr(f"percentile_approx(abs(x{i} - m{i}), 0.5, 1000)").alias(f"d{i}") for i in range(DIM)]
    )
    none = F.lit(float("inf"))
    robust = mad.select(
        "gl", "gs", F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("n"), none.alias("det"), none.alias("fall"), *[f"m{i}" for i in range(DIM)],
        *[(1 / (F.pow(1.4826 * F.col(f"d{i}"), 2) + VECTOR[i][2] ** 2) if i == j else F.lit(0.0)).cast("double").alias(f"p{i}{j}") for i, j in PAIRS],
    )

    def classical(t: pa.Table) -> pa.Table:
        mean, cov = _moments(t, np.ones(1, dtype=bool), 1.0)
        return _row(t, mean, np.linalg.inv(cov + _FLOOR), math.inf, math.inf)

    plain = stats.groupBy("gl", "gs").agg(*_sums()).withColumn("start", F.lit(1).cast("long")).groupBy("gl", "gs").applyInArrow(classical, _PARAMS)
    return robust.unionByName(plain)


def fit(stats: DataFrame) -> DataFrame:
    """MCD centre and scatter of each group of ``stats`` (gl, gs, x0..x4): gl, gs, n, m*, p*; a written table.

    Distances are binned (PER_OCTAVE bins an octave), so the chosen share ends at a bin's edge.
    """
    params = written(_starts(stats), "mcd")
    limit = chi2_quantile(0.975, DIM)
    raw_factor = H / chi2_cdf(chi2_quantile(H, DIM), DIM + 2)
    end_factor = 0.975 / chi2_cdf(limit, DIM + 2)
    last = False
    for step in range(C_STEPS + 1):
        keys = ["gl", "gs", "start", "det"]
        d = stats.join(params, ["gl", "gs"]).withColumn("d", F.greatest(_distance(), F.lit(0.0)))
        cell = F.least(F.floor(F.log2(F.col("d") + 2.0**-16) * PER_OCTAVE) + 16 * PER_OCTAVE, F.lit(BINS - 1))
        if last:
            cell = F.when(F.col("d") <= limit, 0).otherwise(1)
        cells = d.drop("n").withColumn("cell", cell.cast("int")).groupBy(*keys, "cell").agg(*_sums())
        new = written(cells.groupBy("gl", "gs", "start").applyInArrow(_solver(last, end_factor if last else raw_factor), _PARAMS), "mcd")
        forget(params)
        params = new
        if last:
            return params
        if step == C_STEPS - 1 or not new.where(F.col("fall") > FALL).limit(1).count():
            last = True  # the start of the smaller determinant goes on
            cols = [c for c in params.columns if c not in ("gl", "gs")]
            params = params.groupBy("gl", "gs").agg(F.min(F.struct("det", *[c for c in cols if c != "det"])).alias("b")).select("gl", "gs", *[F.col(f"b.{c}").alias(c) for c in cols])
    return params


def _shrunk(own: np.ndarray, wider: np.ndarray) -> np.ndarray:
    """Rows of (n, centre, scatter): own estimates leaning on the wider ones; the distance of the centres adds to the scatter."""
    w = (own[:, :1] / (own[:, :1] + SHRINK))
    m, mw = own[:, 1 : 1 + DIM], wider[:, 1 : 1 + DIM]
    off = m - mw
    cross = np.stack([off[:, i] * off[:, j] for i, j in PAIRS], axis=1)
    return np.concatenate([own[:, :1], w * m + (1 - w) * mw, w * own[:, 1 + DIM :] + (1 - w) * wider[:, 1 + DIM :] + w * (1 - w) * cross], axis=1)


def shrink(params: DataFrame) -> DataFrame:
    """Estimates of sources, languages and all to those each source is judged by: gl, gs, m*, p* (inverse scatter)."""
    names = ["n", *[f"m{i}" for i in range(DIM)], *[f"p{i}{j}" for i, j in PAIRS]]
    at = lambda tag: [F.col(c).alias(f"{tag}_{c}") for c in names]
    every = params.where(F.col("gl") == WHOLE).select(*names).first()  # one row
    if every is None:
        return params.select("gl", "gs", *names[1:])
    wide = WIDE**2 * np.array([_FLOOR[i, j] for i, j in PAIRS])
    top = np.array([list(every)])
    top = _shrunk(top, np.concatenate([[0.0], top[0, 1 : 1 + DIM], wide])[None])
    own = params.where((F.col("gl") != WHOLE) & (F.col("gs") != WHOLE)).select("gl", "gs", *at("s"))
    both = own.join(params.where((F.col("gl") != WHOLE) & (F.col("gs") == WHOLE)).select("gl", *at("l")), "gl").select("gl", "gs", *[f"{tag}_{c}" for tag in "sl" for c in names])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            v = np.stack([b.column(2 + i).to_numpy() for i in range(2 * len(names))], axis=1)
            lang = _shrunk(v[:, len(names) :], np.repeat(top, len(b), axis=0))
            e = _shrunk(v[:, : len(names)], lang)
            cov = np.zeros((len(b), DIM, DIM))
            for k, (i, j) in enumerate(PAIRS):
                cov[:, i, j] = cov[:, j, i] = e[:, 1 + DIM + k]
            inv = np.linalg.inv(cov + _FLOOR)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(e[:, 1 + i]) for i in range(DIM)], *[pa.array(inv[:, i, j]) for i, j in PAIRS]], names=["gl", "gs", *names[1:]])

    return both.mapInArrow(tidy(go), f"gl string, gs string, {_MOMENTS}")


def _grouped(df: DataFrame, lang: str, source: str, prefix: str) -> DataFrame:
    return df.select("*", _key(F.col(f"`{lang}`")).alias("gl"), _key(F.col(f"`{source}`")).alias("gs"), *[x.alias(f"x{i}") for i, x in enumerate(_vector(prefix))])


def fit_stats(stats: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """Estimates for every (lang, source) of a statistics table: gl, gs, centre, inverse scatter."""
    ok = _grouped(stats.where(~base_failed(prefix)), lang, source, prefix).select("gl", "gs", *[f"x{i}" for i in range(DIM)])
    ways = F.array(F.struct("gl", "gs"), F.struct("gl", F.lit(WHOLE).alias("gs")), F.struct(F.lit(WHOLE).alias("gl"), F.lit(WHOLE).alias("gs")))
    feed = ok.select(F.explode(ways).alias("w"), *[f"x{i}" for i in range(DIM)]).select("w.gl", "w.gs", *[f"x{i}" for i in range(DIM)])
    return written(shrink(fit(feed)), "mcd")


def verdict(df: DataFrame, params: DataFrame, cutoff: float, lang: str, source: str, prefix: str) -> DataFrame:
    """Adds base_failed, distance2 (null where base rules fail) and kept, each named with prefix."""
    names = df.columns
    g = _grouped(df, lang, source, prefix).join(params, ["gl", "gs"], "left")
    d = F.when(~base_failed(prefix), F.greatest(_distance(), F.lit(0.0)))
    return g.withColumn("_d", d).select(
        *[F.col(f"`{c}`") for c in names],
        base_failed(prefix).alias(f"{prefix}base_failed"),
        F.col("_d").alias(f"{prefix}distance2"),
        (~base_failed(prefix) & (F.col("_d").isNull() | (F.col("_d") <= cutoff))).alias(f"{prefix}kept"),
    )


#: Chance of a clean document of a normal population being rejected.
ALPHA = 1e-9


def judge(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", alpha: float = ALPHA) -> DataFrame:
    """Per row: id, the five counts, base_failed, distance2, kept."""
    docs = pick(docs, id_col, text, lang, source).toDF("u0", "u1", "u2", "u3")
    stats = written(with_stats(docs, "u1", ["u0", "u2", "u3"], "q_"), "stats")
    lang, source = "u2", "u3"
    out = verdict(stats, fit_stats(stats, lang, source, "q_"), chi2_quantile(1 - alpha, DIM), lang, source, "q_")
    return out.select(F.col("u0").alias(id_col), *[F.col(f"q_{s}").alias(s) for s in STATS], F.col("q_base_failed").alias("base_failed"), F.col("q_distance2").alias("distance2"), F.col("q_kept").alias("kept"))


def keep_good(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", alpha: float = ALPHA) -> DataFrame:
    """Rows of docs that are kept, with all their columns.

    The estimates come from a statistics table without texts; the second pass
    counts again instead of shuffling the texts to join them with verdicts.
    """
    docs, (text, lang, source), back = isolate(docs, text, lang, source)
    names = docs.columns
    stats = written(with_stats(docs, text, [lang, source], "q_"), "stats")
    params = fit_stats(stats, lang, source, "q_")
    forget(stats)
    again = with_stats(docs, text, names, "q_")
    return back(verdict(again, params, chi2_quantile(1 - alpha, DIM), lang, source, "q_").where("q_kept").select(*names))
