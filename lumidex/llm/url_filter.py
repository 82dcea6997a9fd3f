"""URL filters: fixed rules, then a list of blocked hosts and pages in a sorted digest array.

Host and path of a url are taken apart by expressions.  A rule (host, path
prefix) fits its host and all subdomains if the url's path starts with the
rule's; the longest fitting rule decides.  Every other url is looked up in a
blocklist: the host, each of its parent domains, and host + path.

The blocklist is an array of 64-bit xxhash keys in ascending order beside the
full strings they stand for, in shards by the keys' leading bits.  Workers map
it, probe a whole batch by vectorised binary search, and take a hit only if the
stored string equals the probed one, so colliding keys do no harm.

Scale: one narrow pass over two columns, no shuffle; mapped pages of the list are
shared by all workers of a machine.  Hosts are looked up once a batch.  The list
is a table of any size: shards are sorted and written by tasks (:func:`build_table`).

Defined cases: a null url, or one without ``://``, has empty host and path; no
rule fits it and it is allowed.  Repeated rows are judged alike.  Empty tables and
an empty blocklist are fine.  Other columns are ignored.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import estimated_bytes, fresh, local_path, pick, ship, tidy

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Domains that the query blocks; each stands for its subdomains too.
BLOCKLIST = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

#: Bytes of entries that a shard holds, about.
SHARD = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(h: Column, p: Column, rule: tuple[str, str, str]) -> Column:
    return ((h == rule[0]) | h.endswith("." + rule[0])) & p.startswith(rule[1])


def _write(stem: str, keys: np.ndarray, strings: list[bytes]) -> None:
    tag = uuid.uuid4().hex
    files = ((".keys", keys.tobytes()), (".off", np.cumsum([0, *map(len, strings)], dtype=np.int64).tobytes()), (".str", b"".join(strings)))
    for name, data in files:
        with open(f"{stem}{name}.{tag}", "wb") as f:
            f.write(data)
    for name, _ in files:
        os.replace(f"{stem}{name}.{tag}", f"{stem}{name}")


def build(entries: Iterable[str], stem: str) -> str:
    """Writes the digest array of a list in memory as one shard: ``stem``.keys, .off, .str; files appear by rename."""
    strings = sorted(set(entries))
    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    _write(stem, keys[order], [strings[i].encode() for i in order])
    return stem


def build_table(entries: DataFrame, folder: str, shards: int | None = None) -> str:
    """Writes the digest array of a table (one column of strings; nulls and repeats go) in shards, a task each; returns the folder."""
    spark = entries.sparkSession
    ship(spark)
    os.makedirs(folder)
    n = shards or max(1, math.ceil(estimated_bytes(entries) / SHARD))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([xxhash.xxh64_intdigest(s) for s in b.column(0).to_pylist()], dtype=np.uint64)
            shard = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys.view(np.int64)), b.column(0)], names=["p", "k", "s"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if len(b)], schema=pa.schema([("p", pa.int32()), ("k", pa.int64()), ("s", pa.string())]))
        p, k = rows["p"].to_numpy(), rows["k"].to_numpy().view(np.uint64)
        for shard in np.unique(p).tolist():
            here = np.flatnonzero(p == shard)
            _write(f"{folder}/{shard:05d}", k[here], [x.encode() for x in rows["s"].take(pa.array(here)).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([len(p)], pa.int64())], names=["n"])

    column = F.col(f"`{entries.columns[0]}`").cast("string").alias("s")
    rows = entries.select(column).where("s is not null").distinct().mapInArrow(tidy(keyed), "p int, k long, s string")
    rows.repartition(n, "p").sortWithinPartitions("p", F.col("k") < 0, "k", "s").mapInArrow(tidy(go), "n long").agg(F.sum("n")).collect()
    with open(f"{folder}/shards.new", "w") as f:
        f.write(str(n))
    os.replace(f"{folder}/shards.new", f"{folder}/shards")
    return folder


class DigestArray:
    """A mapped shard of a blocklist; one that was never written holds nothing."""

    def __init__(self, stem: str, key_of=xxhash.xxh64_intdigest) -> None:
        def load(name: str, kind: type) -> np.ndarray:
            there = os.path.exists(f"{stem}{name}") and os.path.getsize(f"{stem}{name}")
            return np.memmap(f"{stem}{name}", dtype=kind, mode="r") if there else np.zeros(0, kind)

        self.keys, self.off, self.raw, self.key_of = load(".keys", np.uint64), load(".off", np.int64), load(".str", np.uint8), key_of

    def contains(self, strings: list[str], keys: np.ndarray | None = None) -> np.ndarray:
        found = np.zeros(len(strings), dtype=bool)
        if not len(self.keys) or not strings:
            return found
        if keys is None:
            keys = np.fromiter(map(self.key_of, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            want, j = strings[i].encode(), int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.raw[self.off[j] : self.off[j + 1]].tobytes() == want:
                    found[i] = True
                    break
                j += 1
        return found


class Blocklist:
    """The shards of :func:`build_table`, mapped as they are needed; or the single one of :func:`build`."""

    def __init__(self, where: str) -> None:
        self.where, self.open = where, {}
        self.n = 0
        if os.path.isdir(where):
            with open(f"{where}/shards") as f:
                self.n = int(f.read())

    def contains(self, strings: list[str]) -> np.ndarray:
        keys = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        shard = ((keys >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)
        found = np.zeros(len(strings), dtype=bool)
        for p in np.unique(shard).tolist():
            if p not in self.open:
                self.open[p] = DigestArray(f"{self.where}/{p:05d}" if self.n else self.where)
            here = np.flatnonzero(shard == p)
            found[here] = self.open[p].contains([strings[i] for i in here.tolist()], keys[here])
        return found


def domains(h: str) -> list[str]:
    """The host and its parent domains."""
    parts = h.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if h else []


def judge(pages: DataFrame, *, blocklist: DataFrame | Iterable[str] | str = BLOCKLIST, id_col: str = "page_id", url: str = "url", rules: tuple = RULES) -> DataFrame:
    """Per row: id, host, path, rule (null where none fits), verdict.

    ``blocklist``: a table of entries, entries, or what :func:`build_table` or
    :func:`build` wrote to a folder that all executors have mounted.
    """
    spark = pages.sparkSession
    ship(spark)
    if isinstance(blocklist, str):
        stem = blocklist
    else:
        if not isinstance(blocklist, DataFrame):
            blocklist = spark.createDataFrame([(x,) for x in blocklist], "entry string")
        stem = build_table(blocklist, local_path(fresh(spark, "blocklist")))
    h, p = F.col("host"), F.col("path")
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        rule, said = F.when(_fits(h, p, r), r[0] + r[1]).otherwise(rule), F.when(_fits(h, p, r), r[2]).otherwise(said)
    cut = pick(pages, id_col, url).select(F.col(f"`{id_col}`"), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    cut = cut.select("*", rule.alias("rule"), said.alias("verdict"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = Blocklist(stem)
        for b in batches:
            hosts = b.column(1).dictionary_encode()
            names = hosts.dictionary.to_pylist()
            probes = [(i, d) for i, x in enumerate(names) for d in domains(x)]
            hit = array.contains([d for _, d in probes])
            bad = np.zeros(len(names), dtype=bool)
            bad[[i for (i, _), x in zip(probes, hit) if x]] = True
            blocked = bad[hosts.indices.to_numpy()]
            free = np.flatnonzero(~blocked)
            paths = b.column(2).take(pa.array(free)).to_pylist()
            where = hosts.indices.to_numpy()[free].tolist()
            blocked[free] = array.contains([names[i] + x for i, x in zip(where, paths)])
            verdict = [v or ("block" if x else "allow") for v, x in zip(b.column(4).to_pylist(), blocked.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdict, pa.string())], names=b.schema.names)

    return cut.mapInArrow(tidy(go), cut.schema)


ORACLE = f"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
  FROM pages),
r(name, dom, prefix, verdict) AS (VALUES {", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in RULES)}),
best AS (
  SELECT page_id, host, path, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict
  FROM u JOIN r ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, prefix) GROUP BY ALL),
bad(name) AS (VALUES {", ".join(f"('{x}')" for x in BLOCKLIST)}),
hit AS (SELECT DISTINCT host, path FROM u JOIN bad ON host = name OR ends_with(host, '.' || name) OR host || path = name)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, CASE WHEN hit.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN best ON u.page_id = best.page_id AND u.host = best.host AND u.path = best.path
LEFT JOIN hit ON u.host = hit.host AND u.path = hit.path
"""
