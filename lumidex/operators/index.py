"""The index: postings, lexicon and field statistics, in memory or as Parquet segments.

A segment is an immutable set of tables; appending writes another one, compaction
rewrites all into one.  Documents are numbered from 0 within a segment; the
catalog says where a segment begins, so numbers of later segments follow those
of earlier ones.  The catalog is a series of numbered files, the newest of which
counts: a change is one rename to the next number, which fails if another writer
took it, and is then tried again on top of that.  So writers may run side by
side, and one that dies leaves the index as it was.  Postings carry the field's length in the document, so scoring
needs no join for it.  Postings and lexicon are partitioned by field and sorted
by term: a field is a folder, a term a run of rows in each of its files.  A file
of postings holds all of some documents, so they are never shuffled by term.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import FieldSpec, by_document, postings, single
from .tables import numbered

TABLES = ("documents", "postings", "lexicon", "field_stats")
KEYS = ("field", "term", "num_i", "num_f")


def lexicon(posts: DataFrame) -> DataFrame:
    """field, term | num_i | num_f, df: in how many documents each value occurs."""
    return posts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("df"))


def field_stats(posts: DataFrame) -> DataFrame:
    """field, n_docs (having the field), total_len, avgdl.

    A posting of length 1 is all that its document has in the field, so only longer ones are grouped by document.
    """
    several = F.col("dl") > 1
    per_doc = posts.groupBy("field", F.when(several, F.col("doc_idx")).alias("doc")).agg(F.count(F.lit(1)).alias("n"), F.max("dl").alias("dl"))
    alone = F.col("doc").isNull()
    sums = per_doc.groupBy("field").agg(F.sum(F.when(alone, F.col("n")).otherwise(1)).alias("n_docs"), F.sum(F.when(alone, F.col("n")).otherwise(F.col("dl"))).alias("total_len"))
    return sums.withColumn("avgdl", F.col("total_len") / F.col("n_docs"))


class Index:
    """Tables of an index.  ``lexicon`` and ``stats`` are derived from the postings where they are not given."""

    def __init__(self, documents: DataFrame, posts: DataFrame, specs: Sequence[FieldSpec], lex: DataFrame | None = None, stats: DataFrame | None = None, path: str | None = None) -> None:
        self.documents, self.postings, self.specs, self.path = documents, posts, list(specs), path
        self.lexicon = lex if lex is not None else lexicon(posts)
        self.stats = stats if stats is not None else field_stats(posts)

        self.expansions: dict[tuple, list] = {}  # of fuzzy terms, see matching

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def close(self) -> None:
        """Frees what is cached of its tables; the files stay."""
        for df in (self.documents, self.postings, self.lexicon, self.stats):
            df.unpersist()
        self.expansions.clear()

    def spec(self, name: str) -> FieldSpec | None:
        return next((s for s in self.specs if s.name == name), None)

    @classmethod
    def of(cls, df: DataFrame, id_col: str, specs: Sequence[FieldSpec], doc_idx: Column | None = None) -> Index:
        """An index over df in memory, planned lazily.  ``doc_idx`` orders ties; without it the rows are numbered as they come."""
        rows = df.withColumn("doc_idx", (doc_idx if doc_idx is not None else F.monotonically_increasing_id()).cast("bigint"))
        return cls(rows.select("doc_idx", F.col(f"`{id_col}`").alias("doc_id")), postings(rows, specs), specs)

    def restrict(self, fields: Sequence[str]) -> Index:
        """The same index with some of its fields only; on disk that reads their folders alone."""
        keep = lambda df: df.where(F.col("field").isin(*fields))
        return Index(self.documents, keep(self.postings), [s for s in self.specs if s.name in fields], keep(self.lexicon), keep(self.stats), self.path)

    def point(self, term: str, field: str | None = None) -> DataFrame:
        """Lexicon entries of one term."""
        at = F.col("term") == term
        return self.lexicon.where(at if field is None else at & (F.col("field") == field))

    def seek(self, field: str, low: str, n: int = 1) -> DataFrame:
        """The first n terms of a field from ``low`` on."""
        return self.lexicon.where((F.col("field") == field) & (F.col("term") >= low)).orderBy("term").limit(n)

    def scan(self, field: str, low: object = None, high: object = None) -> DataFrame:
        """Lexicon entries of a field between two bounds, both inclusive, either open."""
        v = F.coalesce(F.col("num_f"), F.col("num_i")) if self.spec(field) and self.spec(field).rules.kind not in ("text", "keyword") else F.col("term")
        keep = F.col("field") == field
        if low is not None:
            keep &= v >= low
        if high is not None:
            keep &= v <= high
        return self.lexicon.where(keep)


class ConcurrentChange(RuntimeError):
    """Another writer took the number of a new catalog first."""


class Store:
    """An index in a folder: numbered catalogs and one folder of tables per segment."""

    #: Catalogs that stay, newest first, and tries of a change among other writers.
    KEEP, TRIES = 8, 50

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # the catalog goes through Spark's file system, so any shared storage will do
    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return sorted(int(n[8:16]) for n in names if n.startswith("catalog-") and n.endswith(".json"))

    def catalog(self) -> dict:
        """fields, segments (name, where its numbers begin, documents), docs, version and, of a stream, its last batch."""
        have = self._versions()
        if not have:
            return {"version": 0, "fields": [], "segments": [], "docs": 0}
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/catalog-{have[-1]:08d}.json").first()[1])

    def _save(self, catalog: dict) -> None:
        """Makes this the newest catalog, if it is based on the newest."""
        fs, path = self._fs()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        version = catalog["version"] + 1
        new, final = path(f"{self.path}/.catalog-{uuid.uuid4().hex}"), path(f"{self.path}/catalog-{version:08d}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(catalog | {"version": version}).encode()))
        out.close()
        try:  # unlike FileSystem.rename this never replaces a file
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(
                fs.makeQualified(new), fs.makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            )
        except Exception as e:
            fs.delete(new, False)
            if not fs.exists(final):
                raise
            raise ConcurrentChange(f"{self.path}: version {version} is there already") from e
        for old in self._versions()[: -self.KEEP]:
            fs.delete(path(f"{self.path}/catalog-{old:08d}.json"), False)

    def _change(self, edit: Callable[[dict], dict | None]) -> dict | None:
        """Applies ``edit`` to the newest catalog until no other writer comes between; None leaves it as it is."""
        for _ in range(self.TRIES):
            new = edit(self.catalog())
            if new is None:
                return None
            try:
                self._save(new)
                return new
            except ConcurrentChange:
                continue
        raise ConcurrentChange(f"{self.path}: no luck in {self.TRIES} tries")

    def append(self, df: DataFrame, id_col: str, specs: Iterable[FieldSpec] | None = None, order: list[str] | None = None, on_duplicate: str = "keep", batch: int | None = None) -> str | None:
        """Writes df as a new segment.  Fields are fixed by the first segment; ``order`` (columns) numbers the documents, else they come as they are.

        ``on_duplicate``: ``keep`` trusts ids to be disjoint, ``raise`` checks
        them.  ``batch``: number of a stream's batch, which is recorded with the
        segment; nothing happens (None) if that or a later one is in already.
        """
        c = self.catalog()
        given = [s.as_dict() for s in specs or ()]
        if batch is not None and batch <= c.get("stream", -1):
            return None
        if c["fields"] and given and c["fields"] != given:
            raise ValueError("fields differ from the index's")
        kinds = c["fields"] or given
        fields = [FieldSpec(**f) for f in kinds]
        if not fields:
            raise ValueError("no fields")
        if on_duplicate == "raise" and c["segments"]:
            have = self.open(strict=False).documents
            if df.join(have, df[id_col].cast("string") == have["doc_id"].cast("string"), "left_semi").limit(1).count():
                raise ValueError("documents are in the index already")
        columns = dict.fromkeys([id_col, *[s.source for s in fields], *(order or ())])
        rows = numbered(df.select(*[F.col(f"`{c}`") for c in columns]), "doc_idx", [F.col(f"`{c}`") for c in order or ()])
        name = uuid.uuid4().hex
        n = self._write(name, rows.select("doc_idx", F.col(f"`{id_col}`").alias("doc_id")), [(s.name, postings(rows if single(rows, s) else by_document(rows, self._pieces(rows)), [s])) for s in fields], fields)

        def add(c: dict) -> dict | None:
            if c["fields"] and c["fields"] != kinds:
                raise ValueError("fields differ from the index's")
            if batch is not None and batch <= c.get("stream", -1):
                return None
            segment = {"name": name, "base": c["docs"], "docs": n}
            return c | {"fields": kinds, "segments": [*c["segments"], segment], "docs": c["docs"] + n} | ({} if batch is None else {"stream": batch})

        return name if self._change(add) else None

    #: Bytes on disk of the rows that one task analyses or sorts.
    PIECE = 8 << 20

    def _pieces(self, df: DataFrame) -> int:
        """How many parts of PIECE the files make that df reads: a part stays as large, however many rows there are."""
        fs, path = self._fs()
        total = sum(fs.getContentSummary(path(at)).getLength() for at in {f.rpartition("/")[0] for f in df.inputFiles()})
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // self.PIECE))

    def _write(self, name: str, documents: DataFrame, posts: Iterable[tuple[str, DataFrame]], specs: Sequence[FieldSpec]) -> int:
        """``posts``: postings by name of field, which are sorted where they are; a column that a field lacks is left out, so it reads as null."""
        at = f"{self.path}/{name}"
        documents.write.parquet(f"{at}/documents")
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for field, df in posts:
            values = dict.fromkeys(s.value for s in specs if s.name == field)
            df.select(*values, "doc_idx", "tf", "dl").sortWithinPartitions(*values).write.mode("append").parquet(f"{at}/postings/field={escaped(field)}")
        kept = self._read(name, "postings")
        lexicon(kept).sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{at}/lexicon")
        field_stats(kept).write.parquet(f"{at}/field_stats")
        return self.spark.read.parquet(f"{at}/documents").count()

    _SCHEMAS = {
        "postings": "term string, num_i bigint, num_f double, doc_idx bigint, tf int, dl int, field string",
        "lexicon": "term string, num_i bigint, num_f double, df bigint, field string",
        "field_stats": "field string, n_docs bigint, total_len bigint, avgdl double",
    }

    def _read(self, name: str, table: str, base: int = 0) -> DataFrame:
        reader = self.spark.read
        if table in self._SCHEMAS:
            reader = reader.schema(self._SCHEMAS[table])
        df = reader.parquet(f"{self.path}/{name}/{table}")
        df = df.select("field", *[c for c in df.columns if c != "field"]) if "field" in df.columns else df
        return df.withColumn("doc_idx", F.col("doc_idx") + F.lit(base)) if base and "doc_idx" in df.columns else df

    def open(self, strict: bool = False) -> Index:
        """The index over all segments.  ``strict``: there must be exactly one."""
        c = self.catalog()
        if not c["segments"] or strict and len(c["segments"]) != 1:
            raise FileNotFoundError(f"{self.path}: {len(c['segments'])} segments")
        return self._opened(c)

    def _opened(self, c: dict) -> Index:
        t = {name: reduce(DataFrame.unionByName, [self._read(s["name"], name, s["base"]) for s in c["segments"]]) for name in TABLES}
        lex, stats = t["lexicon"], t["field_stats"]
        if len(c["segments"]) > 1:  # counts add up, averages are made again
            lex = lex.groupBy(*KEYS).agg(F.sum("df").alias("df"))
            stats = stats.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")).withColumn("avgdl", F.col("total_len") / F.col("n_docs"))
        # files of ids are small for what they hold, so by their size alone they would be broadcast
        return Index(t["documents"].hint("merge"), t["postings"], [FieldSpec(**f) for f in c["fields"]], lex, stats, self.path)

    def compact(self) -> str | None:
        """Rewrites all segments as one, in one job a table; nothing to do for fewer than two.

        Segments that others add meanwhile stay.  Those that were rewritten stay
        on disk for readers that have them open, until :meth:`vacuum`.
        """
        c = self.catalog()
        if len(c["segments"]) < 2:
            return c["segments"][0]["name"] if c["segments"] else None
        whole = self._opened(c)
        name = uuid.uuid4().hex
        posts = by_document(whole.postings, self._pieces(whole.postings))
        self._write(name, whole.documents, [(field, posts.where(F.col("field") == field)) for field in dict.fromkeys(s.name for s in whole.specs)], whole.specs)

        def swap(now: dict) -> dict:
            if now["segments"][: len(c["segments"])] != c["segments"]:
                raise ConcurrentChange(f"{self.path}: the segments were compacted by another writer")
            return now | {"segments": [{"name": name, "base": 0, "docs": c["docs"]}, *now["segments"][len(c["segments"]) :]]}

        self._change(swap)
        return name

    def vacuum(self) -> list[str]:
        """Removes the folders of segments that the newest catalog does not name; for times without readers of older ones, or writers."""
        fs, path = self._fs()
        live = {s["name"] for s in self.catalog()["segments"]}
        gone = [f.getPath().getName() for f in fs.listStatus(path(self.path)) if f.isDirectory() and f.getPath().getName() not in live]
        for name in gone:
            fs.delete(path(f"{self.path}/{name}"), True)
        return gone

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)


def merge(a: Index, b: Index) -> Index:
    """Both indexes as one: b's documents are numbered behind a's; counts add up."""
    shift = F.coalesce(a.documents.agg(F.max("doc_idx")).select(F.col("max(doc_idx)") + 1).scalar(), F.lit(0))
    move = lambda df: df.withColumn("doc_idx", F.col("doc_idx") + shift)
    lex = a.lexicon.unionByName(b.lexicon).groupBy(*KEYS).agg(F.sum("df").alias("df"))
    parts = a.stats.select("field", "n_docs", "total_len").unionByName(b.stats.select("field", "n_docs", "total_len"))
    stats = parts.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")).withColumn("avgdl", F.col("total_len") / F.col("n_docs"))
    specs = a.specs + [s for s in b.specs if s not in a.specs]
    return Index(a.documents.unionByName(move(b.documents)), a.postings.unionByName(move(b.postings)), specs, lex, stats)
