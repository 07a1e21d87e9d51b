"""Line deduplication over levelled sorted runs, with built-in functions only.

Lines are identified by a 128-bit hash of their key. Documents arrive in
batches of ascending id. A batch's distinct line hashes, sorted, are
merge-joined with the runs of all earlier batches: a hash found in a run
belongs to an earlier document, and the hashes that no run holds become a new
run. Runs are tables bucketed and sorted by hash, one file for each bucket, so
these joins read them in order without a shuffle or a sort. Whenever
``fanout`` runs stand on one level they are compacted by a merge join, bucket
by bucket, into one run of the next level, so a batch meets few runs however
many batches came before.

Cases: a null or empty text is one empty line. Null ids own no line and keep
all of theirs. Rows that repeat an id count as one document and are treated
alike. Keys shorter than the minimum are never dropped. An empty table gives
no rows. The input's columns pass through unchanged, whatever their names; the
added column is called ``lines``, with underscores added where the input has a
column of that name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, SPACE_CHARS, cut, delete_folder, free_name, let, scratch_path

MIN_KEY_CHARS = 10
#: There are at least this many batches, and a batch holds about this many documents at most.
BATCHES, BATCH_DOCS = 4, 500_000_000
FANOUT = 2
#: With this setting, scans of buckets of one file each tell Spark that their rows are sorted.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer white space and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), _UPPER, _LOWER)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def line_hashes(text: Column, min_chars: int = MIN_KEY_CHARS) -> Column:
    """One hash for each line, null where the key is too short to count."""
    hashed = lambda key: F.when(F.length(key) >= min_chars, key_hash(key))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: let(line_key(line), hashed))


class LineRuns:
    """The levelled runs: tables of (h1, h2, owner) in the shared folder.

    Use it in a ``with`` block, which drops what is left of the runs at its end.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        self.before = self.spark.conf.get(SORTED_SCANS, None)
        self.spark.conf.set(SORTED_SCANS, "true")
        return self

    def __exit__(self, *problem) -> None:
        for name in list(self.paths):
            self.drop(name)
        if self.before is None:
            self.spark.conf.unset(SORTED_SCANS)
        else:
            self.spark.conf.set(SORTED_SCANS, self.before)

    def write(self, rows: DataFrame) -> str:
        """Store ``rows``, whose partitions must be the buckets of their hashes, and return the table's name."""
        name, path = f"symgraph_run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        self.paths[name] = path
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", path).saveAsTable(name)
        return name

    def rows(self, name: str) -> DataFrame:
        """The rows of a run; those of a batch's table that no earlier run held."""
        table = self.spark.table(name)
        return (table.where(F.col("known").isNull()) if "known" in table.columns else table).select("h1", "h2", "owner").hint("merge")

    def merged(self, batch: DataFrame) -> str:
        """Store the distinct hashes of ``batch`` (h1, h2, owner) with their number n and ``known``, the owner that a run holds, else null; returns the table's name."""
        laid = batch.groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.count("*").alias("n"))
        known = F.lit(None).cast("long")
        for k, name in enumerate(run for level in self.levels for run in level):
            laid = laid.join(self.rows(name).withColumnRenamed("owner", f"known{k}"), ["h1", "h2"], "left")
            known = F.coalesce(known, F.col(f"known{k}"))
        return self.write(laid.select("h1", "h2", "owner", "n", known.alias("known")))

    def add(self, name: str) -> None:
        """Add a stored batch as a run of level 0."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fanout:
                self._compact(depth)

    def _compact(self, depth: int) -> None:
        """Merge the runs of a level; no two runs hold the same hash."""
        first, *rest = self.levels[depth]
        merged = self.rows(first)
        for name in rest:
            more = self.rows(name).withColumnRenamed("owner", "more")
            merged = merged.join(more, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "more").alias("owner")).hint("merge")
        if depth + 1 == len(self.levels):
            self.levels.append([])
        self.levels[depth + 1].append(self.write(merged))
        for name in self.levels[depth]:
            # The tables of batches are still asked for their owners; what was compacted before is not.
            if "known" not in self.spark.table(name).columns:
                self.drop(name)
        self.levels[depth] = []

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_folder(self.spark, self.paths.pop(name))


def batch_bounds(docs: DataFrame, doc_id: str, batches: int | None) -> list[int]:
    """Ids that cut the documents into about equal batches, by default as many as their number asks for."""
    ids = docs.select(F.col(doc_id).cast("long").alias("id")).where("id IS NOT NULL")
    batches = batches or max(BATCHES, -(-ids.count() // BATCH_DOCS))
    if batches < 2:
        return []
    cuts = ids.approxQuantile("id", [k / batches for k in range(1, batches)], min(0.01, 0.25 / batches))
    return sorted({int(c) for c in cuts or []})


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


@contextmanager
def line_table(docs: DataFrame, doc_id: str, text: str, bounds: list[int]) -> Iterator[DataFrame]:
    """(id, text_hash, place, h1, h2, batch) of all lines that count, in one folder for each batch."""
    spark = docs.sparkSession
    number = sum([F.when(F.col("id") > b, 1).otherwise(0) for b in bounds], F.lit(0))
    held = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), text_hash(F.col(text)).alias("text_hash"), F.posexplode(line_hashes(F.col(text))).alias("place", "h")
    )
    path = scratch_path(spark, "lines")
    lines = held.where("h IS NOT NULL").select("id", "text_hash", "place", "h.h1", "h.h2", number.cast("int").alias("batch"))
    try:
        lines.write.partitionBy("batch").parquet(path)
        yield spark.read.schema(lines.schema).parquet(path)
    finally:
        delete_folder(spark, path)


def foreign_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """Rows (id, text_hash, places): for each text of a document, where lines stand that an earlier document owns."""
    spark = docs.sparkSession
    bounds = batch_bounds(docs, doc_id, batches)
    place = ["id", "text_hash", "place"]
    with line_table(docs, doc_id, text, bounds) as lines, LineRuns(spark, fanout) as runs:
        hot_rows = max(1, lines.count() // HOT_SHARE)
        dropped = lines.select(*place).limit(0)
        for k in range(len(bounds) + 1):
            rows = lines.where(F.col("batch") == k)
            met = runs.merged(rows.select("h1", "h2", F.col("id").alias("owner")))
            if k < len(bounds):
                runs.add(met)
            shared = spark.table(met).where(F.col("known").isNotNull() | (F.col("n") > 1)).select(
                "h1", "h2", F.coalesce("known", "owner").alias("owner"), (F.col("n") > hot_rows).alias("hot")
            )
            # A hot line has over hot_rows rows, so there are at most HOT_SHARE of them.
            hot = F.broadcast(shared.where("hot").select("h1", "h2", F.col("owner").alias("hot_owner")))
            marked = rows.join(hot, ["h1", "h2"], "left")
            cold = marked.where("hot_owner IS NULL").drop("hot_owner").join(shared.where("NOT hot"), ["h1", "h2"])
            dropped = dropped.unionByName(marked.where("hot_owner < id").select(*place)).unionByName(cold.where("owner < id").select(*place))
        return cut(dropped.groupBy("id", "text_hash").agg(F.collect_set("place").alias("places")), "foreign")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with a struct column ``lines``: n_lines, n_dropped and kept_text."""
    hidden, out = free_name(docs, "foreign"), free_name(docs, "lines")
    foreign = foreign_lines(docs, doc_id, text, batches, fanout).select(F.struct("*").alias(hidden))
    base = F.coalesce(F.col(text), F.lit(""))
    places = F.col(hidden)["places"]

    def kept(split: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), places)
        return F.struct(
            F.size(split).cast("long").alias("n_lines"),
            F.size(places).cast("long").alias("n_dropped"),
            F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n").alias("kept_text"),
        )

    whole = F.struct(F.size(F.split(base, "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), base.alias("kept_text"))
    same = (F.col(doc_id).cast("long") == F.col(hidden)["id"]) & (text_hash(F.col(text)) == F.col(hidden)["text_hash"])
    joined = docs.join(foreign, same, "left")
    return joined.withColumn(out, F.when(F.col(hidden)["id"].isNull(), whole).otherwise(let(F.split(base, "\n"), kept))).drop(hidden)
