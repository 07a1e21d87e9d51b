"""Tables of an index as sorted segments, laid out once for each key they are looked up by.

A build writes one segment: for each table its new rows, and the owners (files)
whose rows in older segments no longer count. A table is the union of its
segments, each without the owners that a later one names, so a build writes in
proportion to what changed. Small segments are merged into the one before them,
which keeps their number logarithmic.

Within a segment every table is stored once for each lookup key, in ranges of
that key, and a small table tells the least and greatest key of every file. A
lookup with few keys therefore reads only the files that may hold them, with the
keys as literal predicates that skip row groups too. A small segment has one
file for each table, which serves all keys.

A version is a file that names its segments. It is created only if no file of
that number is there, so of two builders that started from the same version one
wins and the other is told (:class:`CommitConflict`). Segments are never
changed, so readers keep what they opened. What only older versions name is
deleted, but never a segment that was begun from a version which is still kept:
its builder may be running.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STORED
from ..scratch import cut, delete, files_in, folders, read_text, write_new

#: The keys by which each table is stored; the first is the one that whole tables are read by.
LAYOUTS = {
    "files": ("id", "path", "module"),
    "symbols": ("id", "file_id", "name", "qualname"),
    "calls": ("file_id", "caller_id", "callee_id", "name"),
    "imports": ("file_id", "target_id"),
    "imported": ("name",),
    "reach": ("file_id",),
    "tried": ("tried",),
    "wanted": ("wanted",),
    "postings": ("term",),
    "lengths": ("id", "file_id"),
    "grams": ("gram",),
}
#: Keys of a lookup that are written into its plan at most; more are joined.
LITERALS = 1_000
#: Files that a lookup names at most; beyond them it reads the whole layout with its keys as predicates.
MOST_FILES = 1_000
#: Rows of a stored file.
FILE_ROWS = 1_000_000
#: Segments of fewer files than this are sorted by one task.
SMALL_FILES = 200
#: A segment is merged into the one before it unless that has at least so many times its rows.
FANOUT = 4
#: Versions that stay.
KEPT_VERSIONS = 2
BOUNDS = "table string, key string, file string, low_id long, high_id long, low_text string, high_text string"
DEAD = "table string, owner long"


class CommitConflict(RuntimeError):
    """Another builder has committed a version since this one started."""


def owner(table: str) -> str:
    return "id" if table == "files" else "file_id"


def _is_text(table: str, key: str) -> bool:
    return key in ("path", "module", "name", "qualname", "tried", "wanted", "term", "gram")


# ---------------------------------------------------------------- versions

def _version_path(base: str, number: int) -> str:
    return f"{base}/versions/{number:012d}.json"


def versions(spark: SparkSession, base: str) -> list[int]:
    """The numbers of committed versions, the newest first."""
    names = [n for n in files_in(spark, f"{base}/versions/*.json") if n.removesuffix(".json").isdigit()]
    return sorted((int(n.removesuffix(".json")) for n in names), reverse=True)


def describe(spark: SparkSession, base: str, number: int) -> dict:
    return json.loads(read_text(spark, _version_path(base, number)))


def commit(spark: SparkSession, base: str, told: dict) -> None:
    """Make ``told`` the version of its number, or raise :class:`CommitConflict` if there is one."""
    if not write_new(spark, _version_path(base, told["version"]), json.dumps(told, indent=1)):
        raise CommitConflict(f"version {told['version']} of {base} has been committed by another builder")


def prune(spark: SparkSession, base: str) -> None:
    """Delete old versions and the segments that only they name, with what failed builds left from before them."""
    found = versions(spark, base)
    kept, old = found[:KEPT_VERSIONS], found[KEPT_VERSIONS:]
    if len(kept) < KEPT_VERSIONS:
        return
    named = {s["name"] for v in kept for s in describe(spark, base, v)["segments"]}
    for v in old:
        delete(spark, _version_path(base, v))
    for name, folder in folders(spark, f"{base}/s-*"):
        if name not in named and int(name.split("-")[1]) < kept[-1]:
            delete(spark, folder)


# ---------------------------------------------------------------- segments

def new_segment(number: int) -> str:
    """A name for a segment begun from version ``number``."""
    return f"s-{number:012d}-{uuid.uuid4().hex}"


def _lay(rows: DataFrame, path: str, table: str, key: str, small: bool = False) -> None:
    """Write one layout of a table."""
    held = rows.select(*[c.split()[0] for c in STORED[table].split(", ")])
    tie = [c for c in ("id", "file_id") if c in held.columns and c != key]
    laid = held.coalesce(1) if small else held.repartitionByRange(key, *tie)
    laid.sortWithinPartitions(key, *tie).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/{table}/by_{key}")


def _ends(spark: SparkSession, path: str, table: str, key: str) -> DataFrame:
    """The least and greatest key and the number of rows of every file of a layout."""
    held = spark.read.schema(STORED[table]).parquet(f"{path}/{table}/by_{key}").groupBy(F.col("_metadata.file_name").alias("file"))
    low, high = F.min(key), F.max(key)
    text = _is_text(table, key)
    none = [F.lit(None).cast("string"), F.lit(None).cast("string")] if not text else [F.lit(None).cast("long"), F.lit(None).cast("long")]
    agg = held.agg(low.alias("low"), high.alias("high"), F.count("*").alias("n"))
    ends = [*none, F.col("low"), F.col("high")] if text else [F.col("low"), F.col("high"), *none]
    names = ("low_id", "high_id", "low_text", "high_text")
    return agg.select(F.lit(table).alias("table"), F.lit(key).alias("key"), "file", *[e.alias(n) for e, n in zip(ends, names, strict=True)], "n")


def write_segment(spark: SparkSession, base: str, name: str, rows: dict[str, DataFrame], dead: dict[str, DataFrame], small: bool) -> dict:
    """Write the rows of every table in all its layouts, and the owners whose older rows they replace."""
    path = f"{base}/{name}"

    keys = {t: LAYOUTS[t][:1] if small else LAYOUTS[t] for t in rows}

    def lay_dead() -> None:
        parts = [df.select(F.lit(t).alias("table"), F.col(df.columns[0]).cast("long").alias("owner")) for t, df in dead.items()]
        named = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], DEAD)
        named.distinct().coalesce(1).write.parquet(f"{path}/dead")

    with ThreadPoolExecutor(8) as pool:
        jobs = [pool.submit(_lay, rows[t], path, t, k, small) for t in rows for k in keys[t]] + [pool.submit(lay_dead)]
        for job in jobs:
            job.result()
    bounds = reduce(DataFrame.unionByName, [_ends(spark, path, t, k) for t in rows for k in keys[t]])
    if not small:
        bounds.coalesce(1).write.parquet(f"{path}/bounds")
        bounds = spark.read.parquet(f"{path}/bounds")
    told = bounds.groupBy("table", "key").agg(F.sum("n").alias("n")).collect()
    counts = {r["table"]: r["n"] for r in told if r["key"] == LAYOUTS[r["table"]][0]}
    return {"name": name, "rows": {t: n for t in rows if (n := counts.get(t, 0))}, "dead": sorted(dead), "small": small}


#: By frame made by :func:`settled`: its values.
_FEW: WeakKeyDictionary = WeakKeyDictionary()


def few_values(keys: DataFrame) -> list | None:
    """The distinct values of the only column if there are few, else None."""
    if keys in _FEW:
        return _FEW[keys]
    column = F.col(keys.columns[0])
    found = [r[0] for r in keys.select(column).where(column.isNotNull()).distinct().limit(LITERALS + 1).collect()]
    return found if len(found) <= LITERALS else None


def settled(keys: DataFrame, name: str) -> DataFrame:
    """The distinct values of a frame of one column, as a local table if they are few, else stored."""
    found = few_values(keys)
    if found is None:
        return cut(keys.where(F.col(keys.columns[0]).isNotNull()).distinct(), name)
    local = keys.sparkSession.createDataFrame([(v,) for v in found], keys.schema)
    _FEW[local] = found
    return local


def _ranges(bounds: DataFrame) -> dict[tuple, list[tuple]]:
    """By table and key: (low, high, file) in order."""
    held: dict = {}
    for r in bounds.collect():
        low, high = (r["low_text"], r["high_text"]) if _is_text(r["table"], r["key"]) else (r["low_id"], r["high_id"])
        if low is not None:
            held.setdefault((r["table"], r["key"]), []).append((low, high, r["file"]))
    return {k: sorted(v) for k, v in held.items()}


class Store:
    """The tables of one version; ``told`` is None for an index that has none yet."""

    def __init__(self, spark: SparkSession, base: str, told: dict | None):
        self.spark, self.base, self.told = spark, base, told or {"version": 0, "segments": [], "next_file": 1}
        self._bounds: dict[str, dict] = {}

    @property
    def segments(self) -> list[dict]:
        return self.told["segments"]

    def _dead(self, table: str, since: int) -> DataFrame | None:
        """The owners that segments after number ``since`` name for a table."""
        later = [f"{self.base}/{s['name']}/dead" for s in self.segments[since + 1 :] if table in s["dead"]]
        if not later:
            return None
        return self.spark.read.schema(DEAD).parquet(*later).where(F.col("table") == table).select(F.col("owner").alias(owner(table))).distinct()

    def _alive(self, df: DataFrame, table: str, at: int) -> DataFrame:
        dead = self._dead(table, at)
        return df if dead is None else df.join(dead, owner(table), "left_anti").select(*df.columns)

    def _none(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], STORED[table])

    def _read(self, table: str, segment: dict, key: str, files: list[str] | None = None) -> DataFrame:
        folder = f"{self.base}/{segment['name']}/{table}/by_{LAYOUTS[table][0] if segment['small'] else key}"
        return self.spark.read.schema(STORED[table]).parquet(*([f"{folder}/{f}" for f in files] if files is not None else [folder]))

    def rows(self, table: str, key: str | None = None, first: int = 0) -> DataFrame:
        """All live rows of a table; from segment number ``first`` on."""
        key = key or LAYOUTS[table][0]
        parts = [self._alive(self._read(table, s, key), table, k) for k, s in enumerate(self.segments) if k >= first and table in s["rows"]]
        return reduce(DataFrame.unionByName, parts) if parts else self._none(table)

    def _files(self, segment: dict, table: str, key: str) -> list[tuple]:
        """(low, high, file) in order, for files with any key; read once for each segment."""
        if segment["name"] not in self._bounds:
            self._bounds[segment["name"]] = _ranges(self.spark.read.schema(BOUNDS).parquet(f"{self.base}/{segment['name']}/bounds"))
        return self._bounds[segment["name"]].get((table, key), [])

    def get(self, table: str, key: str, values: list, prefix: bool = False) -> DataFrame:
        """Live rows whose key is one of a few values, or begins with one of them; only files that may hold them are read."""
        values = sorted({v for v in values if v is not None})
        parts = []
        for at, segment in enumerate(self.segments):
            if table not in segment["rows"] or not values:
                continue
            wanted: set[str] = set()
            if not segment["small"]:
                held = self._files(segment, table, key)
                lows, highs = [h[0] for h in held], [h[1] for h in held]
                for v in values:
                    # Files are ranges in order, so those that may hold a key are neighbours.
                    last = v + "\U0010ffff" if prefix else v
                    wanted.update(h[2] for h in held[bisect.bisect_left(highs, v) : bisect.bisect_right(lows, last)])
            if wanted or segment["small"]:
                read = self._read(table, segment, key, sorted(wanted) if 0 < len(wanted) <= MOST_FILES else None)
                test = reduce(lambda a, b: a | b, [F.col(key).startswith(v) for v in values]) if prefix else F.col(key).isin(values)
                parts.append(self._alive(read.where(test), table, at))
        return reduce(DataFrame.unionByName, parts) if parts else self._none(table)

    def lookup(self, table: str, key: str, keys: DataFrame) -> DataFrame:
        """Live rows whose key is in the only column of ``keys``, by :meth:`get` if those are few, else by a join."""
        if not any(table in s["rows"] for s in self.segments):
            return self._none(table)
        few = few_values(keys)
        if few is not None:
            return self.get(table, key, few)
        keys = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
        return self.rows(table, key).join(keys, key, "left_semi").select(*self._none(table).columns)

    def searched(self) -> tuple[int, int]:
        """How many symbols and search terms there are."""
        return self.told["n_symbols"], self.told["n_terms"]

    def mergeable(self, fresh: dict) -> int:
        """From which segment on the segments and a new one of these rows should be one; their number if none."""
        size = lambda s: sum(s["rows"].values())
        total, first = size(fresh), len(self.segments)
        while first and size(self.segments[first - 1]) < FANOUT * total:
            first -= 1
            total += size(self.segments[first])
        return first


class LazyStore(Store):
    """A store over tables that lie somewhere else; each layout is written when a lookup first asks for it.

    ``tables`` has a function for each table that gives its rows. Whole tables
    are read as they are given, so a query pays only for the keys it uses.
    """

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, Callable[[], DataFrame]], told: dict):
        segment = {"name": new_segment(0), "rows": dict.fromkeys(tables, 0), "dead": [], "small": False}
        super().__init__(spark, base, {"version": 1, "segments": [segment], **told})
        self._tables = tables

    def rows(self, table: str, key: str | None = None, first: int = 0) -> DataFrame:
        return self._tables[table]().select(*[c.split()[0] for c in STORED[table].split(", ")])

    def _files(self, segment: dict, table: str, key: str) -> list[tuple]:
        held = self._bounds.setdefault(segment["name"], {})
        if (table, key) not in held:
            path = f"{self.base}/{segment['name']}"
            _lay(self.rows(table), path, table, key)
            held[table, key] = _ranges(_ends(self.spark, path, table, key)).get((table, key), [])
        return held[table, key]

    def searched(self) -> tuple[int, int]:
        if "n_terms" not in self.told:
            n_terms = self.rows("lengths").agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
            self.told |= {"n_symbols": self.rows("symbols").count(), "n_terms": n_terms}
        return super().searched()


def next_version(store: Store, segments: list[dict], **told) -> dict:
    """The description of the version after ``store``'s with these segments."""
    return store.told | {"version": store.told["version"] + 1, "segments": segments} | told


def merged(store: Store, first: int, fresh: dict) -> tuple[Store, dict[str, DataFrame], dict[str, DataFrame]]:
    """What segments from number ``first`` on and the segment ``fresh`` are together: a store over both, rows, dead owners."""
    both = Store(store.spark, store.base, next_version(store, [*store.segments, fresh]))
    # A table may have rows, or owners that are gone, in any of them.
    held = {"files"}.union(*(s["rows"] for s in both.segments[first:]))
    rows = {t: both.rows(t, first=first) for t in LAYOUTS if t in held}
    if first == 0:
        return both, rows, {}
    dead = {t: d for t in LAYOUTS if (d := both._dead(t, first - 1)) is not None}
    return both, rows, dead

