"""Incremental maintenance of an index.

A run lists the tree, compares sizes and times with those stored, reads only
files that may have changed, once, and compares their digests. What did change
is scanned, links that this can affect are settled anew (:mod:`relink`), and the
result becomes a segment of a new version (:mod:`store`). Files that cannot be
read, and what lies in folders that cannot be listed, keep their rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_segment
from ..schemas import STORED
from ..scratch import cut, delete, numbered, temporary
from ..settings import Settings
from ..sources.files import discover, read_contents, with_text
from . import scan
from .graph import Index
from .relink import relink, symbol_rows, with_ids
from .store import SMALL_FILES, CommitConflict, Store, commit, describe, merged, new_segment, next_version, prune, versions, write_segment

#: A file changed less than this before the last run began may have changed again within the clock's tick, so it is read.
RECHECK_NS = 2_000_000_000
#: What a scan tells of calls and imports.
FRESH_CALLS = ("file_id", "caller_name", "callee", "line", "name")
FRESH_IMPORTS = ("file_id", "module", "names", "kind", "line")
#: Rows of merged segments up to which one task sorts them.
SMALL_ROWS = 500_000


class NoIndexError(RuntimeError):
    """There is no index to read."""


@dataclass
class Report:
    files_scanned: int = 0
    files_changed: int = 0
    files_skipped: int = 0
    files_removed: int = 0
    symbols: int = 0
    calls: int = 0
    imports: int = 0
    languages: dict[str, int] = field(default_factory=dict)
    elapsed: float = 0.0
    #: Files whose content was read, and those that could not be.
    files_read: int = 0
    files_unreadable: int = 0
    #: Calls of unchanged files that were settled anew.
    calls_relinked: int = 0


def diff(before: DataFrame, now: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(key, status): added, changed, same or removed."""
    old = before.select(key, F.col(digest).alias("__old"), F.lit(True).alias("__had"))
    new = now.select(key, F.col(digest).alias("__new"), F.lit(True).alias("__has"))
    status = (
        F.when(F.col("__had").isNull(), "added").when(F.col("__has").isNull(), "removed")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    )
    return old.join(new, key, "full_outer").select(key, status.alias("status"))


def merge(before: DataFrame, fresh: DataFrame, kept: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``before`` whose key is in ``kept``, and all of ``fresh``."""
    return before.join(kept.select(key), key, "left_semi").unionByName(fresh)


def open_store(spark: SparkSession, index_path: str) -> Store | None:
    """The current version; None, and nothing created, if there is none."""
    found = versions(spark, index_path)
    return Store(spark, index_path, describe(spark, index_path, found[0])) if found else None


def open_index(spark: SparkSession, index_path: str) -> Index:
    """The current version; raises :class:`NoIndexError` if there is none."""
    store = open_store(spark, index_path)
    if store is None:
        raise NoIndexError(f"no index found at {index_path}")
    return Index.of(store)


def build(spark: SparkSession, settings: Settings, force: bool = False) -> Report:
    """Bring the index of a source tree up to date; raises :class:`CommitConflict` if another builder was faster."""
    with temporary(spark):
        return _build(spark, settings, force)


def catalogue(store: Store, listed: DataFrame, unlisted: DataFrame, trust: bool) -> DataFrame:
    """(path, lang, size, mtime, id, old_digest, status): every path listed or stored; status is suspect, quiet or removed.

    Quiet files have the size, time and language that are stored, and were not
    changed shortly before the last run. Stored paths below a folder that could
    not be listed are quiet too.
    """
    known = store.rows("files").select("path", "id", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("lang").alias("old_lang"), F.col("digest").alias("old_digest"))
    both = listed.join(known, "path", "full_outer")
    like = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) & (F.col("lang") == F.col("old_lang"))
    calm = like & (F.col("mtime") < store.told.get("started_ns", 0) - RECHECK_NS) & F.lit(trust)
    status = F.when(F.col("size").isNull(), "removed").when(calm, "quiet").otherwise("suspect")
    told = both.select("path", "lang", "size", "mtime", "id", "old_digest", "old_mtime", status.alias("status"))
    hidden = [r["path"] for r in unlisted.collect()]  # folders without permission are few
    below = F.lit(False)
    for folder in hidden:
        below |= F.col("path").startswith(folder + "/") | F.lit(folder == ".")
    return told.withColumn("status", F.when((F.col("status") == "removed") & below, "quiet").otherwise(F.col("status")))


def _build(spark: SparkSession, settings: Settings, force: bool) -> Report:
    if settings.engine == "deep":
        raise ValueError("engine 'deep' needs grammars that this library does not bring; use 'quick' or 'auto'")
    started, started_ns, base = time.monotonic(), time.time_ns(), settings.index_path
    store = open_store(spark, base) or Store(spark, base, None)
    trust = settings.incremental and not force
    listed, unlisted = discover(spark, settings)
    paths = cut(catalogue(store, listed, unlisted, trust), "catalogue")

    suspects = paths.where("status = 'suspect'")
    read = cut(with_text(read_contents(suspects, settings.root)), "texts")
    told = read.join(paths.select("path", "id", "old_digest", "old_mtime"), "path")
    legible = told.where("digest IS NOT NULL")
    alike = (F.col("digest").eqNullSafe(F.col("old_digest"))) & F.lit(trust)
    changed = cut(legible.where(~alike).drop("old_digest", "old_mtime"), "changed")
    removed = paths.where("status = 'removed'")
    quiet_n, removed_n = (paths.where(F.col("status") == s).count() for s in ("quiet", "removed"))
    counts = read.agg(F.count("*").alias("read"), F.count("digest").alias("legible")).first()
    changed_n = changed.count()

    # Ids last: a changed file keeps its own, a new one gets the next.
    next_file = store.told["next_file"]
    added = numbered(changed.where("id IS NULL").select("path"), "path", name="at").select("path", (F.col("at") + (next_file - 1)).alias("file_id"))
    ids = cut(changed.where("id IS NOT NULL").select("path", F.col("id").alias("file_id")).unionByName(added), "ids")
    stamp = F.lit(datetime.now(UTC).replace(microsecond=0))
    files = changed.drop("id").join(ids, "path").withColumn("indexed_at", stamp).withColumnRenamed("file_id", "id")
    fresh = {"files": cut(files.select("id", "path", "lang", "module", "size", "mtime", "digest", "lines", "indexed_at"), "fresh-files")}
    if changed_n:
        langs = scan.languages_of(changed)
        symbols = cut(scan.symbols(changed, langs), "scan-symbols")
        calls = with_ids(scan.calls(changed, symbols, langs), ids).withColumn("name", last_segment(F.col("callee")))
        fresh |= {
            "symbols": cut(symbol_rows(symbols, ids), "fresh-symbols"),
            "calls": cut(calls.select(*FRESH_CALLS), "fresh-calls"),
            "imports": cut(with_ids(scan.imports(changed, langs), ids).select(*FRESH_IMPORTS), "fresh-imports"),
        }
    else:
        none = {t: spark.createDataFrame([], STORED[t]) for t in ("symbols", "calls", "imports")}
        fresh |= {"symbols": none["symbols"], "calls": none["calls"].select(*FRESH_CALLS), "imports": none["imports"].select(*FRESH_IMPORTS)}
    touched = cut(changed.where("id IS NOT NULL").select(F.col("id").alias("file_id")).unionByName(removed.select(F.col("id").alias("file_id"))), "touched")

    segments, fresh_segment = store.segments, None
    totals = {k: store.told.get(k, 0) for k in ("n_symbols", "n_terms")}
    report = Report(
        quiet_n + counts["read"], changed_n, quiet_n + counts["read"] - changed_n, removed_n,
        files_read=counts["legible"], files_unreadable=counts["read"] - counts["legible"],
    )
    # Files that were only written again keep all rows but the one with their time.
    again = legible.where(alike & (F.col("mtime") != F.col("old_mtime"))).select("id", F.col("mtime").alias("new_mtime"))
    again = cut(again, "refreshed")
    again_n = again.count() if trust else 0
    if changed_n or removed_n or again_n:
        rows, dead = relink(store, fresh, touched)
        if again_n:
            timed = store.lookup("files", "id", again.select("id")).join(again, "id").withColumn("mtime", F.col("new_mtime")).select(*rows["files"].columns)
            rows["files"], dead["files"] = rows["files"].unionByName(timed), dead["files"].unionByName(again.select(F.col("id").alias("file_id")))
        fresh_segment = write_segment(spark, base, new_segment(store.told["version"]), rows, dead if segments else {}, changed_n <= SMALL_FILES)
        left = store.lookup("lengths", "file_id", touched).agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        gone = store.lookup("symbols", "file_id", touched).count()
        more = rows["lengths"].agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
        report.symbols, report.imports = fresh_segment["rows"].get("symbols", 0), fresh["imports"].count()
        report.calls = fresh["calls"].count()
        report.calls_relinked = fresh_segment["rows"].get("calls", 0) - report.calls
        totals = {"n_symbols": totals["n_symbols"] - gone + report.symbols, "n_terms": totals["n_terms"] - left[1] + more}
        first = store.mergeable(fresh_segment)
        segments = [*store.segments, fresh_segment]
        if first < len(store.segments):
            _, rows, dead = merged(store, first, fresh_segment)
            small = sum(sum(s["rows"].values()) for s in segments[first:]) <= SMALL_ROWS
            whole = write_segment(spark, base, new_segment(store.told["version"]), rows, dead, small)
            segments = [*store.segments[:first], whole]
    version = next_version(
        store, segments, root=settings.root, last_indexed=datetime.now(UTC).isoformat(timespec="seconds"), started_ns=started_ns,
        next_file=next_file + added.count(), **totals,
    )
    try:
        commit(spark, base, version)
    except CommitConflict:
        for name in {s["name"] for s in [*segments, *([fresh_segment] if fresh_segment else [])]} - {s["name"] for s in store.segments}:
            delete(spark, f"{base}/{name}")
        raise
    if fresh_segment and fresh_segment not in segments:
        delete(spark, f"{base}/{fresh_segment['name']}")
    prune(spark, base)
    langs = Store(spark, base, version).rows("files").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    report.languages, report.elapsed = {r["lang"]: r["n"] for r in langs}, time.monotonic() - started
    return report
