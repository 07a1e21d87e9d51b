"""Source files as a DataFrame: discovery, filters, content, digest and text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import EXTENSIONS, language, module_id
from ..functions.text import glob_regex, line_count
from ..scratch import cut
from ..settings import Settings


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _some(values: Column, regex: str) -> Column:
    return F.exists(values, lambda v: v.rlike(regex))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether the path or any folder above it matches a pattern.

    A pattern with a slash is held against paths and prefixes, one without
    against names and whole paths.
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    tests = []
    for pattern in filter(None, patterns):
        regex = glob_regex(pattern)
        if "/" in pattern:
            tests.append(_some(prefixes, regex) | path.startswith(pattern.rstrip("/") + "/"))
        else:
            tests.append(_some(parts, regex) | _some(prefixes, regex))
    return _any(tests)


def included(path: Column, patterns: list[str]) -> Column:
    """Whether the path equals, lies under or matches a pattern; no pattern lets all pass."""
    if not patterns:
        return F.lit(True)
    bases = [p.rstrip("/") for p in patterns if p]
    return _any([(path == b) | path.startswith(b + "/") for b in bases] + [path.rlike(glob_regex(p)) for p in patterns if p])


#: Entries that a task lists before it hands folders on to the next round.
LISTED_AT_ONCE = 5_000
#: Bytes of content that a task reads, about.
READ_BYTES = 32 << 20
LISTED = "folder boolean, path string, size long, mtime long"
READ = "path string, lang string, size long, mtime long, content binary, error string"


def list_tree(spark: SparkSession, root: str, prune: list[str], suffixes: list[str], most: int) -> DataFrame:
    """(path, size, mtime, listed) of the files of a tree, listed in rounds; folders that cannot be listed are rows too, with ``listed`` false.

    A task lists what lies below the folders it is given until it has seen so
    many entries, and hands the folders left on to the next round, where they
    are dealt to all tasks. So a large tree splits wherever it branches, and
    a small one takes one round. Folders whose name matches a pattern of
    ``prune`` are not entered; names that Spark would hide are listed. The root
    must be mounted where tasks run.
    """
    root, endings = root.rstrip("/"), tuple(suffixes)
    tasks = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        barred = [re.compile(p) for p in prune]
        for batch in batches:
            waiting, seen, found = [p or "." for p in batch.column("path").to_pylist()], 0, []
            while waiting and seen < LISTED_AT_ONCE:
                folder = waiting.pop()
                try:
                    with os.scandir(f"{root}/{folder}") as entries:
                        for e in entries:
                            seen += 1
                            path = e.name if folder == "." else f"{folder}/{e.name}"
                            if e.is_dir(follow_symlinks=False):
                                waiting += [path] if not any(p.match(e.name) for p in barred) else []
                            elif e.name.lower().endswith(endings) and e.is_file():
                                told = e.stat()
                                found += [(False, path, told.st_size, told.st_mtime_ns)] if told.st_size <= most else []
                except FileNotFoundError:
                    continue  # the folder has gone
                except OSError:
                    found.append((None, folder, None, None))
            found += [(True, path, None, None) for path in waiting]
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.bool_(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["folder", "path", "size", "mtime"])

    rounds, waiting = [], spark.createDataFrame([("",)], "path string")
    while not rounds or not waiting.isEmpty():
        rounds.append(cut(waiting.repartition(tasks).mapInArrow(run, LISTED), "listing"))
        waiting = rounds[-1].where("folder").select("path")
    return reduce(DataFrame.unionByName, rounds).where("folder IS NULL OR NOT folder").select("path", "size", "mtime", F.col("folder").isNotNull().alias("listed"))


def discover(spark: SparkSession, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(path, lang, size, mtime) of every file to index, without reading any, and (path) of folders that could not be listed."""
    names = [glob_regex(p) for p in settings.exclude if p and "/" not in p]
    found = list_tree(spark, settings.root, names, sorted(EXTENSIONS | settings.language_map), settings.max_file_kb * 1024)
    lang = language(F.col("path"), settings.language_map)
    keep = ~excluded(F.col("path"), settings.exclude) & included(F.col("path"), settings.include) & lang.isNotNull()
    return found.where(F.col("listed") & keep).select("path", lang.alias("lang"), "size", "mtime"), found.where("NOT listed").select("path")


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, lang, size, mtime) with ``content``, dealt out by bytes; where it cannot be read it is null, and ``error`` says why."""
    root, total = root.rstrip("/"), files.agg(F.sum("size")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                content = error = None
                try:
                    with open(f"{root}/{path}", "rb") as held:
                        content = held.read()
                except OSError as problem:
                    error = str(problem)
                own = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*own.schema.names, "content", "error"])

    dealt = files.select("path", "lang", "size", "mtime").repartition(total // READ_BYTES + 1, "path")
    return dealt.mapInArrow(run, READ)


def decoded(content: Column) -> Column:
    """Bytes as text: bad UTF-8 becomes U+FFFD, a byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def with_text(found: DataFrame) -> DataFrame:
    """(path, lang, module, size, mtime, digest, lines, text) of files with content."""
    text = found.select("path", "lang", "size", "mtime", F.sha2("content", 256).alias("digest"), decoded(F.col("content")).alias("text"))
    return text.select("path", "lang", module_id(F.col("path"), F.col("lang"), F.col("text")).alias("module"), "size", "mtime", "digest", line_count(F.col("text")).alias("lines"), "text")
