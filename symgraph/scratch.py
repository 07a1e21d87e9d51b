"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may fall back to a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="symgraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders of the tables cut within :func:`temporary`, in this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def folders(spark: SparkSession, pattern: str) -> list[tuple[str, str]]:
    """Names and paths of the folders that match a pattern."""
    path, system = _path(spark, pattern)
    found = [s.getPath() for s in system.globStatus(path) or [] if s.isDirectory()]
    return [(p.getName(), p.toString()) for p in found]


def files_in(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files that a pattern matches."""
    path, system = _path(spark, pattern)
    return [s.getPath().getName() for s in system.globStatus(path) or [] if s.isFile()]


def read_text(spark: SparkSession, name: str) -> str:
    """A small file whole, without a job."""
    path, system = _path(spark, name)
    stream = system.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, name: str, text: str) -> bool:
    """Create a small file, whole or not at all; False if there is one of that name.

    The text is written beside it and then renamed, which fails in HDFS and
    its like if the name is taken. A local disk gets a second link to the file
    instead, since its renames would replace what is there.
    """
    path, system = _path(spark, name)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_{uuid.uuid4().hex}")
    system.mkdirs(path.getParent())
    out = system.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() != "file":
            return bool(system.rename(beside, path))
        os.link(beside.toUri().getPath(), path.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        system.delete(beside, False)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the tables cut inside when the block ends; frames that read them must not outlive it.

    The block is given a :func:`cut` for the tables that are to outlive it.
    """
    made: list[str] = []
    outer = _MADE.get()

    def lasting(df: DataFrame, name: str) -> DataFrame:
        inner = _MADE.set(outer)
        try:
            return cut(df, name)
        finally:
            _MADE.reset(inner)

    token = _MADE.set(made)
    try:
        yield lasting
    finally:
        _MADE.reset(token)
        for folder in made:
            delete(spark, folder)


#: By application: how many tables are being cut, and what the setting was before the first of them.
_CUTTING: dict[str, tuple[int, str]] = {}
_LOCK = threading.Lock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go with the writing, not when the driver next collects garbage."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        n, before = _CUTTING.get(app, (0, ""))
        before = before if n else spark.conf.get(_CLEANUP, "false")
        _CUTTING[app] = (n + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _CUTTING.pop(app)
            if n > 1:
                _CUTTING[app] = (n - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that nothing is computed twice or lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/symgraph/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """``df`` with a column that counts its rows from 1 in the given order.

    Rows are range-partitioned and counted per task; only the tasks' counts,
    one number each, reach the driver.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # The upper bits of this number are the task, the lower 33 count its rows.
    laid = cut(laid.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    counts = laid.groupBy(F.shiftright("__at", 33).alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
    shifts, before = [], 1
    for row in counts:
        shifts.append((row["task"], before - (row["task"] << 33)))
        before += row["n"]
    shift = F.broadcast(spark.createDataFrame(shifts, "__task long, __shift long"))
    joined = laid.join(shift, F.shiftright("__at", 33) == F.col("__task"))
    return joined.select((F.col("__at") + F.col("__shift")).alias(name), *df.columns)
