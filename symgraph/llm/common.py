"""Helpers that several training-data operators share."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, shared_dir

#: The white space that separates words in every contract of this subpackage.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"

#: Id lists up to this many rows (8 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_IDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/symgraph/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this package's in the shared folder."""
    if "/symgraph/" in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


def bounded(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` marked for broadcast if it holds at most ``limit`` rows, else as it is.

    ``ids`` should come from :func:`cut`, since its rows are counted here.
    """
    return F.broadcast(ids) if ids.count() <= limit else ids


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that no model may learn from; a null id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of text that a task holds as Python objects at a time, about; a longer text stands alone.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, place: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``limit`` bytes of text in column ``place``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    starts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1).tolist(), len(sizes)]
    for start, end in itertools.pairwise(starts):
        yield batch.slice(start, end - start)


def map_texts(docs: DataFrame, keep: list[str], columns: dict[str, tuple[str, pa.DataType]], fn, text: str = "text") -> DataFrame:
    """The columns ``keep``, untouched, with ``columns`` computed from the texts.

    ``columns`` gives each new column's Spark and Arrow types; ``fn`` gets a
    list of texts (None for null) and returns one sequence for each column. A
    new column whose name is among ``keep`` gets underscores added to it.
    """
    kept = docs.select(*[docs[k] for k in keep])
    columns = {free_name(kept, k): v for k, v in columns.items()}
    fields = [T.StructField(k, docs.schema[k].dataType) for k in keep]
    fields += [T.StructField(k, T._parse_datatype_string(kind)) for k, (kind, _) in columns.items()]
    kinds = [arrow for _, arrow in columns.values()]
    width = len(keep)
    # Texts that pass through anyway are sent once: batches of whole texts are what these tasks' memory goes to.
    if text in keep and docs.schema[text].dataType == T.StringType():
        place, given = keep.index(text), kept
    else:
        place, given = width, docs.select(*[docs[k] for k in keep], docs[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(slices(b, place) for b in batches):
            made = fn(batch.column(place).to_pylist())
            arrays = [batch.column(i) for i in range(width)] + [pa.array(c, type=t) for c, t in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *columns])

    return given.mapInArrow(run, T.StructType(fields))


#: Keys that hold more than 1/HOT_SHARE of all rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 2_000


def join_by_key(rows: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``side`` (one row for each key), safe against hot keys.

    ``side``'s column ``n`` counts the rows of each key and ``total`` all rows,
    so fewer than HOT_SHARE keys are hot, and those are broadcast.
    """
    is_hot = F.col(n) > max(1, total // HOT_SHARE)
    values = [c for c in side.columns if c not in (key, n)]
    hot = side.where(is_hot).select(key, F.struct(*values).alias("__hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    first = marked.where("__hot IS NOT NULL").select(*rows.columns, *[F.col("__hot")[v].alias(v) for v in values])
    return first.unionByName(marked.where("__hot IS NULL").drop("__hot").join(side.where(~is_hot).drop(n), key).select(*rows.columns, *values))
