"""A pipeline over ``documents``: each stage reads what the one before it wrote.

Toxic documents go, then documents of low quality and failing lines of the
others, then lines that an earlier document holds, then all but one document
of each group of near copies; what is left is packed into token windows.

Cases: null and empty texts fail the quality rules. Rows with a null id pass
every stage on their texts alone and are linked with nothing. Rows that repeat
an id are judged one by one, by their own texts; of equal rows one stays behind
the n-gram join. Texts are read whole. An empty table gives no pieces. Columns
other than those of ``documents`` are left behind, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import linededup, ngramjoin, packing, quality, toxicity
from symgraph.llm.common import delete_folder, scratch_path, table
from symgraph.llm.tokens import vocabulary
from symgraph.scratch import temporary


#: What every stage but the last reads and returns; other columns are left behind, whatever their names.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with a new text and its length, in the columns of ``documents``."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.segments(docs, model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(quality.kept_documents(docs.select(*COLUMNS)), F.col("quality.clean_text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(linededup.dedup_lines(docs.select(*COLUMNS)), F.col("lines.kept_text"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    return ngramjoin.one_of_each(docs.select(*COLUMNS), n=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("packing", packing_stage),
]

#: Segment scores, token ids and window places are beyond SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages wrote is deleted once the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
