"""Scanning works out each of its tables once."""

from pyspark.sql import functions as F

from symgraph.operators import scan
from symgraph.plans import sources


def test_symbols_are_named_once(spark, sf_dir):
    found = scan.symbols(sources.files(spark, sf_dir))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Each read of the lines' or the symbols' table is one relation of the plan.
    assert plan.count("Relation [") < 40, plan.count("Relation [")


def test_texts_are_made_by_several_tasks(spark, sf_dir):
    tasks = sources.files(spark, sf_dir).select(F.length("text").alias("n"), F.spark_partition_id().alias("task"))
    assert tasks.groupBy("task").agg(F.sum("n")).count() > 1
