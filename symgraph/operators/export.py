"""Exports of an index: JSON documents and Graphviz source, as rows of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot_escape
from .graph import Index


#: The order of each exported table.
ORDER = {"files": ["path"], "symbols": ["qualname", "file", "start_line"], "calls": ["file", "line", "callee", "caller"], "imports": ["file", "line", "module"]}


def json_tables(index: Index) -> dict[str, DataFrame]:
    """The exported tables."""
    files, paths = index.files, index.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    targets = files.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"))
    symbols = index.symbols.join(paths, "file_id")
    calls = index.calls.join(paths, "file_id")
    imports = index.imports.join(paths, "file_id").join(targets, "target_id", "left")
    return {
        "files": files.select("path", "lang", "module", "lines"),
        "symbols": symbols.select("qualname", "name", "kind", "parent", "start_line", "end_line", "signature", "file"),
        "calls": calls.select(F.col("caller_name").alias("caller"), "callee", "callee_id", "line", "file"),
        "imports": imports.select("module", "kind", "line", "file", "target_path"),
    }


def json_sections(index: Index) -> dict[str, DataFrame]:
    """The exported tables, each in a fixed order."""
    return {name: rows.orderBy(*ORDER[name]) for name, rows in json_tables(index).items()}


def json_rows(index: Index) -> DataFrame:
    """(section, json): one row for each exported record, in no order."""
    parts = [
        rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
        for name, rows in json_tables(index).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def write_json(index: Index, path: str) -> None:
    """One folder of JSON lines for each section."""
    for name, rows in json_sections(index).items():
        rows.write.json(f"{path}/{name}")


def dot_rows(index: Index) -> DataFrame:
    """(section, a, b, line): the statements of a Graphviz digraph; sorted by the first three columns they read in order."""
    text = lambda template, *cols: F.format_string(template, *cols)

    def rows(df: DataFrame, section: int, a: Column, b: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), a.cast("long").alias("a"), b.cast("long").alias("b"), line.alias("line"))

    one = index.files.sparkSession.range(1)
    zero = F.lit(0)
    held = index.symbols.select("file_id").distinct().join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    node = text('    n%d [label="%s" kind="%s"];', F.col("id"), dot_escape(F.col("qualname")), dot_escape(F.col("kind")))
    calls = index.calls.where("caller_id IS NOT NULL")
    known, unknown = calls.where("callee_id IS NOT NULL"), calls.where("callee_id IS NULL")
    parts = [
        rows(one, 0, zero, zero, F.lit("digraph symgraph {")),
        rows(held, 1, F.col("file_id"), F.lit(-1), text('  subgraph cluster_%d { label="%s";', F.col("file_id"), dot_escape(F.col("path")))),
        rows(index.symbols, 1, F.col("file_id"), F.col("id"), node),
        rows(held, 1, F.col("file_id"), F.lit(2**62), F.lit("  }")),
        rows(known, 2, F.col("caller_id"), F.col("callee_id"), text("  n%d -> n%d;", F.col("caller_id"), F.col("callee_id"))),
        rows(unknown, 3, F.col("caller_id"), zero, text('  n%d -> "%s" [style=dashed];', F.col("caller_id"), dot_escape(F.col("callee")))),
        rows(
            index.imports.where("target_id IS NOT NULL"), 4, F.col("file_id"), F.col("target_id"),
            text('  f%d -> f%d [label="%s" style=dotted];', F.col("file_id"), F.col("target_id"), dot_escape(F.col("module"))),
        ),
        rows(one, 5, zero, zero, F.lit("}")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_dot(index: Index, path: str) -> None:
    """The graph as text files whose parts, in order, are one Graphviz source."""
    dot_rows(index).orderBy("section", "a", "b", "line").select("line").write.text(path)
