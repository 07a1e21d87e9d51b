"""Scanning rules that the fixture tree does not show."""

from pyspark.sql import functions as F

from symgraph.functions.languages import language, module_id
from symgraph.functions.text import call_sites, glob_regex, last_segment, line_count, lines
from symgraph.operators import scan


def tree(spark, sources):
    rows = spark.createDataFrame(list(sources.items()), "path string, text string").withColumn("lang", language(F.col("path")))
    return rows.select("path", "lang", module_id(F.col("path"), F.col("lang"), F.col("text")).alias("module"), "text")


def found(spark, path, text):
    return [tuple(r) for r in scan.symbols(tree(spark, {path: text})).orderBy("start_line").select("kind", "qualname", "start_line", "end_line").collect()]


def test_python_nesting_ignores_undeclared_dedents(spark):
    source = "class A:\n    def one(self):\n        pass\n\nif True:\n    def two():\n        pass\n"
    assert found(spark, "m.py", source) == [("class", "m.A", 1, 4), ("method", "m.A.one", 2, 4), ("method", "m.A.two", 6, 7)]


def test_python_nested_class_and_decorator(spark):
    source = "class Outer:\n    class Inner:\n        @wrap\n        def deep(self):\n            return 1\n# end\n"
    assert found(spark, "pkg/__init__.py", source) == [("class", "pkg.Outer", 1, 6), ("class", "pkg.Outer.Inner", 2, 6), ("method", "pkg.Outer.Inner.deep", 4, 6)]


def test_class_without_brace_on_its_line_holds_nothing(spark):
    source = "class A\n{\n  go() {\n  }\n}\n"
    assert found(spark, "a.js", source) == [("class", "a.A", 1, 5)]


def test_calls_outside_all_spans_have_no_caller(spark):
    files = tree(spark, {"a.py": "def f():\n    g()\nif f(1):\n    print(f(2))\n"})
    rows = scan.calls(files, scan.symbols(files)).orderBy("line", "place").collect()
    assert [(r["line"], r["caller_name"], r["callee"]) for r in rows] == [(2, "a.f", "g"), (3, "", "f"), (4, "", "print"), (4, "", "f")]


def test_empty_and_blank_files(spark):
    files = tree(spark, {"a.py": "", "b.go": "\n\n", "c.rs": "   "})
    symbols = scan.symbols(files)
    assert symbols.count() == scan.calls(files, symbols).count() == scan.imports(files).count() == 0


def test_package_only_counts_at_the_top(spark):
    files = tree(spark, {"x/A.java": "// licence\npackage com.a;\n", "x/B.java": "\n package com.b;\n", "x/c.go": "package c\n"})
    assert {r["path"]: r["module"] for r in files.collect()} == {"x/A.java": "x/A", "x/B.java": "com.b", "x/c.go": "c"}


def test_lines_break_like_text_lines(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\n"
    row = spark.createDataFrame([(text,), ("",)], "t string").select(lines(F.col("t")).alias("l"), line_count(F.col("t")).alias("n")).collect()
    assert row[0]["l"] == text.splitlines() and [r["n"] for r in row] == [8, 0]


def test_call_chains_and_segments(spark):
    row = spark.createDataFrame([("x = a.b(c::d(1)) + $e (2) + é(3)",)], "t string").select(call_sites(F.col("t")).alias("c")).first()
    assert row["c"][:3] == ["a.b", "c::d", "$e"]
    names = spark.createDataFrame([("a::b.c",), ("x",), ("p.q::r",)], "n string").select(last_segment(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in names] == ["c", "x", "r"]


def test_globs():
    import fnmatch
    import re

    for pattern in ("*.min.js", "a?c", "[ab]*", "[!a]b", "x/**/y", "[", "a.b"):
        for name in ("q.min.js", "abc", "bcd", "cb", "ab", "x/1/2/y", "[", "a.b", "axb"):
            assert bool(re.match(glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def test_scanned_calls_and_imports_are_linked(spark, sf_dir):
    from symgraph.plans.queries import QUERIES

    calls = {(r["path"], r["callee"]): r["target"] for r in QUERIES["scan_calls"](spark, sf_dir).collect()}
    assert calls["src1.js", "other2"] is None and calls["src0.py", "K10"] == "src0.K10" and calls["src0.py", "h1"] == "src1.h1"
    targets = {r["module"]: r["target"] for r in QUERIES["scan_imports"](spark, sf_dir).where("path = 'src1.js'").collect()}
    assert targets == {"./src7": "src7.js", "lib1": None}
