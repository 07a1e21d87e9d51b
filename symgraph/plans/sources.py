"""Source texts in six languages made from the supplier and part tables, and what scanning them gives.

A supplier is a file and each of its parts a stretch of lines in it. In the
templates {f} stands for the file, {g} for the next one of its language, {p}
for the part and {q} for the one after, which lies in another file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import module_id


@dataclass(frozen=True)
class Template:
    lang: str
    suffix: str
    module: str
    header: str
    lines: str
    # (kind, name, container, first line, last line, signature, doc); lines count from 0 within the stretch.
    symbols: tuple = ()
    # (line, caller, callee)
    calls: tuple = ()
    # (line from 1, module, names, kind, path of the target)
    imports: tuple = ()

    @property
    def size(self) -> int:
        return self.lines.count("\n") + 1

    @property
    def before(self) -> int:
        return self.header.count("\n") + 1


TEMPLATES = [
    Template(
        "python", "py", "src{f}", "import os{f}\nfrom src{g} import a{f}, b{f}",
        "class K{p}:\n    '''Doc of {p}.'''\n    def m{p}(self, a):\n        \"\"\"Says {p}.\"\"\"\n        return h{q}(a) if a else None\ndef g{p}(x, y={p}):\n    return K{p}(x)",
        (("class", "K{p}", "", 0, 4, "", "Doc of {p}."), ("method", "m{p}", "K{p}", 2, 4, "self, a", "Says {p}."), ("function", "g{p}", "", 5, 6, "x, y={p}", "")),
        ((4, "K{p}.m{p}", "h{q}"), (6, "g{p}", "K{p}")),
        ((1, "os{f}", "", "module", ""), (2, "src{g}", "a{f},b{f}", "from", "src{g}.py")),
    ),
    Template(
        "javascript", "js", "src{f}", "import { u{f}, v{f} as w{f} } from './src{g}'\nconst { z{f} } = require('lib{f}')",
        "export class C{p} {\n  run{p}(a, b) {\n    return this.stop{q}(a)\n  }\n}\nexport function f{p}(x) {\n  if (x) { other{q}(x) }\n}\nconst h{p} = (t) => f{p}(t)",
        (("class", "C{p}", "", 0, 4, "", ""), ("method", "run{p}", "C{p}", 1, 4, "a, b", ""), ("function", "f{p}", "", 5, 7, "x", ""), ("function", "h{p}", "", 8, 8, "t", "")),
        ((2, "C{p}.run{p}", "this.stop{q}"), (6, "f{p}", "other{q}"), (8, "h{p}", "f{p}")),
        ((1, "./src{g}", "u{f},v{f},w{f}", "import", "src{g}.js"), (2, "lib{f}", "z{f}", "require", "")),
    ),
    Template(
        "typescript", "ts", "src{f}", "import './src{g}'",
        "export interface I{p} {\n  id: number\n}\nexport type T{p} = string\nexport function f{p}(x: I{p}) {\n  return make{q}(x)\n}",
        (("interface", "I{p}", "", 0, 2, "", ""), ("type", "T{p}", "", 3, 3, "", ""), ("function", "f{p}", "", 4, 6, "x: I{p}", "")),
        ((5, "f{p}", "make{q}"),),
        ((1, "./src{g}", "", "import", "src{g}.ts"),),
    ),
    Template(
        "go", "go", "pkg{f}", 'package pkg{f}\nimport "fmt{f}"\nimport (\n\t"strings{f}"\n)',
        "type S{p} struct {\n}\ntype R{p} interface {\n}\nfunc (s *S{p}) Find{p}(k string) string {\n\treturn low{q}.Up(k)\n}\nfunc Serve{p}(k string) {\n\ttrim{q}(k)\n}",
        (("type", "S{p}", "", 0, 1, "", ""), ("interface", "R{p}", "", 2, 3, "", ""), ("method", "Find{p}", "S{p}", 4, 6, "k string", ""), ("function", "Serve{p}", "", 7, 9, "k string", "")),
        ((5, "S{p}.Find{p}", "low{q}.Up"), (8, "Serve{p}", "trim{q}")),
        # An item of a block is counted from the block's first letter by its place within the brackets.
        ((2, "fmt{f}", "", "module", ""), (3, "strings{f}", "", "module", "")),
    ),
    Template(
        "java", "java", "com.s{f}", "package com.s{f};\nimport java.util.L{f};",
        "public class J{p} {\n    static int add{p}(int a, int b) {\n        return sum{q}(a, b);\n    }\n}",
        (("class", "J{p}", "", 0, 4, "", ""), ("method", "add{p}", "J{p}", 1, 4, "int a, int b", "")),
        ((2, "J{p}.add{p}", "sum{q}"),),
        ((2, "java.util.L{f}", "", "import", ""),),
    ),
    Template(
        "rust", "rs", "src{f}", "use std::fmt{f};\nmod src{g};",
        "pub struct P{p} {\n    x: f64,\n}\npub trait Q{p} {\n    fn area{p}(&self) -> f64 {\n        0.0\n    }\n}\nimpl P{p} {\n    pub fn new{p}() -> f64 {\n        dist{q}(0.0)\n    }\n}\npub fn top{p}(a: f64) -> f64 {\n    a.root{q}()\n}",
        (
            ("type", "P{p}", "", 0, 2, "", ""), ("interface", "Q{p}", "", 3, 12, "", ""), ("method", "area{p}", "Q{p}", 4, 8, "&self", ""),
            ("method", "new{p}", "P{p}", 9, 12, "", ""), ("function", "top{p}", "", 13, 15, "a: f64", ""),
        ),
        ((10, "P{p}.new{p}", "dist{q}"), (14, "top{p}", "a.root{q}")),
        ((1, "std::fmt{f}", "", "use", ""), (2, "src{g}", "", "mod", "src{g}.rs")),
    ),
]


def _filled(template: str, f: Column, p: Column | None = None) -> Column:
    out = F.replace(F.replace(F.lit(template), F.lit("{f}"), f.cast("string")), F.lit("{g}"), (f + len(TEMPLATES)).cast("string"))
    if p is not None:
        out = F.replace(F.replace(out, F.lit("{p}"), p.cast("string")), F.lit("{q}"), (p + 1).cast("string"))
    return out


def _stretches(lines: str) -> Column:
    return F.transform(F.coalesce("ps", F.array().cast("array<bigint>")), lambda p: _filled(lines, F.col("f"), p))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, module, text)."""
    suppliers, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "part"))
    n = F.broadcast(suppliers.agg(F.count("*").alias("n")))  # one row
    held = parts.crossJoin(n).groupBy((F.col("p_partkey") % F.col("n")).alias("f")).agg(F.sort_array(F.collect_list("p_partkey")).alias("ps"))
    named = suppliers.select(F.col("s_suppkey").alias("f"), (F.col("s_suppkey") % len(TEMPLATES)).alias("l"))
    # Texts are far larger than the rows that they are made from, so by those rows' size all would be made in one task.
    each = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "f").join(held, "f", "left")
    path = lang = text = F.lit(None).cast("string")
    for k, t in enumerate(TEMPLATES):
        mine = F.col("l") == k
        text = F.when(mine, F.array_join(F.concat(F.array(_filled(t.header, F.col("f"))), _stretches(t.lines)), "\n")).otherwise(text)
        path, lang = F.when(mine, _filled(f"src{{f}}.{t.suffix}", F.col("f"))).otherwise(path), F.when(mine, t.lang).otherwise(lang)
    made = each.select(path.alias("path"), lang.alias("lang"), text.alias("text"))
    return made.select("path", "lang", module_id(F.col("path"), F.col("lang"), F.col("text")).alias("module"), "text")


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{names.split('(')[0]} AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names.split('(')[1]})"


_FILES = ", ".join(f"({k}, '{t.suffix}', '{t.module}', {t.before}, {t.size})" for k, t in enumerate(TEMPLATES))
#: Files and stretches: k counts a file's parts from 0.
_BASE = f"""
WITH langs AS (SELECT * FROM (VALUES {_FILES}) v(l, suffix, module, before, size)),
files AS (SELECT s_suppkey AS f, s_suppkey % {len(TEMPLATES)} AS l, 'src' || s_suppkey || '.' || suffix AS path, replace(module, '{{f}}', s_suppkey::VARCHAR) AS module, before, size
  FROM supplier JOIN langs ON l = s_suppkey % {len(TEMPLATES)}),
parts AS (SELECT files.*, p_partkey AS p, row_number() OVER (PARTITION BY f ORDER BY p_partkey) - 1 AS k
  FROM part JOIN files ON f = p_partkey % (SELECT count(*) FROM supplier)),
"""


def _put(column: str) -> str:
    return f"replace(replace({column}, '{{p}}', p::VARCHAR), '{{q}}', (p + 1)::VARCHAR)"


SYMBOLS_SQL = _BASE + _values([(k, *s) for k, t in enumerate(TEMPLATES) for s in t.symbols], "t(l, kind, name, outer_name, first, last, signature, doc)") + f"""
SELECT path, kind, {_put("name")} AS name, module || '.' || {_put("CASE WHEN outer_name = '' THEN name ELSE outer_name || '.' || name END")} AS qualname,
  CASE WHEN outer_name = '' THEN '' ELSE module || '.' || {_put("outer_name")} END AS parent,
  CAST(before + k * size + first + 1 AS INTEGER) AS start_line, CAST(before + k * size + last + 1 AS INTEGER) AS end_line, {_put("signature")} AS signature, {_put("doc")} AS doc
FROM parts JOIN t USING (l)"""

#: A call means the symbol of its name in its own file, else the only one of that name.
CALLS_SQL = (
    _BASE
    + _values([(k, *c) for k, t in enumerate(TEMPLATES) for c in t.calls], "t(l, line, caller, callee)")
    + ",\n"
    + _values([(k, *s[1:3]) for k, t in enumerate(TEMPLATES) for s in t.symbols], "named(l, name, outer_name)")
    + f""",
symbols AS (SELECT f, {_put("name")} AS name, module || '.' || {_put("CASE WHEN outer_name = '' THEN name ELSE outer_name || '.' || name END")} AS qualname FROM parts JOIN named USING (l)),
own AS (SELECT f, name, min(qualname) AS target FROM symbols GROUP BY f, name HAVING count(*) = 1),
alone AS (SELECT name, min(qualname) AS target FROM symbols GROUP BY name HAVING count(*) = 1),
found AS (SELECT f, path, CAST(before + k * size + line + 1 AS INTEGER) AS line, module || '.' || {_put("caller")} AS caller_name, {_put("callee")} AS callee FROM parts JOIN t USING (l))
SELECT path, line, caller_name, callee, coalesce(own.target, alone.target) AS target FROM found
LEFT JOIN own ON own.f = found.f AND own.name = regexp_extract(callee, '[^.]*$') LEFT JOIN alone ON alone.name = regexp_extract(callee, '[^.]*$')"""
)

_ASKED = "replace(replace({}, '{{f}}', files.f::VARCHAR), '{{g}}', (files.f + %d)::VARCHAR)" % len(TEMPLATES)
IMPORTS_SQL = _BASE + _values([(k, *i) for k, t in enumerate(TEMPLATES) for i in t.imports], "t(l, line, asked, names, kind, target)") + f"""
SELECT files.path, {_ASKED.format("asked")} AS module, replace(names, '{{f}}', files.f::VARCHAR) AS names, kind, CAST(line AS INTEGER) AS line, other.path AS target
FROM files JOIN t ON t.l = files.l LEFT JOIN files other ON other.path = {_ASKED.format("t.target")}"""

# ---------------------------------------------------------------- imports in all languages

#: Files by language and folder, each with imports of the next file of its language, of a neighbour in another one, and of nothing.
LINKED_VIEWS = f"""
WITH n AS (SELECT max(s_suppkey) AS n FROM supplier),
langs AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{t.lang}', '{t.suffix}')" for k, t in enumerate(TEMPLATES))}) v(l, lang, suffix)),
files AS (SELECT s_suppkey AS id, 'd' || CAST(s_suppkey % 2 AS STRING) || '/src' || CAST(s_suppkey AS STRING) || '.' || suffix AS path, lang,
  'd' || CAST(s_suppkey % 2 AS STRING) || '.src' || CAST(s_suppkey AS STRING) AS module, s_suppkey + {len(TEMPLATES)} AS g FROM supplier JOIN langs ON l = s_suppkey % {len(TEMPLATES)}),
asked AS (
  SELECT id AS file_id, CASE lang WHEN 'python' THEN '.src' || CAST(g AS STRING) WHEN 'javascript' THEN './src' || CAST(g AS STRING) WHEN 'typescript' THEN './src' || CAST(g AS STRING) || '.ts'
    WHEN 'rust' THEN 'src' || CAST(g AS STRING) || '::Thing' ELSE 'd' || CAST(g % 2 AS STRING) || '.src' || CAST(g AS STRING) END AS module, CASE WHEN g <= n THEN g END AS target_id, 1 AS line FROM files, n
  UNION ALL
  SELECT id, CASE lang WHEN 'python' THEN 'd' || CAST(g % 2 AS STRING) || '.src' || CAST(g AS STRING) ELSE '../d' || CAST((id + 1) % 2 AS STRING) || '/src' || CAST(id + 1 AS STRING) END,
    CASE WHEN lang = 'python' AND g <= n THEN g WHEN lang IN ('javascript', 'typescript') AND id + 1 <= n THEN id + 1 END, 2 FROM files, n WHERE lang IN ('python', 'javascript', 'typescript', 'go')
  UNION ALL
  SELECT id, CASE lang WHEN 'rust' THEN 'std::src' || CAST(g AS STRING) WHEN 'python' THEN '...src' || CAST(g AS STRING) WHEN 'java' THEN 'gone.Thing' ELSE '../../../src' || CAST(g AS STRING) END, NULL, 3 FROM files
)
"""
LINKED_SQL = LINKED_VIEWS.replace("AS STRING", "AS VARCHAR") + "SELECT file_id, module, target_id, CAST(line AS INTEGER) AS line FROM asked"


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, imports) of the stand-in in all languages; targets are for the resolver to find."""
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("supplier")
    files = spark.sql(LINKED_VIEWS + "SELECT id, path, lang, module FROM files")
    return files, spark.sql(LINKED_VIEWS + "SELECT file_id, module, CAST(line AS INT) AS line FROM asked")


#: Each Python file lists the next one as a member of its own package.
RELATIVE_SQL = LINKED_VIEWS.replace("AS STRING", "AS VARCHAR") + f"""
SELECT path, '.' AS module, 4 AS line FROM files WHERE lang = 'python' AND g = (SELECT min(id) FROM files WHERE lang = 'python') + {len(TEMPLATES)}"""


def relative_imports(files: DataFrame) -> DataFrame:
    own = files.where("lang = 'python'").select(F.col("id").alias("file_id"), (F.col("id") + len(TEMPLATES)).alias("g"))
    return own.select("file_id", F.lit(".").alias("module"), F.lit(None).cast("long").alias("target_id"), F.array(F.concat(F.lit("src"), F.col("g").cast("string"))).alias("names"), F.lit("from").alias("kind"), F.lit(4).alias("line"))
