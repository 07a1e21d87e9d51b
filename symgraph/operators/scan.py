"""Extraction of symbols, calls and imports from source texts.

Texts are taken apart into lines, and everything else is windows, joins and
aggregations within a path: running sums give brace depths, a container's
reach ends where the depth first falls back, a declaration's qualified name
lists the containers around it, and a call belongs to the innermost span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import NOT_METHODS
from ..functions.patterns import DECLARATIONS, HEADERS, IMPORTS, Declaration
from ..functions.text import blank, call_sites, count_of, indent, is_call, line_of, lines, strip
from ..scratch import cut
from .intervals import enclosing, nearest_before, next_at_most

BRACES = ("javascript", "typescript", "java", "rust")
QUOTES = ('"""', "'''")
SYMBOLS_FOUND = "path string, kind string, name string, qualname string, parent string, start_line int, end_line int, signature string, doc string"
IMPORTS_FOUND = "path string, rank int, offset int, module string, names array<string>, kind string, line int"


def source_lines(files: DataFrame) -> DataFrame:
    """(path, lang, module, n_lines, line, text): one row for each line of each file."""
    split = files.select("path", "lang", "module", lines(F.coalesce("text", F.lit(""))).alias("all"))
    return split.select("path", "lang", "module", F.size("all").alias("n_lines"), F.posexplode("all").alias("at", "text")).select(
        "path", "lang", "module", "n_lines", (F.col("at") + 1).alias("line"), "text"
    )


def _declared(d: Declaration, lang: str, text: Column) -> Column:
    """A struct of what the line declares by ``d``, null if it does not match."""
    line = F.substring_index(text, "//", 1) if d.kind == "method" and lang in ("javascript", "typescript") else text
    pattern = "(?U)" + d.pattern
    group = lambda k: F.regexp_extract(line, pattern, k) if k else F.lit("")
    matches = line.rlike(pattern)
    if d.reserved:
        matches &= ~group(d.name).isin(*NOT_METHODS)
    if d.first_word:
        matches &= ~F.element_at(F.split(F.ltrim(group(d.first_word)), r"\s+"), 1).isin(*d.not_first)
    return F.when(
        matches,
        F.struct(
            F.lit(d.kind).alias("kind"), group(d.name).alias("name"), (strip(group(d.signature)) if d.trim else group(d.signature)).alias("signature"), group(d.owner).alias("owner"),
            F.lit(d.container).alias("container"), F.lit(d.symbol).alias("symbol"), F.lit(d.nested).alias("nested"),
        ),
    )


def languages_of(files: DataFrame) -> list[str]:
    """The languages among files; the patterns of others need not be planned."""
    return sorted(r["lang"] for r in files.select("lang").distinct().collect() if r["lang"])


def declaration(lang: Column, text: Column, langs: list[str]) -> Column:
    found = F.lit(None)
    for name, patterns in DECLARATIONS.items():
        if name not in langs:
            continue
        found = F.when(lang == name, F.coalesce(*[_declared(d, name, text) for d in patterns])).otherwise(found)
    return found


def call_text(lang: Column, text: Column, langs: list[str]) -> Column:
    """The part of a line in which calls are looked for."""
    body = F.substring(text, F.locate("{", text) + 1, F.length(text))
    braced = F.locate("{", text) > 0
    found = text
    for name, patterns in HEADERS.items():
        if name not in langs:
            continue
        rest = [F.when(text.rlike("(?U)" + p), F.regexp_replace(text, "(?U)" + p, "")) for p in patterns]
        if name == "python":
            part = F.coalesce(*rest, text)
        elif name in ("javascript", "typescript"):
            header = reduce(lambda a, b: a | b, [text.rlike("(?U)" + p) for p in patterns])
            part = F.when(header & braced, body).otherwise(F.coalesce(*rest, text))
        else:
            part = F.when(braced, body).otherwise(F.coalesce(*rest, text))
        found = F.when(lang == name, part).otherwise(found)
    return found


def nesting(table: DataFrame) -> DataFrame:
    """The lines with their nesting level before (``level``) and after (``after``) them.

    Braces count in brace languages, indentation in Python; Go is flat.
    """
    step = F.when(F.col("lang").isin(*BRACES), count_of(F.col("text"), "{") - count_of(F.col("text"), "}")).otherwise(0)
    order = Window.partitionBy("path").orderBy("line")
    total = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    deep = table.withColumn("step", step).withColumn("after", total.cast("int")).withColumn("level", (F.col("after") - F.col("step")).cast("int"))
    return deep.withColumn("level", F.when(F.col("lang") == "python", indent(F.col("text"))).otherwise(F.col("level")))


def container_reach(deep: DataFrame) -> DataFrame:
    """(path, from_line, last, name, kind): lines after ``from_line`` up to ``last`` lie in the container."""
    held = deep.where("d.container").select("path", "lang", "line", "level", "d.name", "d.kind")
    braces = held.where(F.col("lang") != "python")
    # The depth falls back to a container's own only on its first line or where braces close.
    stops = deep.where((F.col("step") < 0) | F.col("d.container")).select("path", "line", F.col("after").alias("level"))
    closed = next_at_most(braces, stops, ["path"], "line", "level", "last", inclusive=True)
    dents = held.where(F.col("lang") == "python")
    left = next_at_most(dents, dents.select("path", "line", "level"), ["path"], "line", "level", "stop").withColumn("last", F.col("stop") - 1)
    both = closed.select("path", "line", "last", "name", "kind").unionByName(left.select("path", "line", "last", "name", "kind"))
    return both.select("path", F.col("line").alias("from_line"), "last", F.col("name").alias("outer"), F.col("kind").alias("outer_kind"))


def docstrings(deep: DataFrame) -> DataFrame:
    """(path, line, doc): the first line of the docstring below each Python declaration."""
    python = deep.where(F.col("lang") == "python")
    back = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    filled = lambda value: F.last(F.when(~blank(F.col("text")), value), ignorenulls=True).over(back)
    one = python.withColumn("below", filled(F.col("text")))
    two = one.withColumn("two_below", filled(F.coalesce("below", F.lit("")))).where("d IS NOT NULL")
    first = F.regexp_replace("below", r"(?U)^\s+", "")
    doc = F.lit("")
    for quote in QUOTES:
        body = F.substring(first, F.lit(len(quote) + 1), F.length(first))
        here, below = F.substring_index(body, quote, 1), F.substring_index(F.col("two_below"), quote, 1)
        text = F.when(body.contains(quote) | ~blank(body), strip(here)).otherwise(strip(F.coalesce(below, F.lit(""))))
        doc = F.when(first.startswith(quote), text).otherwise(doc)
    return two.select("path", "line", doc.alias("doc"))


def symbols(files: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """(path, kind, name, qualname, parent, start_line, end_line, signature, doc)."""
    langs = languages_of(files) if langs is None else langs
    if not langs:
        return files.sparkSession.createDataFrame([], SYMBOLS_FOUND)
    # Six branches read the lines, so their patterns and sums are worked out once.
    deep = cut(nesting(source_lines(files)).withColumn("d", declaration(F.col("lang"), F.col("text"), langs)), "scan-lines")
    items = deep.where("d.symbol").select("path", "lang", "module", "n_lines", "line", "level", "d")
    around = items.join(container_reach(deep), "path").where((F.col("from_line") < F.col("line")) & (F.col("line") <= F.coalesce("last", F.lit(2**31 - 1))))
    outers = around.groupBy("path", "line").agg(F.sort_array(F.collect_list(F.struct("from_line", "outer", "outer_kind"))).alias("outers"))
    held = items.join(outers, ["path", "line"], "left").withColumn("outers", F.coalesce("outers", F.array().cast(outers.schema["outers"].dataType)))
    held = held.where(~F.col("d.nested") | (F.size("outers") > 0))

    prefix = F.when(F.col("module") != "", F.array("module")).otherwise(F.array().cast("array<string>"))
    inner = F.when(F.col("d.owner") != "", F.array("d.owner")).otherwise(F.transform("outers", lambda o: o["outer"]))
    last_outer = F.try_element_at(F.col("outers"), F.lit(-1))["outer_kind"]
    kind = F.when((F.col("lang") == "python") & (F.col("d.kind") == "function") & (last_outer == "class"), "method").when(
        (F.col("lang") == "rust") & (F.col("d.kind") == "function") & (F.size("outers") > 0), "method"
    ).otherwise(F.col("d.kind"))
    # Nearly every step below asks for these rows several times, and so would find the containers around them each time.
    named = cut(held.select(
        "path", "lang", "n_lines", "line", "level", kind.alias("kind"), F.col("d.name").alias("name"), F.col("d.signature").alias("signature"),
        F.when(F.size(inner) > 0, F.array_join(F.concat(prefix, inner), ".")).otherwise("").alias("parent"),
        F.array_join(F.concat(prefix, inner, F.array("d.name")), ".").alias("qualname"),
    ), "scan-named")

    braced = named.where(F.col("lang") != "python")
    braced = next_at_most(braced, braced.select("path", "line", "level"), ["path"], "line", "level", "stop")
    # A Python body ends before the first line of code that is not indented deeper than its header.
    code = deep.where((F.col("lang") == "python") & ~blank(F.col("text")) & ~F.ltrim("text").startswith("#")).select("path", "line", "level")
    lag = F.lag("level").over(Window.partitionBy("path").orderBy("line"))
    code = code.withColumn("above", lag).where("above IS NULL OR level <= above").drop("above")
    dented = next_at_most(named.where(F.col("lang") == "python"), code, ["path"], "line", "level", "stop")
    ended = braced.unionByName(dented).withColumn("end_line", F.coalesce(F.col("stop") - 1, F.col("n_lines")).cast("int"))
    told = ended.join(docstrings(deep), ["path", "line"], "left")
    return told.select("path", "kind", "name", "qualname", "parent", F.col("line").alias("start_line"), "end_line", "signature", F.coalesce("doc", F.lit("")).alias("doc"))


def calls(files: DataFrame, found: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """(path, line, place, caller_name, callee) given the symbols found in the files."""
    langs = languages_of(files) if langs is None else langs
    table = source_lines(files)
    sites = table.select("path", "lang", "line", F.posexplode(call_sites(call_text(F.col("lang"), F.col("text"), langs))).alias("place", "callee"))
    sites = sites.where(is_call(F.col("callee"), F.col("lang"))).drop("lang")
    placed = enclosing(sites, found, ["path"], "line", "start_line", "end_line", "qualname", "caller_name")
    return placed.select("path", "line", "place", F.coalesce("caller_name", F.lit("")).alias("caller_name"), "callee")


def located(table: DataFrame, keys: list[str], pattern: str, text: str = "text") -> DataFrame:
    """All matches of a pattern with their line and offset: (keys, match, line, offset).

    The text between matches is summed up in order, so every place is exact
    even for patterns that span lines.
    """
    both = table.select(*keys, F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    # One text between matches goes along with each match; the last one is left out.
    pairs = F.arrays_zip(F.slice("gaps", F.lit(1), F.size("hits")).alias("gap"), F.col("hits").alias("match"))
    rows = both.select(*keys, F.posexplode(pairs).alias("k", "pair")).select(*keys, "k", "pair.gap", "pair.match")
    order = Window.partitionBy(*keys).orderBy("k")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda f: F.sum(f("gap") + f("match")).over(upto) - f("match")
    lined = rows.withColumn("line", (before(lambda c: newlines(F.col(c))) + 1).cast("int"))
    return lined.withColumn("offset", before(lambda c: F.length(c)).cast("int")).select(*keys, "match", "line", "offset")


def _listed(names: Column) -> Column:
    return F.filter(F.transform(F.split(names, ","), strip), lambda x: x != "")


def imports(files: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """(path, rank, offset, module, names, kind, line); rank and offset give the order in a file."""
    langs = languages_of(files) if langs is None else langs
    none = F.array().cast("array<string>")
    of = lambda *langs: files.where(F.col("lang").isin(*langs) & F.col("text").isNotNull())
    hits = lambda key, *langs: located(of(*langs), ["path"], IMPORTS[key])
    part = lambda key, k: F.regexp_extract("match", IMPORTS[key], k)

    def rows(found: DataFrame, rank: int, module: Column, names: Column, kind: str) -> DataFrame:
        return found.select("path", F.lit(rank).alias("rank"), "offset", module.alias("module"), names.alias("names"), F.lit(kind).alias("kind"), "line")

    parts = []
    if "python" in langs:
        parts.append(rows(hits("python_module", "python"), 0, part("python_module", 1), none, "module"))
        parts.append(rows(hits("python_from", "python"), 1, part("python_from", 1), _listed(F.btrim(part("python_from", 2), F.lit("()"))), "from"))
    js = ("javascript", "typescript")
    if set(js) & set(langs):
        clause = F.filter(F.regexp_extract_all(part("js_import", 1), F.lit(IMPORTS["js_name"]), F.lit(0)), lambda x: x != "as")
        bindings = hits("js_binding", *js).select("path", "offset", part("js_binding", 1).alias("bound"))
        required = nearest_before(hits("js_require", *js), bindings, ["path"], "offset", "bound", "bound")
        parts.append(rows(hits("js_import", *js), 0, part("js_import", 2), clause, "import"))
        parts.append(rows(required, 1, part("js_require", 1), F.coalesce(_listed(F.col("bound")), none), "require"))
    if "go" in langs:
        singles = rows(hits("go_single", "go"), 0, part("go_single", 1), none, "module")
        blocks = hits("go_block", "go").select("path", F.col("offset").alias("start"), part("go_block", 1).alias("inner"))
        items = located(blocks, ["path", "start"], IMPORTS["go_item"], "inner").withColumn("offset", F.col("start") + F.col("offset"))
        # An item's line is counted from the block's start by its offset within the brackets.
        items = items.join(of("go").select("path", "text"), "path").withColumn("line", line_of(F.col("text"), F.col("offset")).cast("int"))
        grouped = rows(items, 1, part("go_item", 1), none, "module").join(singles.select("path", "module").distinct(), ["path", "module"], "left_anti")
        parts += [singles, grouped.select(*singles.columns)]
    if "java" in langs:
        parts.append(rows(hits("java_import", "java"), 0, part("java_import", 1), none, "import"))
    if "rust" in langs:
        parts.append(rows(hits("rust_mod", "rust"), 0, part("rust_mod", 1), none, "mod"))
        parts.append(rows(hits("rust_use", "rust"), 1, F.rtrim(strip(F.substring_index(part("rust_use", 1), "::{", 1)), F.lit(";")), none, "use"))
    return reduce(DataFrame.unionByName, parts) if parts else files.sparkSession.createDataFrame([], IMPORTS_FOUND)
