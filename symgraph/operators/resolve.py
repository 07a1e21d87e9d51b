"""Linking of imports to files and of calls to symbols, as joins.

Every rule yields candidates with a priority, and the least priority wins. A
rule that asks for a unique name yields nothing when the name is ambiguous, so
the next rule decides. Uniqueness is counted before joining, so a name that
occurs everywhere costs one row, not one for each pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import ALL_EXTENSIONS, IMPORT_EXTENSIONS, extension
from ..functions.text import last_segment, normalize_path
from ..scratch import cut, temporary

#: Languages in which files of one module share names without imports.
FAMILIES = ("java", "go", "javascript", "typescript")
_RELATIVE = ("javascript", "typescript", "rust")
#: A name that more files than this hold is looked for file by file.
HELD_BY_MANY = 16


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _under(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat_ws("/", base, name))


def _dots(module: Column) -> Column:
    return F.length(module) - F.length(F.ltrim(module, F.lit(".")))


def candidate_paths(path: Column, lang: Column, module: Column, langs: list[str]) -> Column:
    """Paths that an import may mean, best first; only rules of the languages named are planned."""
    own = folder(path)
    with_ext = lambda base, exts: F.array(*[F.concat(base, F.lit(e)) for e in exts])

    # "./x" and "../x": the path itself if it has a suffix, then with each known suffix in its place.
    target = normalize_path(_under(own, module))
    bare = F.when(extension(target) != "", F.regexp_replace(target, r"\.[^./]+$", "")).otherwise(target)
    relative = F.lit(None).cast("array<string>")
    for name in sorted(set(_RELATIVE) & set(langs)):
        order = IMPORT_EXTENSIONS[name] + [e for e in ALL_EXTENSIONS if e not in IMPORT_EXTENSIONS[name]]
        tried = with_ext(bare, order)
        found = F.when(extension(target) != "", F.concat(F.array(target), tried)).otherwise(tried)
        relative = F.when(lang == name, F.when(target != "", found)).otherwise(relative)

    # Python: leading dots climb from the file's folder; other modules are tried in every folder above the file.
    steps = F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, "/"))
    level = _dots(module)
    base = F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - (level - 1), F.lit(0))), "/")
    tail = F.replace(F.ltrim(module, F.lit(".")), F.lit("."), F.lit("/"))
    dotted = F.when(tail == "", base).otherwise(_under(base, tail))
    package = F.concat(_under(dotted, F.lit("__init__.py")))
    from_dots = F.when(dotted == "", F.array(package)).otherwise(F.array(F.concat(dotted, F.lit(".py")), package))
    name = F.replace(module, F.lit("."), F.lit("/"))
    climbing = F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    absolute = F.flatten(F.transform(climbing, lambda up: F.array(F.concat(_under(up, name), F.lit(".py")), F.concat(_under(up, name), F.lit("/__init__.py")))))

    first = F.element_at(F.split(module, "::"), 1)
    rust = F.when(
        ~first.isin("std", "core", "alloc"), F.array(_under(own, F.concat(first, F.lit(".rs"))), _under(own, F.concat(first, F.lit("/mod.rs"))))
    )
    other = F.lit(None).cast("array<string>")
    for known in sorted({"javascript", "typescript", "go", "java"} & set(langs)):
        tried = with_ext(name, IMPORT_EXTENSIONS[known])
        other = F.when(lang == known, F.concat(tried, F.array(F.concat(name, F.lit("/main.go")))) if known == "go" else tried).otherwise(other)

    is_relative = module.startswith("./") | module.startswith("../")
    found = F.when(module == "", None).when(module.startswith("./") | module.startswith("../"), relative)
    if "python" in langs:
        found = found.when((lang == "python") & module.startswith("."), from_dots).when(lang == "python", absolute)
    if "rust" in langs:
        found = found.when(lang == "rust", rust)
    return found.when(F.replace(module, F.lit("."), F.lit("")) == "", None).otherwise(other)


def tried_paths(imports: DataFrame, files: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """(file_id, module, place, tried): the paths that each import may mean, the best first."""
    langs = list(IMPORT_EXTENSIONS) if langs is None else langs
    asked = imports.select("file_id", "module").distinct().join(files.select(F.col("id").alias("file_id"), "path", "lang"), "file_id")
    tried = asked.select("file_id", "module", F.posexplode(candidate_paths(F.col("path"), F.col("lang"), F.col("module"), langs)).alias("place", "tried"))
    return tried.withColumn("tried", normalize_path(F.col("tried")))


def resolve_imports(imports: DataFrame, files: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """``imports`` (with file_id and module) with ``target_id``, null where no file fits."""
    tried = tried_paths(imports, files) if tried is None else tried
    hit = tried.join(files.select(F.col("path").alias("tried"), F.col("id").alias("hit")), "tried")
    target = hit.groupBy("file_id", "module").agg(F.min_by("hit", "place").alias("target_id"))
    return imports.drop("target_id").join(target, ["file_id", "module"], "left")


def wanted_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (file_id, module): modules that the names listed by an import may be."""
    own = files.select(F.col("id").alias("file_id"), "path", F.col("module").alias("own"))
    named = imports.where(F.size("names") > 0).select("file_id", "module", F.explode("names").alias("name")).join(own, "file_id")
    # A relative import starts at the package of the file; what follows its dots plays no part.
    parts = F.split("own", r"\.")
    depth = F.when(F.col("path").endswith("__init__.py"), F.size(parts)).otherwise(F.size(parts) - 1) - (_dots(F.col("module")) - 1)
    package = F.array_join(F.slice(parts, F.lit(1), F.greatest(depth, F.lit(0))), ".")
    base = F.when(F.col("module").startswith("."), package).otherwise(F.col("module"))
    full = F.when(base == "", F.col("name")).otherwise(F.concat_ws(".", base, "name"))
    return named.select("file_id", F.explode(F.array(full, F.concat(full, F.lit(".__init__")))).alias("module")).distinct()


def reachable_files(imports: DataFrame, files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Distinct (file_id, reach): files that a file imports, and submodules it imports by name."""
    direct = imports.where(F.col("target_id").isNotNull()).select("file_id", F.col("target_id").alias("reach"))
    wanted = wanted_modules(imports, files) if wanted is None else wanted
    first = files.groupBy("module").agg(F.min("id").alias("reach"))
    return direct.unionByName(wanted.join(first, "module").select("file_id", "reach")).distinct()


def _by_file(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, those of a file in one task.

    What one part tells the others about a file and something more is then read
    by windows, which need no other exchange; a join on both would have one.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("file_id")


def _over_reach(asked: DataFrame, held: DataFrame, reach: DataFrame, name: str) -> DataFrame:
    """(file_id, callee, n, pick): the symbols under ``name`` in all files that each asking file reaches.

    ``held`` has one row (file_id, name, n, pick) for each file and name. A name
    that few files hold is looked up there first, and the files that hold it
    are then sought among those reached. For names that many files hold, the
    files reached come first: from file to file go either the names asked for
    in the one or those held in the other, whichever are fewer, and each only
    once for all calls that ask for it.
    """
    columns = ["file_id", name, "n", "pick"]
    files = cut(held.groupBy(name).agg((F.count("*") > HELD_BY_MANY).alias("many")), "resolve-holders")
    known = asked.select("file_id", name).repartition(name).distinct().join(files, name)
    at = held.select(F.col("file_id").alias("reach"), name, "n", "pick").join(files, name)
    found = known.where("NOT many").join(at.where("NOT many"), name).join(reach, ["file_id", "reach"], "left_semi").select(*columns)
    if not files.where("many").isEmpty():
        wanted, there = known.where("many").select("file_id", name), at.where("many").drop("many")
        ways = reach.join(wanted.groupBy("file_id").agg(F.count("*").alias("asks")), "file_id")
        ways = cut(ways.join(there.groupBy("reach").agg(F.count("*").alias("holds")), "reach"), "resolve-ways")
        sent = ways.where("asks < holds").join(wanted, "file_id").join(there, ["reach", name])
        fetched = ways.where("asks >= holds").join(there, "reach")
        found = found.unionByName(sent.select(*columns)).unionByName(fetched.select(*columns))
    summed = found.groupBy("file_id", name).agg(F.sum("n").alias("n"), F.min("pick").alias("pick"))
    return asked.select(*dict.fromkeys(["file_id", "callee", name])).join(summed, ["file_id", name]).select("file_id", "callee", "n", "pick")


def resolve_calls(calls: DataFrame, symbols: DataFrame, files: DataFrame, reach: DataFrame) -> DataFrame:
    """``calls`` with ``caller_id`` and ``callee_id``.

    Rules, best first: a symbol of the same file by qualified name, then by
    unique name; of a reachable file by qualified name, then by unique name
    over all of them; of another file of the same module by unique name; of
    the whole index by unique name. Ties go to the lowest id. Rules that look
    beyond the file see only the calls that the file itself left open.

    Texts asked for are sent once, to the names that symbols have; what no
    symbol has goes no further, and the rest goes on by numbers of names. The
    calls themselves are sent once, by file, to the answers.
    """
    with temporary(calls.sparkSession) as lasting:
        best, callers = _answers(calls, symbols, files, reach)
        best, callers = lasting(best, "resolve-best"), lasting(callers, "resolve-callers")
    given = calls.drop("caller_id", "callee_id")
    told = _by_file(given.withColumn("__call", F.lit(True)), best, callers)
    told = told.withColumn("callee_id", F.max("callee_id").over(Window.partitionBy("file_id", "callee")))
    told = told.withColumn("caller_id", F.max("caller_id").over(Window.partitionBy("file_id", "caller_name")))
    return told.where("__call").select(*given.columns, "callee_id", "caller_id")


def _answers(calls: DataFrame, symbols: DataFrame, files: DataFrame, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, callee, callee_id) for the texts that have an answer, and (file_id, caller_name, caller_id)."""
    lang = files.select(F.col("id").alias("file_id"), "lang", "module")
    placed = cut(symbols.select("id", "file_id", "name", "qualname").join(lang.select("file_id", "module"), "file_id"), "resolve-symbols")

    # Numbers of names and of qualified names; they are stored, so they are the same wherever they are read.
    alone = F.when(F.count("*") == 1, F.min("id")).alias("anywhere")
    names = cut(placed.where("name <> ''").groupBy("name").agg(alone).withColumn("n_id", F.monotonically_increasing_id()), "resolve-names")
    texts = placed.select(F.col("qualname").alias("callee")).where("callee IS NOT NULL").distinct()
    texts = cut(texts.withColumn("q_id", F.monotonically_increasing_id()), "resolve-texts")
    held = placed.join(names.select("name", "n_id"), "name", "left").join(texts.withColumnRenamed("callee", "qualname"), "qualname", "left")
    held = cut(held.select("id", "file_id", "module", "qualname", "n_id", "q_id"), "resolve-held")
    callers = held.where("qualname IS NOT NULL").groupBy("file_id", F.col("qualname").alias("caller_name")).agg(F.min("id").alias("caller_id"))

    asked = calls.select("file_id", "callee").repartition("callee").distinct().join(texts, "callee", "left")
    asked = asked.withColumn("name", last_segment(F.col("callee"))).where("name <> ''").join(names, "name", "left")
    known = asked.where("n_id IS NOT NULL OR q_id IS NOT NULL").select("file_id", "callee", "n_id", "q_id", "anywhere")

    # What the file itself has; its symbols carry ids, the texts asked for do not.
    near = _by_file(known, held.select("id", "file_id", "n_id", "q_id"))
    of_text, of_name = Window.partitionBy("file_id", "q_id"), Window.partitionBy("file_id", "n_id")
    near = near.withColumn("by_text", F.when(F.col("q_id").isNotNull(), F.min("id").over(of_text)))
    near = near.withColumns({"own_n": F.count("id").over(of_name), "own_ids": F.bit_xor("id").over(of_name), "first": F.min("id").over(of_name)})
    by_name = F.when(F.col("n_id").isNotNull() & (F.col("own_n") == 1), F.col("first"))
    near = near.where("callee IS NOT NULL").withColumn("near", F.coalesce("by_text", by_name))
    # Of what it leaves open, only files with others in their module need to know of those.
    members = files.groupBy("module").agg(F.count("*").alias("members"))
    kin = F.when(F.col("lang").isin(*FAMILIES) & (F.col("members") > 1), F.col("module")).alias("kin")
    near = near.join(lang.join(members, "module", "left").select("file_id", kin), "file_id")
    settled = cut(near.select("file_id", "callee", "n_id", "q_id", "near", "anywhere", "kin", "own_n", "own_ids"), "resolve-asked")

    left = settled.where("near IS NULL")
    reach = cut(reach, "resolve-reach")
    of = lambda number: left.where(F.col(number).isNotNull()).select("file_id", F.col(number).alias("callee")).distinct()
    has = lambda number: held.where(F.col(number).isNotNull()).groupBy("file_id", F.col(number).alias("callee")).agg(F.count("*").alias("n"), F.min("id").alias("pick"))
    third = _over_reach(of("q_id"), has("q_id"), reach, "callee").select("file_id", F.col("callee").alias("q_id"), F.col("pick").alias("third"))
    fourth = _over_reach(of("n_id"), has("n_id"), reach, "callee").where("n = 1").select("file_id", F.col("callee").alias("n_id"), F.col("pick").alias("fourth"))
    # Other files of the module: all of its symbols of that name less those of the file itself; if one is left, its id is what their ids differ by.
    family = held.where("n_id IS NOT NULL").groupBy(F.col("module").alias("kin"), "n_id").agg(F.count("*").alias("all_n"), F.bit_xor("id").alias("all_ids"))
    fifth = left.where("kin IS NOT NULL AND n_id IS NOT NULL").select("file_id", "kin", "n_id", "own_n", "own_ids").distinct().join(family, ["kin", "n_id"])
    fifth = fifth.where("all_n - own_n = 1").select("file_id", "n_id", F.col("all_ids").bitwiseXOR(F.coalesce("own_ids", F.lit(0))).alias("fifth"))
    best = _by_file(settled.select("file_id", "callee", "n_id", "q_id", "near", "anywhere"), third, fourth, fifth)
    best = best.withColumn("third", F.max("third").over(of_text))
    best = best.withColumns({rule: F.max(rule).over(of_name) for rule in ("fourth", "fifth")}).where("callee IS NOT NULL")
    best = best.select("file_id", "callee", F.coalesce("near", "third", "fourth", "fifth", "anywhere").alias("callee_id"))
    return best.where("callee_id IS NOT NULL"), callers
