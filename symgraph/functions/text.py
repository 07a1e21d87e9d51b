"""Lines, call sites, names and search terms as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import NOT_CALLS

#: Every separator at which a text breaks into lines.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
# Fixed value: a chain of identifiers joined by "." or "::" before an opening bracket.
CALL_CHAIN = r"(?U)([A-Za-z_$][\w$]*(?:(?:::|\.)[A-Za-z_$][\w$]*)*)\s*\("


def lines(text: Column) -> Column:
    """The lines of a text; a break at its end opens no further line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(lines(text)))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset from 0; only newlines count."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def call_sites(line: Column) -> Column:
    """All call targets in a line, in order."""
    return F.regexp_extract_all(line, F.lit(CALL_CHAIN), F.lit(1))


def head(name: Column) -> Column:
    return F.element_at(F.split(name, r"::|\."), 1)


def is_call(name: Column, lang: Column) -> Column:
    """Whether a call target's first segment is no keyword of the language."""
    rules = F.lit(True)
    for known, words in NOT_CALLS.items():
        rules = F.when(lang == known, ~head(name).isin(*words)).otherwise(rules)
    return rules


def last_segment(name: Column) -> Column:
    """What follows the last "::", and in it the last "."."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))


def blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count_of(line: Column, char: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(char), F.lit("")))


def normalize_path(path: Column) -> Column:
    """Fold "." and ".." lexically; null when the path leaves its root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up, stay = part == "..", part.isin("", ".")
        kept = F.when(stay, acc["kept"]).when(up, F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["kept"], part))
        return F.struct(kept.alias("kept"), (acc["out"] | (up & (F.size(acc["kept"]) == 0))).alias("out"))

    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["kept"], "/")))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over whole paths; "*" crosses slashes."""
    out, k = "", 0
    while k < len(pattern):
        c, k = pattern[k], k + 1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "[" and (end := pattern.find("]", k + 1 + (pattern[k : k + 1] == "!"))) > 0:
            inner = pattern[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[^" + inner[1:] + "]" if inner.startswith("!") else "[" + ("\\" if inner.startswith("^") else "") + inner + "]"
            k = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


# Letters with marks and the letters they fold to.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőŕřśşšťūůűźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorrssstuuuzzz"


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), _MARKED, _PLAIN)


def terms(text: Column) -> Column:
    """Search terms: folded runs of letters and digits."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), "")


def dot_escape(text: Column) -> Column:
    """For a quoted label: backslashes, then quotes, are escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
