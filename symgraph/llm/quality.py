"""Line-first quality cleaning with built-in functions only.

Every line is judged on its own by punctuation, navigation and boilerplate
rules. Lines that fail are removed; a document that loses too much of its text
with them, or that fails the document-level base rules, is rejected.

Cases: a null text is an empty text, which fails the base rules. Blank lines
pass. Repeated rows are judged alike and all stay. Texts of any length are
judged whole. An empty table gives no rows. The input's columns pass through
unchanged; the added column is called ``quality``, with underscores added where
the input has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, free_name, let, words

#: Symbols that the base statistics count.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
#: A line fails if symbols make up this share of its visible characters.
MAX_SYMBOL_PERCENT = 10
#: A line fails if runs of ! and ? number at least this share of its words.
MAX_SHOUT_PERCENT = 30
#: A line this long without any sentence punctuation fails.
UNPUNCTUATED_WORDS = 100
#: A document is rejected when it loses more than this share of its visible characters.
MAX_LOST_PERCENT = 30

SHOUT_RE = r"[!?]{2,}"
PUNCTUATION_RE = r"[.,;:!?]"
NAVIGATION_MARKS_RE = r"[|»›•]"
NAVIGATION_RE = (
    r"(?i)^[ \t]*(home|menu|search|log ?in|sign ?(in|up)|register|next( page)?|prev(ious)?( page)?|back( to top)?"
    r"|skip to (main )?content|read more|click here|share( this)?|print|contact( us)?|about( us)?|faq|site ?map|help)[ \t.!:>]*$"
)
BOILERPLATE_RE = (
    r"(?i)(all rights reserved|cookie policy|privacy policy|terms (of|and) (use|service|conditions)|enable javascript"
    r"|lorem ipsum|subscribe to our newsletter|follow us on|powered by [a-z]+|copyright (©|\(c\)))"
)


def visible(text: Column) -> Column:
    """Number of code points that are not white space."""
    return F.length(F.translate(text, SPACE_CHARS, ""))


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column) -> Column:
    """True when a line breaks a punctuation, navigation or boilerplate rule."""

    def rules(n_words: Column, chars: Column) -> Column:
        marks = F.regexp_count(line, F.lit(NAVIGATION_MARKS_RE))
        punctuation = (
            (symbols(line) * 100 >= chars * MAX_SYMBOL_PERCENT)
            | (F.regexp_count(line, F.lit(SHOUT_RE)) * 100 >= n_words * MAX_SHOUT_PERCENT)
            | ((n_words >= UNPUNCTUATED_WORDS) & ~line.rlike(PUNCTUATION_RE))
        )
        navigation = ((marks >= 3) & (marks * 4 >= n_words)) | line.rlike(NAVIGATION_RE)
        return (chars > 0) & (punctuation | navigation | line.rlike(BOILERPLATE_RE))

    return let(F.size(words(line)), lambda n: let(visible(line), lambda c: rules(n, c)))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the same text.

    Windows are compared by a 64-bit hash of their words. Work grows as
    n log n in the length of the text.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        step = lambda acc, at: F.struct(
            (acc["total"] + at + window - F.greatest(acc["end"], at)).alias("total"), (at + window).alias("end")
        )
        return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["total"])

    def twice(ranked: Column) -> Column:
        same = lambda i, j: F.get(ranked, i)["h"] == F.get(ranked, j)["h"]
        found = F.filter(
            F.sequence(F.lit(0), F.size(ranked) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))
        )
        return covered(F.transform(found, lambda i: F.get(ranked, i)["at"]))

    def of(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(placed), twice))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])), of)

    return let(tokens, lambda w: F.when(F.size(w) < window, 0).otherwise(windows(w)))


def statistics(text: Column) -> Column:
    """One struct of the base statistics of a text."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            visible(text).cast("long").alias("word_chars"),
            symbols(text).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    filled = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    return let(words(text), lambda w: let(filled, lambda lines: of(w, lines)))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality``.

    Its fields are the base statistics, ``clean_text`` (the text without
    failing lines), ``lost_chars``, ``base_failed`` and ``kept``. No row is
    dropped here, so callers can report or filter.
    """
    base = F.coalesce(F.col(text), F.lit(""))

    def verdict(s: Column, kept_text: Column) -> Column:
        failed = (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEATED_PERCENT)
        lost = s["word_chars"] - visible(kept_text)
        return F.struct(
            *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            kept_text.alias("clean_text"),
            lost.cast("long").alias("lost_chars"),
            failed.alias("base_failed"),
            (~failed & (lost * 100 <= s["word_chars"] * MAX_LOST_PERCENT)).alias("kept"),
        )

    passing = F.array_join(F.filter(F.split(base, "\n"), lambda line: ~line_fails(line)), "\n")
    return docs.withColumn(free_name(docs, "quality"), let(statistics(base), lambda s: let(passing, lambda t: verdict(s, t))))


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of :func:`clean` that are kept.

    The verdict passes through a generator, so Spark cannot evaluate the
    cleaning once for a filter and again for the result.
    """
    judged, name = clean(docs, text), free_name(docs, "quality")
    kept = F.explode(F.filter(F.array(name), lambda q: q["kept"]))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], kept.alias(name))
