"""Full-text search with BM25 over several columns of one table.

A search text is a small boolean expression: words and "phrases" that must all
occur, ``OR``, ``NOT``, ``prefix*`` and ``column:word``. Texts that are no such
expression fall back to a case-insensitive substring match. Every part becomes
a DataFrame over postings; only the final top rows are sorted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from ..scratch import cut

K1, B = 1.2, 0.75
#: Inverse document frequencies are at least this.
LEAST_IDF = 1e-6


class NotAQuery(ValueError):
    """The text is no boolean expression."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Without:
    keep: object
    drop: object


_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<mark>[():*])|(?P<word>\w+))', re.UNICODE)


def parse(text: str, columns: tuple[str, ...]):
    """The expression of a search text; raises :class:`NotAQuery`."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise NotAQuery(text)
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    left = tokens[::-1]
    peek = lambda: left[-1] if left else (None, None)

    def phrase():
        kind, value = left.pop() if left else (None, None)
        column = None
        if kind == "word" and peek() == ("mark", ":"):
            left.pop()
            if value not in columns:
                raise NotAQuery(text)
            column, (kind, value) = value, left.pop() if left else (None, None)
        if (kind, value) == ("mark", "(") and column is None:
            inner = either()
            if not left or left.pop() != ("mark", ")"):
                raise NotAQuery(text)
            return inner
        if kind not in ("word", "quoted") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise NotAQuery(text)
        prefix = peek() == ("mark", "*")
        if prefix:
            left.pop()
        words = value[1:-1].replace('""', '"') if kind == "quoted" else value
        return Phrase((words,), prefix, column)

    def both():
        parts = [phrase()]
        while peek()[0] in ("word", "quoted") and peek() != ("word", "AND") and peek()[1] not in ("OR", "NOT") or peek() == ("mark", "("):
            parts.append(phrase())
        return Both(tuple(parts)) if len(parts) > 1 else parts[0]

    def without():
        found = both()
        while peek() == ("word", "NOT"):
            left.pop()
            found = Without(found, both())
        return found

    def all_of():
        parts = [without()]
        while peek() == ("word", "AND"):
            left.pop()
            parts.append(without())
        return Both(tuple(parts)) if len(parts) > 1 else parts[0]

    def either():
        parts = [all_of()]
        while peek() == ("word", "OR"):
            left.pop()
            parts.append(all_of())
        return Either(tuple(parts)) if len(parts) > 1 else parts[0]

    found = either()
    if left:
        raise NotAQuery(text)
    return found


def postings(rows: DataFrame, key: str, columns: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, col, term, pos) and the columns ``extra``: every term of every searched column."""
    parts = [rows.select(key, *extra, F.lit(c).alias("col"), F.posexplode(terms(F.col(c))).alias("pos", "term")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a piece that the substring index is made of.
GRAM = 3


def grams(rows: DataFrame, key: str, columns: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (gram, key) and the columns ``extra``: every stretch of three characters in any column, A-Z lowered."""
    text = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), _UPPER, _LOWER)
    pieces = lambda t: F.when(F.length(t) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda i: F.substring(t, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, *extra, F.explode(F.array_distinct(F.concat(*[pieces(text(c)) for c in columns]))).alias("gram"))


def grams_of_pattern(text: str) -> list[str]:
    """The pieces that every match of a substring pattern holds; % and _ stand for other text."""
    parts = re.split("[%_]", text.translate(str.maketrans(_UPPER, _LOWER)))
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


#: Rows of a task that sorts postings, about; larger inputs have more tasks.
TASK_ROWS = 1_000_000


def tasks_for(rows: DataFrame) -> int:
    """In how many tasks to sort rows that are stored: as many as shuffles have, and more where there are many rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def stored(post: DataFrame, key: str, name: str = "postings") -> tuple[DataFrame, DataFrame]:
    """Postings written out in order of their terms, so that a lookup reads only the stretches that may hold its term, and (key, d), each row's number of terms."""
    held = cut(post, f"{name}-found")  # texts are split once, not again for the bounds of ranges
    laid = cut(held.repartitionByRange(tasks_for(held), "term", key).sortWithinPartitions("term", key), name)
    return laid, cut(held.groupBy(key).agg(F.count("*").alias("d")), f"{name}-lengths")


def _phrases(query, scored: bool = False) -> list[Phrase]:
    """All phrases of an expression; with ``scored`` those that count for the score, which are all but those behind NOT."""
    if isinstance(query, Phrase):
        return [query]
    if isinstance(query, Without):
        return _phrases(query.keep, scored) + ([] if scored else _phrases(query.drop))
    return [p for part in query.parts for p in _phrases(part, scored)]


class Searcher:
    """Search over ``rows``; ``post`` may be a stored table of :func:`postings`, and ``lengths`` that of :func:`stored`."""

    def __init__(self, rows: DataFrame, key: str, columns: tuple[str, ...], post: DataFrame | None = None, lengths: DataFrame | None = None):
        self.rows, self.key, self.columns = rows, key, tuple(columns)
        self.post = postings(rows, key, self.columns) if post is None else post
        self.lengths = self.post.groupBy(key).agg(F.count("*").alias("d")) if lengths is None else lengths

    def occurrences(self, word: str, prefix: bool) -> DataFrame:
        """Postings of a term, or of all that begin with it."""
        return self.post.where(F.col("term").startswith(word) if prefix else F.col("term") == word)

    def size(self) -> DataFrame:
        """One row (rows, terms)."""
        return self.rows.agg(F.count("*").alias("rows")).crossJoin(self.lengths.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("terms")))

    def lengths_of(self, keys: DataFrame) -> DataFrame:
        """(key, d) for at least the keys given."""
        return self.lengths

    def _hits(self, phrase: Phrase, words: list[str]) -> DataFrame:
        """(key, f): how often a phrase occurs in each row."""
        found = None
        for k, word in enumerate(words):
            post = self.occurrences(word, phrase.prefix and k == len(words) - 1)
            post = post if phrase.column is None else post.where(F.col("col") == phrase.column)
            mine = post.select(self.key, "col", (F.col("pos") - k).alias("pos"))
            found = mine if found is None else found.join(mine, [self.key, "col", "pos"], "left_semi")
        return found.groupBy(self.key).agg(F.count("*").alias("f"))

    def hits(self, phrases: list[Phrase]) -> DataFrame:
        """(key, k, f) for every phrase by its number, stored; their words are split in one job."""
        spark = self.rows.sparkSession
        split = spark.range(1).select(*[terms(F.lit(p.words[0])).alias(f"w{k}") for k, p in enumerate(phrases)]).first()
        parts = [self._hits(p, words).withColumn("k", F.lit(k)) for k, (p, words) in enumerate(zip(phrases, split, strict=True)) if words]
        none = self.post.select(self.key, F.lit(0).alias("k"), F.lit(0).cast("long").alias("f")).where("false")
        return cut(reduce(DataFrame.unionByName, [p.select(self.key, "k", "f") for p in parts]) if parts else none, "search-hits")

    def _matching(self, query, hits: DataFrame, numbers: dict[int, int]) -> DataFrame:
        if isinstance(query, Phrase):
            return hits.where(F.col("k") == numbers[id(query)]).select(self.key)
        if isinstance(query, Without):
            return self._matching(query.keep, hits, numbers).join(self._matching(query.drop, hits, numbers), self.key, "left_anti")
        parts = [self._matching(p, hits, numbers) for p in query.parts]
        if isinstance(query, Both):
            return reduce(lambda a, b: a.join(b, self.key, "left_semi"), parts)
        return reduce(DataFrame.unionByName, parts).distinct()

    def scores(self, query) -> DataFrame:
        """(key, score) of the matching rows; a lower score is better."""
        phrases = _phrases(query)
        numbers = {id(p): k for k, p in enumerate(phrases)}
        stored_hits = self.hits(phrases)
        scored = stored_hits.where(F.col("k").isin([numbers[id(p)] for p in _phrases(query, scored=True)]))
        held = scored.groupBy("k").agg(F.count("*").alias("n"))  # one row for each phrase
        matching = self._matching(query, stored_hits, numbers)
        hits = scored.join(F.broadcast(held), "k").join(matching, self.key, "left_semi")
        hits = hits.join(self.lengths_of(matching), self.key).crossJoin(F.broadcast(self.size()))
        rare = F.ln((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
        idf = F.when(rare > 0, rare).otherwise(F.lit(LEAST_IDF))
        mean = F.col("terms") / F.col("rows")
        part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / mean))
        return hits.groupBy(self.key).agg((-F.sum(part)).alias("score"))

    def candidates(self, text: str) -> DataFrame:
        """Rows that may hold a substring."""
        return self.rows

    def like(self, text: str, columns: tuple[str, ...]) -> DataFrame:
        """Rows with the text anywhere in a column; % and _ in it are wildcards, case counts only beyond ASCII."""
        pattern = "%" + text.replace("\\", "\\\\") + "%"
        folded = pattern.translate(str.maketrans(_UPPER, _LOWER))
        return self.candidates(text).where(reduce(lambda a, b: a | b, [F.translate(c, _UPPER, _LOWER).like(folded) for c in columns]))


class StoredSearcher(Searcher):
    """Search over the symbols of an index's store, all by keyed lookups."""

    def __init__(self, store, columns: tuple[str, ...]):
        self.store, self.key, self.columns = store, "id", tuple(columns)
        self.rows, self.post = store.rows("symbols"), store.rows("postings")

    def occurrences(self, word: str, prefix: bool) -> DataFrame:
        return self.store.get("postings", "term", [word], prefix)

    def size(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([self.store.searched()], "rows long, terms long")

    def lengths_of(self, keys: DataFrame) -> DataFrame:
        return self.store.lookup("lengths", "id", keys).select("id", "d")

    def candidates(self, text: str) -> DataFrame:
        """By the letter pieces of the text, all of which a row must hold; a text without any is sought in all rows."""
        pieces = grams_of_pattern(text)
        if not pieces:
            return self.rows
        held = self.store.get("grams", "gram", pieces).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(pieces))
        return self.store.lookup("symbols", "id", cut(held.select("id"), "search-candidates"))


def search_symbols(index, text: str, limit: int | None = 20) -> DataFrame:
    """Symbols that match the text, best first; in substring mode by qualified name.

    In an index with a store only the symbols and files that are shown are read.
    """
    columns = ("qualname", "name", "doc", "signature")
    shown = ["id", "kind", "qualname", "name", "doc", "signature", "start_line", "end_line", "path"]
    text, stored_index = text.strip(), getattr(index, "store", None)
    finder = StoredSearcher(stored_index, columns) if stored_index else Searcher(index.symbols, "id", columns)
    first = lambda df: df if limit is None or limit < 0 else df.limit(limit)
    found = index.symbols.where("false").withColumn("score", F.lit(0.0))
    order = ["score", "id"]
    if text:
        try:
            best = cut(first(finder.scores(parse(text, columns)).orderBy(*order)), "search-best")
            found = index.lookup("symbols", "id", best.select("id")).join(best, "id")
        except NotAQuery:
            order = ["qualname", "id"]
            found = cut(first(finder.like(text, columns[:3]).orderBy(*order)), "search-like")
    paths = index.lookup("files", "id", found.select("file_id")).select(F.col("id").alias("file_id"), "path")
    return found.join(paths, "file_id").orderBy(*order).select(*shown)
