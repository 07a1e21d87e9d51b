"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, maintext, mergedropout, ngramjoin, packing, quality, resample, sharding, tokenfile, topk, toxicity, wordruns
from .common import scratch_path, table
from .tokens import vocabulary


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts; whatever else the table holds plays no part."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    tokenfile.write_ids(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_ids(spark, path, with_ids=False)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, k=5)


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mergedropout.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), shards=16)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_documents(documents(spark, sf_dir), n=4, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.clean(documents(spark, sf_dir))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in fields])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept_text", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    docs = docs.select("doc_id", wordruns.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return wordruns.digests(wordruns.find_runs(docs, ["doc_id"]))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), orders=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_file": op2_token_file,
    "op3_topk": op3_topk,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_sharding": op5_sharding,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_word_runs": op11_word_runs,
    "op12_resampling": op12_resampling,
    "op13_main_text": op13_main_text,
}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""

_OP6 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w
), n AS (
  SELECT d.doc_id, count(g.s) AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, n.n AS n_shingles, least.component_id FROM documents d JOIN n ON n.doc_id = d.doc_id JOIN least ON least.doc_id = d.doc_id
"""

def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _visible(column: str) -> str:
    return f"length(translate({column}, {_SPACES}, ''))"


def _symbols(column: str) -> str:
    return f"(length({column}) - length(translate({column}, {_sql(quality.SYMBOLS)}, '')))"


_OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d2 AS (SELECT row_number() OVER () AS r, doc_id, t, {_WORDS.format("t")} AS w, string_split(t, chr(10)) AS ls FROM d),
lines AS (SELECT r, unnest(ls) AS l FROM d2),
judged AS (
  SELECT r, l, len({_WORDS.format("l")}) AS nw, {_visible("l")} AS nc, {_symbols("l")} AS ns,
    len(regexp_extract_all(l, {_sql(quality.SHOUT_RE)})) AS shouts, len(regexp_extract_all(l, {_sql(quality.NAVIGATION_MARKS_RE)})) AS marks
  FROM lines
), failing AS (
  SELECT r, sum(nc) AS lost FROM judged WHERE nc > 0 AND (
    ns * 100 >= nc * {quality.MAX_SYMBOL_PERCENT} OR shouts * 100 >= nw * {quality.MAX_SHOUT_PERCENT}
    OR (nw >= {quality.UNPUNCTUATED_WORDS} AND NOT regexp_matches(l, {_sql(quality.PUNCTUATION_RE)}))
    OR (marks >= 3 AND marks * 4 >= nw) OR regexp_matches(l, {_sql(quality.NAVIGATION_RE)}) OR regexp_matches(l, {_sql(quality.BOILERPLATE_RE)}))
  GROUP BY r
), dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM judged WHERE nc > 0 GROUP BY r),
win AS (SELECT r, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i, w FROM d2 WHERE len(w) >= {quality.WINDOW}),
keyed AS (SELECT r, i, array_to_string(w[i:i+{quality.WINDOW - 1}], ' ') AS k FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM keyed) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY r),
s AS (
  SELECT d2.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({_visible("t")} AS BIGINT) AS word_chars, CAST({_symbols("t")} AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM d2 LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN failing USING (r)
), b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * {quality.MAX_LOST_PERCENT} AS kept FROM b
"""

_OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {linededup.MIN_KEY_CHARS} AND doc_id IS NOT NULL GROUP BY key),
m AS (SELECT k.*, coalesce(o.owner < k.doc_id, false) AS dropped FROM k LEFT JOIN o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

#: The checksum of each distinct word, byte by byte through the usual table of 256 values.
_OP12 = r"""
WITH steps AS (
  SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS v FROM (SELECT unnest(range(256)) AS b)
), tab AS (SELECT list(v ORDER BY b) AS t FROM steps),
src AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), numbered AS (SELECT row_number() OVER () AS r, * FROM src),
w AS (
  SELECT r, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM numbered
), bytes AS (
  SELECT word, list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || h[2 * i - 1 : 2 * i] AS BIGINT)) AS bs FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM w)
), crc AS (
  SELECT word, xor(list_reduce(bs, lambda c, x: xor(c // 256, t[CAST(xor(c, x) % 256 AS INTEGER) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, tab
), f AS (SELECT r, side, bucket FROM w JOIN crc USING (word)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM n),
gain AS (SELECT bucket, CAST(floor(1000 * ln((n.t + 1) * (total.s + 10000) / ((n.s + 1) * (total.t + 10000)))) AS BIGINT) AS g FROM n, total),
doc AS (SELECT r, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM numbered LEFT JOIN doc USING (r) WHERE side = 'd'
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

#: On the given pages the main text is what the article element holds.
_OP13 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&') AS t FROM a),
s AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM s
"""

ORACLE_SQL = {"op3_topk": _OP3, "op6_ngram_join": _OP6, "op7_quality_rules": _OP7, "op9_line_dedup": _OP9, "op12_resampling": _OP12, "op13_main_text": _OP13}
