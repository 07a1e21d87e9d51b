"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import langid, linededup, mergedropout, ngramjoin, packing, quality, rangecoder, sharding, tokenfile, topk, toxicity
from symgraph.llm.tokens import Encoder, vocabulary

#: Names that operators use themselves.
CLASHES = ["quality", "lines", "score", "evidence", "passages", "foreign", "shard", "slot", "at", "id", "sid", "h1", "batch", "token", "n", "part", "ids"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHES)
LONG = " ".join(f"w{k % 977}x" for k in range(30_000))
TEXTS = ["", None, "a", "same words here and there for all to see", "same words here and there for all to see", LONG, LONG + " more", " \n\t ", "x\ny\n\nz", "é 世界 ▁ <|endoftext|>"]
BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    nulls, more = (None,) * len(CLASHES), tuple(f"own {c}" for c in CLASHES)
    rows = [(k, t, "en", *more) for k, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], None, *nulls), (None, "no id at all", "en", *nulls), (None, None, None, *nulls)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (3, 0), (3, 0), (4, 0), (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")


def test_toxicity_cases(odd, empty, labels):
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    nothing = toxicity.fit(odd, labels.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(odd, nothing).collect()} == {0}
    assert toxicity.segments(odd, model, keep=["doc_id", "lang"]).columns == ["doc_id", "lang", "score", "evidence", "passages"]
    kept = toxicity.segments(odd, model, keep=["doc_id", "score", "passages"])
    assert kept.columns == ["doc_id", "score", "passages", "score_", "evidence", "passages_"]
    assert {r["score"] for r in kept.where("doc_id IS NOT NULL").collect()} == {"own score", None}


def test_maximal_segments_against_brute_force():
    def brute(x):
        """Recursion by the definition: the best segment, then both sides of it."""
        best = max(((sum(x[i:j]), -(j - i), -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return brute(x[:i]) + [(i, j, best[0])] + [(i2 + j, j2 + j, s) for i2, j2, s in brute(x[j:])]

    rng = random.Random(1)
    for _ in range(300):
        x = [rng.choice([-5, -3, -2, 1, 2, 4, 7]) + rng.random() / 8 for _ in range(rng.randrange(0, 14))]
        got = toxicity.maximal_segments(np.array(x))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(x)]


def test_maximal_segments_take_linear_time():
    began = time.process_time()
    assert toxicity.maximal_segments(np.array([1.0, -2.0] * 60_000)) == [(k, k + 1, 1.0) for k in range(0, 120_000, 2)]
    assert time.process_time() - began < 10


def test_toxicity_against_brute_force(spark, sf_dir):
    """Counts, smoothing, segments, calibration and scores again in plain Python, over the whole table."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts, marks = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect()}
    train = [(texts[d], y) for d, y in marks.items() if d in texts and zlib.crc32(str(d).encode()) % 5]
    base, counts = sum(y for _, y in train) / len(train), {}
    for text, y in train:
        for token in {t for t in re.split(r"[\W_]+", text.lower()) if t}:
            for name in [token, *(token[:k] + "*" for k in toxicity.PREFIXES if len(token) >= k)]:
                t, n = counts.get(name, (0, 0))
                counts[name] = (t + y, n + 1)
    counts = {k: v for k, v in counts.items() if v[1] >= 2}

    def share(chain):
        """The share of the last of a chain of prefixes, each the prior of the next."""
        p = base
        for name in chain:
            t, n = counts.get(name, (0, 0))
            p = (t + toxicity.PRIOR * p) / (n + toxicity.PRIOR)
        return min(max(p, 1e-4), 1 - 1e-4)

    logit = lambda p: float(np.log(p / (1 - p)))

    def token_score(token):
        chain = [token[:k] + "*" for k in toxicity.PREFIXES if len(token) >= k] + [token]
        while chain and chain[-1] not in counts:
            chain.pop()
        return logit(share(chain)) - logit(base) - toxicity.DRIFT if chain else -toxicity.DRIFT

    def segments(scores):
        best = max(((sum(scores[i:j]), i, j) for i in range(len(scores)) if scores[i] > 0 for j in range(i + 1, len(scores) + 1) if scores[j - 1] > 0), default=None)
        return [] if not best or best[0] <= 0 else segments(scores[: best[1]]) + [best[0]] + segments(scores[best[2] :])

    rows = {r["doc_id"]: r for r in toxicity.segments(docs, model, keep=["doc_id"]).collect()}
    short = [d for d in texts if len(texts[d]) < 1_500]
    assert len(short) > 50
    for d in short:
        scores = [token_score(t) for t in toxicity.TOKEN_RE.findall(texts[d].lower())]
        chance = np.log(max(model.k * len(scores), 1e-9) / toxicity.MAX_CHANCE)
        evidence = sum(max(0.0, model.lam * s - chance) for s in segments(scores))
        assert rows[d]["evidence"] == pytest.approx(evidence, abs=1e-6)
        assert rows[d]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(evidence - model.cut, -60, 60))), abs=1e-9)
    # K is the likeliest one for the best segments of the clean training rows.
    n_s = [(len(x), max((s for _, _, s in toxicity.maximal_segments(np.array(x))), default=0.0)) for x in ([token_score(t) for t in toxicity.TOKEN_RE.findall(text.lower())] for text, y in train if not y) if x]
    assert model.k == pytest.approx(max(1e-3, len(n_s) / sum(n * np.exp(-model.lam * s) for n, s in n_s)), rel=1e-6)


def test_toxic_passages_are_found(spark):
    rng = random.Random(2)
    clean = [f"{rng.choice('abcdef')}{rng.choice('lmnop')}{k % 40}" for k in range(4000)]
    docs, marks = [], []
    for k in range(300):
        words = rng.sample(clean, 60)
        toxic = int(k % 4 == 0)
        if toxic:
            words[10:12] = ["vileword", "nastyone"]
        docs.append((k, " ".join(words)))
        marks.append((k, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(rows[k]["predicted"] == y for k, y in marks)
    text = docs.where("doc_id = 0").first()["text"]
    span = rows[0]["passages"][0]
    assert "vileword" in text[span["start"] : span["end"]]


def test_token_file_cases(spark, odd, empty, tmp_path):
    tokenfile.write_ids(odd, str(tmp_path / "a"), BPE, frame_ids=5_000)
    rows = tokenfile.read_ids(spark, str(tmp_path / "a")).orderBy("start").collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [d for d, _ in texts]
    assert [r["ids"] for r in rows] == [Encoder.of(BPE).encode([t], 2)[0].tolist() for _, t in texts]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    tokenfile.write_ids(empty, str(tmp_path / "b"), BPE)
    assert tokenfile.read_ids(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("block", [1, 7, 64, 2048])
def test_range_coder_round_trip(block):
    rng = random.Random(block)
    ids = [rng.choice([rng.randrange(50_000), 5, 6, 7, 2**32 - 1, 131_071, 0]) for _ in range(3_000)] + [9] * 500
    frame = rangecoder.pack_frame(np.array(ids), block)
    assert rangecoder.unpack_frame(frame).tolist() == ids
    assert rangecoder.unpack_frame(rangecoder.pack_frame(np.array([], dtype=np.int64), block)).tolist() == []


def test_range_coder_compresses_and_notices_damage():
    ids = np.array([k % 50 for k in range(20_000)])
    frame = rangecoder.pack_frame(ids)
    assert len(frame) < 20_000 * 2 / 8
    with pytest.raises(ValueError):
        rangecoder.unpack_frame(frame[:-3] + b"\x00\x01\x02")
    with pytest.raises(ValueError):
        rangecoder.unpack_frame(b"XXXX" + frame[4:])


def test_tokeniser_equals_the_library():
    tokenizer = Encoder.of(BPE).tokenizer
    texts = ["  a  b \n c   d", "\n\n x", " ", " a b c\x1c d", "<|endoftext|> x", "é 世界  \t\t q ' s it's  it 's", "a   b", "x  y \x00 z", "a b\x00 c"]
    for text, ids in zip(texts, Encoder.of(BPE).encode(texts, 1), strict=True):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_topk_cases(spark):
    rows = [
        (0, [0.5, -0.25]), (50, [1.0, 1.0]), (7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (11, [float("inf"), 0.0]), (12, []),
        (13, [1.0, 1.0]), (14, [1.0, 1.0]), (14, [2.0, 0.0]), (15, [0.0, 0.0]), (16, [1.0]), (None, [1.0, 1.0]), (17, [-0.001, 0.9]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(table)
    valid = [(r["id"], r["terms"]) for r in vectors.collect()]
    for sizes in ((2048, 16384), (1, 3)):
        got = topk.top_k(vectors.where("id % 50 = 0"), vectors, 5, *sizes).collect()
        assert sorted(map(tuple, got)) == sorted(topk.brute_force(valid, 50, 5))
    assert topk.top_k(vectors.where("false"), vectors).count() == topk.top_k(vectors, vectors.where("false")).count() == 0


def test_merge_dropout_cases(odd, empty):
    rows = mergedropout.round_trip(odd, PIECES).collect()
    want = sorted(zlib.crc32((r["text"] or "").encode()) for r in odd.collect())
    assert sorted(r["decoded_crc32"] for r in rows) == want
    assert mergedropout.round_trip(empty, PIECES).count() == 0
    one, two = ({r["doc_id"]: r["ids"] for r in mergedropout.encode_documents(odd.where("doc_id = 5"), PIECES, seed=s).collect()}[5] for s in (1, 2))
    assert one != two


def test_merge_dropout_agendas_agree():
    coder = mergedropout.MergeDropout(PIECES, 0.2, 3)
    units = ["▁hello", "▁▁▁there's", "▁", "▁▁▁▁", "▁naïveté", "▁世界", "▁aaaaaaaaaaa", "x\ny", "▁internationalisation"]
    assert coder.merge_matrix(units, [1] * len(units)) == [coder.merge_heap(u, 1) for u in units]
    plain = mergedropout.MergeDropout(PIECES, 0.0, 3)
    for text in ("hello there  world", "\n", "  x", "q" * 90, "émigré 12345"):
        assert plain.encode([text], [0])[0].tolist() == plain.library.encode(text)


def test_merge_dropout_against_brute_force(spark, sf_dir):
    """Whole texts of the table, each unit by a plain scan over neighbours."""
    coder = mergedropout.MergeDropout(PIECES, mergedropout.DROPOUT, mergedropout.SEED)
    score = coder.library.get_score

    def brute(unit, key):
        parts, offered = [(k, k + 1, coder.pieces.get(c), c) for k, c in enumerate(unit)], {}

        def joins(a, b):
            target = coder.pieces.get(a[3] + b[3]) if a[2] is not None and b[2] is not None else None
            place = (a[0], b[0], b[1])
            if target is not None and place not in offered:
                offered[place] = bool(mergedropout.skipped(*(np.array([x]) for x in (key, *place)), coder.dropout)[0])
            return None if target is None or offered[place] else target

        while True:
            found = [(-score(t), k, t) for k in range(len(parts) - 1) if (t := joins(parts[k], parts[k + 1])) is not None]
            if not found:
                break
            _, k, target = min(found)
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1], target, parts[k][3] + parts[k + 1][3])]
        spelt = lambda text: [coder.bytes[b] for c in text for b in ("▁" if c == mergedropout._LITERAL else c).encode()]
        return [i for _, _, target, text in parts for i in ([target] if target is not None else spelt(text))]

    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 2_500][:25]
    docs += [(10**6, "naïve 世界 ▁ x\n\ty  z " + "q" * 50)]
    table = spark.createDataFrame([tuple(r) for r in docs], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in mergedropout.encode_documents(table, PIECES).collect()}
    hashed = {r["doc_id"]: int(r["h"], 16) for r in table.select("doc_id", F.lpad(F.hex(F.xxhash64("doc_id")), 16, "0").alias("h")).collect()}
    for d, text in docs:
        units = mergedropout.UNIT_RE.findall("▁" + text.replace("▁", mergedropout._LITERAL).replace(" ", "▁")) if text else []
        keys = coder.keys_of(text, hashed[d], len(units))
        assert got[d] == [i for u, key in zip(units, keys, strict=True) for i in brute(u, key)], d


def test_merge_dropout_splits_every_occurrence_on_its_own(spark):
    """A word that repeats has many splits, each that of the agenda with the occurrence's key."""
    coder = mergedropout.MergeDropout(PIECES, 0.2, 3)
    word, text = "▁internationalisation", " ".join(["internationalisation"] * 400)
    keys = [coder.keys_of(text, d, 400).tolist() for d in (1, 2)]
    want = [[coder.merge_heap(word, k) for k in row] for row in keys]
    assert [x.tolist() for x in coder.encode([text, text], [1, 2])] == [[i for ids in row for i in ids] for row in want]
    assert len({tuple(ids) for row in want for ids in row}) > 20 and want[0] != want[1]
    held = spark.createDataFrame([(k, "internationalisation") for k in range(200)], "doc_id long, text string")
    assert len({tuple(r["ids"]) for r in mergedropout.encode_documents(held, PIECES).collect()}) > 4


def test_sharding_cases(odd, empty):
    rows = sharding.assign_shards(odd, 3).collect()
    assert len(rows) == odd.count() and {r["shard"] for r in rows} <= {0, 1, 2}
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["text_crc32"] == 0}) == 1
    many = sharding.assign_shards(odd.where("doc_id = 4").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))), 3).collect()
    assert sorted(r["slot"] for r in many) == list(range(500)) and len({r["shard"] for r in many}) == 1
    assert sharding.assign_shards(empty, 3).count() == 0


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(4)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 100) for _ in range(rng.randrange(0, 80))), reverse=True)
        places, bins = sharding.best_fit_decreasing(sizes, 100)
        assert sharding.fills(places, sizes) == sharding.fills(sharding.brute_force(sizes, 100), sizes)
        assert bins == len(set(places))


def test_shards_are_written_whole(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd.count()
    assert back.groupBy("shard_", "slot_").count().where("count > 1").count() == 0
    assert {r["shard"] for r in back.collect()} == {"own shard", None}
    sharding.write_shards(odd.select("doc_id", "text"), str(tmp_path / "plain"), 3)
    assert set(spark.read.parquet(str(tmp_path / "plain")).columns) == {"doc_id", "text", "slot", "shard"}


def brute_links(docs, n, percent):
    sets = {}
    for d, text in docs:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[d] = {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} if len(found) >= n else {tuple(found)} if found else set()
    comp = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {d: (len(sets[d]), comp[d]) for d in ids}


def test_ngram_join_against_brute_force(spark, monkeypatch):
    """Near copies, chains and shared passages, with a frequent class that most n-grams fall into."""
    monkeypatch.setattr(ngramjoin.frequent_tokens, "__defaults__", (3, 1 << 20))
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(40)]
    docs = []
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(4, 90))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
            if group % 3 == 0:
                words += passage
            docs.append((len(docs) * 3, " ".join(words)))
    for percent, n in ((85, 4), (80, 5), (50, 2)):
        got = ngramjoin.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(docs, n, percent)


@pytest.mark.parametrize("paired", [0, 5, 64])
def test_ngram_join_of_wide_and_narrow_sets(spark, monkeypatch, paired):
    """Sets whose frequent n-grams are too many to pair, beside and linked with sets that pair theirs."""
    monkeypatch.setattr(ngramjoin.frequent_tokens, "__defaults__", (3, 1 << 20))
    monkeypatch.setattr(ngramjoin, "PAIRED", paired)
    rng = random.Random(11)
    docs = []
    for _ in range(5):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 70))]
        for _ in range(9):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
            docs.append((len(docs), " ".join(words + [f"x{k}" for k in range(rng.randrange(0, 6))])))
    for percent in (60, 85):
        got = ngramjoin.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), 2, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(docs, 2, percent)


def test_ngram_join_of_many_near_copies_of_a_long_text(spark):
    """600 near copies of 20,000 words: every n-gram of a prefix is frequent, and no pairs of them are made."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda k: F.concat(F.lit("w"), F.when(k == F.col("id") * 30, -F.col("id")).otherwise(k)))).alias("text"))
    began = time.process_time()
    got = ngramjoin.link_documents(rows.repartition(8)).collect()
    assert {(r["n_shingles"], r["component_id"]) for r in got} == {(19_997, 0)} and len(got) == 600
    assert time.process_time() - began < 60


def test_ngram_join_cases(odd, empty):
    rows = ngramjoin.link_documents(odd).collect()
    assert len(rows) == odd.count()
    known = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in known.items()} == brute_links(list(enumerate(TEXTS)), 4, 85)
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert ngramjoin.link_documents(empty).count() == 0


def test_ngram_join_counts_repeated_rows_once(spark):
    """Three near copies with the third row doubled, then every row doubled."""
    rng = random.Random(9)
    docs, doubled = [], []
    for group in range(60):
        base = [f"g{group}w{k}" for k in range(60)]
        changed = list(base)
        for at in rng.sample(range(2, 58, 7), 4):
            changed[at] = f"g{group}v{at}"
        docs += [(len(docs) + k, " ".join(words)) for k, words in enumerate((base, [*base, "some", "more"], changed))]
        doubled.append(docs[-1])
    want = brute_links(docs, 4, 50)
    for rows in (docs + doubled, docs + docs):
        got = ngramjoin.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 50).collect()
        assert len(got) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_ngram_join_samples_no_rows_without_id(spark):
    """A set that a task first meets in a row with a null id."""
    words = [f"w{k}" for k in range(200)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(None, " ".join(words)), (5, " ".join(words)), (7, " ".join(near)), (None, None), (8, None)]
    got = ngramjoin.link_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"]) == [(5, 197, 5), (7, 197, 5), (8, 0, 8)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if not r["doc_id"]) == [(0, None), (197, None)]


def test_ngram_join_blocks_of_very_long_sets(spark):
    """Over 150,000 n-grams each: 1 and 2 are nearly equal, 3 shares a third with them; 4 is short and ruled out."""
    rng = np.random.default_rng(10)
    tokens = rng.integers(0, 2**63, 152_000, dtype=np.int64).astype(np.uint64)
    sets = {1: tokens, 2: tokens[1_500:], 3: np.concatenate((tokens[:50_000], rng.integers(0, 2**63, 101_000, dtype=np.int64).astype(np.uint64))), 4: tokens[:60]}
    held = spark.createDataFrame([(k, len(t), bytearray(ngramjoin.sketch(t))) for k, t in sets.items()], "sid long, n long, sketch binary")
    split = spark.createDataFrame([(9, 1, 4, 1, k, k) for k in sets], "sig long, least long, width long, sigs long, sid long, comp long")
    left = ngramjoin.block_pairs(split, held, 85)
    found = {tuple(r) for r in left.collect()}
    assert (1, 2) in found and not any(b == 4 for _, b in found)
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    assert {tuple(r) for r in ngramjoin.sketched(pairs, held, 85).collect()} == found
    tokens = spark.createDataFrame([(k, len(t), t.view(np.int64).tolist()) for k, t in sets.items()], "sid long, n long, tokens array<long>")
    assert [tuple(r) for r in ngramjoin.verify(left, tokens, 85).collect()] == [(1, 2)]


def test_quality_cases(odd, empty):
    judged = quality.clean(odd).collect()
    assert len(judged) == odd.count()
    stats = {r["doc_id"]: r["quality_"] for r in judged if r["doc_id"] is not None}
    assert {r["quality"] for r in judged} == {"own quality", None}
    assert quality.kept_documents(odd).columns == [*odd.columns, "quality_"]
    assert stats[1]["n_words"] == 0 and stats[1]["base_failed"] and not stats[1]["kept"]
    assert stats[5]["n_words"] == 30_000 and stats[5]["n_repeat_words"] == 30_000
    assert quality.clean(empty).count() == quality.kept_documents(empty).count() == 0


def test_quality_judges_lines(spark):
    good = "This is a plain sentence with some more words, and it ends well.\n"
    text = good * 1 + "Home\n" + "a | b | c | d | e\n" + "All rights reserved.\n" + "WOW!! BUY!! NOW!!\n" + "x$$$ y%%% z&&&\n" + "Another plain sentence stands here, with quite enough words to be kept whole."
    row = quality.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["quality"]
    assert row["clean_text"].splitlines() == [good.strip(), text.splitlines()[-1]]


def test_line_dedup_cases(odd, empty):
    found = linededup.dedup_lines(odd, batches=3, fanout=2)
    rows = found.collect()
    assert len(rows) == odd.count() and found.columns == [*odd.columns, "lines_"]
    assert {r["foreign"] for r in rows} == {"own foreign", None} and {r["lines"] for r in rows} == {"own lines", None}
    kept = {r["doc_id"]: r["lines_"] for r in rows if r["doc_id"] is not None}
    assert (kept[3]["n_dropped"], kept[4]["n_dropped"], kept[4]["kept_text"], kept[1]["n_lines"]) == (0, 1, "", 1)
    assert linededup.dedup_lines(empty).count() == 0


def test_line_runs_are_joined_in_order_and_dropped(spark, monkeypatch):
    """No sort or shuffle stands over the scan of a run, and no run is left behind."""
    plans, write = [], linededup.LineRuns.write

    def watched(runs, rows):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        plans.append(plan[plan.find("== Initial Plan") :] if "== Initial Plan" in plan else plan)
        return write(runs, rows)

    monkeypatch.setattr(linededup.LineRuns, "write", watched)
    docs = spark.createDataFrame([(k, "\n".join(f"This is line {(k * 7 + j) % 90} of all" for j in range(5))) for k in range(200)], "doc_id long, text string")
    linededup.dedup_lines(docs, batches=8, fanout=2)
    assert max(p.count("symgraph_run") for p in plans) >= 3
    for plan in plans:
        assert plan.count("Exchange") <= 2 and plan.count("Sort [") <= 1, plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("symgraph_run")]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    pool = [f"Line number {k} of the pool" for k in range(30)] + ["short", "", " Line number 1 OF the pool\t"]
    docs = [(k * 2, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for k in range(60)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    owner = {}
    for d, text in docs:
        for line in text.split("\n"):
            owner.setdefault(key(line), d)
    want = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == d) for d, t in docs}
    for batches, fanout in ((1, 2), (5, 2), (9, 3)):
        got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches, fanout=fanout)
        assert {r["doc_id"]: r["lines"]["kept_text"] for r in got.collect()} == want


def test_packing_cases(odd, empty):
    packed = packing.pack_documents(odd, BPE, window=64)
    ids = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in ids) == packed.agg(F.sum("length")).first()[0]
    assert max(len(r["ids"]) for r in ids) == 64
    assert packed.where("start = 0").count() == odd.count()
    assert packing.pack_documents(empty, BPE).count() == 0


def test_packing_tree_against_brute_force():
    rng = random.Random(7)
    for _ in range(50):
        lengths = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(0, 120))), reverse=True)
        windows, offsets, opened = packing.pack(lengths, 64)
        assert sorted(sharding.fills(windows, lengths).values()) == sorted(sharding.fills(sharding.brute_force(lengths, 64), lengths).values())
        assert len({(w, o) for w, o in zip(windows, offsets, strict=True)}) == len(lengths) and opened == len(set(windows))


def test_language_cases(odd, empty):
    model = langid.fit(odd)
    rows = {r["doc_id"]: r for r in langid.identify(odd, model).collect() if r["doc_id"] is not None}
    assert [rows[k]["lang_pred"] for k in (0, 1, 7)] == ["und"] * 3 and rows[3]["lang_pred"] == "en"
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_languages_are_not_capped(spark):
    rows = [(10 * k + j, f"word{k} other{k}", f"lang{k:03}") for k in range(520) for j in range(3)]
    got = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {lang for d, _, lang in rows if zlib.crc32(str(d).encode()) % 5}
    assert len(want) > 500 and {r["lang"] for r in got.select("lang").distinct().collect()} == want


def test_language_rejects_what_is_far(spark):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(k, " ".join(word("abcde" if k % 2 else "vwxyz") for _ in range(60)), "one" if k % 2 else "two") for k in range(80)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(rows[1][1])[0] == "one" and not model.predict(rows[1][1])[2]
    assert model.predict("μμμ λλλ κκκ ιιι θθθ")[2] and model.predict("123 !!")[0] == "und"


def test_language_against_brute_force(spark, sf_dir):
    """N-grams, weights and the nearest centroid again in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    fold = lambda c: c if c >= 128 or chr(c).isalpha() else 32

    def vector(text):
        raw, counts = [], {}
        for c in f" {text.lower()} ".encode():
            if not raw or fold(c) != 32 or raw[-1] != 32:
                raw.append(fold(c))
        for k, c in enumerate(raw):
            grams = [c] + ([c * 257 + raw[k + 1] + 65_537] if k + 1 < len(raw) else [])
            grams += [(c * 257 + raw[k + 1]) * 257 + raw[k + 2] + 16_777_259] if k + 2 < len(raw) else []
            for g in grams:
                at = ((g & 0xFFFFFFFF) * 2_654_435_761 & 0xFFFFFFFF) >> 19
                counts[at] = counts.get(at, 0) + 1
        weights = {k: float(np.log1p(n)) * float(model.idf[k]) for k, n in counts.items()}
        size = sum(w * w for w in weights.values()) ** 0.5
        return {k: w / size for k, w in weights.items()}

    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for d, text in [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] and len(r["text"]) < 3_000][:60]:
        if not any(map(str.isalpha, text)):
            assert rows[d]["lang_pred"] == "und"
            continue
        v = vector(text)
        near = [sum(w * float(c[k]) for k, w in v.items()) for c in model.centroids]
        assert rows[d]["lang_pred"] == model.langs[model.owner[int(np.argmax(near))]]
        best = [max(x for x, o in zip(near, model.owner, strict=True) if o == k) for k in range(len(model.langs))]
        odds = np.exp((np.array(best) - max(best)) * 30)
        assert rows[d]["score"] == pytest.approx(odds.max() / odds.sum(), abs=1e-4)
