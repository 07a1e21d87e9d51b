"""Marks in tokens, equal rows, damaged files and ids that hold several texts."""

import unicodedata

import numpy as np
import pytest

import corpus_pipeline as cp
from symgraph.llm import langid, ngramjoin, packing, rangecoder, tokenfile, toxicity
from symgraph.llm.tokens import vocabulary

BPE = vocabulary("byte_bpe_50k.json")
#: By script: words of clean texts, and words that stand in toxic ones alone.
SCRIPTS = {
    "devanagari": ("हिन्दी में लिखा हुआ एक अच्छा वाक्य है और कुछ शब्द", "दुष्टतम मूर्खानन्द"),
    "thai": ("ภาษา ไทย เขียน ดี มาก และ มี คำ ที่ นี่", "ชั่วช้า เลวทรามยิ่ง"),
    "decomposed": (unicodedata.normalize("NFD", "une très bonne phrase écrite où tout va bien"), unicodedata.normalize("NFD", "imbécîlé crétîné")),
    "latin": ("a rather good sentence that says little of note", "scoundrelly dimwitted"),
}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_toxicity_sees_words_with_marks(spark, script):
    clean, toxic = (w.split() for w in SCRIPTS[script])
    rng = np.random.default_rng(3)
    told = lambda bad: " ".join([*rng.choice(clean, 30), *(list(rng.choice(toxic, 6)) if bad else []), *rng.choice(clean, 20)])
    rows = [(k, told(k % 4 == 0), int(k % 4 == 0)) for k in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[k] == y for k, _, y in rows)


def test_training_rows_are_bounded_where_an_id_repeats(spark):
    docs = spark.range(500).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    assert toxicity.training_rows(docs, spark.createDataFrame([(7, 1)], "doc_id long, toxic int")).count() == 1


def test_equal_rows_are_packed_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 500)
    docs = spark.range(4_000).selectExpr("1L AS doc_id", "'the same few words' AS text")
    rows = packing.pack_documents(docs, BPE, with_ids=False).select("sequence_id", "offset", "length").collect()
    tasks = {}
    for r in rows:
        tasks[r["sequence_id"] // packing.TASK_IDS] = tasks.get(r["sequence_id"] // packing.TASK_IDS, 0) + 1
    assert len(rows) == 4_000 and len(tasks) == 8 and max(tasks.values()) < 700


def test_damaged_frames_are_noticed():
    ids = np.arange(5_000) % 613
    frame = rangecoder.pack_frame(ids, 2_000)
    assert rangecoder.unpack_frame(frame).tolist() == ids.tolist()
    for at in range(40):  # every byte of the head and of the list of blocks
        broken = bytearray(frame)
        broken[at] ^= 0x41
        with pytest.raises(ValueError):
            rangecoder.unpack_frame(bytes(broken))
    for broken in (b"", frame[:3], frame[:19], frame[:30], frame[:-1], frame + b"x", frame[:-9] + b"12345678" + frame[-1:]):
        with pytest.raises(ValueError):
            rangecoder.unpack_frame(broken)


def test_damaged_lists_of_documents_are_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(5)], "doc_id long, text string")
    tokenfile.write_ids(docs, str(tmp_path / "ids"), BPE)
    row = next(r.asDict() for r in spark.read.parquet(str(tmp_path / "ids")).collect())
    assert len(tokenfile.checked_ids(row)) == row["n_ids"]
    for change in ({"doc_ids": [9, *row["doc_ids"][1:]]}, {"lengths": [row["lengths"][0] + 1, *row["lengths"][1:]]}, {"n_ids": row["n_ids"] + 1}):
        with pytest.raises(ValueError):
            tokenfile.checked_ids(row | change)


def test_ids_with_several_texts_lose_only_near_copies(spark, sf_dir):
    words = [f"word{k}" for k in range(60)]
    t, other = " ".join(words), " ".join(f"other{k}" for k in range(60))
    rows = [(1, t), (2, t + " more"), (2, other), (3, other + " more"), (4, None), (4, ""), (4, ""), (5, t + " again"), (5, t + " yet"), (6, "alone in this " + other[:40]), (6, "alone in this " + other[:40]), (None, t), (None, t)]
    docs = spark.createDataFrame([(d, x, "en", "s", len(x or ""), "own") for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long, component string")
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in ngramjoin.one_of_each(docs, 5, 80).collect()))
    assert kept == sorted([(0, t), (0, t), (1, t), (2, other), (4, ""), (4, ""), (4, ""), (6, "alone in this " + other[:40])])
    assert ngramjoin.one_of_each(docs, 5, 80).columns == docs.columns
    assert cp.ngram_join_stage(spark, docs, sf_dir).columns == cp.COLUMNS
    assert ngramjoin.one_of_each(docs.where("false"), 5, 80).count() == 0
    same = spark.createDataFrame([(8, t), (8, t + " x"), (9, t)], "doc_id long, text string")
    assert [r["doc_id"] for r in ngramjoin.one_of_each(same, 5, 80).collect()] == [8]


def test_models_of_many_languages_are_used_in_blocks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(None, None, "en"), (-1, "12 34", "en"), (-1, "12 34", "en")], docs.schema))
    whole = langid.fit(docs)
    monkeypatch.setattr(langid, "MODEL_LANGS", 1)
    monkeypatch.setattr(langid, "BLOCKS_A_PASS", 2)
    large = langid.fit(docs)
    assert isinstance(large, langid.LargeModel) and large.blocks == len(whole.langs) > 2
    told = lambda model: sorted(repr((r["doc_id"], r["lang_pred"], round(r["score"], 6), r["rejected"])) for r in langid.identify(docs, model).collect())
    assert told(large) == told(whole)
