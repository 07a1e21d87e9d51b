"""The pipeline's stages, one by one, against plain Python."""

import re
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from symgraph.llm import quality, toxicity
from symgraph.llm.common import table
from symgraph.llm.tokens import vocabulary

from .test_cases import brute_links

SPACES = " \t\n\x0b\x0c\r"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_fails(line):
    words, chars = len(WORD_RE.findall(line)), sum(c not in SPACES for c in line)
    symbols, marks = sum(c in quality.SYMBOLS for c in line), len(re.findall(quality.NAVIGATION_MARKS_RE, line))
    return chars > 0 and bool(
        symbols * 100 >= chars * quality.MAX_SYMBOL_PERCENT
        or len(re.findall(quality.SHOUT_RE, line)) * 100 >= words * quality.MAX_SHOUT_PERCENT
        or (words >= quality.UNPUNCTUATED_WORDS and not re.search(quality.PUNCTUATION_RE, line))
        or (marks >= 3 and marks * 4 >= words)
        or re.search(quality.NAVIGATION_RE, line)
        or re.search(quality.BOILERPLATE_RE, line)
    )


def cleaned(text):
    """The text that the quality stage keeps, or None."""
    words, w = WORD_RE.findall(text), quality.WINDOW
    windows = [tuple(words[k : k + w]) for k in range(len(words) - w + 1)]
    times = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    repeated = {k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(w)}
    if len(words) < quality.MIN_WORDS or 100 * len(repeated) > quality.MAX_REPEATED_PERCENT * len(words):
        return None
    kept = "\n".join(x for x in text.split("\n") if not line_fails(x))
    seen = lambda t: sum(c not in SPACES for c in t)
    return kept if (seen(text) - seen(kept)) * 100 <= seen(text) * quality.MAX_LOST_PERCENT else None


def test_stages(spark, sf_dir, tmp_path):
    docs, columns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "documents").columns
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) or name in ("toxicity",)

    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    clean = {d: t for d, t in given.items() if model.probability(toxicity.score_text(t, model)[0]) < 0.5}
    assert seen["toxicity"] == clean and len(clean) < len(given)

    good = {d: cleaned(t or "") for d, t in clean.items()}
    assert seen["quality_rules"] == {d: t for d, t in good.items() if t is not None}

    key, owner, left = lambda line: line.strip(SPACES).translate(LOWER), {}, {}
    for d in sorted(seen["quality_rules"]):
        lines = seen["quality_rules"][d].split("\n")
        for line in lines:
            owner.setdefault(key(line), d)
        left[d] = "\n".join(x for x in lines if len(key(x)) < 10 or owner[key(x)] == d)
    assert seen["line_dedup"] == left

    groups = brute_links(list(left.items()), 5, 80)
    assert seen["ngram_join"] == {d: left[d] for d, (_, c) in groups.items() if c == d}

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces, windows = {}, {}
    for r in cp.STAGES[-1][1](spark, docs, sf_dir).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(seen["ngram_join"])
    for d, text in seen["ngram_join"].items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for held in windows.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024


@pytest.mark.parametrize("rows", [[], [(1, "too short", "en", "s", 9), (None, None, None, None, None)]])
def test_nothing_comes_in_or_nothing_survives(spark, sf_dir, tmp_path, rows):
    """An empty table, and one whose documents all fail the quality rules; with a column whose name an operator uses."""
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_run(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0
