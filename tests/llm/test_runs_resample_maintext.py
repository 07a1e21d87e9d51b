"""Word runs, resampling and main text: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from symgraph.llm import maintext, queries, resample, wordruns

LONG = " ".join(f"w{k % 977}x" for k in range(30_000))
TEXTS = ["", None, "a", "one two three " * 9, "one two three " * 9, LONG, " \n\t ", "é 世界 é 世界", "no run here at all"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "own", "own") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "own", "own"), (None, "one one " * 8, None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, weight string")


# ---------------------------------------------------------------- runs

def brute_runs(words, least):
    """Every stretch by its smallest period, by comparing each word with that q places on."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q))


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 5, 20, 70]))]
            if len(w) > 5 and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = rng.randrange(1, len(w) - a + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        least = rng.choice([2, 3, 4, 8, 12])
        got = wordruns.runs_of(np.array([x for w in texts for x in w]), np.array([len(w) for w in texts]), least)
        assert list(zip(*(g.tolist() for g in got), strict=True)) == [(d, *r) for d, w in enumerate(texts) for r in brute_runs(w, least)]


def test_long_runs_take_loglinear_time():
    n = 150_000
    for w, period in ((np.zeros(n, int), 1), (np.tile(np.arange(77), n // 77 + 1)[:n], 77)):
        got = wordruns.runs_of(w, np.array([n]))
        assert [g.tolist() for g in got] == [[0], [0], [n], [period]]


def test_word_runs_query(spark, sf_dir):
    """The whole query again in plain Python; runs of long texts by comparing whole columns of words."""
    texts = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf_dir).collect()]
    rows = {r["doc_id"]: r for r in queries.op11_word_runs(spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    for d, text in texts:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        codes, found = np.unique(np.array(w), return_inverse=True)[1] if w else np.zeros(0, int), {}
        for q in range(1, len(w) // 2 + 1):
            same = np.concatenate(([False], codes[q:] == codes[:-q], [False]))
            edges = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if e - s >= q and e - s + q >= 12:
                    found.setdefault((s, e + q), q)
        runs = sorted((s, e - s, q) for (s, e), q in found.items())
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        expected = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        r = rows[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == expected, d
        assert r["runs_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest()


def test_word_runs_cases(odd):
    found = wordruns.find_runs(odd, ["doc_id", "runs"])
    assert found.columns == ["doc_id", "runs", "runs_", "collapsed"]
    rows = found.collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == odd.count() and sum(r["doc_id"] == 3 for r in rows) == 2
    assert [tuple(r) for r in by_id[3]["runs_"]] == [(0, 27, 3)] and by_id[3]["collapsed"] == "one two three"
    assert [tuple(r) for r in by_id[5]["runs_"]] == [(0, 30_000, 977)] and by_id[5]["collapsed"] == " ".join(LONG.split()[:977])
    assert by_id[0]["collapsed"] == by_id[1]["collapsed"] == by_id[6]["collapsed"] == "" and by_id[7]["runs_"] == [] and by_id[7]["collapsed"] == TEXTS[7]
    assert {r["collapsed"] for r in rows if r["doc_id"] is None} == {"", "one"}
    empty = wordruns.find_runs(odd.where("false"), ["doc_id"])
    assert wordruns.digests(empty).count() == 0


# ---------------------------------------------------------------- resampling

def test_composed_checksums_against_zlib():
    rng = random.Random(5)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _ in range(60):
        parts = lambda: [rng.choice(["a", "B", "é", "世", " ", "-", "1", "z" * rng.randrange(1, 130), "\n", "_"]) for _ in range(rng.randrange(0, 30))]
        texts = ["".join(parts()) if rng.random() < 0.9 else None for _ in range(rng.randrange(1, 8))]
        told = resample._texts(pa.array(["lead", *texts], pa.string()).slice(1))
        for n, (row, crcs) in enumerate(resample.feature_crcs(*told, 4), start=1):
            words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts]
            expected = [(d, zlib.crc32(" ".join(w[i : i + n]).encode())) for d, w in enumerate(words) for i in range(len(w) - n + 1)]
            assert list(zip(row.tolist(), crcs.tolist(), strict=True)) == expected


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling_against_brute_force(spark, sf_dir, orders):
    docs, target = queries.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    buckets = 500

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    told = {r["doc_id"]: features(r["text"]) for r in docs.collect()}
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, f in told.values():
        np.add.at(s, f, 1)
    for r in target.collect():
        np.add.at(t, features(r["text"])[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    weight = {d: sum(gain[b] for b in f) // len(f) if f else 0 for d, (_, f) in told.items()}
    h = {d: int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16) for d in told}
    score = {d: weight[d] + math.floor(-1000 * math.log(-math.log((h[d] + 0.5) / 2**32))) for d in told}
    may = sorted((d for d in told if told[d][0] >= 20), key=lambda d: (-score[d], d))
    rank = {d: k for k, d in enumerate(may[: 30 * len(may) // 100], start=1)}
    rows = resample.resample(docs, target, orders, buckets, percent=30, least_words=20, seed=7).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows} == {d: (len(told[d][1]), weight[d], score[d], rank.get(d)) for d in told}


def test_resampling_cases(spark, odd):
    none = odd.where("false")
    gain = resample.gains(odd, none, orders=2, buckets=50)
    weighed = resample.weigh(odd, gain, ["doc_id", "weight"], orders=2)
    assert weighed.columns == ["doc_id", "weight", "n_words", "n_features", "weight_"]
    rows = resample.resample(odd, odd, orders=2, buckets=50, percent=100, least_words=0).collect()
    assert len(rows) == odd.count() and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    assert {(r["n_features"], r["weight"]) for r in rows if r["doc_id"] in (0, 1, 6)} == {(0, 0)}
    same = [r for r in rows if r["doc_id"] == 3]
    assert len(same) == 2 and same[0]["score"] == same[1]["score"] and abs(same[0]["rank"] - same[1]["rank"]) == 1
    assert {r["rank"] for r in resample.resample(odd, odd, percent=0).collect()} == {None}
    assert resample.resample(none, none).count() == 0
    with pytest.raises(ValueError):
        resample.gains(odd, odd, buckets=0)


def test_many_equal_rows_get_ranks_of_their_own(spark):
    docs = spark.range(3_000).selectExpr("7L AS doc_id", "'some words that are all alike' AS text")
    rows = resample.resample(docs, docs, percent=50, least_words=1).select("rank").collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1_501))


# ---------------------------------------------------------------- main text

P = "<p>Long running text of an article, with a comma or two, and enough words to be dense.</p>"
PARTS = {
    "plain": (f"<body><div>{P}{P}</div></body>", 2),
    "blog": (f"<body class='home no-sidebar'><header><h1>Site</h1><a href=/>Home</a></header><div id=content><article><header><h1>Title</h1></header>{P * 3}<footer>by me</footer></article></div><aside>{P}</aside></body>", 3),
    "comments": (f"<body><main><article>{P * 2}</article><section id='comments'><article class='comment'>{P}</article><article class='comment'>{P}</article></section></main></body>", 2),
    "notices": (f"<body><div class='cookie-banner'>{P}</div><div role=alert>{P}</div><form>{P}<button>{P}</button></form><article>{P * 2}</article><div class='adBox'>{P}</div></body>", 2),
    "form around": (f"<body><form action=x><div class=menuBar>{P}</div><h1>Title</h1>{P * 2}<input name=q></form></body>", 2),
    "parts": (f"<body><div><section>{P * 4}</section><section>{P * 2}</section></div><div><a href=1>one link</a> <a href=2>another link</a></div></body>", 6),
    "left open": (f"<body><nav><ul><li><a href=1>one<li><a href=2>two</ul></nav><article><p><b>{P[3:-4]}<br>{P * 2}", 3),
}


@pytest.mark.parametrize("name", sorted(PARTS))
def test_main_text_of_made_up_pages(name):
    page, copies = PARTS[name]
    title = "Title " if "Title" in page else ""
    assert maintext.main_text(f"<!doctype html><html><head><title>t</title></head>{page}</html>") == title + " ".join([P[3:-4]] * copies)


def test_main_text_reads_markup():
    of = maintext.main_text
    assert of("<p>a &lt;b&gt; &amp;amp; &#233;&nbsp;c</p>") == "a <b> &amp; é c"
    assert of("<p>one<b>two</b> <i>three</i><br>four<p>five<!-- <p>no --><script>var t='</p>';</script>six") == "onetwo three four fivesix"
    assert of("<p title='a>b' data-x=it's>1 < 2</p><p id=\"x>y\">rest</p>") == "1 < 2 rest"
    assert of("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert [of(t) for t in ("", None, "<", "<div", "<script>x", "<!-- x", "text")] == ["", "", "<", "", "", "", "text"]


def test_main_text_of_deep_and_long_pages():
    deep = "<div>" * 20_000 + "deep words" + "</div>" * 20_000
    assert maintext.main_text(deep) == "deep words"
    assert maintext.main_text("<article>" + P * 20_000).count("Long") == 20_000
    assert maintext.main_text("<body>" + "<p a=\"" * 3_000 + "x") is not None


def test_main_text_density_by_hand():
    # Two paragraphs of 40 and 20 characters in one block, without links: densities 40 and 20, of the block 60 / 2.
    root, nodes = maintext.read_tree("<body><div><p>" + "x" * 40 + "</p><p>" + "y" * 20 + "</p></div></body>")
    assert [n.name for n in nodes] == ["#root", "body", "div", "p", "p"] and [n.chars for n in nodes] == [0, 0, 0, 40, 20]
    assert maintext.density(60, 2, 0, 0, 0.0) == 30
    linked = maintext.density(50, 3, 10, 1, 0.2)
    assert linked == pytest.approx(50 / 3 * math.log(50 / 10 * 3 / 1) / math.log(math.log(50 / 40 * 10 + 0.2 * 50 + math.e)))


def test_main_text_cases(spark):
    page = f"<article>{P}</article>"
    rows = [(1, "u", page, "own"), (1, "u", page, "own"), (2, None, None, "own"), (None, "v", "", None), (3, "w", "<nav>only a menu</nav>", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = maintext.extract(pages, ["page_id", "text"])
    assert found.columns == ["page_id", "text", "text_", "n_chars"]
    got = sorted((r["page_id"] or 0, r["text_"], r["n_chars"]) for r in found.collect())
    assert got == [(0, "", 0), (1, P[3:-4], len(P) - 7), (1, P[3:-4], len(P) - 7), (2, "", 0), (3, "", 0)]
    assert maintext.extract(pages.where("false"), ["page_id"]).count() == 0
