"""What Python workers are sent and what they keep."""

import pyarrow as pa

from symgraph.llm import toxicity
from symgraph.llm.common import map_texts
from symgraph.llm.tokens import Encoder, vocabulary


def test_texts_that_pass_through_are_sent_once(spark):
    docs = spark.createDataFrame([(1, "a good text", 3), (2, None, 4), (3, "", 5)], "doc_id long, text string, n long")
    found = toxicity.segments(docs, toxicity.ToxicityModel(), keep=["doc_id", "text", "n"])
    assert "__text" not in found._jdf.queryExecution().toString()
    rows = found.orderBy("doc_id").select("doc_id", "text", "n", "score").collect()
    assert [tuple(r) for r in rows] == [(1, "a good text", 3, 0.0), (2, None, 4, 0.0), (3, "", 5, 0.0)]


def test_kept_columns_of_another_type_stay_as_they_are(spark):
    found = map_texts(spark.range(3), ["id"], {"n": ("long", pa.int64())}, lambda texts: [[len(t) for t in texts]], text="id")
    assert sorted(map(tuple, found.collect())) == [(0, 1), (1, 1), (2, 1)] and dict(found.dtypes)["id"] == "bigint"


def test_a_worker_keeps_a_bounded_number_of_pieces():
    encoder = Encoder(vocabulary("byte_bpe_50k.json"))
    texts = ["x " + " ".join(f"w{k}" for k in range(at, at + 5_000)) for at in range(0, 300_000, 5_000)]
    for at in range(0, len(texts), 10):
        for text, ids in zip(texts[at : at + 10], encoder.encode(texts[at : at + 10], 0), strict=True):
            assert ids[:-1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.codes) <= 200_000
