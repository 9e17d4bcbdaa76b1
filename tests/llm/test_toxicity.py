import zlib

import numpy as np
import pyarrow as pa

from strideflow.llm.queries import toxicity
from strideflow.llm.toxicity import features, fit, score


def test_learns_and_bears_edge_rows(spark, table):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]

    def text(bad):
        w = list(rng.choice(vocabulary, rng.integers(20, 200)))
        for _ in range(4 if bad else 0):
            w.insert(rng.integers(0, len(w)), rng.choice(["Zonk", "zonk!", "grubble"]))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0)) for i in range(600)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (3, 1, None), (700, 0, 1), (5, None, 0)]
    docs = table(rows + [(9000, None), (9001, ""), (9002, "zonk"), (None, "zonk grubble"), (9003, "w " * 100_000), (1, rows[1][1])])
    weights = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [(r["row"]["doc_id"], r["score"]) for r in score(docs, weights).collect()]
    assert len(got) == len(rows) + 6 and all(0 <= s <= 1 for _, s in got)
    held = [(i, s) for i, s in got if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in held])
    assert right > 0.97
    by = dict(got)
    assert by[9000] < 0.5 and by[9000] == by[9001]
    assert 0 < len(weights.at) < 5000


def test_held_out_labels_are_never_read(spark, table):
    rows = [(i, f"word{i % 7} zonk" if i % 2 else f"word{i % 7}") for i in range(400)]
    labels = [(i, 1, i % 2) for i in range(400)]
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (fit(table(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert np.array_equal(a.at, b.at) and np.array_equal(a.value, b.value)


def test_nothing_to_learn(spark, table):
    weights = fit(table([]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len(weights.at) == 0
    assert score(table([]), weights).collect() == []
    assert score(table([(1, "a b")]), weights).first()["score"] < 0.5


def test_features_stay_inside_their_text():
    alone = [features(pa.array([t]))[0].tolist() for t in ("a b c", "d e", "")]
    at, bounds = features(pa.array(["a b c", "d e", None]))
    assert [at[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == alone


def test_held_out_documents_are_ranked(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["toxic"] == 0], [r["score"] for r in rows if r["toxic"] == 1]
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.93
