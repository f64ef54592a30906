import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.quality import WIDTH, Model, bags, constant, encode, fit, score, train


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, counts = rng.random((9, WIDTH)), np.array([2, 1, 4, 2])
    label, weight = np.array([1.0, 0, 0, 1]), np.array([1.0, 2, 1, 0.5])
    shapes = {"encode": (WIDTH, 3), "encode0": (3,), "content": (3, 2), "gate": (3, 2), "attend": (2,), "head": (3,), "head0": (1,)}
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), {k: rng.standard_normal(s) * 0.3 for k, s in shapes.items()})

    def loss():
        p = model.forward(x, counts)
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()

    got = model.gradients(x, counts, label, weight)
    for name, w in model.weights.items():
        place = tuple(rng.integers(n) for n in w.shape)
        before, step = w[place], 1e-5
        w[place] = before + step
        up = loss()
        w[place] = before - step
        down = loss()
        w[place] = before
        assert got[name][place] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_attention_finds_the_one_bad_passage():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 9, 400)
    x = rng.random((counts.sum(), WIDTH)).astype(np.float32)
    label = rng.integers(0, 2, 400).astype(np.float32)
    starts = np.cumsum(counts) - counts
    x[starts[label == 0] + rng.integers(0, counts[label == 0]), 3] += 4
    model = fit(x, counts, label, np.ones(400, np.float32))
    assert ((model.forward(x, counts) >= 0.5) == (label == 1)).mean() > 0.97


def test_whole_texts_are_encoded_whatever_the_batch():
    texts = [None, "", "a", "é" * 2000, "The cat. " * 300_000, "x\0y"]
    together = np.concatenate([x for _, _, x in bags(texts)])
    alone = np.concatenate([x for t in texts for _, _, x in bags([t])])
    assert np.array_equal(together, alone)
    assert sum(len(c) for _, c, _ in bags(texts)) == len(texts)
    assert len(together) == sum(max(1, -(-len((t or "").encode()) // 512)) for t in texts)
    assert np.isfinite(encode(np.zeros((1, 512), np.uint8))).all()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some text"), (2, "long " * 100_000), (2, "")], "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("held_out", F.lit(3))
    labels = spark.createDataFrame([(2, None), (None, 1)], "doc_id long, quality int")
    got = score(docs, train(docs, labels))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 5
    assert got.filter("score between 0 and 1 and predicted = 1").count() == 5
    assert score(docs, constant(0.0)).filter("predicted = 0").count() == 5
    kept = score(docs, constant(0.9), keep=True)
    assert kept.columns == [*docs.columns, "quality_score"] and kept.count() == 5
    assert score(docs.limit(0), train(docs.limit(0), labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, train(docs, labels, docs_per_label=1000)).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 1000
    right = got["predicted"] == got["quality"]
    assert right.mean() > 0.95
    assert right[got["quality"] == 1].mean() > 0.97
