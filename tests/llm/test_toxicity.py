"""Held-out accuracy, and texts without features."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.llm import toxicity

rnd = random.Random(5)
WORDS = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "ve") for b in ("na", "ko", "di", "pe", "ru", "shi", "bo", "ga")]


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = [], []
    for i in range(1500):
        bad = rnd.random() < 0.3
        w = [rnd.choice(WORDS) for _ in range(rnd.randrange(20, 200))]
        for _ in range(4 if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["vile", "grubby", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame([*rows, (None, "vile nasty"), (2000, None), (2001, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_held_out_accuracy(spark, data):
    docs, labels = data
    w = toxicity.train(docs, labels)
    assert 0 < (w != 0).sum() < 0.1 * len(w)
    s = toxicity.score(docs, w, ["doc_id"])
    assert s.count() == 1503 and s.where("score < 0 OR score > 1 OR isnan(score)").count() == 0
    held = s.join(labels.where("toxic IS NOT NULL"), "doc_id").where(toxicity.fold(F.col("doc_id")) == 0)
    right = held.where((F.col("score") >= 0.5).cast("int") == F.col("toxic")).count()
    assert right >= 0.95 * held.count() > 200
    assert s.where("doc_id IN (2000, 2001)").select("score").distinct().count() == 1


def test_held_out_labels_are_never_read(spark, data):
    docs, labels = data
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.train(docs, labels) == toxicity.train(docs, turned)).all()


def test_nothing_to_learn(spark, data):
    docs, labels = data
    w = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, w, ["doc_id"]).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), w, ["doc_id"]).count() == 0


def plain_ftrl(rows, epochs, seed):
    """Per-coordinate FTRL-proximal, one number at a time."""
    z, n = {}, {}
    draw = np.random.default_rng(seed)

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            places, label = rows[k]
            x = {**{int(i): (len(places) + 1) ** -0.25 for i in places}, "intercept": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_is_the_plain_one():
    rows = [(np.array(sorted(rnd.sample(range(60), rnd.randrange(1, 20)))), rnd.randrange(2)) for _ in range(200)]
    w = toxicity.ftrl(rows, bits=6, epochs=3, seed=4)
    expected = plain_ftrl(rows, 3, 4)
    assert w[-1] == pytest.approx(expected["intercept"]) and sum(v == 0 for k, v in expected.items()) > 3
    assert all(w[i] == pytest.approx(expected.get(i, 0.0), abs=1e-12) for i in range(64))


def test_features_are_words_pairs_and_skips():
    m = 2**64
    mix = [int(x) for x in toxicity.MIX]

    def word(t):
        h = (zlib.crc32(t) * mix[0] + len(t)) % m
        return (h ^ (h >> 31)) * mix[1] % m

    texts = ["One two  THREE two", "", None, "x", "a b", "É é " + "long " * 2000]
    for t, got in zip(texts, toxicity.Features()(texts), strict=True):
        w = [word(x) for x in (t or "").encode().lower().split()]
        found = [x * mix[3] % m for x in w] + [(a * mix[1] + b) * mix[2] % m for a, b in zip(w, w[1:], strict=False)] + [(a * mix[2] + b * mix[1]) * mix[0] % m for a, b in zip(w, w[2:], strict=False)]
        assert got.tolist() == sorted({x >> 44 for x in found})


def test_a_very_long_text_is_scored_whole(spark, data):
    """What stands behind a long text changes its score."""
    plain = "lona miko radi " * 100_000
    w = toxicity.train(*data)
    df = spark.createDataFrame([(1, plain), (2, plain + "vile nasty grubby " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, w, ["doc_id"]).collect()}
    assert set(got) == {1, 2} and 0 <= got[1] < got[2] <= 1


def test_ids_that_repeat_and_clashing_names(spark, data):
    docs, labels = data
    w = toxicity.train(docs, labels)
    assert (toxicity.train(docs.unionByName(docs), labels) == w).all()
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), w, ["doc_id", "score"])
    assert out.columns == ["doc_id", "score"] and out.schema["score"].dataType.simpleString() == "double"
