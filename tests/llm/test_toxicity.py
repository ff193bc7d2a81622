"""Operator 5: held-out accuracy, and features and scores against plain loops."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import toxicity
from cairn.llm.common import column_bytes


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.predict(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = got.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    y = np.array([r.toxic for r in rows])
    s = np.array([r.score for r in rows])
    p = np.array([r.predicted for r in rows])
    rank = s.argsort().argsort()
    n = y.sum()
    assert (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n)) > 0.93
    assert p[y == 0].mean() < 0.02 and p[y == 1].mean() > 0.6


def test_scores_are_sums_over_distinct_features():
    texts = ["you are an IDIOT you are", "", None, "a b a b", "é Ü-x, you idiot"]
    data, offsets = column_bytes(pa.array(texts))
    rng = np.random.default_rng(1)
    w = rng.normal(size=(1 << 10) + 1)
    row, at = toxicity.features(data, offsets, 10)
    want = [1 / (1 + np.exp(-(sum(w[a] for a in set(at[row == i].tolist())) + w[-1]))) for i in range(len(texts))]
    assert np.allclose(toxicity.score_block(data, offsets, w), want)
    for i, t in enumerate(texts):
        n = len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or ""))
        assert (row == i).sum() == n + max(0, n - 1) + max(0, n - 2)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(["bad words here", "good words here"] * 60)] + [(500, None, 1.0), (500, "", 1.0), (None, "x " * 30_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] + [(0, 0), (7, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    rows = toxicity.predict(docs, labels).collect()
    assert len(rows) == 123 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[2] > by[3]
    clean = toxicity.keep_clean(docs, toxicity.train(docs, labels))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} >= {3} and 2 not in {r.doc_id for r in clean.collect()}


@pytest.mark.parametrize("n", [0, 3])
def test_no_labels(spark, n):
    docs = spark.createDataFrame([(i, "text") for i in range(n)], "doc_id long, text string")
    rows = toxicity.predict(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.0, 0)] * n


def test_updates_are_those_of_the_published_loop():
    """Per-coordinate FTRL-proximal, one coordinate at a time (McMahan et al. 2013, algorithm 1)."""
    rng = np.random.default_rng(6)
    rows = [sorted(set(rng.integers(0, 64, 6).tolist())) + [64] for _ in range(200)]
    labels = [int(3 in r or rng.random() < 0.2) for r in rows]
    a, b, l1, l2 = 0.5, 1.0, 0.3, 0.1
    z, n, w = [0.0] * 65, [0.0] * 65, [0.0] * 65

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((b + n[i] ** 0.5) / a + l2)

    model = toxicity.Ftrl(6, a, b, l1, l2)
    for r, y in zip(rows, labels):
        for i in r:
            w[i] = weight(i)
        p = 1 / (1 + np.exp(-sum(w[i] for i in r)))
        for i in r:
            g = p - y
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
            z[i] += g - s * w[i]
            n[i] += g * g
        assert model.learn(np.array(r), y) == pytest.approx(p)
    assert np.allclose(model.weights(), [weight(i) for i in range(65)]) and (model.weights() == 0).any() and model.weights()[3] > 0


def test_training_counts_and_passes():
    """``fit`` learns each row once a pass, from the coordinates of ``FEWEST`` rows and more."""
    texts = ["bad word here", "good word here"] * 20 + ["alone only once"]
    got = toxicity.fit(texts, [1, 0] * 20 + [1], passes=2, bits=10, l1=0.01)
    data, offsets = column_bytes(pa.array(texts, pa.large_string()))
    row, at = toxicity.features(data, offsets, 10)
    seen = {}
    for r, c in set(zip(row.tolist(), at.tolist())):
        seen.setdefault(c, set()).add(r)
    assert all((got[c] != 0) <= (len(rs) >= toxicity.FEWEST) for c, rs in seen.items())
    data, offsets = column_bytes(pa.array(["bad word here", "good word here"]))
    bad, good = toxicity.score_block(data, offsets, got)
    assert bad > 0.6 > 0.4 > good
