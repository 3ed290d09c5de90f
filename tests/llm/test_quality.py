from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tillpath.llm import positive_unlabelled as pu
from tillpath.llm import quality_rules as qr
from tillpath.llm import text_features as tf


def auc(scores, truth):
    order = np.argsort(np.argsort(scores))
    good = np.array(truth) == 1
    n, m = good.sum(), (~good).sum()
    return (order[good].sum() - n * (n - 1) / 2) / (n * m)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(1 for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_counts_equal_a_plain_count(some_docs, odd_rows):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("ab é #| \n \t x", k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["a b c a b c", "a a a", "a a a a", "l\nl\n\n\nl \nl", ""] + [r.text for r in some_docs.limit(40).collect() if len(r.text) < 6000]
    texts += [t for _, t in odd_rows if t and len(t) < 100]
    for text in texts:
        data = text.encode()
        assert qr.counts(data, data.split()) == brute_counts(text)


def test_rules_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in qr.quality_rules(docs, labels.where("doc_id % 2 = 0")).collect()}
    truth = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    fair = [(got[d].kept, q) for d, q in truth.items() if not got[d].base_failed]
    assert np.mean([k for k, q in fair if q == 1]) > 0.98
    assert np.mean([k for k, q in fair if q == 0]) < 0.1


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(0)
    x = np.zeros((6000, tf.SIZE), np.float32)
    x[:, :3] = rng.random((6000, 3))
    chance = tf.squash(8 * x[:, 0] - 4 * x[:, 1] - 2)
    y = (rng.random(6000) < chance).astype(int)
    p = qr.fit(x[:4000], y[:4000]).probability(x[4000:])
    for low in (0.1, 0.4, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[4000:][part].mean()) < 0.08


def test_prior_is_estimated():
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.85):
        good, bad = rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000)
        mixed = np.concatenate([good[: int(3000 * prior)], bad[: int(3000 * (1 - prior))]])
        assert abs(pu.estimate_prior(good[3000:], mixed) - prior) < 0.06


def plain_risk(p, u, w, prior):
    """The risk term by term, in plain numbers."""
    import math

    def loss(row, sign):
        z = sum(float(a) * float(b) for a, b in zip(row, w[:-1])) + float(w[-1])
        return math.log1p(math.exp(-sign * z))

    positive = sum(loss(r, 1) for r in p) / len(p)
    as_negative = sum(loss(r, -1) for r in p) / len(p)
    unlabelled = sum(loss(r, -1) for r in u) / len(u)
    return prior * positive, unlabelled - prior * as_negative


def test_risk_and_slope_equal_a_plain_sum():
    rng = np.random.default_rng(4)
    p, u = rng.normal(size=(30, 6)).astype(np.float32), rng.normal(size=(40, 6)).astype(np.float32)
    seen = set()
    for prior, size in ((0.3, 0.2), (0.9, 1.5), (0.9, 0.1), (0.99, 3.0)):
        w = (size * rng.normal(size=7)).astype(np.float32).astype(float)
        for shift in (0.0, 4.0):
            q = p + np.float32(shift)
            whole, negative, slope = pu.risk(q, u, w, prior)
            first, second = plain_risk(q, u, w, prior)
            assert abs(negative - second) < 1e-4 and abs(whole - (first + max(0.0, second))) < 1e-4
            seen.add(second >= 0)
            for k in range(7):
                step = np.zeros(7)
                step[k] = 1e-3
                high, low = (plain_risk(q, u, w + s, prior) for s in (step, -step))
                # Below zero the step goes up the negative part alone.
                rise = sum(high) - sum(low) if second >= 0 else low[1] - high[1]
                assert abs(slope[k] - rise / 2e-3) < 2e-3
    assert seen == {True, False}


def test_fit_equals_the_same_steps_by_plain_means():
    """All steps of the fit with gradients summed row by row."""
    rng = np.random.default_rng(9)
    good, bad = (np.abs(rng.normal(m, 0.3, size=(25, tf.SIZE))).astype(np.float32) * (np.arange(tf.SIZE) < 5) for m in (1.0, 0.4))
    positive, unlabelled = good[:15], np.concatenate([good[15:], bad[:15]])
    model = pu.fit(positive, unlabelled, prior=0.4)
    p, u = (3.0 * tf.scaled(x).astype(float)[:, :5] for x in (positive, unlabelled))
    w, adam = np.zeros(6), tf.Adam(6, pu.RATE)
    for step in range(pu.STEPS):
        adam.rate = pu.RATE * (1 - step / pu.STEPS) + 1e-4
        s = lambda r: 1 / (1 + np.exp(-(r @ w[:5] + w[5])))
        one = lambda r, a: a * np.append(r, 1.0)
        negative = np.mean([np.log1p(np.exp(r @ w[:5] + w[5])) for r in u]) - 0.4 * np.mean([np.log1p(np.exp(r @ w[:5] + w[5])) for r in p])
        up = sum(one(r, s(r)) for r in u) / len(u) - 0.4 * sum(one(r, s(r)) for r in p) / len(p)
        slope = 0.4 * sum(one(r, s(r) - 1) for r in p) / len(p) + up if negative >= 0 else -up
        slope[:5] += pu.DECAY * w[:5]
        adam.step(w, slope)
    assert np.allclose(model.weights[:5], w[:5], atol=2e-2) and not model.weights[5:].any()


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in pu.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    scores, truth = np.array([s for s, _ in held]), np.array([q for _, q in held])
    print("auc", auc(scores, truth), "accuracy", ((scores >= 0.5) == truth).mean())
    assert auc(scores, truth) > 0.97 and ((scores >= 0.5) == truth).mean() > 0.95
    # Held-out labels change nothing.
    flipped = labels.withColumn("quality", F.when(pu.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(pu.train(docs, labels).weights, pu.train(docs, flipped).weights)


def test_odd_rows_empty_tables_and_other_columns(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 1), (8, 0), (9, 1), (99, 1), (None, 1), (10, None)], "doc_id long, quality int")
    wide = odd_docs.withColumn("kept", F.lit("k")).withColumn("score", F.lit(1)).withColumn("_0", F.lit(2)).withColumn("value", F.lit(0))
    for known in (labels, labels.limit(0)):
        judged = qr.quality_rules(wide, known).collect()
        assert len(judged) == odd_docs.count()
        assert len(pu.classify(wide, known).collect()) == odd_docs.count()
        kept = qr.drop_rejected(wide, known)
        assert kept.columns == wide.columns and kept.count() == sum(r.kept for r in judged)
    assert pu.classify(odd_docs.limit(0), labels).count() == 0
    assert qr.quality_rules(odd_docs.limit(0), labels).count() == 0


def test_sample_takes_one_row_per_doc_id(spark, make_docs):
    texts = [(i, f"text number {i}") for i in range(5)] + [(1, f"again {k}") for k in range(200)]
    docs = make_docs(texts)
    kept = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, value int")
    data, values = tf.sample(docs, kept)
    assert values.tolist() == [0, 1, 0, 1, 0]
    hashes = {r.text: r.h for r in docs.where("doc_id = 1").select("text", F.xxhash64("text").alias("h")).collect()}
    chosen = [texts[0][1], min(hashes, key=hashes.get), *[t for _, t in texts[2:5]]]
    assert (data == np.stack([tf.vector(t.encode()) for t in chosen])).all()
