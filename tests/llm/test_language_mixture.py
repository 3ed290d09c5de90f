from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpath.llm import language_mixture as lm


def plain_grams(text, n_cells):
    """The cells of all n-grams, letter by letter."""
    letters = "".join(c if c.isalpha() else "\0" for c in text.lower())
    words = [w for w in letters.split("\0") if w]
    if not words:
        return None
    codes = [0]
    for word in words:
        codes += [ord(c) for c in word] + [0]
    out = []
    for order in range(1, lm.ORDERS + 1):
        for i in range(len(codes) - order + 1):
            if order == 1 and not codes[i]:
                continue
            mixed = 0
            for c in codes[i : i + order]:
                mixed = (mixed * 0x100000001B3 + c + 1) % 2**64
            hashed = (mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
            out.append((hashed >> 32) % n_cells)
    return sorted(out)


@pytest.mark.parametrize("text", ["", " 12 !", "a", "Ab, cD.\nÉÀß 1x", "漢字 かな", "İstanbul", "x" * 50, "  lead and end  "])
def test_cells_equal_a_plain_version(text):
    got = lm.cells(text, 997)
    assert (got is None and plain_grams(text, 997) is None) or sorted(got.tolist()) == plain_grams(text, 997)


@pytest.fixture(scope="module")
def known(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.learn(docs.where(~lm.held_out()).select("text", "lang"))
    rows = docs.where(lm.held_out()).select("text", "lang").collect()
    return docs, model, rows


def test_learned_counts_equal_a_plain_count(known):
    docs, model, _ = known
    counts = {name: Counter() for name in model.names}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(lm.cells(r.text, model.n_cells).tolist() if lm.cells(r.text, 9) is not None else [])
    for k, name in enumerate(model.names):
        total = sum(counts[name].values())
        want = (np.array([counts[name][c] for c in range(model.n_cells)]) + lm.SMOOTHING) / (total + lm.SMOOTHING * model.n_cells)
        assert np.allclose(model.chances[:, k], want)
    assert math.isclose(np.exp(model.prior).sum(), 1)


def test_held_out_accuracy(known):
    _, model, rows = known
    right = [lm.predict(r.text, model)[0] == r.lang for r in rows if any(c.isalpha() for c in r.text)]
    assert len(right) > 200 and np.mean(right) > 0.98


def test_mixtures_are_found_with_their_shares(known):
    _, model, rows = known
    draw = random.Random(5)
    by = {name: [r.text for r in rows if r.lang == name and len(r.text) > 400] for name in model.names}
    sets, errors, alone = [], [], []
    for _ in range(80):
        one, two = draw.sample(model.names, 2)
        first, second = draw.choice(by[one]), draw.choice(by[two])
        n, part = draw.randint(400, 2000), draw.uniform(0.2, 0.8)
        text = (first * 9)[: int(n * part)] + " " + (second * 9)[: n - int(n * part)]
        shares, _ = lm.shares_of(lm.cells(text, model.n_cells), model)
        found = {model.names[k]: v for k, v in shares.items()}
        assert math.isclose(sum(found.values()), 1, abs_tol=1e-9)
        sets.append(set(found) == {one, two})
        errors.append(abs(found.get(one, 0) - part))
        alone.append(len(lm.shares_of(lm.cells(first, model.n_cells), model)[0]) == 1)
    assert np.mean(sets) > 0.9 and np.mean(errors) < 0.06 and np.mean(alone) > 0.9


def test_shares_have_the_greatest_likelihood():
    """Two languages: the shares against a fine search over all shares."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        chances = rng.dirichlet(np.ones(30), 2).T
        counts = rng.integers(0, 20, 30).astype(float)
        shares, reached = lm.mixture(counts, chances, np.array([0.8, 0.2]))
        grid = np.linspace(0, 1, 2001)
        best = max((counts @ np.log(chances @ np.array([t, 1 - t]))) for t in grid)
        assert reached > best - 0.05 and math.isclose(shares.sum(), 1)


def test_odd_rows(spark, odd_docs):
    schema = "doc_id long, text string, lang string, source string"
    good = [(i, "the cat and the dog sat on the mat and so on", "en", "s") for i in range(40)]
    good += [(i, "der Hund und die Katze sind auf der Matte und so", "de", "s") for i in range(40, 80)]
    odd = [(80, None, "en", "s"), (81, "", "de", "s"), (82, "12 - !", "en", "s"), (None, "the dog and the cat", "de", "s"),
           (83, "the cat", None, "s"), (83, "the cat", None, "s"), (84, "x" * 3_000_000, None, "s")]
    docs = spark.createDataFrame(good + odd, schema)
    rows = {}
    for r in lm.language_id(docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == len(good) + len(odd)
    for i in range(85):
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for r in rows[i])
    assert [rows[i][0].lang_pred for i in (0, 40, 80, 81, 82, 83)] == ["en", "de", "und", "und", "und", "en"]
    assert len(rows[83]) == 2 and rows[None][0].lang_pred == "en" and not rows[None][0].held_out
    assert all(0 <= r.score <= 1 for found in rows.values() for r in found) and rows[80][0].score == 0
    wide = docs.withColumn("languages", F.lit(1)).withColumn("cell", F.lit("x")).withColumn("held_out", F.lit("x"))
    pick = lambda df: sorted((repr(tuple(r))) for r in df.collect())
    assert pick(lm.language_id(wide)) == pick(lm.language_id(docs))
    assert lm.language_id(docs.limit(0)).collect() == []
    nothing = lm.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct()
    assert [tuple(r) for r in nothing.collect()] == [("und", 0.0)]
    assert lm.language_id(odd_docs).count() == odd_docs.count()


def test_only_rows_that_may_be_learned_from_count(spark):
    """Labels of the held-out rows change no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lied = docs.withColumn("lang", F.when(lm.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    assert sorted(map(tuple, lm.language_id(docs).collect())) == sorted(map(tuple, lm.language_id(lied).collect()))


def test_ties_and_many_languages(spark):
    rows = [(i, "same text here", "l%04d" % (i % 300), "s") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = lm.learn(docs)
    assert model.chances.size <= lm.MOST_NUMBERS and len(model.names) == 300
    assert lm.predict("same text", model)[0] == "l0000"
