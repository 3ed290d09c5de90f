from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillpath.llm.periodic_runs import collapsed, lyndon_array, periodic_runs, planted, runs, strongest


def smallest_periods(words, least_periods):
    """All runs by comparing the words one period apart; a multiple of a smaller period is no run of its own."""
    n, found = len(words), {}
    for period in range(1, n // 2 + 1):
        start = None
        for i in range(n - period + 1):
            same = i < n - period and words[i] == words[i + period]
            if same and start is None:
                start = i
            elif not same and start is not None:
                length = i - start + period
                inside = any(s <= start and start + length <= s + m for (s, m), p in found.items() if period % p == 0)
                if length >= 2 * period and not inside:
                    found[start, length] = period
                start = None
    return sorted(((s, m, p) for (s, m), p in found.items() if m >= least_periods * p), key=lambda r: (r[0], r[2]))


def plain_runs(words, min_words, min_periods):
    return [r for r in smallest_periods(words, min_periods) if r[1] >= min_words]


def plain_lyndon(ranks):
    out = []
    for i in range(len(ranks)):
        best = 1
        for j in range(i + 2, len(ranks) + 1):
            part = ranks[i:j]
            if all(part < part[k:] for k in range(1, len(part))):
                best = j - i
        out.append(best)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24))
def test_lyndon_array_equals_its_definition(ranks):
    assert lyndon_array(ranks, 4) == plain_lyndon(ranks)
    other = [3 - r for r in ranks]
    assert lyndon_array(other, 4) == plain_lyndon(other)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 8), st.integers(2, 4))
def test_runs_equal_comparing_all_periods(words, least, periods):
    assert runs(words, least, periods) == plain_runs(words, least, periods)


def test_runs_in_built_texts():
    draw = random.Random(7)
    for _ in range(150):
        words = [b"w%d" % draw.randrange(draw.choice([2, 5, 400])) for _ in range(draw.randrange(200))]
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(words) + 1)
            part = [b"w%d" % draw.randrange(9) for _ in range(draw.randrange(1, 12))]
            words[at:at] = part * draw.randrange(1, 9) + part[: draw.randrange(len(part))]
        words = planted(words, draw.randrange(10**6))
        assert runs(words) == plain_runs(words, 24, 3)


@pytest.mark.parametrize("build", [
    lambda: [b"a"] * 20000, lambda: [b"a", b"b"] * 10000, lambda: [b"%d" % (i % 997) for i in range(20000)],
    lambda: [b"%d" % i for i in range(20000)] * 3, lambda: [b"%d" % -(i // 3) for i in range(30000)],
])
def test_long_texts_take_no_quadratic_time(build):
    words = build()
    for start, length, period in runs(words):
        assert words[start : start + length - period] == words[start + period : start + length]


def test_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 900:
        a, b = b, b + a
    assert runs(b, 1, 2) == plain_runs(b, 1, 2)


def test_strongest_is_exact_and_takes_the_first():
    assert strongest([(0, 24, 3), (1, 40, 5), (9, 16, 2)]) == (0, 24, 3)
    assert strongest([(0, 10**15, 3), (1, 10**15 + 1, 3)]) == (1, 10**15 + 1, 3)
    assert strongest([]) is None


def dropped(words, found):
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def stated(words, doc_id):
    """The revision word by word."""
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None:
        words = stated(words, doc_id)
    found = plain_runs(words, 24, 3) if len(words) < 700 else runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    sha = lambda data: hashlib.sha256(data).hexdigest()
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found).encode()
    return (
        repr(doc_id), len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(dropped(words, found)),
    )


def got(df):
    picked = df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted(((repr(r[0]), *r[1:]) for r in picked.collect()), key=repr)


def test_documents_equal_a_plain_version(some_docs):
    want = sorted((expected(r.doc_id, r.text) for r in some_docs.collect()), key=repr)
    result = got(periodic_runs(some_docs, planted))
    assert result == want
    assert sum(r[1] > 0 for r in result) > 5


def test_odd_rows(odd_docs, odd_rows, make_docs):
    wide = odd_docs.withColumn("start", F.lit("x")).withColumn("runs", F.lit(1)).withColumn("period", F.lit(None).cast("int"))
    want = sorted((expected(*r) for r in odd_rows), key=repr)
    assert got(periodic_runs(odd_docs, planted)) == got(periodic_runs(wide, planted)) == want
    assert periodic_runs(odd_docs.limit(0), planted).count() == 0
    tied = make_docs([(10, "a b c " * 12 + "x " + "d e f " * 12), (10, "a b c " * 12 + "x " + "d e f " * 12)])
    rows = periodic_runs(tied).collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.collapsed) for r in rows] == [(2, 0, 36, 3, "a b c x d e f")] * 2
    assert collapsed([b"a"] * 30, [(0, 30, 1)]) == b"a"
