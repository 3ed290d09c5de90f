from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tillpath.llm import exact_dedup as ed
from tillpath.llm.sharding import shard


def brute_dedup(rows):
    plain = {}
    for doc, text in rows:
        plain.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc))
    return sorted(
        [
            (repr(doc), repr(min(group)[2]), len(group), doc == min(group)[2], hashlib.sha256(p.encode()).hexdigest())
            for p, group in plain.items() for _, _, doc in group
        ]
    )


def got_dedup(df):
    return sorted((repr(r[0]), repr(r[1]), r[2], r[3], r[4]) for r in df.collect())


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_dedup_equals_grouping_by_text(make_docs, block):
    texts = ["", None, " ", "ab c", "abc", "a bc\n", "abcd", "aaaa", "aaaaa", "aaaaaa", "abcabc", "é é", "éé", "\U0001f600" * 7, "x" * 31, "x" * 32]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, "abc"), (3, "ab c")]
    assert got_dedup(ed.exact_dedup(make_docs(rows), block)) == brute_dedup(rows)


def test_dedup_of_hot_groups(make_docs, monkeypatch):
    rows = [(i, ("hot text " * 3 if i % 3 else f"own {i} text") + " " * (i % 2)) for i in range(4000)]
    assert got_dedup(ed.exact_dedup(make_docs(rows), 8)) == brute_dedup(rows)


def test_dedup_odd_rows(odd_docs, some_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    wide = odd_docs.withColumn("kept", F.lit(1)).withColumn("name", F.lit("x")).withColumn("_name", F.lit(2))
    assert got_dedup(ed.exact_dedup(wide)) == brute_dedup(rows)
    assert ed.exact_dedup(odd_docs.limit(0)).count() == 0
    kept = ed.drop_copies(some_docs)
    assert kept.columns == some_docs.columns
    want = {r[0] for r in brute_dedup([(r.doc_id, r.text) for r in some_docs.collect()]) if r[3]}
    assert {repr(r.doc_id) for r in kept.select("doc_id").collect()} == want


def jump_hash(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_equal_the_published_algorithm(spark, odd_docs, make_docs):
    ids = [0, 1, 2, 7, 23, 10**12, 2**63 - 1, -1, -(2**63), None] + list(range(100, 2000))
    rows = [(i, "té" * (k % 5)) for k, i in enumerate(ids)]
    for docs, source in ((make_docs(rows), rows), (odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])):
        got = shard(docs).collect()
        assert len(got) == len(source)
        seen = sorted((repr(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got)
        assert seen == sorted(
            (repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump_hash(i or 0, 24), jump_hash(i or 0, 25))
            for i, t in source
        )
        assert all(r.grown_shard in (r.shard, 24) for r in got)
        for s in range(24):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_of_an_empty_table_and_clashing_names(odd_docs):
    assert shard(odd_docs.limit(0)).count() == 0
    assert shard(odd_docs.withColumn("shard", F.lit(1)).withColumn("_at", F.lit(1))).count() == odd_docs.count()
