from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillpath.llm import simhash as sh


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """fingerprint -> set of fingerprints connected to it."""
    values = sorted(set(prints))
    arr = np.array(values, np.uint64)
    seen, out = {}, {}
    for start in values:
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            x = np.uint64(todo.pop())
            near = arr[np.bitwise_count(arr ^ x) <= 3]
            for y in near.tolist():
                if y not in group:
                    group.add(y)
                    todo.append(y)
        for y in group:
            seen[y] = out[y] = group
    return out


def check(docs, got):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [(d, brute_print(t)) for d, t in texts]
    groups = brute_components([p for _, p in prints])
    first = {}
    for d, p in prints:
        key = min(groups[p])
        if d is not None:
            first[key] = min(first.get(key, d), d)
    want = sorted((repr(d), f"{p:016x}", repr(first.get(min(groups[p])))) for d, p in prints)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got.collect()) == want


def test_words_one_bit_apart_meet():
    low, high, patterns, count = sh._code()
    assert sorted(set(count.tolist())) == [1, 6] and (count == 6).sum() == 1771
    rng = np.random.default_rng(1)
    for x in rng.integers(0, 1 << 23, 300).tolist():
        s = low[x & 4095] ^ high[x >> 12]
        near = x ^ int(patterns[s, 0])
        for bit in range(23):
            y = x ^ (1 << bit)
            t = low[y & 4095] ^ high[y >> 12]
            assert near in [y ^ int(p) for p in patterns[t, : count[t]]]


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_every_pair_within_three_bits_shares_a_key(errors):
    rng = random.Random(errors)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), errors))
        key, owner, wide = sh.golay_keys(np.array([x, y], np.uint64))
        near = set(key[(owner == 0) & ~wide].tolist())
        assert near & set(key[(owner == 1) & wide].tolist())


@pytest.mark.parametrize("bucket", [1024, 2])
def test_components_of_planted_fingerprints(spark, bucket):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(300)]
    for base in values[:40]:
        chain = base
        for _ in range(6):
            chain ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.append(chain)
    ball = values[50]
    values += [ball ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(120)]
    groups = brute_components(values)
    signed = np.array(sorted(set(values)), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.component for r in sh.components(sh.links(df, bucket)).collect()}
    for v in signed:
        members = np.array(sorted(groups[v % (1 << 64)]), np.uint64).view(np.int64).tolist()
        assert got.get(v, v) == min(members)


def test_all_documents_equal_brute_force(some_docs, odd_docs):
    check(some_docs, sh.near_dedup(some_docs))
    wide = odd_docs.withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    check(odd_docs, sh.near_dedup(wide))
    assert sh.near_dedup(odd_docs.limit(0)).count() == 0


def test_one_of_each_group_stays(make_docs):
    base = " ".join(f"w{i}" for i in range(400))
    docs = make_docs([(5, base), (3, base + " "), (9, base.replace("w7 ", "W7 ")), (4, "other words here"), (8, None), (2, "")])
    kept = sh.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
