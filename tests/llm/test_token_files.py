from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillpath.llm import range_coder as rc
from tillpath.llm import token_files as tf
from tillpath.llm.tokens import library_tokenizer


def same(blocks):
    back = rc.decode_blocks(rc.encode_blocks([np.array(b, np.int64) for b in blocks]))
    assert [b.tolist() for b in back] == [list(b) for b in blocks]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=200), max_size=6))
def test_round_trip(blocks):
    same(blocks)


def test_round_trip_of_long_skewed_and_extreme_blocks():
    rng = np.random.default_rng(3)
    blocks = [
        [7] * 5000, list(range(4096)), rng.integers(0, 65536, 4096).tolist(), [65535, 0] * 2000,
        np.minimum(rng.zipf(1.3, 5000), 65535).tolist(), [], [65535],
    ]
    same(blocks)
    sizes = [len(p) for p in rc.encode_blocks([np.array(b, np.int64) for b in blocks])]
    assert sizes[0] < 1000 and sizes[3] < 1200 and sizes[4] < 2 * 5000
    with pytest.raises(ValueError):
        rc.encode_blocks([np.array([65536])])


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 500, 700) for _ in range(5)]
    payloads = rc.encode_blocks(blocks)
    assert rc.encode_blocks([blocks[2]])[0] == payloads[2]
    assert (rc.decode_blocks([payloads[3]])[0] == blocks[3]).all()
    for place in (5, 9, 40, len(payloads[1]) - 30):
        broken = bytearray(payloads[1])
        broken[place] ^= 4
        with pytest.raises(ValueError):
            rc.decode_blocks([bytes(broken)])
    with pytest.raises(ValueError):
        rc.decode_blocks([payloads[1][:-2]])


def test_crcs_combine():
    data = bytes(range(256)) * 40
    parts = [data[:3], b"", data[3:1000], data[1000:]]
    assert tf.combined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(data)


def check(spark, docs, folder, block_ids):
    tf.write(docs, folder, block_ids=block_ids)
    library = library_tokenizer(public_tokenizers.path(tf.VOCABULARY))
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        want.append((repr(doc), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tf.read_index(spark, folder).collect()
    assert sorted((repr(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    parts = tf.read_ids(spark, folder).collect()
    assert sum(len(p["ids"]) for p in parts) == start


@pytest.mark.parametrize("block_ids", [64, 4096])
def test_files_give_every_document_back(spark, some_docs, odd_docs, tmp_path, block_ids):
    check(spark, some_docs, str(tmp_path / "all"), block_ids)
    wide = odd_docs.withColumn("file", F.lit(1)).withColumn("parts", F.lit("p")).withColumn("ids", F.lit(2))
    check(spark, wide, str(tmp_path / "odd"), block_ids)


def test_empty_table(spark, odd_docs, tmp_path):
    tf.write(odd_docs.limit(0), str(tmp_path / "none"))
    assert tf.read_index(spark, str(tmp_path / "none")).count() == 0


def test_all_lanes_of_all_blocks_advance_together(monkeypatch):
    steps, look = [], rc._Followers.look
    monkeypatch.setattr(rc._Followers, "look", lambda self, active, *ids: steps.append(active) or look(self, active, *ids))
    blocks = [np.arange(4096) % k for k in (7, 300, 4096)] + [np.arange(100)]
    payloads = rc.encode_blocks(blocks)
    assert max(steps) > 3 * 4096 // 64 and len(steps) <= 64
    steps.clear()
    assert [b.tolist() for b in rc.decode_blocks(payloads)] == [b.tolist() for b in blocks]
    assert len(steps) <= 64


def test_long_and_ragged_blocks_beside_others():
    rng = np.random.default_rng(5)
    blocks = [np.minimum(rng.zipf(1.2, n), 65535) for n in (1, 63, 64, 65, 129, 4097, 50000)] + [rng.integers(0, 65536, 70000)]
    payloads = rc.encode_blocks(blocks)
    assert [rc.encode_blocks([b])[0] for b in blocks] == payloads
    assert [b.tolist() for b in rc.decode_blocks(payloads[::-1])][::-1] == [b.tolist() for b in blocks]


def test_a_block_is_smaller_than_its_single_ids_say():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 49408, 400)
    ids = words[np.minimum(rng.zipf(1.4, 4096), 400) - 1]
    counts = np.unique(ids, return_counts=True)[1]
    entropy = -(counts * np.log2(counts / 4096)).sum() / 8
    # Telling the ids takes at most two bytes each, a lane at most four.
    assert len(rc.encode_blocks([ids])[0]) < 1.1 * entropy + 2 * len(counts) + 4 * 128 + 100


def test_damage_is_told_or_does_no_harm():
    rng = np.random.default_rng(7)
    ids = np.minimum(rng.zipf(1.3, 1500), 65535)
    payload, told = rc.encode_blocks([ids])[0], 0
    for place in rng.integers(0, len(payload), 300):
        broken = bytearray(payload)
        broken[place] ^= 1 << rng.integers(0, 8)
        try:
            # The last word of a lane may name another place in the same interval.
            assert (rc.decode_blocks([bytes(broken)])[0] == ids).all()
        except ValueError:
            told += 1
    assert told > 270
