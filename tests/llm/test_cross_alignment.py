from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillpath.llm.cross_alignment import cross_alignment, token_bytes
from tillpath.llm.perfect_hash import PerfectHash, block_of, build

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def library_tokens(texts):
    """(id, bytes) pairs of both libraries."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    for k, b in enumerate(plain + [b for b in range(256) if b not in plain]):
        letters[chr(b) if b in plain else chr(256 + k - len(plain))] = b
    for text in texts:
        e = first.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = []
        for i in second.encode(text or ""):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        data = (" " + (text or "")).encode()
        whole = text and b"".join(x for _, x in a) == b"".join(x for _, x in b) == data
        yield (a, b) if whole else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def plain_version(rows):
    docs, count = [], Counter()
    for (doc_id, _), (a, b) in zip(rows, library_tokens(t for _, t in rows)):
        a, b = spans(a), spans(b)
        links, j = [], 0
        for x in a:
            while j and b[j - 1][2] > x[1]:
                j -= 1
            while j < len(b) and b[j][1] < x[2]:
                if b[j][2] > x[1]:
                    links.append((x[0], b[j][0]))
                j += 1
        count.update(links)
        docs.append((doc_id, a, b, links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, a, b, links in docs:
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if before <= s and e <= end) for side in (a, b)))
            before = end
            a, b = [x for x in a if x[2] > end], [x for x in b if x[2] > end]
        text = ";".join(groups)
        n_a, n_b = (sum(len(g.split("|")[k].split(",")) for g in groups) for k in (0, 1))
        out.append((
            repr(doc_id), n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
            sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


def got(df):
    return sorted((repr(r[0]), *r[1:]) for r in df.select(*COLUMNS).collect())


MIXED = [
    (20, "Été naïve Übergröße 漢字かな \U0001f600\U0001f468‍\U0001f469 <s></s><unk>"), (21, "a▁b"), (22, "tab\tand  two\n\n"),
    (23, " leading"), (24, "the the the the"), (24, "the the the the"), (25, "�\x00\x7f­"), (None, "the end"),
]


def test_odd_rows_equal_a_plain_version(make_docs, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 20000] + MIXED
    docs = make_docs(rows)
    want = plain_version(rows)
    assert got(cross_alignment(docs)) == want
    wide = docs.withColumn("row", F.lit("x")).withColumn("a", F.lit(1)).withColumn("pair", F.lit(1.5))
    assert got(cross_alignment(wide)) == want
    assert want[-1][1:] != (0,) * 6 + ("",) and sum(r[1] == 0 for r in want) == 3


def test_small_blocks_slices_and_portions_give_the_same(make_docs, some_docs):
    rows = [(r.doc_id, r.text[:3000]) for r in some_docs.limit(60).collect()]
    want = plain_version(rows)
    docs = make_docs(rows).repartition(7)
    assert got(cross_alignment(docs)) == want
    assert got(cross_alignment(docs, block_keys=50, slice_keys=1500, fan_in=2, portion=100, texts=False)) == want


def test_whole_texts_of_the_smallest_table(some_docs):
    rows = [(r.doc_id, r.text) for r in some_docs.collect()]
    result = cross_alignment(some_docs)
    assert got(result) == plain_version(rows)
    for row in result.limit(20).collect():
        assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256


def test_long_texts_and_empty_tables(odd_docs, make_docs):
    assert cross_alignment(odd_docs).count() == odd_docs.count()
    assert cross_alignment(odd_docs.limit(0)).collect() == []
    nothing = cross_alignment(make_docs([(1, ""), (2, None), (3, "▁")]))
    assert got(nothing) == [(str(i), 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_hash_is_minimal_perfect_and_verified(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 2**46, n))
    blocks = 7
    built = [build(keys[block_of(keys, blocks) == j]) for j in range(blocks)]
    whole = PerfectHash(blocks, 0, built) if n else None
    if not n:
        assert len(built[0][2]) == 0
        return
    assert sorted(whole.index(keys).tolist()) == list(range(len(keys)))
    assert (whole.keys[whole.index(keys)] == keys).all()
    others = np.setdiff1d(draw.integers(0, 2**46, 3 * n), keys)
    assert (whole.index(others) == -1).all()
    part = PerfectHash(blocks, 2, built[2:5])
    inside = (block_of(keys, blocks) >= 2) & (block_of(keys, blocks) < 5)
    assert ((part.index(keys) >= 0) == inside).all()
    with pytest.raises(ValueError):
        build(np.array([5, 5]))


def test_token_bytes():
    ids = token_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(set(ids)) == len(ids) == 50256
    assert token_bytes(public_tokenizers.path("piece_bpe_32k.model"))[13] == b"\n"
