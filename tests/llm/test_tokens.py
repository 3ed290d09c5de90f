from __future__ import annotations

import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillpath.llm import bpe, token_counts
from tillpath.llm import tokens
from tillpath.llm.tokens import byte_level_encoder, library_tokenizer, rank_encoding, rank_ids, word_encoder, word_rank_encoding, _byte_letters, _SETTLED

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "é", "don't", "'", "re", " ", "  ", "\n", " \n ", "\t", "12", "!?", "\x1c", "\x85", "　", "word", "\U0001f600", "İ", "́", "Σ"]


def random_texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(n)]


def want(rows):
    e = rank_encoding(RANKS)
    out = []
    for doc, text in rows:
        ids = e.encode_ordinary(text or "")
        out.append(
            (repr(doc), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((text or "").encode()).hexdigest())
        )
    return sorted(out)


def got(df):
    return sorted((repr(r[0]), r[1], r[2], r[3]) for r in df.collect())


@pytest.mark.parametrize("chunk, overlap", [(32768, 1024), (64, 32), (16, 8), (5, 5)])
def test_stitched_chunks_equal_the_library(make_docs, chunk, overlap):
    rows = list(enumerate(random_texts(chunk, 150, 200)))
    assert got(bpe.digests(bpe.encode(make_docs(rows), chunk=chunk, overlap=overlap))) == want(rows)


def test_all_documents_and_odd_rows(some_docs, odd_docs, odd_rows):
    rows = [(r.doc_id, r.text) for r in some_docs.collect()]
    assert got(bpe.digests(bpe.encode(some_docs, chunk=2048, overlap=128))) == want(rows)
    wide = odd_docs.withColumn("ids", F.lit(1)).withColumn("row", F.lit(1)).withColumn("chunk", F.lit("c"))
    assert got(bpe.digests(bpe.encode(wide))) == want([r[:2] for r in odd_rows])
    assert bpe.encode(odd_docs.limit(0)).count() == 0


def test_decoding_gives_the_bytes_back(odd_docs, odd_rows):
    back = bpe.decode(bpe.encode(odd_docs, chunk=1000, overlap=100)).collect()
    assert sorted(bytes(r["data"]) for r in back) == sorted((t or "").encode() for _, t in odd_rows)


@pytest.mark.parametrize("name, encoder", [("byte_bpe_50k.json", byte_level_encoder), ("word_bpe_49k.json", word_encoder)])
def test_units_give_the_ids_of_the_whole_text(some_docs, odd_rows, name, encoder):
    path = public_tokenizers.path(name)
    own, library = encoder(path), library_tokenizer(path)
    texts = [t for _, t in odd_rows if t and len(t) < 50000] + random_texts(3, 400, 60) + [r.text for r in some_docs.limit(60).collect()]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(own(text)).cast("I")) == ids


def test_every_merge_is_what_ranks_would_do():
    """A token's bytes, encoded with lower ranks only, end in the pair that its merge names; with merges in the
    order of ids, encoding by ranks then takes the same steps as encoding by merges."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    ranks = rank_encoding(public_tokenizers.path("byte_bpe_50k.json"))._mergeable_ranks
    letters = _byte_letters()
    for pair in merges:
        first, second = (bytes(letters[c] for c in part) for part in pair)
        parts = [bytes([b]) for b in first + second]
        while len(parts) > 2:
            near = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(near)
            assert rank < ranks[first + second]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [first, second]


def test_every_merge_of_word_pieces_is_what_ranks_would_do():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    ranks = word_rank_encoding(path)._mergeable_ranks
    letters = _byte_letters()
    for pair in merges:
        first, second = (bytes(letters[c] for c in p.removesuffix("</w>")) + b"A" * p.endswith("</w>") for p in pair)
        parts = [bytes([b]) for b in first + second]
        while len(parts) > 2:
            near = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(near)
            assert rank < ranks[first + second]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [first, second]


def test_words_of_every_settled_character():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = word_encoder(path), library_tokenizer(path)
    signs = [chr(c) for c in range(0xD7A4) if _SETTLED.fullmatch(chr(c))]
    rng = random.Random(7)
    marks = [s for s in signs if 0x300 <= ord(s) < 0x370]
    texts = [f"a{s}1{s}{s}!{s} {s}s'{s}B" for s in signs]
    texts += ["".join(rng.choices(signs[:1400], k=30)) for _ in range(3000)]
    texts += ["".join(a + rng.choice(marks) + rng.choice(["", rng.choice(marks)]) for a in rng.choices(signs[:1300], k=12)) for _ in range(3000)]
    for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(memoryview(own(text)).cast("I")) == whole.ids, text


@pytest.mark.parametrize("text", ["b" * 5000, "A" * 1001 + " x", "!" * 3000, "AAA A", "\u0558\u0559x", "\U00010940a", "x\u0130\u03a3 \u03a3", " ", "\x1c \x85a"])
def test_odd_words(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = library_tokenizer(path).encode(text, add_special_tokens=False).ids
    assert list(memoryview(word_encoder(path)(text)).cast("I")) == ids


@pytest.mark.parametrize("text", [" " * 30000 + "z", " " * 30000 + "\n z", "a" + "\n" * 30000, "b" + "\t" * 25000 + " c " + " " * 20000, " " * 25000 + "\x1cq"])
def test_long_white_space(text):
    own = rank_encoding(RANKS)
    assert rank_ids(own, text) == own.encode_ordinary(text)
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = library_tokenizer(path).encode(text, add_special_tokens=False).ids
    assert list(memoryview(byte_level_encoder(path)(text)).cast("I")) == ids


def test_white_space_that_the_pattern_cannot_take():
    own = rank_encoding(RANKS)
    text = "a" + " " * 1_500_000 + "z"
    assert own.decode(rank_ids(own, text)) == text


def count(text):
    return len(rank_encoding(RANKS).encode_ordinary(text))


@pytest.mark.parametrize("leaf", [1, 8, 256])
def test_counts_after_edits_equal_a_full_count(leaf):
    rng = random.Random(leaf)
    for text in random_texts(leaf, 120, 80):
        tree = token_counts.Tree.build(text, count, leaf)
        assert tree.tokens[1] == count(text) and tree.chars[1] == len(text)
        for _ in range(12):
            start = rng.randint(0, len(text))
            stop = min(len(text), start + rng.choice([0, 0, 1, 3, 20]))
            text, _ = tree.edit(text, start, stop, "".join(rng.choices(PARTS, k=rng.randint(0, 4))), count)
            assert tree.tokens[1] == count(text) and tree.chars[1] == len(text)


def test_only_the_region_is_encoded_again():
    text = "some plain words " * 4000
    tree = token_counts.Tree.build(text, count)
    new, again = tree.edit(text, 30000, 30005, "other", count)
    assert tree.tokens[1] == count(new) and again < 4 * 300


def test_edits_table_and_revision(spark, some_docs, odd_docs, make_docs):
    docs = make_docs([(1, "one two three"), (2, "x"), (3, None)])
    edits = spark.createDataFrame(
        [(1, 0, 3, "ten"), (1, 4, 7, ""), (1, 99, 120, " more"), (3, 0, 0, "new")],
        "doc_id long, start int, stop int, replacement string",
    )
    rows = token_counts.apply_edits(token_counts.with_edits(token_counts.build_trees(docs), edits)).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert texts == {1: "ten  three more", 2: "x", 3: "new"}
    assert all(r.n_tokens == count(r.text) for r in rows)
    clash = spark.createDataFrame([(1, 0, 3, ""), (1, 2, 4, "")], "doc_id long, start int, stop int, replacement string")
    with pytest.raises(Exception, match="overlap"):
        token_counts.apply_edits(token_counts.with_edits(token_counts.build_trees(docs), clash)).collect()
    for table in (some_docs, odd_docs.withColumn("n_tokens", F.lit(1)).withColumn("edits", F.lit(2))):
        trees = token_counts.build_trees(table).withColumn("edits", token_counts.revision_of())
        rows = token_counts.apply_edits(trees).collect()
        old = sorted((repr(r.doc_id), count(r.text or "")) for r in table.select("doc_id", "text").collect())
        assert sorted((repr(r.doc_id), r.n_tokens_before) for r in rows) == old
        assert all(r.n_tokens == count(r.text) and r.text.endswith("revision.") for r in rows)
    assert token_counts.build_trees(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name, encoder", [("byte_bpe_50k.json", byte_level_encoder), ("word_bpe_49k.json", word_encoder)])
def test_added_tokens_in_a_text_give_their_ids(name, encoder):
    path = public_tokenizers.path(name)
    own, plain = encoder(path), Tokenizer.from_file(path)
    texts = ["hi <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b.", "A <|ENDOFTEXT|>! <|endoftext|>, don<|endoftext|>'t"]
    rng = random.Random(5)
    parts = [*PARTS, "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", "."]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(1500)]
    for text in texts:
        assert list(memoryview(own(text)).cast("I")) == plain.encode(text, add_special_tokens=False).ids, text
    assert list(memoryview(own(texts[0])).cast("I")) == ([5303, 220, 50256, 2124] if "50k" in name else [1883, 49407, 343])


def test_pieces_between_white_space_are_encoded_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoding, asked = word_rank_encoding(path), []

    class Counting:
        def encode_ordinary(self, text):
            asked.append(text)
            return encoding.encode_ordinary(text)

    pieces = tokens._Pieces(Counting())
    text = "the cat, the dog's the\tcat, été the"
    assert b"".join(map(pieces.__getitem__, text.encode().split())) == word_encoder(path)(text)
    assert len(asked) == len(set(asked)) == 4
    # Long pieces are not kept; a long word is the library's.
    long = b"ab," * 100
    assert pieces[long] == pieces[long] and long not in pieces
    with pytest.raises(tokens._LongWord):
        pieces[b"q" * 1001]
    words = ("q" * 1001 + " J̌ İ").encode().decode()
    assert list(memoryview(word_encoder(path)(words)).cast("I")) == library_tokenizer(path).encode(words, add_special_tokens=False).ids
