"""Alignment of two tokenizers, with corpus-wide counts of linked ids through a minimal perfect hash.

Both tokenizers cut the same bytes (a space and the text). Where tokens of both end, groups end; every
stretch between two neighbouring ends belongs to one token of each, which is a link. An id pair counts how
many links of the corpus hold it.

1. Texts are encoded once and stored as ids.
2. First pass: tasks align their documents and keep counts of distinct pairs, which they hand over
   pre-aggregated and in bounded portions.
3. Distinct pairs are dealt to blocks of about `BLOCK_KEYS` by hash, and a task builds the minimal perfect hash
   of each block (`perfect_hash`); the keys are stored by index, to verify every look-up.
4. The portions become dense vectors of counts, indexed by hash, per task and block, and the
   vectors are added up as a tree of `FAN_IN` at a time.
5. Second pass: documents are aligned again, and their pairs are looked up. Hash and counts are broadcast in slices
   of at most `SLICE_KEYS` keys (16 bytes each and the bits): one slice for a usual vocabulary pair, more passes
   over the stored ids beyond that, added up by document. The highest count of every id of the second tokenizer is one
   row per vocabulary entry.

No group depends on a document, source or frequent pair: pairs are counted in the task before anything moves, and
a block holds about the same number of distinct pairs whatever their counts are.

Edge cases: NULL and empty texts, and texts whose tokens do not join to the very bytes (U+2581 reads back as
a space), have no tokens: zeros and an empty digest column. Special tokens in a text are plain text. Every row
gives a row, with a repeated or NULL doc_id too; a text counts as often as it is there. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import small
from tillpath.llm.perfect_hash import PerfectHash, block_of, build
from tillpath.llm.tokens import rank_encoding, rank_ids
from tillpath.session import stage

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_KEYS = 1 << 14
SLICE_KEYS = 1 << 22
FAN_IN = 16
# Distinct pairs a task holds before it hands a portion over.
PORTION = 1 << 20


@cache
def pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes every id stands for: of a piece model, or of a byte-level file."""
    if path.endswith(".model"):
        model = pieces(path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        return [
            bytes([int(name[1:-1], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
    encoding = rank_encoding(path)
    known = [b""] * encoding.n_vocab
    for token in encoding.token_byte_values():
        known[encoding.encode_single_token(token)] = token
    return known


@cache
def _sizes(path: str) -> np.ndarray:
    return np.fromiter(map(len, token_bytes(path)), np.int64)


def token_ids(text: str | None, first: str, second: str) -> tuple[list[int], list[int]]:
    """Ids of both tokenizers over a space and the text; none if they do not join to these bytes."""
    if not text:
        return [], []
    a, b = rank_ids(rank_encoding(first), " " + text), pieces(second).encode(text, num_threads=1)
    data = (" " + text).encode()
    if any(b"".join(map(token_bytes(path).__getitem__, ids)) != data for path, ids in ((first, a), (second, b))):
        return [], []
    return a, b


def _kind(path: str) -> str:
    """How ids are stored: in two bytes where the vocabulary allows it."""
    return "<u2" if len(token_bytes(path)) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, first: str, second: str) -> DataFrame:
    """`row` (a number per row), doc_id and the ids `a` and `b` of every row as bytes, stored."""

    def batches(stream):
        kinds = (_kind(first), _kind(second))
        for batch in small(stream, 64):
            both = [token_ids(text, first, second) for text in batch.column(2).to_pylist()]
            data = [pa.array([np.array(x[k], kinds[k]).tobytes() for x in both], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *data], ["row", "doc_id", "a", "b"])

    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text")
    )
    return stage(plain.mapInArrow(batches, "row long, doc_id long, a binary, b binary"), "token-pairs")


def _ids(stored: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some documents one after the other, and where each document starts (and the last ends)."""
    data = stored.to_pylist()
    sizes = np.fromiter(map(len, data), np.int64, len(data)) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(data), kind).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


class Alignment:
    """The links and groups of some documents, given the stored ids of both tokenizers over equal bytes."""

    def __init__(self, a: pa.Array, b: pa.Array, first: str, second: str) -> None:
        (self.a, self.a_starts), (self.b, self.b_starts) = _ids(a, _kind(first)), _ids(b, _kind(second))
        self.a_ends, self.b_ends = np.cumsum(_sizes(first)[self.a]), np.cumsum(_sizes(second)[self.b])
        ends = np.concatenate((self.a_ends, self.b_ends))
        ends.sort(kind="stable")  # two sorted halves
        again = ends[1:] == ends[:-1]
        self.common = ends[1:][again]
        ends = ends[np.concatenate(([True], ~again))] if len(ends) else ends
        self.link_a = np.searchsorted(self.a_ends, ends)
        link_b = np.searchsorted(self.b_ends, ends)
        self.pairs = (self.a[self.link_a] << 32) | self.b[link_b]

    def per_document(self, values: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Sums of `values` by document, given for every value the token of the first tokenizer it belongs to."""
        total = np.concatenate(([0], np.cumsum(values)))
        # Tokens, hence owners, are in the order of the documents.
        return np.diff(total[np.searchsorted(owners, self.a_starts)])

    def groups(self) -> list[str]:
        """Per document `a1,a2|b1;a3|b2,b3`, empty without tokens."""
        of_a, of_b = np.searchsorted(self.common, self.a_ends), np.searchsorted(self.common, self.b_ends)
        last_a = self.common[of_a] == self.a_ends
        last_b = self.common[of_b] == self.b_ends
        # A token stands behind all tokens of earlier groups, and the second tokenizer's behind the first's.
        b_before = np.searchsorted(of_b, of_a, "left")
        a_before = np.searchsorted(of_a, of_b, "right")
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + b_before] = 4 * self.a + np.where(last_a, 1, 0)
        out[np.arange(len(self.b)) + a_before] = 4 * self.b + np.where(last_b, 2, 0)
        names = _names(int(out.max()) // 4 + 1 if len(out) else 0)
        whole = [names[code] for code in out.tolist()]
        starts = self.a_starts + self.b_starts
        return ["".join(whole[s:e])[:-1] for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]


_known_names: list[str] = []


def _names(ids: int) -> list[str]:
    """For every id its decimal with a comma, a bar and a semicolon, at 4 times the id and the next places."""
    for i in range(len(_known_names) // 4, ids):
        _known_names.extend((f"{i},", f"{i}|", f"{i};", ""))
    return _known_names


def _counted(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return distinct, total


def _portions(tokens: DataFrame, first: str, second: str, most: int) -> DataFrame:
    """(pair, n): counts of the links of a task, each pair once per portion."""

    def batches(stream):
        held, counts, size = [], [], 0
        for batch in small(stream):
            distinct, n = np.unique(Alignment(batch.column(0), batch.column(1), first, second).pairs, return_counts=True)
            held.append(distinct)
            counts.append(n.astype(np.int64))
            size += len(distinct)
            if size > 2 * most:
                held, counts = map(list, zip(_counted(held, counts)))
                size = len(held[0])
                if size > most:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(counts[0])], ["pair", "n"])
                    held, counts, size = [], [], 0
        if held:
            distinct, total = _counted(held, counts)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], ["pair", "n"])

    return tokens.select("a", "b").mapInArrow(batches, "pair long, n long")


_HASH = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("sizes", pa.list_(pa.int64())), ("keys", pa.binary()), ("n_keys", pa.int64())])


def hashes(pairs: DataFrame, n_blocks: int) -> DataFrame:
    """The minimal perfect hash of distinct `pairs` (pair): a row per block."""

    def dealt(stream):
        for batch in stream:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(block_of(keys, n_blocks))], ["pair", "block"])

    def built(table: pa.Table) -> pa.Table:
        words, sizes, keys = build(table.column("pair").to_numpy())
        row = {"block": table.column("block")[0].as_py(), "words": words.tobytes(), "sizes": sizes, "keys": keys.tobytes(), "n_keys": len(keys)}
        return pa.Table.from_pylist([row], _HASH)

    return pairs.mapInArrow(dealt, "pair long, block long").groupBy("block").applyInArrow(
        built, "block long, words binary, sizes array<long>, keys binary, n_keys long"
    )


def _slices(table: DataFrame, most: int) -> list[tuple[int, int]]:
    """First and last block of consecutive blocks with at most `most` keys together (one block at least)."""
    slices, held = [], 0
    for block, n in table.select("block", "n_keys").orderBy("block").toLocalIterator():
        if not slices or held + n > most:
            slices.append((block, block))
            held = 0
        slices[-1] = (slices[-1][0], block)
        held += n
    return slices


def _loaded(table: DataFrame, first: int, last: int, n_blocks: int) -> tuple[PerfectHash, pa.Table]:
    """The hash of a slice of blocks, whose size is bounded, and its rows."""
    rows = table.where(F.col("block").between(first, last)).orderBy("block").toArrow()
    found = {b: i for i, b in enumerate(rows.column("block").to_pylist())}
    words, sizes, keys = (rows.column(c) for c in ("words", "sizes", "keys"))
    none = (np.zeros(0, "<u8"), [], np.zeros(0, np.int64))
    blocks = [
        (np.frombuffer(words[i].as_py(), "<u8"), sizes[i].as_py(), np.frombuffer(keys[i].as_py(), np.int64))
        if (i := found.get(block)) is not None else none
        for block in range(first, last + 1)
    ]
    return PerfectHash(n_blocks, first, blocks), rows


def _dense(portions: DataFrame, hashed) -> DataFrame:
    """(block, part, counts): a dense vector for every task and block of the hash."""

    def batches(stream):
        table: PerfectHash = hashed.value
        total = np.zeros(len(table.keys), np.int64)
        for batch in stream:
            at = table.index(batch.column(0).to_numpy())
            np.add.at(total, at[at >= 0], batch.column(1).to_numpy()[at >= 0])
        part = TaskContext.get().partitionId()
        spans = [(j, s, e) for j, (s, e) in enumerate(zip(table.offsets[:-1], table.offsets[1:])) if total[s:e].any()]
        for at in range(0, len(spans), 64):
            some = spans[at : at + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([table.first + j for j, _, _ in some], pa.int64()), pa.array([part] * len(some), pa.int64()),
                    pa.array([total[s:e].tobytes() for _, s, e in some], pa.binary()),
                ],
                ["block", "part", "counts"],
            )

    return portions.mapInArrow(batches, "block long, part long, counts binary")


def _tree_sum(vectors: DataFrame, fan_in: int) -> DataFrame:
    """(block, counts): the sum of all vectors of a block, `fan_in` at a time."""

    def added(table: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(v.as_py(), np.int64) for v in table.column("counts")))
        return pa.Table.from_arrays(
            [table.column("block").slice(0, 1), table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())],
            ["block", "part", "counts"],
        )

    width = (vectors.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        width = -(-width // fan_in)
        vectors = vectors.withColumn("part", F.floor(F.col("part") / fan_in))
        vectors = vectors.groupBy("block", "part").applyInArrow(added, "block long, part long, counts binary")
        if width == 1:
            return vectors.drop("part")


def _best(counted: DataFrame) -> np.ndarray:
    """The highest count of a pair, by id of the second tokenizer; one row per vocabulary entry comes to the driver."""

    def batches(stream):
        for batch in small(stream, 16):
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, n = np.frombuffer(keys, np.int64) & 0xFFFFFFFF, np.frombuffer(counts, np.int64)
                most = np.zeros(ids.max() + 1, np.int64)
                np.maximum.at(most, ids, n)
                own = np.flatnonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(most[own])], ["id", "n"])

    rows = counted.select("keys", "counts").mapInArrow(batches, "id long, n long").groupBy("id").agg(F.max("n").alias("n")).toArrow()
    ids = rows.column("id").to_numpy()
    out = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    out[ids] = rows.column("n").to_numpy()
    return out


_RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _looked_up(tokens: DataFrame, known, first: str, second: str, is_first: bool, texts: bool) -> DataFrame:
    """Per row the sums over its links that the slice holds; what depends on the row alone only with the first slice."""

    def batches(stream):
        table, counts, best = known.value
        for batch in small(stream):
            x = Alignment(batch.column(2), batch.column(3), first, second)
            distinct, inverse = np.unique(x.pairs, return_inverse=True)
            at = table.index(distinct)
            n = np.where(at >= 0, counts[np.maximum(at, 0)], 0) if len(counts) else np.zeros(len(distinct), np.int64)
            top = (at >= 0) & (n == best[np.minimum(distinct & 0xFFFFFFFF, len(best) - 1)])
            sums = [x.per_document(v[inverse], x.link_a) for v in (top.astype(np.int64), n)]
            zero = np.zeros(batch.num_rows, np.int64)
            own, digests, groups = [zero] * 4, [""] * batch.num_rows, [None] * batch.num_rows
            if is_first:
                ends_a = np.searchsorted(x.a_ends, x.common)
                n_a, n_b = np.diff(x.a_starts), np.diff(x.b_starts)
                own = [n_a, n_b, x.per_document(np.ones(len(ends_a), np.int64), ends_a), x.per_document(np.ones(len(x.link_a), np.int64), x.link_a)]
                whole = x.groups()
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in whole]
                groups = whole if texts else groups
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, [*own, *sums]), pa.array(digests, pa.string()), pa.array(groups, pa.string())],
                [c.split(" ")[0] for c in _RESULT.split(", ")],
            )

    return tokens.select("row", "doc_id", "a", "b").mapInArrow(batches, _RESULT)


def cross_alignment(
    docs: DataFrame, first: str | None = None, second: str | None = None, texts: bool = True,
    block_keys: int = BLOCK_KEYS, slice_keys: int = SLICE_KEYS, fan_in: int = FAN_IN, portion: int = PORTION,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and (with `texts`) groups of every row.

    `first` is a byte-level file, `second` a piece model that sets a space before the text.
    """
    first, second = first or public_tokenizers.path(BYTE_LEVEL), second or public_tokenizers.path(PIECES)
    spark = docs.sparkSession
    tokens = encoded(docs, first, second)
    portions = stage(_portions(tokens, first, second, portion), "pair-portions")
    distinct = stage(portions.select("pair").distinct(), "pairs")
    n_blocks = max(1, -(-distinct.count() // block_keys))
    table = stage(hashes(distinct, n_blocks), "pair-hashes")
    slices = _slices(table, slice_keys)
    counted = []
    for a, b in slices:
        shared = spark.sparkContext.broadcast(_loaded(table, a, b, n_blocks)[0])
        vectors = stage(_dense(portions, shared), "pair-vectors")
        counted.append(stage(_tree_sum(vectors, fan_in), "pair-counts"))
        shared.destroy()
    columns = [c.split(" ")[0] for c in _RESULT.split(", ")][1:]
    columns = columns if texts else columns[:-1]
    if not slices:
        return _without_links(tokens, columns)
    filled = table.join(reduce(DataFrame.unionByName, counted), "block")
    best = _best(filled)
    parts = []
    for k, (a, b) in enumerate(slices):
        hashed, rows = _loaded(filled, a, b, n_blocks)
        counts = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in rows.column("counts")])
        known = spark.sparkContext.broadcast((hashed, counts, best))
        parts.append(_looked_up(tokens, known, first, second, k == 0, texts))
    if len(parts) == 1:
        return parts[0].select(*columns)
    sums = [F.sum(c).alias(c) for c in columns[1:7]]
    rest = [F.max(c).alias(c) for c in columns[7:]]
    return reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, *rest).select(*columns)


def _without_links(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """The result where no text has tokens."""
    zeros = [F.lit(0).cast("long").alias(c) for c in columns[1:7]]
    return tokens.select("doc_id", *zeros, *[F.lit("").alias(c) for c in columns[7:]])
