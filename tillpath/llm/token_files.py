"""Token ids as files of range-coded blocks.

Documents are range-partitioned by doc_id and sorted inside, so files follow one another in
ascending doc_id order. Each partition encodes its texts, appends the end id to every document and
cuts the stream of ids into blocks of a fixed number of ids, which are coded by `range_coder`. A
file is a Parquet file whose rows are blocks (`payload`), each with its place in the file and the
parts of documents it holds; Spark commits it, so a lost executor leaves no half-written file, and
any store that Spark reads serves. The reader needs nothing but the files: it decodes the blocks,
checks their checksums, and puts the parts of documents that span blocks together by combining
their CRCs.

Edge cases: a NULL or empty text is the end id alone. NULL doc_ids come first. Rows that repeat a
doc_id follow one another, ordered by text. Other columns are ignored. An empty table writes no
block and reads back as no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath.llm.common import small, text_of
from tillpath.llm.range_coder import BLOCK_IDS, LOCKSTEP, decode_blocks, encode_blocks
from tillpath.llm.tokens import word_encoder
from tillpath.session import shared_folder

VOCABULARY, END_ID = "word_bpe_49k.json", 1

_PART = pa.struct([("ordinal", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
_ROWS = (
    "file int, block long, first long, n long,"
    " parts array<struct<ordinal:bigint,doc_id:bigint,n:bigint>>, payload binary"
)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode `docs` and write its blocks below `folder`."""
    path = path or public_tokenizers.path(VOCABULARY)

    def batches(stream):
        encoder = word_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        file = TaskContext.get().partitionId()
        done = 0  # blocks written
        ids: list[np.ndarray] = []  # ids of documents not yet written, whole documents
        docs_: list[tuple[int, int, int]] = []  # (ordinal, doc_id, ids left) of those
        held, ordinal = 0, 0

        def flush(last: bool):
            nonlocal done, ids, docs_, held
            stream_ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
            count = -(-held // block_ids) if last else held // block_ids
            for at in range(0, count, LOCKSTEP):
                blocks = [stream_ids[k * block_ids : (k + 1) * block_ids] for k in range(at, min(count, at + LOCKSTEP))]
                payloads = encode_blocks(blocks)
                parts, queue = [], docs_
                for block in blocks:
                    own, need = [], len(block)
                    while need:
                        number, doc, n = queue[0]
                        take = min(n, need)
                        own.append({"ordinal": number, "doc_id": doc, "n": take})
                        need -= take
                        if take == n:
                            queue.pop(0)
                        else:
                            queue[0] = (number, doc, n - take)
                    parts.append(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * len(blocks), pa.int32()),
                        pa.array(range(done, done + len(blocks)), pa.int64()),
                        pa.array([(done + k) * block_ids for k in range(len(blocks))], pa.int64()),
                        pa.array([len(b) for b in blocks], pa.int64()),
                        pa.array(parts, pa.list_(_PART)),
                        pa.array(payloads, pa.binary()),
                    ],
                    ["file", "block", "first", "n", "parts", "payload"],
                )
                done += len(blocks)
            rest = stream_ids[count * block_ids :]
            ids, held = ([rest] if len(rest) else []), len(rest)

        for batch in small(stream):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(encoder(text) + end, "<u4")
                ids.append(own)
                docs_.append((ordinal, doc, len(own)))
                ordinal += 1
                held += len(own)
                if held >= LOCKSTEP * block_ids:
                    yield from flush(False)
        yield from flush(True)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(batches, _ROWS).write.parquet(folder)


@cache
def _zeros(power: int) -> tuple[int, ...]:
    """What 2^power zero bytes do to the CRC of every single bit."""
    if power == 0:
        columns = []
        for bit in range(32):
            value = 1 << bit
            for _ in range(8):
                value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
            columns.append(value)
        return tuple(columns)
    half = _zeros(power - 1)
    return tuple(_through(half, column) for column in half)


def _through(matrix: tuple[int, ...], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= matrix[low.bit_length() - 1]
        value ^= low
    return out


def combined_crc(crcs: list[int], sizes: list[int]) -> int:
    """CRC-32 of the concatenation, from the CRCs and byte sizes of its parts."""
    total = 0
    for crc, size in zip(crcs, sizes):
        power = 0
        while size:
            if size & 1:
                total = _through(_zeros(power), total)
            size >>= 1
            power += 1
        total ^= crc
    return total


@F.pandas_udf(T.LongType())
def _combine(crcs: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([combined_crc(c.tolist(), [4 * int(n) for n in k]) for c, k in zip(crcs, counts)])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The decoded parts: file, block, first (of the part in its file), ordinal, doc_id and `ids`."""
    return _decoded(spark.read.parquet(folder), True)


def _decoded(blocks: DataFrame, with_ids: bool) -> DataFrame:
    last = ("ids", pa.list_(pa.int32())) if with_ids else ("crc", pa.int64())

    def batches(stream):
        for batch in stream:
            for at in range(0, batch.num_rows, LOCKSTEP):
                some = batch.slice(at, LOCKSTEP)
                rows = []
                files, numbers, firsts, parts, payloads = (some.column(i).to_pylist() for i in range(5))
                for file, number, first, own, ids in zip(files, numbers, firsts, parts, decode_blocks(payloads)):
                    start = 0
                    for part in own:
                        piece = ids[start : start + part["n"]]
                        value = piece.astype(np.int32) if with_ids else zlib.crc32(piece.astype("<u4").tobytes())
                        rows.append((file, number, first + start, part["ordinal"], part["doc_id"], part["n"], value))
                        start += part["n"]
                columns = list(zip(*rows)) or [[]] * 7
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), last[1]]
                names = ["file", "block", "first", "ordinal", "doc_id", "n", last[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = "ids array<int>" if with_ids else "crc long"
    return blocks.select("file", "block", "first", "parts", "payload").mapInArrow(
        batches, f"file int, block long, first long, ordinal long, doc_id long, n long, {kind}"
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from decoded blocks."""
    blocks = spark.read.parquet(folder)
    # One row per file.
    sizes = blocks.groupBy("file").agg(F.sum("n").alias("size"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("file").alias("_file"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("_offset"))
    documents = _decoded(blocks, False).groupBy("file", "ordinal", "doc_id").agg(
        F.min("first").alias("first"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "crc", "n"))).alias("parts"),
    )
    single = F.size("parts") == 1
    columns = lambda crc: [
        "doc_id", (F.col("_offset") + F.col("first")).alias("start"), "n_tokens", crc.alias("ids_crc32")
    ]
    placed = documents.join(F.broadcast(offsets), F.col("file") == F.col("_file"))
    return placed.where(single).select(*columns(F.col("parts")[0]["crc"])).unionByName(
        placed.where(~single).select(*columns(_combine("parts.crc", "parts.n")))
    )


def scratch_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"token-files-{uuid.uuid4().hex}")
