"""Byte-level BPE encoding with overlapping chunks, and decoding.

A text longer than a chunk is cut into windows that overlap. Every window is split into pre-tokens
by itself, in whatever task it lands. A window that begins in the middle of a pre-token is out of
step at first; from the first place in the overlap where it and its predecessor both have a
boundary they agree for ever, because a pre-token depends only on what follows its start. The piece
between two such places is encoded by itself, and the ids of the pieces of a document are put
together in order. A place counts only if the character before it is no white space: the pattern
looks ahead after white space. Boundaries at the very end of a window are not trusted.

If the overlap of some pair of windows has no such place (one long run without a boundary), the
document is put together again and encoded as one piece.

A text of one chunk is encoded where it is. Only the chunks of longer ones are shuffled.

Edge cases: NULL counts as empty and has no ids. Repeated doc_ids give a row each; other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath.llm.common import small, text_of
from tillpath.llm.tokens import rank_encoding, rank_ids
from tillpath.session import stage

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024
# A contraction is three characters, so boundaries this close to the end of a window may be wrong.
_UNSURE = 4


@cache
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def boundaries(window: str) -> list[int]:
    """Ends of the pre-tokens of `window` that follow a character other than white space."""
    ends = [m.end() for m in _pattern().finditer(window)]
    return [e for e in ends if not window[e - 1].isspace()]


def _encoded(texts: DataFrame, path: str, *keep: str) -> DataFrame:
    """The columns `keep` and the ids of column `text`."""
    fields = ", ".join(f"{k} {dict(texts.dtypes)[k]}" for k in keep)

    def batches(stream):
        encoding = rank_encoding(path)
        for batch in small(stream):
            ids = [rank_ids(encoding, t or "") for t in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"]
            )

    return texts.select(*keep, "text").mapInArrow(batches, f"{fields}, ids array<int>")


def _windows(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    def batches(stream):
        for batch in small(stream):
            for row, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(some), pa.int64()),
                            pa.array([doc] * len(some), pa.int64()),
                            pa.array(range(at, at + len(some)), pa.int32()),
                            pa.array([len(starts)] * len(some), pa.int32()),
                            pa.array([text[s : s + chunk + overlap] for s in some], pa.string()),
                        ],
                        ["row", "doc_id", "chunk", "chunks", "window"],
                    )

    return texts.select("row", "doc_id", "text").mapInArrow(
        batches, "row long, doc_id long, chunk int, chunks int, window string"
    )


def _edges(windows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Per window the boundaries in its first `overlap` characters and in the overlap with the next
    window, both counted from the start of the text."""

    def batches(stream):
        for batch in small(stream):
            heads, tails = [], []
            for number, window in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ends = [e for e in boundaries(window) if e <= len(window) - _UNSURE]
                base = number * chunk
                heads.append([base + e for e in ends if e < overlap])
                tails.append([base + e for e in ends if e >= chunk])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind)],
                ["row", "chunk", "head", "tail"],
            )

    return windows.select("row", "chunk", "window").mapInArrow(
        batches, "row long, chunk int, head array<long>, tail array<long>"
    )


def encode(
    docs: DataFrame, path: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """doc_id and `ids` (array<int>) of every row of `docs`."""
    if not _UNSURE < overlap <= chunk:
        raise ValueError("the overlap must be above 4 and no longer than a chunk")
    path = path or public_tokenizers.path(RANKS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    long = F.char_length("text") > chunk
    short = _encoded(texts.where(~long), path, "doc_id")
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(long)
    windows = stage(_windows(numbered, chunk, overlap).repartition("row", "chunk"), "bpe-windows")
    in_order = Window.partitionBy("row").orderBy("chunk")
    met = _edges(windows, chunk, overlap).select(
        "row", "chunk",
        F.array_min(F.array_intersect("head", F.lag("tail").over(in_order))).alias("start"),
    )
    document = Window.partitionBy("row")
    pieces = met.select(
        "row", "chunk",
        F.coalesce("start", F.lit(0).cast("long")).alias("start"),
        F.lead("start").over(in_order).alias("stop"),
        (F.count_if(F.col("start").isNull()).over(document) == 1).alias("whole"),
    )
    pieces = stage(pieces, "bpe-pieces")
    cuts = windows.join(pieces, ["row", "chunk"])
    base = F.col("chunk").cast("long") * chunk
    from_ = (F.col("start") - base).cast("int")
    until = F.coalesce(F.col("stop") - base, F.lit(chunk + overlap).cast("long")).cast("int")
    stitched = _encoded(
        cuts.where("whole").select(
            "row", "doc_id", "chunk", F.substring("window", from_ + 1, until - from_).alias("text")
        ),
        path, "row", "doc_id", "chunk",
    )
    together = stitched.groupBy("row", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts")
    ).select("doc_id", F.flatten("parts.ids").alias("ids"))
    unmet = cuts.where("NOT whole").groupBy("row", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", F.substring("window", 1, chunk).alias("t")))).alias("parts")
    )
    one_piece = _encoded(unmet.select("doc_id", F.array_join("parts.t", "").alias("text")), path, "doc_id")
    return short.unionByName(together).unionByName(one_piece)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and `data` (binary): the raw bytes of the ids, put together."""
    path = path or public_tokenizers.path(RANKS)

    def batches(stream):
        encoding = rank_encoding(path)
        for batch in small(stream):
            data = [encoding.decode_bytes(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(batches, "doc_id long, data binary")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 per row of `encode`, in one pass over the ids."""
    path = path or public_tokenizers.path(RANKS)

    def batches(stream):
        encoding = rank_encoding(path)
        for batch in small(stream):
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids in rows], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in rows]),
                    pa.array([hashlib.sha256(encoding.decode_bytes(ids)).hexdigest() for ids in rows]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
