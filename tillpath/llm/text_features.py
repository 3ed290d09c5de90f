"""Hashed word and character n-gram features of a text, and the linear models over them.

A text is a vector of square roots of relative frequencies: hashed byte trigrams, words and word
pairs, each with a length of one, and a few shape features between 0 and 1 (shares of symbols,
capitals, digits, repeated pairs and the like). Nothing but the text goes in.

Models are fitted on the driver on a bounded sample of rows (`SAMPLE_ROWS` of each kind, those with
the smallest hash of doc_id), whose vectors are made in the tasks: at most 4000 x 4106 numbers of
four bytes. Scores are computed for every row in Arrow batches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import small, text_of

SAMPLE_ROWS = 4000

_CHARS, _WORDS, _PAIRS = 2048, 1024, 1024
_SHAPES = 10
SIZE = _CHARS + _WORDS + _PAIRS + _SHAPES
_SLICE = 1 << 20


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SPACE = _class(b"\x20\x09\x0a\x0b\x0c\x0d")
_SYMBOL = _class(b"#*$%&|<>@^~=+_{}[]\\/!?")
_CAPITAL = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class(b"0123456789")


def _root(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / max(1, counts.sum()))


def vector(data: bytes, words: list[bytes] | None = None) -> np.ndarray:
    """The features of a UTF-8 text; `words` are its words, if they are known."""
    words = data.split() if words is None else words
    letters = np.frombuffer(data, np.uint8)
    size, n = len(letters), len(words)
    chars = np.zeros(_CHARS, np.int64)
    for at in range(0, max(0, size - 2), _SLICE):
        part = letters[at : at + _SLICE + 2].astype(np.uint32)
        mixed = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)
        chars += np.bincount(mixed >> np.uint32(21), minlength=_CHARS)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    pairs = hashes[:-1] * np.uint32(0x9E3779B1) ^ hashes[1:]
    out = np.zeros(SIZE, np.float32)
    out[:_CHARS] = _root(chars)
    word_counts = np.bincount(hashes % np.uint32(_WORDS), minlength=_WORDS)
    pair_counts = np.bincount(pairs % np.uint32(_PAIRS), minlength=_PAIRS)
    out[_CHARS : _CHARS + _WORDS] = _root(word_counts)
    out[_CHARS + _WORDS : -_SHAPES] = _root(pair_counts)
    by_byte = np.bincount(letters, minlength=256)
    share = lambda table: by_byte[table].sum() / max(1, size)
    distinct = len(np.unique(pairs))
    out[-_SHAPES:] = [
        share(_SYMBOL), share(_CAPITAL), share(_DIGIT), share(_SPACE), by_byte[128:].sum() / max(1, size),
        ((word_counts / max(1, n)) ** 2).sum(), ((pair_counts / max(1, n - 1)) ** 2).sum(),
        1 - distinct / max(1, len(pairs)), min(1.0, size / max(1, n) / 40), min(1.0, np.log1p(n) / 12),
    ]
    return out


def sample(docs: DataFrame, kept: DataFrame, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and values of up to `most` rows of `docs` that `kept` (doc_id, value) names.

    Rows are taken by the hash of doc_id, so the sample depends on the ids alone. One row per doc_id, that
    with the smallest hash of its text, however many rows repeat it.
    """
    names = kept.where("doc_id IS NOT NULL AND value IS NOT NULL").groupBy("doc_id").agg(F.max("value").alias("value"))
    chosen = names.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows; the repeated ones are reduced before vectors are made.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    first = F.struct(F.xxhash64("text").alias("hash"), "text")
    rows = rows.groupBy("doc_id", "value").agg(F.min(first)["text"].alias("text"))

    def batches(stream):
        for batch in small(stream):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            data = [vector(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(data, pa.binary())], ["doc_id", "value", "data"]
            )

    made = rows.select("doc_id", "text", F.col("value").cast("int").alias("value")).select("doc_id", "text", "value")
    found = made.mapInArrow(batches, "doc_id long, value int, data binary").toArrow()
    # In order of the ids (one row each), into one array.
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    values, out = found.column("value").to_numpy()[order].astype(np.int64), np.empty((len(order), SIZE), np.float32)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = 0
    for part in found.column("data").chunks:
        for data in part:
            out[place[at]] = np.frombuffer(data.as_buffer(), np.float32)
            at += 1
    return out, values


class Adam:
    """First-order steps with running moments."""

    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.steps = rate, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def step(self, weights: np.ndarray, slope: np.ndarray) -> None:
        self.steps += 1
        self.mean += 0.1 * (slope - self.mean)
        self.square += 0.001 * (slope * slope - self.square)
        mean = self.mean / (1 - 0.9**self.steps)
        square = self.square / (1 - 0.999**self.steps)
        weights -= self.rate * mean / (np.sqrt(square) + 1e-8)


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scale(x: np.ndarray) -> np.ndarray:
    """Shape features are few and small beside the n-grams; they count five times. In place."""
    x[..., -_SHAPES:] *= 5
    return x


def scaled(x: np.ndarray) -> np.ndarray:
    return scale(x.astype(np.float32, copy=True))
