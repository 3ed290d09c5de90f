"""Best-fit packing by length patterns and non-negative least squares.

Documents are cut into pieces of at most `capacity` tokens; what is left to decide depends on the
lengths alone, so the plan is made from the histogram of lengths, which has at most `capacity`
rows however large the corpus is.

1. Full pieces are sequences of their own. Other lengths fall into bins of `step` tokens, rounded
   up. All patterns of one to three bins that fill a sequence exactly are enumerated.
2. Repeat counts of the patterns are fitted to the bin counts by non-negative least squares (active
   sets on the normal equations), the shortest bins weighing least, and rounded down.
3. Patterns take real lengths: the longest of its largest bin with the shortest of the others.
4. The residual goes by falling length into the fullest sequence that still has room - of the
   patterns or of its own - and opens new ones where there is none.

All steps work on runs of equal sequences, never on single ones. Pieces of one length are numbered
over the cluster (range partitions, no single task), and the number decides the sequence: the plan
is a table of (length, numbers from, to, first sequence, offset) with a few rows per pattern.

Edge cases: a NULL or empty text is the end token alone. Rows that repeat a doc_id are packed as
rows. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import small, text_of
from tillpath.llm.tokens import byte_level_encoder
from tillpath.operators.ranking import group_key
from tillpath.session import stage

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
CAPACITY, STEP = 2048, 8
# A length of half the capacity weighs this, one near nothing weighs a tenth of it.
_WEIGHT = 1.0


def pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with `ids` (array<int>) if wanted.

    A document longer than `capacity` gives full pieces behind a first one that may be shorter.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def batches(stream):
        encoder = byte_level_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in small(stream):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encoder(text) + end
                size = len(data) // 4
                start, number = 0, 0
                while start < size:
                    length = (size - 1) % capacity + 1 if start == 0 else capacity
                    part = data[4 * start : 4 * (start + length)]
                    row = (doc, number, start, length, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                    start, number = start + length, number + 1
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return plain.mapInArrow(
        batches,
        "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids,
    )


def non_negative_fit(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|, by active sets."""
    gram_target = matrix.T @ target
    x = np.zeros(matrix.shape[1])
    used: list[int] = []
    slope = gram_target.copy()
    limit = 1e-9 * max(1.0, np.abs(gram_target).max(initial=0.0))
    for _ in range(4 * matrix.shape[0]):
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if not slope[best] > limit:
            break
        used.append(best)
        while True:
            part = matrix[:, used]
            solved = np.linalg.lstsq(part.T @ part, gram_target[used], rcond=None)[0]
            if (solved > 0).all():
                break
            # Walk towards the solution until the first repeat count is zero, and let that one go.
            old = x[used]
            falling = solved <= 0
            share = np.min(old[falling] / np.maximum(old[falling] - solved[falling], 1e-300))
            moved = old + share * (solved - old)
            keep = moved > 1e-12 * max(1.0, moved.max())
            x[:] = 0
            used = [u for u, k in zip(used, keep) if k]
            x[used] = moved[keep]
            if not used:
                solved = np.zeros(0)
                break
        x[:] = 0
        x[used] = solved
        slope = gram_target - matrix.T @ (matrix[:, used] @ solved)
    return x


def patterns(units: int) -> list[tuple[int, ...]]:
    """All descending tuples of one to three positive numbers that add up to `units`."""
    out: list[tuple[int, ...]] = [(units,)]
    for a in range(units - 1, 0, -1):
        if a >= units - a > 0:
            out.append((a, units - a))
        out += [(a, b, units - a - b) for b in range(min(a, units - a - 1), 0, -1) if b >= units - a - b > 0]
    return out


@dataclass
class _Run:
    """`count` equal sequences; slots are (length, number of the first piece)."""

    count: int
    slots: list[tuple[int, int]]

    def split(self, count: int) -> tuple[_Run, _Run]:
        return _Run(count, self.slots), _Run(self.count - count, [(n, f + count) for n, f in self.slots])


def plan(histogram: dict[int, int], capacity: int = CAPACITY, step: int = STEP) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, count, first sequence, offset) rows that place every piece once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    taken = dict.fromkeys(left, 0)

    def take(length: int, count: int) -> int:
        first = taken[length]
        taken[length] += count
        left[length] -= count
        return first

    units = -(-capacity // step)
    bins: dict[int, list[int]] = {}
    for length in sorted(left):
        bins.setdefault(units if length == capacity else -(-length // step), []).append(length)
    runs: list[_Run] = []
    if capacity in left:
        count = left[capacity]
        runs.append(_Run(count, [(capacity, take(capacity, count))]))
    known = [p for p in patterns(units) if all(b in bins for b in p)]
    if known:
        rows = {b: i for i, b in enumerate(sorted(bins))}
        matrix = np.zeros((len(rows), len(known)))
        for j, pattern in enumerate(known):
            for b in pattern:
                matrix[rows[b], j] += 1
        target = np.array([sum(left[n] for n in bins[b]) for b in sorted(bins)], float)
        weight = np.array([_WEIGHT * (0.1 + min(1.0, 2 * b / units)) for b in sorted(bins)])
        repeats = np.floor(non_negative_fit(matrix * weight[:, None], target * weight) + 1e-6).astype(int)
        for j in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[j])
            while todo > 0:
                lengths = []
                for place, b in enumerate(known[j]):
                    # A length that this pattern holds already must have another piece left.
                    free = [n for n in bins[b] if left[n] > lengths.count(n)]
                    if not free:
                        break
                    lengths.append(free[-1] if place == 0 else free[0])
                if len(lengths) < len(known[j]):
                    break
                count = min([todo, *[left[n] // lengths.count(n) for n in lengths]])
                runs.append(_Run(count, [(n, take(n, count)) for n in lengths]))
                todo -= count
    open_runs: list[list[_Run]] = [[] for _ in range(capacity + 1)]
    room = np.zeros(capacity + 1, bool)

    def put(run: _Run) -> None:
        free = capacity - sum(n for n, _ in run.slots)
        open_runs[free].append(run)
        room[free] = True

    for run in runs:
        put(run)
    for length in sorted(left, reverse=True):
        while left[length] > 0:
            fits = np.flatnonzero(room[length:])
            if len(fits) == 0:
                many = capacity // length
                count, rest = divmod(left[length], many)
                if count:
                    put(_Run(count, [(length, take(length, count)) for _ in range(many)]))
                if rest:
                    put(_Run(1, [(length, take(length, 1)) for _ in range(rest)]))
                continue
            free = length + int(fits[0])
            run = open_runs[free].pop()
            room[free] = bool(open_runs[free])
            count = min(run.count, left[length])
            used, spare = run.split(count)
            used.slots = [*used.slots, (length, take(length, count))]
            put(used)
            if spare.count:
                put(spare)
    placed, sequence = [], 0
    for group in open_runs:
        for run in group:
            offset = 0
            for length, first in run.slots:
                placed.append((length, first, run.count, sequence, offset))
                offset += length
            sequence += run.count
    return placed


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, step: int = STEP, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    cut_up = stage(pieces(docs, path, capacity, end_id), "pieces")
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(
        plan(histogram, capacity, step), "length long, first long, count long, sequence long, offset long"
    )
    numbered = group_key(cut_up, ["length"], ["doc_id", "piece"], "number").withColumn("number", F.col("number") - 1)
    # The plan's size is bounded by the number of lengths, not by the corpus.
    slots = F.broadcast(table.withColumnRenamed("length", "_length"))
    inside = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("count"))
    return numbered.join(slots, (F.col("length") == F.col("_length")) & inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset",
    )
