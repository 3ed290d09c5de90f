"""Periodic runs of words by Baier grouping.

A run is a stretch of words that repeats with a smallest period and cannot be extended on either
side. Every run of two periods or more holds a Lyndon root: a word sequence smaller than all its
rotations under one of two opposite orders of the words, which is the longest Lyndon prefix of
the suffix it starts. So

1. the first phase of Baier's suffix sorter groups the suffixes by exactly that prefix. It goes through
   the groups from the greatest down; the nearest smaller suffix to the left of each member, and how
   often a member points to it, tells which suffixes grow by the group's prefix and form a new group.
   The lengths it ends with are the Lyndon array. It runs twice, under both orders; no suffix is
   sorted any further;
2. a root that is followed by its own first word is extended to both sides as far as words one period apart
   agree (longest common extensions, by comparing doubling and then halving blocks of ids);
3. an extension of the needed length is a run; roots that lie in a run already found are passed over.

A word of a run of k periods occurs k times in it, so a text is first cut at its rarer words; runs
cannot reach over them. What is left, stretch by stretch, is what the steps above work on.

All of this happens inside one text, in the task that reads it, over 32-bit word ids: no shuffle, and
no group that could be hot. Memory grows with the longest text (about 200 bytes a word).

Edge cases: NULL and empty texts have no words, no runs and the digests of the empty string. A NULL
doc_id gives a row; `planted` leaves its text as it is. Repeated rows each give a row. An empty table
gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import small, text_of

MIN_WORDS, MIN_PERIODS = 24, 3

Run = tuple[int, int, int]  # start, length, period


def lyndon_array(ranks: list[int], letters: int) -> list[int]:
    """Length of the longest Lyndon prefix of every suffix; `ranks` are below `letters`."""
    n = len(ranks)
    group_of = list(ranks)
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    prefix = [1] * letters
    below, above = list(range(-1, letters - 1)), list(range(1, letters + 1))
    above[-1:] = [-1]
    # Place i + 1 leads to the nearest place to the left whose suffix is still in a lower group; 0 is none.
    left = list(range(n + 1))
    group = letters - 1
    while group >= 0:
        own = [i for i in members[group] if group_of[i] == group]
        members[group] = []
        for i in own:
            left[i + 1] = i
        times: dict[int, int] = {}
        for i in own:
            at = i
            while (up := left[at]) != at:
                left[at] = up = left[up]
                at = up
            if at:
                left[i + 1] = at
                times[at] = times.get(at, 0) + 1
            else:
                left[i + 1] = 0
        if times:
            gained = prefix[group]
            # Those that more members point to go first and so end above the others of their group.
            by_times: dict[int, list[int]] = {}
            for at, k in times.items():
                by_times.setdefault(k, []).append(at - 1)
            for k in sorted(by_times, reverse=True):
                fresh: dict[int, int] = {}
                for j in by_times[k]:
                    old = group_of[j]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(prefix)
                        prefix.append(prefix[old] + k * gained)
                        members.append([])
                        over = above[old]
                        below.append(old)
                        above.append(over)
                        above[old] = new
                        if over >= 0:
                            below[over] = new
                    group_of[j] = new
                    members[new].append(j)
        group = below[group]
    return [prefix[g] for g in group_of]


def _ahead(ids: bytes, a: int, b: int, size: int) -> int:
    """How many of the 4-byte ids from byte a and from byte b (> a) on agree, in bytes."""
    done, step = 0, 4
    while b + done + step <= size and ids[a + done : a + done + step] == ids[b + done : b + done + step]:
        done += step
        step *= 2
    while step > 4:
        step //= 2
        if b + done + step <= size and ids[a + done : a + done + step] == ids[b + done : b + done + step]:
            done += step
    return done


def _behind(ids: bytes, a: int, b: int) -> int:
    """How many of the 4-byte ids before byte a and before byte b (> a) agree, in bytes."""
    done, step = 0, 4
    while a - done - step >= 0 and ids[a - done - step : a - done] == ids[b - done - step : b - done]:
        done += step
        step *= 2
    while step > 4:
        step //= 2
        if a - done - step >= 0 and ids[a - done - step : a - done] == ids[b - done - step : b - done]:
            done += step
    return done


def _runs_in(ids: np.ndarray, min_words: int, min_periods: int) -> set[Run]:
    """Runs of one stretch of word ids."""
    n = len(ids)
    values, ranks = np.unique(ids, return_inverse=True)
    data, size = ids.astype("<u4").tobytes(), 4 * n
    found: set[Run] = set()
    for ordered in (ranks, len(values) - 1 - ranks):
        roots = np.array(lyndon_array(ordered.tolist(), len(values)), np.int64)
        starts = np.flatnonzero(np.arange(n) + roots < n)
        starts = starts[(ids[starts] == ids[starts + roots[starts]]) & (roots[starts] * min_periods <= n)]
        ends: dict[int, int] = {}
        for at, period in zip(starts.tolist(), roots[starts].tolist()):
            # Two runs of one period share fewer words than a period has.
            if at + period <= ends.get(period, 0):
                continue
            a, b = 4 * at, 4 * (at + period)
            before, after = _behind(data, a, b) // 4, _ahead(data, a, b, size) // 4
            length = before + period + after
            ends[period] = at - before + length
            if length >= max(min_words, min_periods * period):
                found.add((at - before, length, period))
    return found


def runs(words: list[bytes], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[Run]:
    """The runs of `words` with at least `min_words` words and `min_periods` (two or more) periods, by start, then period."""
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    if len(words) < min_words:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    often = np.bincount(ids)[ids] >= min_periods
    edges = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).astype(np.int8)))
    found = []
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if stop - start >= min_words:
            inside = _runs_in(ids[start:stop], min_words, min_periods)
            found += [(start + at, length, period) for at, length, period in inside]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length by period, exactly; of equals the first, then the shortest period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words left when of every run only its first period stays, with single spaces."""
    if not found:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    inside = np.cumsum(edges[:-1])
    return b" ".join([words[i] for i in np.flatnonzero(inside == 0).tolist()])


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The stated revision of a text: in one document of ten a stretch repeats up to the end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    mixed = zlib.crc32(b"%d" % doc_id)
    if mixed % 10:
        return words
    g = mixed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_COLUMNS = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_kept_words long, runs array<struct<start:long,length:long,period:long>>, "
    "collapsed string"
)


def periodic_runs(
    docs: DataFrame, revise=None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, texts: bool = True
) -> DataFrame:
    """The runs of every row's text, and the text with each of them collapsed.

    `start`, `length`, `period` and `exponent_milli` are those of the run with the most periods. `runs` lists
    all of them, `collapsed` is the text that is left (NULL unless `texts`). `revise(words, doc_id)` may change the words first.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()),
        ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
        ("collapsed_sha256", pa.string()), ("n_kept_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ])

    def row(doc_id: int | None, text: bytes) -> dict:
        words = text.split()
        if revise is not None:
            words = revise(words, doc_id)
        found = runs(words, min_words, min_periods)
        best = strongest(found) or (None, None, None)
        left = collapsed(words, found)
        listed = b"".join(b"%d,%d,%d\n" % r for r in found)
        return {
            "doc_id": doc_id, "n_words": len(words), "n_runs": len(found),
            "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if found else None,
            "runs_sha256": hashlib.sha256(listed).hexdigest(), "collapsed_sha256": hashlib.sha256(left).hexdigest(),
            "n_kept_words": left.count(b" ") + 1 if left else 0,
            "runs": [dict(zip(("start", "length", "period"), r)) for r in found],
            "collapsed": left.decode() if texts else None,
        }

    def batches(stream):
        for batch in small(stream):
            ids, data = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pylist([row(i, t) for i, t in zip(ids, data)], schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return plain.mapInArrow(batches, _COLUMNS)
