"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A block is coded by itself: its model starts empty, and a checksum covers its ids. The model mixes
three predictions of the next id, weighted by their hits and misses in the block:

  order 2   the id that last followed the two before it
  order 1   the id that last followed the one before it
  order 0   how often each id comes up where neither of them names it

An id that order 2 or order 1 names is coded by their weights, any other by order 0; the little that
order 0 would add to a named id is given up, which makes every step of the decoder a plain comparison.
A record of each named id is a state that grows with every hit. Weights are kept for every pair of
states, apart where both orders name the same id. The table of a block holds its distinct ids, their
order-0 counts and its weights, compressed; what the higher orders remember is learnt on the way.

A block is cut into lanes of neighbouring ids that share its model. Every lane has its own interval,
which drives a range coder with 48-bit state and 16-bit output words. All lanes of all blocks advance
in lockstep, so one array operation serves the same step of all of them, and an id is learnt once the
step is done. The arithmetic is in doubles, whole numbers below 2^53. Work memory is about 600 kB a
block; callers bound the number of blocks in one call.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 4096
# Blocks in one call.
LOCKSTEP = 64

_MAGIC = b"TPC3"
_HEAD = struct.Struct("<4sIIII")  # magic, ids, crc32 of the ids as little-endian 32-bit, bytes of the table, words
_LANE = 32  # most ids of a lane
_SLOTS = 1 << 11  # of order 2
_STEP = 1267  # from one slot to the next, by the id before
_NONE = -1
_CONTEXTS = 32  # pairs of states, apart or agreed
_COUNTS = 1 << 15  # order-0 counts of longer blocks are scaled down to this sum
_TOTAL_BITS, _SHARE_BITS = 27, 8
_TOTAL, _SHARE = float(1 << _TOTAL_BITS), 1 << (_TOTAL_BITS - _SHARE_BITS)
_WORD, _RENEW, _FULL = float(1 << 16), float(1 << 32), float(1 << 48)
# Words behind the last one of a lane are zeros.
_BEHIND = 2


class _Lanes:
    """The lanes of blocks of `sizes` ids: the longest ones first, and of a block in their order."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.per_block = -(-sizes // _LANE)
        count = np.maximum(self.per_block, 1)
        block = np.repeat(np.arange(len(sizes)), self.per_block)
        within = np.arange(len(block)) - (np.cumsum(self.per_block) - self.per_block)[block]
        even, more = (sizes // count)[block], (sizes % count)[block]
        length = even + (within < more)
        first = (np.cumsum(sizes) - sizes)[block] + within * even + np.minimum(within, more)
        self.order = np.argsort(-length, kind="stable")
        self.back = np.argsort(self.order)
        self.block, self.length, self.first = block[self.order], length[self.order], first[self.order]
        self.steps = int(length.max(initial=0))
        self.going = np.searchsorted(-self.length, -np.arange(self.steps), side="left").tolist()
        # Of every step and lane, whether there is an id, and its place in the joined blocks.
        steps = np.arange(self.steps)[:, None]
        self.on = steps < self.length
        self.place = np.where(self.on, self.first + steps, 0)


class _Followers:
    """What orders 1 and 2 remember: the id that last followed, times 4, plus the state of its record.

    A state is 0 without an id, 1 for a new id, and goes up to 3 with every hit; a miss puts the new id there.
    Ids are places in the joined tables of all blocks, `first` the places of the first ids. Slots of order 2
    depend on differences of places, so other blocks change nothing.
    """

    # The state after an entry that differs from the new id (times 4) by this; a hit differs by its own state.
    _NEXT = np.array([1, 2, 3, 3, 1], np.int32)

    def __init__(self, lanes: _Lanes, first: np.ndarray, ids: int) -> None:
        self.entry = np.full(ids + len(first) * _SLOTS, _NONE << 2, np.int32)
        self.row = ids + lanes.block * _SLOTS
        self.context_row = lanes.block * _CONTEXTS
        # As if the first id of the table stood ahead of every lane.
        self.ahead = first[lanes.block].astype(np.int32)
        self.at = np.empty((2, len(lanes.block)), np.int64)

    def look(self, active: int, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries and named ids of order 1 and order 2, and the context: their states, apart or agreed."""
        at = self.at[:, :active]
        at[0] = last
        slot = before * np.int32(_STEP)
        slot += last
        slot &= np.int32(_SLOTS - 1)
        np.add(slot, self.row[:active], out=at[1])
        entry = self.entry.take(at, mode="clip")
        named, state = entry >> 2, entry & 3
        context = state[1].astype(np.int64)
        context <<= 2
        context += state[0]
        context <<= 1
        context += named[0] == named[1]
        context += self.context_row[:active]
        return entry, named, context

    def learn(self, active: int, entry: np.ndarray, now: np.ndarray) -> None:
        now = now << 2
        new = self._NEXT.take(entry ^ now, mode="clip")
        new += now
        self.entry[self.at[:, :active]] = new


class _Shares:
    """What the weights and order-0 counts of all blocks make of the whole interval.

    A cell is a context times 4 plus what happens there: 0 if order 2 names the id, 1 if only order 1 does, 2 if
    order 0 codes it. Every cell has a start `base` and a `scale`; an id lies at `low` and has `count` times the
    scale. A named id is the one at place 0, which has the whole cell; the ids of the tables follow it.
    """

    def __init__(self, weights: np.ndarray, counts: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> None:
        ahead = np.concatenate([[0], np.cumsum(counts)])
        begin = ahead[first]
        total = ahead[first + kinds] - begin
        self.count = np.concatenate([[1.0], counts])
        self.low = np.concatenate([[0.0], ahead[:-1] - np.repeat(begin, kinds)])
        two, both = weights[:, 0].astype(np.int64) * _SHARE, weights.sum(1, dtype=np.int64) * _SHARE
        scale = ((1 << _TOTAL_BITS) - both) // np.maximum(total, 1)[:, None]
        nothing = np.zeros_like(two)
        self.base = np.stack([nothing, two, both, nothing], 2).ravel().astype(float)
        self.scale = np.maximum(np.stack([two, both - two, scale, nothing], 2), 1).ravel().astype(float)
        # Where the order-0 counts of a cell begin, behind the one of place 0.
        self.begin = np.stack([nothing, nothing, nothing + 1 + begin[:, None], nothing], 2).ravel()


def _weights(cells: np.ndarray, blocks: int) -> np.ndarray:
    """Weights of order 2 and order 1 in every context of every block, of 256 with those of order 0."""
    found = np.bincount(cells, minlength=blocks * _CONTEXTS * 4).reshape(blocks, _CONTEXTS, 4)
    whole = np.maximum(found.sum(2), 1)
    most = (1 << _SHARE_BITS) - 1
    second = np.minimum(np.maximum(found[..., 0] * most // whole, found[..., 0] > 0), most - 1)
    first = np.minimum(np.maximum(found[..., 1] * most // whole, found[..., 1] > 0), most - second)
    return np.stack([second, first], 1).astype(np.uint8)


def _bytes_of(values: np.ndarray) -> list[np.ndarray]:
    """The low and the high bytes of numbers below 65536."""
    return [(values & 255).astype(np.uint8), (values >> 8).astype(np.uint8)]


def _table_of(data: bytes, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, counts, weights and words of each lane, from weights, words, steps between the ids, and counts less one."""
    try:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
    except zlib.error as error:
        raise ValueError("table of a block differs") from error
    ids = (len(raw) - 2 * _CONTEXTS - 2 * lanes) // 4
    if ids < (lanes > 0) or len(raw) != 2 * _CONTEXTS + 2 * lanes + 4 * ids:
        raise ValueError("table of a block does not fit it")
    weights, raw = raw[: 2 * _CONTEXTS].reshape(2, _CONTEXTS), raw[2 * _CONTEXTS :].astype(np.int64)
    wide = lambda at, n: raw[at : at + n] + (raw[at + n : at + 2 * n] << 8)
    words, steps, counts = wide(0, lanes), wide(2 * lanes, ids), wide(2 * (lanes + ids), ids)
    return np.cumsum(steps), counts + 1, weights, words


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One self-contained payload per block of ids below 65536."""
    m = len(blocks)
    sizes = np.array([len(b) for b in blocks], np.int64)
    joined = np.concatenate([np.empty(0, np.int64), *blocks]).astype(np.int64)
    if joined.max(initial=0) >= 65536 or joined.min(initial=0) < 0:
        raise ValueError("ids must be below 65536")
    # The distinct ids of all blocks in one list, and of every id its place there.
    keys = joined + np.repeat(np.arange(m) << 16, sizes)
    seen = np.zeros((m << 13, 8), bool)
    seen.reshape(-1)[keys] = True
    some = np.flatnonzero(seen.view(np.uint64))
    at, bit = np.nonzero(seen[some])
    distinct = (some[at] << 3) + bit
    place = np.empty(m << 16, np.int32)
    place[distinct] = np.arange(len(distinct))
    kinds = np.bincount(distinct >> 16, minlength=m)
    first = np.cumsum(kinds) - kinds

    lanes = _Lanes(sizes)
    width = len(lanes.block)
    ids = place.take(keys, mode="clip").take(lanes.place, mode="clip") if width else np.empty((0, 0), np.int32)
    followers = _Followers(lanes, first, len(distinct))
    cells, places = np.zeros(ids.shape, np.int64), np.zeros(ids.shape, np.int64)
    last = before = followers.ahead
    for step, act in enumerate(lanes.going):
        now = ids[step, :act]
        entry, named, cell = followers.look(act, last[:act], before[:act])
        miss = (named != now).view(np.uint8)
        plain = miss[0] & miss[1]
        cell <<= 2
        cell += miss[1]
        cell += plain
        cells[step, :act] = cell
        np.multiply(now + np.int32(1), plain, out=places[step, :act])
        followers.learn(act, entry, now)
        last, before = now, last
    weights = _weights(cells[lanes.on], m)
    found = np.bincount(places.ravel(), minlength=len(distinct) + 1)[1:]
    whole = np.bincount(distinct >> 16, weights=found, minlength=m).astype(np.int64)[distinct >> 16]
    counts = np.where(whole > _COUNTS, 1 + found * (_COUNTS - 1) // np.maximum(whole, 1), found)
    shares = _Shares(weights, counts, first, kinds)

    # Lanes have written about as many words each, so a row of words is what one step touches. `low` stays below
    # 2^49: what a word holds above 16 bits is carried to the word before at the end.
    words = np.zeros((2 * lanes.steps + 2, width), np.int32)
    used = np.zeros(width, np.int64)
    low, size = np.zeros(width), np.full(width, _FULL)
    for step, act in enumerate(lanes.going):
        cell, at = cells[step, :act], places[step, :act]
        scale = shares.scale.take(cell, mode="clip")
        start = shares.low.take(at, mode="clip")
        start *= scale
        start += shares.base.take(cell, mode="clip")
        unit = np.floor(size[:act] * (1 / _TOTAL))
        start *= unit
        low[:act] += start
        unit *= scale
        np.multiply(unit, shares.count.take(at, mode="clip"), out=size[:act])
        short = np.flatnonzero(size[:act] < _RENEW)
        while len(short):
            out = low.take(short)
            word = np.floor(out * (1 / _RENEW))
            words[used.take(short), short] = word
            used[short] += 1
            low[short] = (out - word * _RENEW) * _WORD
            wider = size.take(short) * _WORD
            size[short] = wider
            short = short[wider < _RENEW]
    # One more word names a place in the interval: zeros follow it.
    if width:
        words[used, np.arange(width)] = np.ceil(low * (1 / _RENEW))
    used += 1
    for at in range(int(used.max(initial=1)) - 1, 0, -1):
        words[at - 1] += words[at] >> 16
    used = used[lanes.back]
    rows = words[: int(used.max(initial=0))].T[lanes.back]
    rows = rows[np.arange(rows.shape[1]) < used[:, None]].astype("<u2")
    names = distinct & 65535
    steps = np.diff(names, prepend=0)
    steps[first[kinds > 0]] = names[first[kinds > 0]]
    by_lane, by_id = _bytes_of(used), _bytes_of(steps) + _bytes_of(counts - 1)
    lane, word, out = 0, 0, []
    for block, ids_of in enumerate(blocks):
        own = slice(lane, lane + int(lanes.per_block[block]))
        table = slice(first[block], first[block] + kinds[block])
        parts = [weights[block], *(column[own] for column in by_lane), *(column[table] for column in by_id)]
        # Bytes of such tables hardly repeat but in runs of zeros.
        pack = zlib.compressobj(strategy=zlib.Z_RLE)
        packed = pack.compress(b"".join(part.tobytes() for part in parts)) + pack.flush()
        total, crc = int(used[own].sum()), zlib.crc32(np.asarray(ids_of).astype("<u4").tobytes())
        head = _HEAD.pack(_MAGIC, int(sizes[block]), crc, len(packed), total)
        out.append(head + packed + rows[word : word + total].tobytes())
        lane, word = own.stop, word + total
    return out


# Damaged words may lead to any number; the checksum tells.
@np.errstate(invalid="ignore", over="ignore")
def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of every payload; ValueError if one is damaged."""
    crcs, sizes, tables, words = [], [], [], []
    for payload in payloads:
        if len(payload) < _HEAD.size:
            raise ValueError("block too short")
        magic, size, crc, packed, count = _HEAD.unpack_from(payload)
        if magic != _MAGIC or len(payload) != _HEAD.size + packed + 2 * count:
            raise ValueError("not a block, or cut off")
        table = _table_of(payload[_HEAD.size : _HEAD.size + packed], -(-size // _LANE))
        if table[0].max(initial=0) >= 65536 or table[3].sum() != count:
            raise ValueError("table of a block does not fit it")
        crcs.append(crc)
        sizes.append(size)
        tables.append(table)
        words.append(np.frombuffer(payload, "<u2", offset=_HEAD.size + packed))
    if not payloads:
        return []
    sizes = np.array(sizes, np.int64)
    names, counts, weights, used = (list(column) for column in zip(*tables))
    kinds = np.array([len(n) for n in names], np.int64)
    first = np.cumsum(kinds) - kinds
    names, counts, used = np.concatenate(names), np.concatenate(counts), np.concatenate(used)
    shares = _Shares(np.stack(weights), counts, first, kinds)
    # The place of the id that holds each order-0 count, behind the one of place 0.
    holder = np.repeat(np.arange(len(names) + 1, dtype=np.int32), np.concatenate([[1], counts]))
    lanes = _Lanes(sizes)
    width = len(lanes.block)
    ends = np.cumsum(used)
    spread = np.zeros(int(used.sum()) + _BEHIND * width + 1)
    spread[np.arange(int(used.sum())) + _BEHIND * np.repeat(np.arange(width), used)] = np.concatenate(words)
    next_word = (ends - used + _BEHIND * np.arange(width))[lanes.order]
    # `value` is what the code holds above the low end of the range.
    value = np.zeros(width)
    for _ in range(3):
        value = value * _WORD + spread.take(next_word, mode="clip")
        next_word += 1
    size = np.full(width, _FULL)
    followers = _Followers(lanes, first, len(names))
    ids = np.zeros(lanes.on.shape, np.int32)
    # The ids that order 2, order 1 and order 0 give every lane.
    given, lane = np.empty((3, width), np.int32), np.arange(width)
    last = before = followers.ahead
    for step, act in enumerate(lanes.going):
        entry, named, cell = followers.look(act, last[:act], before[:act])
        cell <<= 2
        unit = np.floor(size[:act] * (1 / _TOTAL))
        # A quotient of whole numbers this small is never rounded up to the next whole number.
        place = value[:act] / unit
        miss = (place >= shares.base.take(cell + 1, mode="clip")).view(np.uint8)
        miss += place >= shares.base.take(cell + 2, mode="clip")
        cell += miss
        base, scale = shares.base.take(cell, mode="clip"), shares.scale.take(cell, mode="clip")
        place -= base
        place /= scale
        count = place.astype(np.int64)
        count += shares.begin.take(cell, mode="clip")
        at = holder.take(count, mode="clip")
        given[:2, :act] = named[::-1]
        np.subtract(at, 1, out=given[2, :act])
        choice = miss.astype(np.int64)
        choice *= width
        choice += lane[:act]
        now = given.take(choice, mode="clip")
        start = shares.low.take(at, mode="clip")
        start *= scale
        start += base
        start *= unit
        unit *= scale
        unit *= shares.count.take(at, mode="clip")
        rest = value[:act] - start
        short = unit < _RENEW
        more = short.astype(float)
        following = spread.take(next_word[:act], mode="clip")
        following *= more
        more *= _WORD - 1
        more += 1
        rest *= more
        np.add(rest, following, out=value[:act])
        np.multiply(unit, more, out=size[:act])
        next_word[:act] += short
        short = np.flatnonzero(size[:act] < _RENEW)
        while len(short):
            value[short] = value.take(short) * _WORD + spread.take(next_word.take(short), mode="clip")
            next_word[short] += 1
            wider = size.take(short) * _WORD
            size[short] = wider
            short = short[wider < _RENEW]
        ids[step, :act] = now
        followers.learn(act, entry, now)
        last, before = now, last
    joined = names.take(ids.T[lanes.back][lanes.on.T[lanes.back]], mode="clip")
    out = np.split(joined, np.cumsum(sizes)[:-1])
    for block, crc in zip(out, crcs):
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block differs")
    return out
