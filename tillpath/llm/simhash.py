"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprint. Words of the text (A-Z lower-cased) form shingles; each is hashed with XXH64, and a
bit of the 64-bit fingerprint is 1 if it is set in over half of the hashes.

Keys. A fingerprint is read as three segments of 22, 21 and 21 bits, each padded to a word of the
binary Golay code (23,12). The code is perfect: every word lies within three bits of exactly one
codeword, its near one; words three bits away from it lie four bits away from five more. If two
words differ in one bit, the near codeword of one is within four bits of the other. So

    one side of a join brings the near codeword's index   (one key)
    the other side the indices of all codewords within 4  (one or six keys)

and words at most one bit apart meet. Three errors over three segments leave either a segment
without error and another with at most one - six ordered choices, key: the exact segment and the
other's index - or exactly one error in each - key: the three indices, where the wide side is split
between both roles. About 70 rows per distinct fingerprint, with keys of 33 to 36 bits.

Join. Only distinct fingerprints are keyed, so exact copies cost nothing. Keys held by a single
fingerprint go first. Keys with up to `bucket` rows compare their two sides as arrays, and only
verified pairs leave the expression. The fingerprints of fuller keys are compared by another
exact way, without pairs inside the key: two fingerprints at most three bits apart share a word
that is at most one bit from the first and two bits from the second, so hanging the members of such
a word on its smallest first-kind member links them all; that is a fixed number of rows for each
fingerprint, however many share a key.

Components of the links are found by contraction (`common.components`).

Edge cases: NULL and empty texts have no words and the fingerprint zero; fewer words than a shingle
takes give one shingle of all of them. Rows that repeat a doc_id each give a row. NULL doc_ids take
part; a component of NULL ids only has a NULL id. Other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath.llm.common import components, numbered_rows, only, small, text_of
from tillpath.session import stage

SHINGLE_WORDS, MAX_BITS, HASH_SEED = 3, 3, 42
# Rows of one key that are compared directly.
BUCKET = 1024

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_PAIRS = tuple((i, j) for i in range(3) for j in range(3) if i != j)
_GENERATOR = 0b110001110101  # of the cyclic Golay code, degree 11
_SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    count = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _SLICE):
        stop = min(count, at + _SLICE)
        spans = zip(starts[at:stop], ends[at + shingle - 1 : stop + shingle - 1])
        hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in spans), "<u8", stop - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` (longs) and `fp` (the fingerprint as a signed long) of every row."""

    def batches(stream):
        for batch in small(stream):
            texts = batch.column(len(keep)).cast(pa.binary()).to_pylist()
            values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values.view(np.int64))], [*keep, "fp"]
            )

    plain = docs.select(*[F.col(k).cast("long").alias(k) for k in keep], text_of().alias("text"))
    return plain.mapInArrow(batches, ", ".join(f"{k} long" for k in [*keep, "fp"]))


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word; per syndrome the error patterns that lead
    to the codewords within four bits (the near one first) and how many there are."""
    remainder = np.zeros(23, np.int64)
    value = 1
    for bit in range(23):
        remainder[bit] = value
        value <<= 1
        if value >> 11:
            value ^= _GENERATOR

    def table(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for bit in range(bits):
            half = 1 << bit
            out[half : 2 * half] = out[:half] ^ remainder[first + bit]
        return out

    low, high = table(0, 12), table(12, 11)
    patterns = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            syndrome = low[error & 4095] ^ high[error >> 12]
            patterns[syndrome, count[syndrome]] = error
            count[syndrome] += 1
    return low, high, patterns, count


def golay_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row of `values`, wide side?) for unsigned 64-bit `values`."""
    low, high, patterns, count = _code()
    exact, near, wide, held = [], [], [], []
    for shift, bits in _SEGMENTS:
        word = ((values >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = low[word & 4095] ^ high[word >> 12]
        exact.append(word)
        codewords = (word[:, None] ^ patterns[syndrome]) >> 11
        near.append(codewords[:, 0])
        wide.append(codewords)
        held.append(np.arange(6)[None, :] < count[syndrome][:, None])
    rows = np.arange(len(values))
    keys, owners, sides = [], [], []

    def add(key: np.ndarray, mask: np.ndarray | None, is_wide: bool) -> None:
        flat = key.reshape(len(values), -1)
        owner = np.broadcast_to(rows[:, None], flat.shape)
        if mask is not None:
            flat, owner = flat[mask.reshape(flat.shape)], owner[mask.reshape(owner.shape)]
        keys.append(flat.ravel())
        owners.append(owner.ravel())
        sides.append(np.full(flat.size, is_wide))

    for kind, (i, j) in enumerate(_PAIRS):
        tag = (kind << 58) | (exact[i] << 12)
        add(tag | near[j], None, False)
        add(tag[:, None] | wide[j], held[j], True)
    tag = len(_PAIRS) << 58
    add(tag | (wide[0] << 24) | (near[1] << 12)[:, None] | near[2][:, None], held[0], False)
    both = (wide[1] << 12)[:, :, None] | wide[2][:, None, :]
    add(tag | (near[0] << 24)[:, None, None] | both, held[1][:, :, None] & held[2][:, None, :], True)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(sides)


def _keyed(distinct: DataFrame) -> DataFrame:
    def batches(stream):
        for batch in stream:
            signed = batch.column(0).to_numpy()
            for at in range(0, len(signed), 4096):
                part = signed[at : at + 4096]
                keys, owners, sides = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(part[owners]), pa.array(sides)], ["key", "fp", "wide"]
                )

    return distinct.select("fp").mapInArrow(batches, "key long, fp long, wide boolean")


def _far_apart_words(hot: DataFrame) -> DataFrame:
    """For every fingerprint the words within one bit (`close`) and within two bits of it."""
    masks = [sum(1 << p for p in places) for k in range(3) for places in combinations(range(64), k)]
    masks = np.array(masks, np.uint64).view(np.int64)
    close = np.arange(len(masks)) <= 64

    def batches(stream):
        for batch in stream:
            for value in batch.column(0).to_numpy():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(masks ^ value), pa.array(np.full(len(masks), value)), pa.array(close)],
                    ["word", "fp", "close"],
                )

    return hot.select("fp").mapInArrow(batches, "word long, fp long, close boolean")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all those at most three bits apart.

    `distinct` has one row per fingerprint in `fp`.
    """
    key = Window.partitionBy("key")
    held = _keyed(distinct).select(
        "key", "fp", "wide",
        F.min("fp").over(key).alias("_least"),
        F.max("fp").over(key).alias("_most"),
        F.count(F.lit(1)).over(key).alias("_rows"),
    )
    shared = stage(held.where("_least != _most").drop("_least", "_most"), "simhash-keys")
    sides = shared.where(F.col("_rows") <= bucket).groupBy("key").agg(
        F.collect_list(F.when(~F.col("wide"), F.col("fp"))).alias("near"),
        F.collect_list(F.when(F.col("wide"), F.col("fp"))).alias("far"),
    )
    found = F.flatten(
        F.transform(
            "near",
            lambda a: F.transform(
                F.filter("far", lambda b: (a != b) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    direct = sides.select(F.explode(found).alias("p")).select("p.a", "p.b")
    words = _far_apart_words(shared.where(F.col("_rows") > bucket).select("fp").distinct())
    centre = words.groupBy("word").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"))
    hung = words.join(centre, "word").where("a IS NOT NULL AND a != fp").select("a", F.col("fp").alias("b"))
    return direct.unionByName(hung).distinct()


def _grouped(printed: DataFrame, bucket: int) -> DataFrame:
    """Per fingerprint of `printed` (doc_id, fp) its component_id and, as that may be NULL, the component itself."""
    classes = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("_first")), "fingerprint-classes")
    grouped = components(links(classes, bucket))
    # Names of components: the smallest document over the fingerprints of a component.
    linked = classes.join(grouped.withColumnRenamed("node", "fp"), "fp")
    named = linked.groupBy("component").agg(F.min("_first").alias("_smallest"))
    renamed = stage(
        linked.join(named, "component").select("fp", "component", "_smallest"), "simhash-components"
    )
    # One row per fingerprint first, then to the documents.
    return classes.join(renamed, "fp", "left").select(
        "fp", F.coalesce("_smallest", "_first").alias("component_id"), F.coalesce("component", "fp").alias("component")
    )


def near_dedup(docs: DataFrame, shingle: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of `docs`."""
    printed = stage(fingerprints(docs, shingle), "fingerprints")
    return printed.join(_grouped(printed, bucket), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """One row of every component, of those with its smallest doc_id any one.

    Rows are told apart by a key of their own: doc_ids may be NULL or repeated, and any column may be there.
    """
    rows = numbered_rows(docs, "near-rows")
    printed = stage(fingerprints(rows.select("key", "doc.doc_id", "doc.text"), shingle, ("doc_id", "key")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"))
    # One row per fingerprint first, as in the classes.
    least = printed.groupBy("fp").agg(F.min(order).alias("_least"))
    best = least.join(_grouped(printed, bucket), "fp").groupBy("component").agg(F.min("_least")["c"].alias("key"))
    return only(rows, stage(best.select("key"), "near-kept"))
