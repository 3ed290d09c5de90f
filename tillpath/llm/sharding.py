"""Sharding by jump consistent hashing.

A document's shard depends on its doc_id and the number of shards alone. The key starts a linear
congruential sequence; each draw jumps from the last shard that the key would have had to the next
one, until the jump passes the last shard. When a shard is appended, exactly the keys whose next
jump lands on it move. No table of a ring is kept and no row of another document is looked at.

Edge cases: a NULL text counts as empty (size 8, crc 0); a NULL doc_id hashes like 0; rows that
repeat a doc_id go to the same shard, each with a slot of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.operators.ranking import group_key
from tillpath.session import stage

SHARDS = 24
ROW_BYTES = 8

# Fixed value: the multiplier of the 64-bit linear congruential generator of the published
# algorithm, 2862933555777941757, in two halves of 32 bits so that decimals hold every product.
_HIGH, _LOW = divmod(2862933555777941757, 1 << 32)


def _next_key(key: str) -> str:
    """SQL: key * multiplier + 1 modulo 2^64, on decimal(20,0)."""
    return (
        f"CAST(({key} * {_LOW}BD + (({key} * {_HIGH}BD) % 4294967296BD) * 4294967296BD + 1BD)"
        " % 18446744073709551616BD AS DECIMAL(20,0))"
    )


def jump(key: str, shards: int) -> Column:
    """struct(b, j): the shard of the bigint expression `key` among `shards`, and the next jump.

    With one more shard the key stays at `b` unless `j = shards`.
    """
    unsigned = (
        f"CAST(IF({key} < 0, CAST({key} AS DECIMAL(20,0)) + 18446744073709551616BD,"
        f" CAST({key} AS DECIMAL(20,0))) AS DECIMAL(20,0))"
    )
    draw = "CAST(FLOOR((s.j + 1) * (2147483648D / ((s.k DIV 8589934592BD) + 1))) AS BIGINT)"
    state = F.expr(
        f"aggregate(sequence(1, {int(shards)}),"
        f" named_struct('k', {_next_key(unsigned)}, 'b', -1L, 'j', 0L),"
        f" (s, i) -> IF(s.j < {int(shards)},"
        f" named_struct('k', {_next_key('s.k')}, 'b', s.j, 'j', {draw}), s))"
    )
    return F.struct(state["b"].alias("b"), state["j"].alias("j"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs`.

    `slot` numbers the rows of a shard from 0 by doc_id; `grown_shard` is the shard among
    `shards + 1`.
    """
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        jump("coalesce(doc_id, 0L)", shards).alias("_at"),
    ).select(
        "doc_id", "size", "text_crc32",
        F.lit("key").alias("law"),
        F.col("_at.b").cast("int").alias("shard"),
        F.when(F.col("_at.j") == shards, F.lit(shards)).otherwise(F.col("_at.b")).cast("int").alias("grown_shard"),
    )
    numbered = group_key(stage(placed, "shards"), ["shard"], ["doc_id"], "slot")
    return numbered.withColumn("slot", F.col("slot") - 1)
