"""Exact dedup by deterministic block naming.

The text without white space is cut into blocks of a fixed size. Blocks are sorted inside hash
buckets and numbered by rank, which gives equal blocks one integer name and different blocks
different ones, whatever their hashes do. Adjacent names are paired and the pairs named the same
way, level by level, until a document has one name. Two texts are equal exactly if they end at the
same level with the same name; no digest decides.

Block contents are shuffled once, at the first level. Contents that very many rows share are found
by counting hashes before the shuffle (at most 1000 of them, see `hot_keys`), named apart and
attached by a broadcast join, so their rows move without content and spread evenly.

Edge cases: NULL and empty texts and texts of white space only are one group (they normalise to
the empty text). Rows that repeat a doc_id count as rows of the group and share the fate of that
document; `drop_copies` goes by rows and leaves one of each group. NULL doc_ids sort last among equals. An empty table gives no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath.llm.common import SPACES, attach, hot_keys, numbered_rows, only, text_of
from tillpath.session import cut, stage

BLOCK_CHARS = 4096
_BUCKETS = 1 << 20
_RANK_BITS = 40


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` (with `_row`, `_pos` and the key columns) with the keys replaced by `_name`."""
    hashed = rows.withColumn("_hash", F.xxhash64(*keys))
    hot = hot_keys(hashed.select("_hash"), ["_hash"])
    if hot.isEmpty():
        named = hashed.withColumn("_hot_name", F.lit(None).cast("long"))
    else:
        contents = hashed.join(F.broadcast(hot), "_hash").select("_hash", *keys).distinct()
        # Names below zero, by rank: one row per hot content, a bounded number.
        contents = cut(contents).withColumn(
            "_hot_name", -F.row_number().over(Window.orderBy(*keys)).cast("long")
        )
        renamed = contents.select(
            "_hot_name", F.col("_hash").alias("_hot_hash"), *[F.col(k).alias(f"_hot{k}") for k in keys]
        )
        same = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"_hot{k}")) for k in keys],
            F.col("_hash") == F.col("_hot_hash"),
        )
        named = hashed.join(F.broadcast(renamed), same, "left").drop(
            "_hot_hash", *[f"_hot{k}" for k in keys]
        )
    is_hot = F.col("_hot_name").isNotNull()
    spread = F.when(is_hot, F.xxhash64("_row", "_pos")).otherwise(F.col("_hash"))
    ranked = named.withColumn("_bucket", F.pmod(spread, F.lit(_BUCKETS)))
    for key in keys:
        ranked = ranked.withColumn(key, F.when(~is_hot, F.col(key)))
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*keys))
    name = F.coalesce(F.col("_hot_name"), F.shiftleft(F.col("_bucket"), _RANK_BITS) + rank)
    return ranked.withColumn("_name", name).drop("_hash", "_hot_name", "_bucket", *keys)


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, n_chars, text_sha256 and its identity (`level`, `name`)."""
    plain = F.regexp_replace(F.col("_text"), f"{SPACES}+", "")
    whole = docs.select(
        *keep, F.monotonically_increasing_id().alias("_row"), text_of().alias("_text")
    ).select(*keep, "_row", F.char_length("_text").alias("n_chars"), plain.alias("_plain"))
    size = F.char_length("_plain")
    cuts = F.greatest(F.ceil(size / F.lit(block_chars)), F.lit(1)).cast("int")
    blocks = whole.select("*", cuts.alias("_n")).select(
        "*",
        F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_pos"),
    ).select(
        "_row", "_n", "_pos",
        F.when(F.col("_pos") == 0, F.struct(*keep, "n_chars", F.sha2("_plain", 256).alias("text_sha256")))
        .alias("_doc"),
        F.when(F.col("_n") == 1, F.col("_plain"))
        .otherwise(F.expr(f"substring(_plain, _pos * {block_chars} + 1, {block_chars})"))
        .alias("_block"),
    )
    level0 = stage(_named(blocks, ["_block"]), "block-names")
    heads = level0.where("_pos = 0").select("_row", "_doc.*", "_n", "_name")
    columns = [*keep, "n_chars", "text_sha256"]
    done = [heads.where("_n = 1").select(*columns, F.lit(0).alias("level"), F.col("_name").alias("name"))]
    longest = level0.agg(F.max("_n")).first()[0] or 1
    if longest > 1:
        open_docs = heads.where("_n > 1").drop("_name", "_n")
        current, finished, level = level0.where("_n > 1").select("_row", "_n", "_pos", "_name"), [], 0
        while longest > 1:
            level += 1
            even = F.col("_pos") % 2 == 0
            pairs = current.groupBy("_row", "_n", F.floor(F.col("_pos") / 2).cast("int").alias("_half")).agg(
                F.max(F.when(even, F.col("_name"))).alias("_left"),
                F.max(F.when(~even, F.col("_name"))).alias("_right"),
            ).select("_row", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.col("_half").alias("_pos"), "_left", "_right")
            current = cut(_named(pairs, ["_left", "_right"]))
            finished.append(
                current.where("_n = 1").select("_row", F.lit(level).alias("level"), F.col("_name").alias("name"))
            )
            current = current.where("_n > 1")
            longest = (longest + 1) // 2
        last = reduce(DataFrame.unionByName, finished)
        done.append(open_docs.join(last, "_row").select(*columns, "level", "name"))
    return reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of `docs`.

    Of equal texts the one with the most code points in its original text stays, then the smallest
    doc_id.
    """
    known = stage(identities(docs, block_chars), "identities")
    order = F.struct(
        (-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")
    )
    groups = stage(known.groupBy("level", "name").agg(
        F.min(order)["c"].alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    ), "identity-groups")
    return attach(known, groups, ["level", "name"], "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row of every group of equal texts, the one of `keep_id`; of its rows any one.

    Rows are told apart by a key of their own: doc_ids may be NULL or repeated, and any column may be there.
    """
    rows = numbered_rows(docs, "exact-rows")
    known = identities(rows.select("key", "doc.doc_id", "doc.text"), block_chars, ("doc_id", "key"))
    order = F.struct(
        (-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"),
        F.col("key").alias("d"),
    )
    kept = known.groupBy("level", "name").agg(F.min(order)["d"].alias("key"))
    return only(rows, stage(kept.select("key"), "exact-kept"))
