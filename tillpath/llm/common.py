"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpath.session import cut, stage

# Words are separated by these characters only (space, tab, line feed, vertical tab, form feed,
# carriage return), in regular expressions and in bytes.split().
SPACES = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with NULL as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def small(stream, rows: int = 256):
    """The Arrow batches of a task in slices of a few rows, so that what Python makes of them stays small."""
    for batch in stream:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def numbered_rows(docs: DataFrame, name: str) -> DataFrame:
    """(key, doc): a number per row and the row itself as one struct, stored, so that every reader sees the
    same numbers. In the struct no column of the input can clash with one of ours."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return stage(docs.select(F.monotonically_increasing_id().alias("key"), whole.alias("doc")), name)


def only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `numbered_rows` whose key is in `kept` (key), as they came in.

    Rows move once, at every size: a plan that broadcast the keys of small tables would tell nothing about
    large ones. What each task holds of `kept` is its share of the keys.
    """
    return rows.join(kept.hint("shuffle_hash"), "key", "left_semi").select("doc.*")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, least: int = 1000, most: int = 1000) -> DataFrame:
    """`rows` with the columns of their group. `groups` has a row per group and its number of rows in `size`.

    The up to `most` largest groups with at least `least` rows reach their rows by broadcast, so that no group has to
    fit into one task; any other is smaller than 1/`most` of all rows.
    """
    hot = cut(groups.where(F.col(size) >= least).orderBy(F.col(size).desc(), *keys).limit(most))
    if hot.isEmpty():
        return rows.join(groups, keys)
    named = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups, keys)
    return rows.join(named, keys).unionByName(rest)


def hot_keys(keys: DataFrame, columns: list[str], least: int = 1000, most: int = 1000) -> DataFrame:
    """The up to `most` most frequent keys with at least `least` rows, checkpointed.

    A key that is not among the `most` largest holds less than 1/`most` of all rows, so whatever
    is left out needs no special care, and the result has a fixed size bound and may be broadcast.
    """
    counted = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return cut(
        counted.where(F.col("_n") >= least).orderBy(F.col("_n").desc(), *columns).limit(most)
    ).drop("_n")


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected `links` (a, b): one row (node, component) per linked node.

    The component is the smallest node in it. Alternates two contractions, each of which hangs the
    neighbours of a node on its smallest neighbour, until nothing moves; the number of rounds is
    logarithmic. Minima are aggregated before the shuffle, and the join that hands them back is an
    ordinary one that adaptive execution splits where a node has very many neighbours.
    """
    edges = cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )

    def hang(directed: DataFrame, keep: Column) -> DataFrame:
        low = directed.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        moved = directed.join(low, "u")
        return moved.where(keep).select("u", "v", "m")

    def digest(df: DataFrame):
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        return row["n"], row["h"]

    before = digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hang(both, F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = cut(large.where("u != v").distinct())
        # Every edge now points from the larger node to the smaller one.
        small = hang(large, F.lit(True))
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = cut(hung.where("u != v").distinct())
        after = digest(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
