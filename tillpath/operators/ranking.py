"""Global order without a global task.

`OVER (ORDER BY ...)` without a partition key sends every row to one task. Here rows are range
partitioned on a unique order, so partitions are of even size even where one value is very
frequent, and every partition needs only one number from its predecessors: how much came before
it. Those per-partition summaries have one row per partition and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpath.session import cut

Order = Sequence["str | Column"]

# Up to this many groups, one row per group is small enough to broadcast.
_GROUP_ROWS = 100_000

# A position is (partition << 33) + index inside the partition.
_INDEX_BITS = 33


def _place(df: DataFrame, order: Order, partitions: int | None) -> DataFrame:
    """Sort `df` over all partitions and remember where each row landed (`_slice`, `_index`).

    Without a given number of partitions adaptive execution chooses it by size. The result is
    checkpointed: partition bounds are sampled, so they must not be drawn a second time.
    """
    if partitions:
        spread = df.repartitionByRange(partitions, *order)
    else:
        spread = df.repartitionByRange(*order)
    sorted_rows = spread.sortWithinPartitions(*order)
    placed = cut(sorted_rows.withColumn("_position", F.monotonically_increasing_id()))
    position = F.col("_position")
    return placed.select(
        *df.columns,
        F.shiftright(position, _INDEX_BITS).alias("_slice"),
        position.bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).alias("_index"),
    )


def _earlier(column: str) -> Column:
    """Sum over the slices before this one; runs on one row per slice."""
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(before), F.lit(0))


def _with_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of the per-group frame to every row.

    Few groups mean large ones, so their rows must stay where they are: the group frame is counted
    and broadcast. With many groups it is an ordinary join, split by adaptive execution if skewed.
    """
    if not keys:
        return rows.crossJoin(F.broadcast(groups))
    renamed = cut(groups.select(
        *[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys]
    ))
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    if renamed.count() <= _GROUP_ROWS:
        renamed = F.broadcast(renamed)
    return rows.join(renamed, same).drop(*[f"_g_{k}" for k in keys])


def dense_key(
    df: DataFrame,
    order: Order,
    name: str,
    *,
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number all rows 1..n in the given unique order; `total` adds n as a column."""
    placed = _place(df, order, partitions)
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    everything = Window.partitionBy()
    starts = sizes.select(
        "_slice",
        _earlier("_size").alias("_before"),
        F.sum("_size").over(everything).alias("_total"),
    )
    extra = [F.col("_total").alias(total)] if total else []
    return placed.join(F.broadcast(starts), "_slice").select(
        *df.columns, (F.col("_before") + F.col("_index") + 1).alias(name), *extra
    )


def group_key(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    name: str,
    *,
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number rows 1..n inside each group, for groups that may be too large for one task."""
    numbered = dense_key(df, [*group, *order], "_rank", partitions=partitions)
    first = numbered.groupBy(*group).agg(
        F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_total")
    )
    extra = [F.col("_total").alias(total)] if total else []
    return _with_group(numbered, first, group).select(
        *df.columns, (F.col("_rank") - F.col("_first") + 1).alias(name), *extra
    )


def running_totals(
    df: DataFrame,
    order: Order,
    totals: dict[str, str],
    *,
    rank: str | None = None,
    count: str | None = None,
    grand: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Running sums in a unique order: `totals` maps a numeric column to its running sum.

    `rank` adds the row number, `count` the number of rows, `grand` maps a column to the name of
    its overall sum.
    """
    placed = _place(df, order, partitions)
    grand = grand or {}
    summed = list(dict.fromkeys([*totals, *grand]))
    slices = placed.groupBy("_slice").agg(
        F.count(F.lit(1)).alias("_size"), *[F.sum(c).alias(f"_sum_{c}") for c in summed]
    )
    everything = Window.partitionBy()
    starts = slices.select(
        "_slice",
        _earlier("_size").alias("_before"),
        F.sum("_size").over(everything).alias("_count"),
        *[_earlier(f"_sum_{c}").alias(f"_before_{c}") for c in summed],
        *[F.sum(f"_sum_{c}").over(everything).alias(f"_grand_{c}") for c in summed],
    )
    inside = Window.partitionBy("_slice").orderBy("_index").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = placed.select("*", *[F.sum(c).over(inside).alias(f"_local_{c}") for c in totals])
    columns = [
        *df.columns,
        *[(F.col(f"_before_{c}") + F.col(f"_local_{c}")).alias(out) for c, out in totals.items()],
    ]
    if rank:
        columns.append((F.col("_before") + F.col("_index") + 1).alias(rank))
    if count:
        columns.append(F.col("_count").alias(count))
    columns += [F.col(f"_grand_{c}").alias(out) for c, out in grand.items()]
    return local.join(F.broadcast(starts), "_slice").select(*columns)


def concentration(
    df: DataFrame, value: str, key: Order, *, partitions: int | None = None
) -> DataFrame:
    """Rows by falling `value` with `rank`, `n_rows`, `cumulative_value` and `total_value`.

    Equal values share one cumulative value, as the default frame of a SQL window has it, while
    ranks stay apart (ties by `key`). Equal values are neighbours in the order; only the values at
    the edge of a slice can go on in the next one, and those are settled on the slice summaries.
    """
    placed = _place(df, [F.col(value).desc(), *key], partitions)
    slices = placed.groupBy("_slice").agg(
        F.count(F.lit(1)).alias("_size"),
        F.sum(value).alias("_sum"),
        F.max(value).alias("_first"),
        F.min(value).alias("_last"),
    )
    # What each slice holds of its first (largest) value.
    leads = (
        placed.join(F.broadcast(slices.select("_slice", "_first")), "_slice")
        .where(F.col(value) == F.col("_first"))
        .groupBy("_slice")
        .agg(F.sum(value).alias("_lead"))
    )
    slices = slices.join(leads, "_slice")
    everything = Window.partitionBy()
    leads_so_far = (
        Window.partitionBy("_first")
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summary = slices.select(
        "*",
        _earlier("_size").alias("_before"),
        _earlier("_sum").alias("_before_sum"),
        F.sum("_size").over(everything).alias("_count"),
        F.sum("_sum").over(everything).alias("_grand"),
        F.sum("_lead").over(leads_so_far).alias("_lead_so_far"),
        F.sum("_lead").over(Window.partitionBy("_first")).alias("_lead_all"),
    )
    carried = (
        summary.groupBy(F.col("_first").alias("_value"))
        .agg(F.max("_lead_all").alias("_carried"))
    )
    starts = summary.join(carried, summary["_last"] == carried["_value"], "left").select(
        "_slice",
        "_before",
        "_before_sum",
        "_count",
        "_grand",
        "_last",
        # What later slices still hold of this slice's last value.
        (
            F.coalesce(F.col("_carried"), F.lit(0))
            - F.when(F.col("_first") == F.col("_last"), F.col("_lead_so_far")).otherwise(F.lit(0))
        ).alias("_later"),
    )
    spill = F.when(F.col(value) == F.col("_last"), F.col("_later")).otherwise(F.lit(0))
    running = placed.withColumn(
        "_running",
        F.sum(value).over(Window.partitionBy("_slice").orderBy(F.col(value).desc())),
    )
    return running.join(F.broadcast(starts), "_slice").select(
        *df.columns,
        (F.col("_before") + F.col("_index") + 1).alias("rank"),
        F.col("_count").alias("n_rows"),
        (F.col("_before_sum") + F.col("_running") + spill).alias("cumulative_value"),
        F.col("_grand").alias("total_value"),
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    shares: dict[str, float],
    *,
    group: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Interpolated quantiles per group as doubles: `shares` maps an output name to a share.

    Rows are first counted per distinct value, so a frequent value travels as one row; the counts
    are then summed up in order and only the rows that hold a wanted position are kept. NULLs are
    left out. A single overall group is `group=()`.
    """
    group = list(group)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    summed = running_totals(counted, [*group, value], {"_n": "_upto"}, partitions=partitions)
    sizes = summed.groupBy(*group).agg(
        F.sum("_n").alias("_rows"), F.min(F.col("_upto") - F.col("_n")).alias("_start")
    )
    joined = _with_group(summed, sizes, group)
    upto = F.col("_upto") - F.col("_start")

    def holds(index: Column) -> Column:
        return (index < upto) & (index >= upto - F.col("_n"))

    wanted, picks = None, []
    for i, share in enumerate(shares.values()):
        position = (F.col("_rows") - 1) * F.lit(float(share))
        low, high = F.floor(position), F.ceil(position)
        hit = holds(low) | holds(high)
        wanted = hit if wanted is None else wanted | hit
        picks += [
            F.max(F.when(holds(low), F.col(value).cast("double"))).alias(f"_low_{i}"),
            F.max(F.when(holds(high), F.col(value).cast("double"))).alias(f"_high_{i}"),
            F.max(position - low).alias(f"_part_{i}"),
        ]
    picked = joined.where(wanted).groupBy(*group).agg(*picks)
    return picked.select(
        *group,
        *[
            (
                F.col(f"_low_{i}") + (F.col(f"_high_{i}") - F.col(f"_low_{i}")) * F.col(f"_part_{i}")
            ).alias(name)
            for i, name in enumerate(shares)
        ],
    )
