"""Values at given ranks without sorting, and groups of equal size from them.

A bound of `ntile` is the value at one rank. To find it, rows are counted in bins between the least and the
greatest value; the bin that holds the rank is narrowed down to its own least and greatest value and cut into
bins again, until it holds one value. Every pass is one aggregate over all rows with a fixed number of bins,
combined before its shuffle; after the first pass only rows inside a bin that holds a bound count. Where
several rows have that value, the same search among their tie-break keys finds the last one that belongs
below the bound. Rows then get their group by comparison with the bounds: no row moves.

Columns are whole numbers or decimals (as unscaled longs; a value beyond 63 bits is an error). NULLs are
not ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 1 << 16


@dataclass(frozen=True)
class _Search:
    """The rank wanted inside [low, high], `before` of whose rows are below; `among` narrows the rows to those of one value."""

    column: str
    by: str
    rank: int
    low: int
    high: int
    before: int = 0
    held: int = 0
    among: int | None = None

    @property
    def bracket(self) -> tuple:
        return self.column, self.by, self.low, self.high, self.among


@dataclass(frozen=True)
class Bound:
    """A row belongs above if its value is greater, or equal with a greater tie-break key."""

    value: int
    tie: int


def sortable(df: DataFrame, column: str) -> Column:
    """A whole number or decimal as a long of the same order."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        shift = F.lit(10**kind.scale).cast("decimal(38,0)")
        return (F.col(column).cast(T.DecimalType(38 - kind.scale, kind.scale)) * shift).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    raise TypeError(f"{column} is neither a whole number nor a decimal")


def _narrowed(keys: DataFrame, searches: list[_Search], bins: int) -> list[_Search]:
    """Every search one pass further."""
    brackets = sorted({s.bracket for s in searches if s.low < s.high}, key=repr)
    cases = []
    for number, (column, by, low, high, among) in enumerate(brackets):
        key, width = F.col(by), (high - low) // bins + 1
        # Division cuts towards zero, which keeps the order, and never leaves the range of a long.
        place = F.expr(f"`{by}` div {width}L") - F.lit(_cut(low, width))
        inside = key.between(low, high)
        if among is not None:
            inside &= F.col(column) == among
        cases.append(F.when(inside, F.struct(F.lit(number).alias("bracket"), place.alias("bin"), key.alias("key"))))
    held = keys.select(F.explode(F.array_compact(F.array(*cases))).alias("c")).select("c.*")
    counted = held.groupBy("bracket", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    so_far = Window.partitionBy("bracket").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("n").over(so_far))
    # Up to `bins` rows a bracket are summed up, the few that hold a rank come to the driver.
    ranks = {b: sorted({s.rank - s.before for s in searches if s.bracket == b}) for b in brackets}
    wanted = F.lit(False)
    for number, b in enumerate(brackets):
        for rank in ranks[b]:
            wanted |= (F.col("bracket") == number) & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    found = upto.where(wanted).collect()

    def step(s: _Search) -> _Search:
        if s.low == s.high:
            return s
        number, rank = brackets.index(s.bracket), s.rank - s.before
        row = next(r for r in found if r["bracket"] == number and r["upto"] - r["n"] < rank <= r["upto"])
        return replace(s, low=row["low"], high=row["high"], before=s.before + row["upto"] - row["n"], held=row["n"])

    return [step(s) for s in searches]


def _cut(value: int, width: int) -> int:
    """Division towards zero."""
    return value // width if value >= 0 else -(-value // width)


def _settled(keys: DataFrame, searches: list[_Search], bins: int) -> list[_Search]:
    while any(s.low < s.high for s in searches):
        searches = _narrowed(keys, searches, bins)
    return searches


def ends(rows: int, groups: int) -> Iterator[int]:
    """The last ranks of the first `groups - 1` of groups whose sizes differ by one at most, without empty rests."""
    small, large = divmod(rows, groups)
    for group in range(1, groups):
        end = group * small + min(group, large)
        if 0 < end < rows:
            yield end


def bounds(df: DataFrame, columns: dict[str, Column], tie: str, groups: int, *, bins: int = BINS) -> dict[str, list[Bound]]:
    """The bounds of `groups` equal groups by each of `columns` (a name to its key, a long), ties by the unique whole number `tie`.

    `df` is read once per pass: store it before. At most a bound per group and column comes to the driver.
    """
    keys = df.select(F.col(tie).cast("long").alias("_tie"), *[c.alias(f"_{name}") for name, c in columns.items()])
    spans = keys.agg(
        F.min("_tie"), F.max("_tie"),
        *[f(f"_{name}") for name in columns for f in (F.count, F.min, F.max)],
    ).first()
    searches = []
    for place, name in enumerate(columns):
        rows, low, high = spans[2 + 3 * place : 5 + 3 * place]
        searches += [_Search(f"_{name}", f"_{name}", end, low, high, held=rows) for end in ends(rows, groups)]
    values = _settled(keys, searches, bins)
    # Where a bound falls between rows of one value, the tie-break key of the last row below it.
    ties = [
        _Search(s.column, "_tie", s.rank - s.before, spans[0], spans[1], among=s.low)
        if s.rank - s.before < s.held else _Search(s.column, "_tie", 1, spans[1], spans[1])
        for s in values
    ]
    ties = _settled(keys, ties, bins)
    out: dict[str, list[Bound]] = {name: [] for name in columns}
    for s, t in zip(values, ties):
        out[s.column[1:]].append(Bound(s.low, t.low))
    return out


def group_of(key: Column, tie: Column, found: list[Bound]) -> Column:
    """1 and one more for every bound the row is above."""
    above = [((key > b.value) | ((key == b.value) & (tie > b.tie))).cast("int") for b in found]
    out = F.lit(1)
    for a in above:
        out = out + a
    return out.cast("int")
