"""Cleaning of raw transaction lines. The order of the steps is part of their meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath.config import DEFAULTS, Settings
from tillpath.fixed_values import RAW_TO_CLEAN
from tillpath.functions.numeric import percent
from tillpath.functions.text import is_return_invoice, is_service_code, strip_text
from tillpath.operators.ranking import exact_quantiles
from tillpath.session import cut, stage

_FIELDS = list(RAW_TO_CLEAN.values())


def rename_columns(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(RAW_TO_CLEAN)


def strip_strings(df: DataFrame) -> DataFrame:
    """Strip every string column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: strip_text(F.col(name)) for name in texts})


def drop_duplicates(df: DataFrame, *, position: str | None = None, copies: str | None = None) -> DataFrame:
    """One row per distinct line.

    `position` names a column that says where a row stood in the feed; it takes no part in the
    comparison and the earliest one is kept. `copies` adds how many rows a line stood for. Copies
    are merged before the shuffle, so a line repeated many times is no hot spot.
    """
    fields = [c for c in df.columns if c != position]
    kept = [F.min(position).alias(position)] if position else []
    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    if not kept and not counted:
        return df.dropDuplicates(fields)
    return df.groupBy(*fields).agg(*kept, *counted)


# Lines fall into this many classes by hash, told apart by bits in words of 64, `_WORDS` words a row: 4,096 rows, 16 MB.
_CLASS_BITS = 27
_WORDS = 512
# About so many hashes are counted by a task.
_HASHES = 500_000


def _hash(fields: list[str]) -> Column:
    return F.xxhash64(*fields)


def _class(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << _CLASS_BITS) - 1)).cast("int")


def _block_word_bit(number: Column) -> tuple[Column, Column, Column]:
    word = F.shiftright(number, 6)
    return (word / _WORDS).cast("int"), word % _WORDS, number.bitwiseAND(F.lit(63))


def copied_classes(lines: DataFrame, fields: list[str]) -> DataFrame:
    """The classes of all lines that have a copy, as bits: `_block` and its `_words`.

    Equal lines have equal hashes, so a line whose hash no other line has is no copy, and only hashes
    are shuffled to find that out. Marked are the classes of the other hashes, so that the marks have a bounded size
    however many copies there are; a marked class may hold lines without a copy as well.
    """
    # Spread before they are counted: nearly all differ, so counting them where they are would merge none.
    # They are short, so adaptive execution would put too many into a task for their counts to fit its memory.
    tasks = 1 + lines.count() // _HASHES
    hashes = lines.select(_hash(fields).alias("_hash")).repartition(tasks, "_hash")
    found = hashes.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    block, word, bit = _block_word_bit(_class(F.col("_hash")))
    placed = found.select(block.alias("_block"), word.alias("_word"), bit.alias("_bit"))
    words = placed.groupBy("_block", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    blocks = words.groupBy("_block").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_found")
    )
    every = F.sequence(F.lit(0), F.lit(_WORDS - 1))
    bits = F.transform(every, lambda i: F.coalesce(F.element_at("_found", i), F.lit(0).cast("long")))
    return blocks.select("_block", bits.alias("_words"))


def _in_classes(lines: DataFrame, classes: DataFrame, *, inside: bool = True) -> DataFrame:
    """The lines whose `_class` is one of `classes`, or those of all others."""
    block, word, bit = _block_word_bit(F.col("_class"))
    marked = F.coalesce(F.getbit(F.get("_words", word), bit) == 1, F.lit(False))
    placed = lines.withColumn("_block", block).join(F.broadcast(classes), "_block", "left")
    return placed.where(marked if inside else ~marked).drop("_block", "_words")


def flag_returns(df: DataFrame) -> DataFrame:
    return df.withColumn("is_return", is_return_invoice(F.col("invoice")))


def _non_product(settings: Settings) -> Column:
    return is_service_code(F.col("stock_code"), settings.non_product_codes)


def _bad_price(settings: Settings) -> Column:
    return F.coalesce((F.col("price") <= settings.min_price) & ~F.col("is_return"), F.lit(False))


def _zero_quantity() -> Column:
    return F.coalesce(F.col("quantity") == 0, F.lit(False))


def drop_non_products(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return df.where(~_non_product(settings))


def drop_bad_prices(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return df.where(~_bad_price(settings))


def drop_zero_quantity(df: DataFrame) -> DataFrame:
    return df.where(~_zero_quantity())


def quantity_bounds(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row (`cap_low`, `cap_high`): the interpolated percentiles, cut to whole numbers."""
    found = exact_quantiles(
        df, "quantity", {"cap_low": settings.cap_low, "cap_high": settings.cap_high}
    )
    # A global aggregate yields its row for an empty feed, too: then there is nothing to cap.
    return found.agg(
        F.max("cap_low").cast("int").alias("cap_low"),
        F.max("cap_high").cast("int").alias("cap_high"),
    )


def cap_quantity(df: DataFrame, bounds: DataFrame) -> DataFrame:
    quantity = F.col("quantity")
    capped = F.when(
        quantity.isNotNull(), F.least(F.greatest(quantity, F.col("cap_low")), F.col("cap_high"))
    )
    return (
        df.crossJoin(F.broadcast(bounds))
        .withColumn("quantity", capped.cast("int"))
        .drop("cap_low", "cap_high")
    )


def add_total(df: DataFrame) -> DataFrame:
    """`total_amount` = capped quantity times price; both money columns become decimals.

    The price is kept to a millionth, and the product is rounded once. The fact rounds the price.
    """
    exact = F.col("price").cast("decimal(18,6)")
    return df.withColumn(
        "total_amount", (F.col("quantity") * exact).cast("decimal(12,2)")
    ).withColumn("price", exact)


def cast_customer(df: DataFrame) -> DataFrame:
    """Customer numbers arrive as decimals or text; what is no number becomes NULL."""
    return df.withColumn("customer_id", F.col("customer_id").try_cast("double").try_cast("long"))


@dataclass(frozen=True)
class Cleaned:
    """Result of the cleaning chain: the lines and the one-row audit."""

    lines: DataFrame
    report: DataFrame


# Rejection steps in order, with the reason that goes into the report.
_STEPS = {
    "filter_non_products": "service and fee codes",
    "filter_invalid_prices": "price too low on a sale",
    "filter_zero_quantity": "quantity is zero",
}


def flag_rejects(distinct_lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add `rejected_by`: the first step that drops the line, NULL where it stays."""
    tests = [_non_product(settings), _bad_price(settings), _zero_quantity()]
    reason = None
    for step, test in zip(_STEPS, tests):
        reason = F.when(test, step) if reason is None else reason.when(test, step)
    return distinct_lines.withColumn("rejected_by", reason)


def cleaning_report(flagged: DataFrame, bounds: DataFrame, *, copies: str = "copies") -> DataFrame:
    """The audit, one row per step, from one aggregate over the flagged distinct lines."""
    kept = F.col("rejected_by").isNull()
    outside = (F.col("quantity") < F.col("cap_low")) | (F.col("quantity") > F.col("cap_high"))
    known = F.col("customer_id").isNotNull()
    rejected = {s: F.count_if(F.col("rejected_by") == s).alias(s) for s in _STEPS}
    totals = (
        flagged.crossJoin(F.broadcast(bounds))
        .agg(
            F.coalesce(F.sum(copies), F.lit(0)).alias("initial_rows"),
            F.count(F.lit(1)).alias("distinct_rows"),
            F.count_if("is_return").alias("returns_flagged"),
            *rejected.values(),
            F.count_if(kept).alias("final_rows"),
            F.count_if(kept & outside).alias("quantity_capped"),
            F.count_if(kept & known).alias("rows_with_customer_id"),
            F.count_if(kept & ~known).alias("rows_without_customer_id"),
        )
        .crossJoin(F.broadcast(bounds))
    )
    steps, before = [], F.col("distinct_rows")
    steps.append((
        "drop_duplicates", F.col("initial_rows"), before, "overlap of parts and exact copies"
    ))
    for step, reason in _STEPS.items():
        after = before - F.col(step)
        steps.append((step, before, after, reason))
        before = after
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).alias("step_no"),
            F.lit(step).alias("step"),
            start.alias("rows_before"),
            end.alias("rows_after"),
            (start - end).alias("rows_removed"),
            F.lit(reason).alias("reason"),
        )
        for i, (step, start, end, reason) in enumerate(steps)
    ])
    summary = [
        "initial_rows", "final_rows", "returns_flagged", "quantity_capped", "cap_low", "cap_high",
        "rows_with_customer_id", "rows_without_customer_id",
    ]
    dropped = percent(F.col("initial_rows") - F.col("final_rows"), F.col("initial_rows"))
    return totals.select(F.inline(rows), *summary, dropped.alias("pct_dropped"))


def finish(kept: DataFrame, bounds: DataFrame) -> DataFrame:
    """The last three steps: cap, total, customer number."""
    return cast_customer(add_total(cap_quantity(kept, bounds)))


def clean_transactions(
    raw: DataFrame, settings: Settings = DEFAULTS, *, position: str | None = None
) -> Cleaned:
    """The whole chain.

    The stripped lines are staged once, with the flags that follow from their fields: the search for copies,
    the percentiles, the report and every table built later read them. Lines that may have a copy, and
    only these, are shuffled to merge them; those that have none stay where they were staged.
    """
    extra = [position] if position else []
    named = strip_strings(rename_columns(raw)).select(*_FIELDS, *extra)

    def flag(lines: DataFrame) -> DataFrame:
        return flag_rejects(flag_returns(lines), settings)

    feed = stage(flag(named).withColumn("_class", _class(_hash(_FIELDS))), "feed-lines")
    classes = cut(copied_classes(feed, _FIELDS))
    single = _in_classes(feed, classes, inside=False).withColumn("copies", F.lit(1).cast("long"))
    others = _in_classes(feed, classes).select(*_FIELDS, *extra)
    merged = stage(flag(drop_duplicates(others, position=position, copies="copies")), "merged-lines")
    flagged = single.drop("_class").unionByName(merged)
    kept = flagged.where(F.col("rejected_by").isNull())
    bounds = cut(quantity_bounds(kept, settings))
    columns = [*_FIELDS, "is_return", "total_amount", *extra]
    return Cleaned(
        lines=finish(kept, bounds).select(*columns),
        report=cleaning_report(flagged, bounds),
    )
