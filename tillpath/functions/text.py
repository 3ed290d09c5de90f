"""String clean-up and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpath import fixed_values

# Unicode white space plus the four ASCII separators that count as space in the raw feeds' reader.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip_text(column: Column) -> Column:
    """Strip white space of any kind from both ends; the text `nan` stands for a missing value."""
    return F.nullif(F.regexp_replace(column.cast("string"), _EDGE_SPACE, ""), F.lit("nan"))


def is_return_invoice(invoice: Column) -> Column:
    return F.coalesce(F.startswith(invoice, F.lit("C")), F.lit(False))


def is_service_code(code: Column, codes) -> Column:
    """Listed service codes and single letters of any script; a missing code is not one."""
    return F.coalesce(code.isin(list(codes)) | code.rlike(r"^\p{L}$"), F.lit(False))


def tenure_bucket(days: Column) -> Column:
    label = None
    for name, last_day in fixed_values.TENURE_BUCKETS.items():
        test = days == last_day if last_day == 0 else days <= last_day
        label = F.when(test, name) if label is None else label.when(test, name)
    return label.otherwise(fixed_values.TENURE_BEYOND)


def readable_feature(name: Column) -> Column:
    """`avg_order_value_enc` -> `Avg Order Value`."""
    return F.initcap(F.regexp_replace(F.regexp_replace(name, "_enc$", ""), "_", " "))
