"""The raw feed: several parts of one schema."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath.schemas import RAW


def require_columns(df: DataFrame, expected: Sequence[str] = tuple(RAW.names)) -> DataFrame:
    """The frame itself, or ValueError if a column is missing. More columns are fine."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}, found {sorted(df.columns)}")
    return df


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack parts by column name; rows that occur in several parts stay."""
    if not parts:
        raise ValueError("no parts to read")
    return reduce(DataFrame.unionByName, [require_columns(p) for p in parts])


# Quotes inside a quoted value are doubled, as spreadsheets write them.
_CSV = {"header": "true", "quote": '"', "escape": '"'}
# A line with fewer or more values than the header has, as it stood in the file.
REFUSED = "_refused"


def account() -> Observation:
    """Counts of a feed that are known once it has been read: `lines_read` and `lines_refused`."""
    return Observation(f"feed-{uuid.uuid4().hex}")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, head): the first line of every file.

    Most of the feed is not read for it: a piece of a file that is followed by another one has its task to
    itself and is left after its first lines. Only last pieces and small files, several of which may share
    a task, are gone through.
    """
    place = F.col("_metadata")
    pieces = spark.read.text(path).select(
        place["file_path"].alias("file"),
        place["file_block_start"].alias("start"),
        (place["file_block_start"] + place["file_block_length"] < place["file_size"]).alias("goes_on"),
        "value",
    )

    def first_lines(stream):
        seen = None
        for batch in stream:
            files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lines = batch.column(3)
            for row, file in enumerate(files):
                if file != seen:
                    seen = file
                    if starts[row] == 0:
                        yield pa.RecordBatch.from_pydict({"file": [file], "head": [lines[row].as_py()]})
            if batch.column(2)[0].as_py():
                return

    return pieces.mapInArrow(first_lines, "file string, head string")


def _csv_parts(spark: SparkSession, path: str, multi_line: bool) -> list[DataFrame]:
    """The files of a part as text columns and `REFUSED`, one frame per distinct header.

    Every file is read with its own header, so files of one folder may have their columns in any order. Headers are
    reduced to the distinct ones by the executors. A part with one header, the usual case, is read as the folder it is;
    only for several of them the names of the files come to the driver.
    """
    options = _CSV | {"multiLine": str(multi_line).lower(), "columnNameOfCorruptRecord": REFUSED, "mode": "PERMISSIVE"}
    # Values are counted against the whole header, also where a reader needs a few columns only.
    options["columnPruning"] = "false"
    heads = _heads(spark, path)
    if heads.select("head").distinct().count() <= 1:
        groups: list[str | list[str]] = [path]
    else:
        heads = heads.groupBy("head").agg(F.collect_list("file").alias("files"))
        groups = [sorted(r["files"]) for r in heads.orderBy("head").collect()]
    parts = []
    for group in groups:
        named = spark.read.options(**_CSV).option("multiLine", multi_line).csv(group).columns
        text = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*named, REFUSED])
        parts.append(require_columns(spark.read.schema(text).options(**options).csv(group)))
    return parts


def _json_columns(spark: SparkSession, path: str) -> list[str]:
    """Names that any record of the part has; writers leave NULL fields out of single records."""
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("k")).distinct()
    return [r["k"] for r in keys.collect()]


def read_lines(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "csv",
    *,
    position: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Every part with the one raw schema, and in `REFUSED` the text of lines that do not fit it (else NULL).

    CSV files need a header and may have their columns in any order, each file its own; values that do
    not parse are NULL. A line fits if it has as many values as its header; a line break inside quotes makes
    two lines that do not, unless `multi_line` allows it (such files cannot be split).
    `position` adds where a row stood (part, file, block, row), comparable between rows, for
    rules that take the first of several rows.
    """
    frames, sources = [], []
    for number, path in enumerate(paths):
        if fmt == "csv":
            sources += [(number, part) for part in _csv_parts(spark, path, multi_line)]
        elif fmt == "json":
            found = _json_columns(spark, path)
            missing = sorted(set(RAW.names) - set(found))
            if missing:
                raise ValueError(f"missing columns {missing}, found {sorted(found)}")
            with_text = T.StructType([*RAW.fields, T.StructField(REFUSED, T.StringType())])
            reader = spark.read.schema(with_text).option("columnNameOfCorruptRecord", REFUSED)
            sources.append((number, reader.json(path)))
        else:
            require_columns(spark.read.format(fmt).load(path))
            whole = spark.read.format(fmt).schema(RAW).load(path)
            sources.append((number, whole.withColumn(REFUSED, F.lit(None).cast("string"))))
    for number, part in sources:
        columns = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in RAW.fields]
        if position:
            columns.append(
                F.struct(
                    F.lit(number).alias("part"),
                    F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"),
                ).alias(position)
            )
        # Spark refuses to read nothing but the refused text, so a data column takes part: no length is negative.
        anchor = F.col(f"`{RAW.names[0]}`").cast("string")
        refused = F.coalesce(F.col(REFUSED), F.when(F.length(anchor) < 0, anchor)).alias(REFUSED)
        frames.append(part.select(*columns, refused))
    return union_parts(frames)


def read_parts(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "csv",
    *,
    position: str | None = None,
    multi_line: bool = False,
    counts: Observation | None = None,
) -> DataFrame:
    """The lines of `read_lines` that fit. `counts` (see `account`) tells how many were read and refused, once
    the first action on the result has run; nothing is read twice for it."""
    lines = read_lines(spark, paths, fmt, position=position, multi_line=multi_line)
    if counts is not None:
        lines = lines.observe(
            counts, F.count(F.lit(1)).alias("lines_read"), F.count(REFUSED).alias("lines_refused")
        )
    return lines.where(F.col(REFUSED).isNull()).drop(REFUSED)


def feed_account(lines: DataFrame) -> DataFrame:
    """One row over the result of `read_lines`: lines read, kept and refused."""
    refused = F.count(REFUSED)
    return lines.agg(
        F.count(F.lit(1)).alias("lines_read"),
        (F.count(F.lit(1)) - refused).alias("lines_kept"),
        refused.alias("lines_refused"),
    )
