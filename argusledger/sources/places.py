"""Where rows of files come from: their order over many files and splits, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusledger.functions.tables import small

#: Column of a row's place: its file, its split's start, and a number that rises by one a row within the split.
PLACE = "_place"


def placed(rows: DataFrame) -> DataFrame:
    """Rows as a file source gave them (a filter may lie between), with :data:`PLACE`; nothing is computed where nobody reads it."""
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias(PLACE))


def split_starts(rows: DataFrame, within_file: bool = False) -> DataFrame:
    """(task, split, file, first, before): a row a split, with the number of rows in the splits before it, or of its file only.

    One task orders these, unless ``within_file``: as many rows as Spark's own list of splits, which the driver holds, has.
    """
    at = F.col(f"{PLACE}.at")
    each = rows.groupBy(F.col(f"{PLACE}.file").alias("file"), F.col(f"{PLACE}.block").alias("block")).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    files = Window.partitionBy("file") if within_file else Window.partitionBy()
    earlier = files.orderBy(*([] if within_file else ["file"]), "block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("file", F.shiftright("first", 33).alias("task"), F.xxhash64("file", "block").alias("split"), "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def with_numbers(rows: DataFrame, within_file: bool = False, base: int = 1) -> DataFrame:
    """Rows with ``row_number``: from ``base``, in the order of files (by name), splits and rows, of all rows of ``rows``.

    A split's rows are read by one task in their order, so a row's number is that of the rows before its split, and its own
    within it.  Splits are joined by task and hash; their table is broadcast where it is small.
    """
    starts = small(split_starts(rows, within_file).select("task", "split", "first", "before"))
    mine = rows.withColumns({"task": F.shiftright(f"{PLACE}.at", 33), "split": F.xxhash64(f"{PLACE}.file", f"{PLACE}.block")})
    return mine.join(starts, ["task", "split"]).withColumn("row_number", F.col(f"{PLACE}.at") - F.col("first") + F.col("before") + base).drop("task", "split", "first", "before")
