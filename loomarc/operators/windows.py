"""Running counts over ordered rows, and the marker windows and turns built on them.

A window function over one key sorts all rows of the key in one task. Where the order is a
number, the running sum is made in two levels instead: within blocks of the order (spread
over tasks) plus the sums of the blocks before, so a hot key has no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block in units of the order column.
BLOCK = 4096


def running_sum(df: DataFrame, key: str, order: str, value: Column, into: str, block: int = BLOCK, ties: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the key before a row (the row excluded).

    ``order`` is a whole number; rows of equal order are ordered by ``ties``. ``total`` names a
    further column for the sum over the whole key, made of the sums of blocks already there.
    """
    marked = df.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_v", value.cast("bigint"))
    sums = marked.groupBy(key, "_b").agg(F.sum("_v").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_n").over(Window.partitionBy(key)).alias(total)] if total else []
    offsets = sums.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), *whole)
    inside = Window.partitionBy(key, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("_w", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return placed.join(offsets, [key, "_b"]).withColumn(into, F.col("_w") + F.col("_offset")).drop("_b", "_v", "_w", "_offset")


def marker_windows(df: DataFrame, key: str, order: str, is_marker: Column, ties: tuple[str, ...] = (), keep_open: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows with ``window_no``: window n holds the rows after marker n-1 and before marker n.

    Markers themselves are dropped; so are rows after the last marker, which belong to no
    window that can be exported, unless ``keep_open``.
    """
    numbered = running_sum(df.withColumn("_m", is_marker), key, order, F.col("_m").cast("int"), "window_no", block, ties, "_windows")
    kept = ~F.col("_m") if keep_open else ~F.col("_m") & (F.col("window_no") < F.col("_windows"))
    return numbered.where(kept).drop("_m", "_windows")


def running_turns(df: DataFrame, key: str, order: str, body: Column, into: str = "turn_no") -> DataFrame:
    """Adds the number of rows with a body up to and including each row (turns count from 1)."""
    spoken = F.coalesce(body != "", F.lit(False)).cast("int")
    counted = running_sum(df, key, order, spoken, into)
    return counted.withColumn(into, F.col(into) + spoken)


def first_per_group(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each group, by aggregation (partial, so hot groups combine map-side)."""
    value = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(value, F.struct(*order)).alias("_r")).select("_r.*")


def top_per_group(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each group with ``index_in_group`` from 0.

    Spark keeps at most n rows per group and task before the shuffle (window group limit).
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", number).where(F.col("_n") <= n).withColumn("index_in_group", F.col("_n") - 1).drop("_n")
