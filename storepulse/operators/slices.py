"""Sorted slices: the common ground of everything that needs an order across tasks.

``sorted_slices`` writes a frame once, then deals it by ranges of an order into a second written table in which
``_slice`` numbers the ranges. A slice is a contiguous run of the order and holds a bounded number of rows,
however many of them share a key, lack one or lack a time. What crosses slices then needs one small row per
(slice, key): counts give offsets to ranks, last values reach the next slice, and step maps carry a state.

The number of slices follows the number of rows, not a session setting; the range bounds come from Spark's own
sample of the written rows, so the plan above is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.session import cut_lineage

SLICE_ROWS = 500_000  # rows of a slice, about
LEAST_ROWS = 10_000  # fewer rows are not worth a slice of their own


def slice_count(rows: int, wanted: int, slice_rows: int = SLICE_ROWS) -> int:
    """Slices for ``rows``: as many as their bound asks for, and up to ``wanted`` to keep the tasks busy."""
    return max(1, -(-rows // slice_rows), min(wanted, rows // LEAST_ROWS))


def sorted_slices(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """``df`` as a written table with ``_slice``; slices follow each other in ``order``, whose last column should
    tell rows apart. Rows are not sorted inside a slice. ``n`` fixes the number of slices."""
    table = cut_lineage(df.withColumn("_slice", F.lit(0)))  # a stored column, so joins on it stay joins
    n = n or slice_count(table.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n == 1:
        return table
    return cut_lineage(table.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null, so rows without a key stay together."""
    renamed = right.select(*[F.col(c).alias(f"_j_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(renamed[f"_j_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_j_{k}" for k in keys])


def slice_offsets(slices: DataFrame, keys: list[str], value: Column, out: str = "_off") -> DataFrame:
    """For each (slice, key) the sum of ``value`` over the key's earlier slices; a row per (slice, key)."""
    parts = slices.groupBy("_slice", *keys).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_slice", *keys, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias(out))


def ranked_rows(df: DataFrame, key: str, order: list[Column], out: str, start: int = 1, n: int | None = None) -> DataFrame:
    """Position of each row within its key in ``order``, from ``start``; a null key is one key.

    The rank inside a slice comes from a window over (slice, key), and a key's earlier slices add their counts:
    a row per slice at most has any, since the slices between a key's first and last are all its own."""
    slices = sorted_slices(df, [F.col(key), *order], n)
    ranked = slices.withColumn("_rn", F.row_number().over(Window.partitionBy("_slice", key).orderBy(*order)))
    offsets = slice_offsets(slices, [key], F.lit(1)).where("_off > 0")
    return (same_keys(ranked, offsets, ["_slice", key], "left")
            .withColumn(out, (F.coalesce("_off", F.lit(0)) + F.col("_rn") + F.lit(start - 1)).cast("long"))
            .drop("_slice", "_rn", "_off"))


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, inclusive: bool = True, n: int | None = None) -> DataFrame:
    """Sum of ``value`` over all rows up to each one in ``order``."""
    slices = sorted_slices(df, order, n)
    upto = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    inside = slices.withColumn("_in", F.coalesce(F.sum(value).over(upto), F.lit(0)))
    totals = slices.groupBy("_slice").agg(F.sum(value).alias("_part"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = totals.select("_slice", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_off"))
    return inside.join(offsets, "_slice").withColumn(out, F.col("_off") + F.col("_in")).drop("_slice", "_in", "_off")


def previous_value(df: DataFrame, key: str, order: list[Column], value: str, out: str, n: int | None = None) -> DataFrame:
    """``out`` is a struct: ``some`` says whether the key has an earlier row in ``order``, ``v`` is that row's value."""
    slices = sorted_slices(df, [F.col(key), *order], n)
    inside = Window.partitionBy("_slice", key).orderBy(*order)
    got = slices.withColumns({"_pv": F.lag(value).over(inside), "_inner": F.row_number().over(inside) > 1})
    last = slices.groupBy("_slice", key).agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    over = Window.partitionBy(key).orderBy("_slice")
    carried = last.select("_slice", key, F.lag("_last").over(over).alias("_cv"), (F.row_number().over(over) > 1).alias("_carried")).where("_carried")
    some = F.col("_inner") | F.coalesce("_carried", F.lit(False))
    return (same_keys(got, carried, ["_slice", key], "left")
            .withColumn(out, F.struct(some.alias("some"), F.when(F.col("_inner"), F.col("_pv")).otherwise(F.col("_cv")).alias("v")))
            .drop("_slice", "_pv", "_inner", "_cv", "_carried"))
