"""Counts, length statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import group_quantiles
from .storage import stored


def task_counts(rows: DataFrame, split: str = "split", task: str = "task") -> DataFrame:
    """Rows for each task and split, for each split, and in all (nulls where summed up)."""
    return rows.rollup(split, task).agg(F.count("*").alias("n"))


def length_stats(rows: DataFrame, group: str, length: Column) -> DataFrame:
    """Shortest, longest, mean (half to even) and lower median of a length, exactly.

    Lengths are counted first, one row for each that a group has; all else, the median too,
    follows from the counts.
    """
    x = stored(rows.select(group, length.cast("long").alias("_x")).groupBy(group, "_x").agg(F.count("*").alias("_n")), "lengths")
    middle = group_quantiles(x, group, "_x", 0.5, "median", weight="_n")
    mean = F.bround(F.sum(F.col("_x") * F.col("_n")) / F.sum(F.when(F.col("_x").isNotNull(), F.col("_n")))).cast("long")
    g = x.groupBy(F.col(group).alias("_group")).agg(F.min("_x").alias("shortest"), F.max("_x").alias("longest"), mean.alias("mean"), F.sum("_n").alias("n"))
    return g.join(middle, F.col("_group").eqNullSafe(F.col(group)), "left").select(F.col("_group").alias(group), "shortest", "longest", "mean", "median", "n")


def histogram(rows: DataFrame, value: Column, least_bins: int) -> DataFrame:
    """Equal-width bins over the range of a whole number: ``bin, n, shortest, longest``.

    As many bins as a width of 20 gives, ``least_bins`` at least; the last bin is closed.
    If all values are equal there is one bin.
    """
    x = rows.select(value.cast("long").alias("_x"))
    lo, hi = x.agg(F.min("_x"), F.max("_x")).first()
    if lo is None or lo == hi:
        at = F.lit(0).cast("long")
    else:
        bins = max(least_bins, (hi - lo) // 20)
        # Whole-number division: a quotient of doubles may fall on the wrong side of an edge.
        at = F.least(F.expr(f"(_x - {lo}) * {bins} div {hi - lo}"), F.lit(bins - 1)).cast("long")
    return x.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("_x").alias("shortest"), F.max("_x").alias("longest"))
