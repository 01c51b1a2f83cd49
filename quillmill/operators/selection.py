"""Exact selection without a global order: k-th least values and quantiles by refining histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key_hash
from .ranking import ranked
from .storage import stored

#: Bits that one round settles: a histogram has 2**STEP bins at most.
STEP = 16
#: Up to so many rows are one top-k of Spark's own; so few rows left in a bin are ordered as they are.
SMALL, FEW = 1000, 4096


def kth_range(rows: DataFrame, value: str, k: int, bits: int) -> tuple[int, int, int] | None:
    """(lo, hi, below): the k-th least of the whole numbers 0 to 2**bits - 1 is in lo to hi - 1, ``below`` are under lo.

    Each round counts the values by their next 16 bits, within the bin that holds the k-th
    one; only these counts reach the driver.  None if there are fewer than ``k`` rows.
    """
    lo, below, shift = 0, 0, bits
    while shift > 0:
        step = min(STEP, shift)
        inside = rows.where((F.col(value) >= lo) & (F.col(value) < lo + (1 << shift)))
        shift -= step
        counts = inside.groupBy(F.shiftright(F.col(value) - F.lit(lo).cast("long"), shift).alias("b")).count().collect()
        for b, n in sorted((r["b"], r["count"]) for r in counts):
            if below + n >= k:
                lo += b << shift
                break
            below += n
        else:
            return None
        if n <= FEW:
            break
    return lo, lo + (1 << shift), below


def least_hashed(rows: DataFrame, k: int, hashed: Column, key: str) -> DataFrame:
    """The k rows of least hash (hexadecimal digits), ties by key: no stage orders or collects all of them.

    A bound on the hash is found by counting; what is under it is taken where it lies, and
    only rows in the bin of the bound are ranked.
    """
    marked = rows.withColumn("_h", hashed)
    if k <= SMALL:
        return marked.orderBy("_h", key).limit(k).drop("_h")
    # Sixty bits of the hash: as many as a positive long holds of whole digits.
    marked = marked.withColumn("_v", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    found = kth_range(marked.select("_v"), "_v", k, 60)
    if found is None:
        return rows
    lo, hi, below = found
    edge = ranked(marked.where((F.col("_v") >= lo) & (F.col("_v") < hi)), ["_h", key], None, "_r").where(F.col("_r") < k - below)
    return marked.where(F.col("_v") < lo).drop("_h", "_v").unionByName(edge.drop("_h", "_v", "_r"))


def sample_least(rows: DataFrame, k: int, key: str, seed: str) -> DataFrame:
    return least_hashed(rows, k, key_hash(seed, F.col(key)), key)


def group_quantiles(rows: DataFrame, group: str, value: str, share: float, name: str = "quantile", bits: int = 32, weight: str | None = None) -> DataFrame:
    """``group, name``: the least value that ``share`` of a group's rows don't exceed, exactly.

    Values are whole numbers from -2**(bits-1) to 2**(bits-1) - 1; nulls don't count; a row
    counts as often as ``weight`` says, by default once.  A
    group is first counted by the upper half of its values' bits, then, in the bin that
    holds the quantile, by the lower half: no buffer or window grows with the distinct
    values of a group beyond 2**(bits/2).
    """
    half = bits // 2
    once = F.lit(1) if weight is None else F.col(weight)
    x = rows.select(F.col(group).alias("_g"), F.col(value).cast("long").alias("_x"), once.cast("long").alias("_w")).where("_x IS NOT NULL")
    upper = stored(x.groupBy("_g", F.shiftright("_x", half).alias("_u")).agg(F.sum("_w").alias("_n")), "upper")
    whole = Window.partitionBy("_g")
    so_far = whole.orderBy("_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = upper.select("_g", "_u", "_n", F.sum("_n").over(so_far).alias("_c"), F.ceil(F.sum("_n").over(whole) * F.lit(share)).alias("_k"))
    target = F.greatest("_k", F.lit(1))
    bin_ = placed.where((F.col("_c") >= target) & (F.col("_c") - F.col("_n") < target)).select(F.col("_g").alias("_bg"), F.col("_u").alias("_bu"), (target - F.col("_c") + F.col("_n")).alias("_left"))
    inside = x.join(bin_, F.col("_g").eqNullSafe(F.col("_bg")) & (F.shiftright("_x", half) == F.col("_bu")))
    lower = inside.groupBy("_g", "_x", "_left").agg(F.sum("_w").alias("_n"))
    run = Window.partitionBy("_g").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lower.withColumn("_c", F.sum("_n").over(run))
    return at.where((F.col("_c") >= F.col("_left")) & (F.col("_c") - F.col("_n") < F.col("_left"))).select(F.col("_g").alias(group), F.col("_x").alias(name))
