"""Ranks and running sums over whole tables without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def spread(df: DataFrame, *keys) -> DataFrame:
    """Range-partition by ``keys`` and store, with the partition in ``_part``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "spread")


def with_running(parts: DataFrame, order: list, sums: dict, within: list | None = None, maxima: dict | None = None) -> DataFrame:
    """Exclusive running sums, and maxima, over the whole table in ``order``, without a one-task window.

    ``parts`` comes from :func:`spread` on the same order (with ``within`` first).  Each
    partition adds up its own rows; only the per-partition totals (one row a partition, or
    one per partition and group with ``within``) pass through a single ordered window.
    ``sums`` maps result names to the columns that are summed, ``maxima`` those whose
    greatest value so far is wanted (null before the first).
    """
    within, maxima = within or [], maxima or {}
    totals = parts.groupBy("_part", *within).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_t_{n}") for n, c in maxima.items()))
    over = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    over = over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part", *within, *(F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.max(f"_t_{n}").over(over).alias(f"_b_{n}") for n in maxima)
    )
    local = Window.partitionBy("_part", *within).orderBy(*order)
    up_to, before = local.rowsBetween(Window.unboundedPreceding, Window.currentRow), local.rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.select("*", *((F.sum(c).over(up_to) - F.col(c)).alias(f"_l_{n}") for n, c in sums.items()), *(F.max(c).over(before).alias(f"_l_{n}") for n, c in maxima.items()))
    if within:
        keys = [inner["_part"] == bases["_part"]] + [inner[w].eqNullSafe(bases[w]) for w in within]
        joined = inner.join(bases, keys, "left")
    else:
        # One row for each partition: bounded by the number of partitions.
        joined = inner.join(F.broadcast(bases), inner["_part"] == bases["_part"], "left")
    return joined.select(*(inner[c] for c in parts.columns), *((F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums), *(F.greatest(f"_l_{n}", f"_b_{n}").alias(n) for n in maxima))


def ranked(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row in ``order``, over the table or within groups.

    Equivalent to ``row_number() - 1``, but a group of any size is spread over partitions.
    """
    within = within or []
    parts = spread(df.withColumn("_one", F.lit(1).cast("long")), *within, *order)
    return with_running(parts, order, {name: "_one"}, within).select(*df.columns, name)
