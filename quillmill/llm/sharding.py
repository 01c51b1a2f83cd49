"""Contiguous balanced shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, with_running


def shard_by_bytes(sized: DataFrame, n_shards: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """Cut a table, in ``key`` order, into ``n_shards`` contiguous shards of near equal bytes.

    Adds ``shard`` (0 to n_shards - 1) and ``slot`` (the place in the shard, gapless from
    0).  The table is range-partitioned by key; each partition sums its own sizes, the
    totals of the partitions are added up, and a row goes to the shard in which the middle
    of its bytes falls.  A shard is off the target by at most one row at either end; a row
    larger than the target leaves neighbours empty.

    Keep large columns out: join them back by key.  A null size counts as 0, null keys come
    first, equal keys are ordered by size and the remaining columns, repeated rows stay,
    an empty table gives no rows.  A column named ``shard`` or ``slot`` is replaced; any
    other name is free for extra columns.
    """
    own = [c for c in sized.columns if c.lower() not in ("shard", "slot")]
    # Under private names, so that no column of the table meets one that is made here.
    private = {c: f"c{i}" for i, c in enumerate(own)}
    rows = sized.select(*(F.col(f"`{c}`").alias(p) for c, p in private.items()))
    bytes_ = private[size]
    order = [private[key], bytes_, *(p for c, p in private.items() if c not in (key, size))]
    rows = rows.withColumn(bytes_, F.coalesce(F.col(bytes_), F.lit(0)).cast("long")).withColumn("one", F.lit(1).cast("long"))
    parts = spread(rows, *order)
    placed = with_running(parts, order, {"before": bytes_, "row": "one"})
    total = parts.agg(F.sum(bytes_)).first()[0] or 1
    middle = (F.col("before") + F.floor(F.col(bytes_) / 2)).cast("decimal(38,0)")
    # Exact integers: the product of bytes and shards passes 64 bits on large inputs.
    at = F.floor(middle * n_shards / F.lit(total).cast("decimal(38,0)")).cast("int")
    cut = placed.withColumn("shard", F.least(at, F.lit(n_shards - 1)))
    first = cut.groupBy("shard").agg(F.min("row").alias("first"))  # at most n_shards rows
    return cut.join(F.broadcast(first), "shard").select(*(F.col(p).alias(c) for c, p in private.items()), "shard", (F.col("row") - F.col("first")).alias("slot"))
