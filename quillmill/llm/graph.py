"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", steps: int | None = None) -> DataFrame:
    """``node, root`` for every node of the edges; ``root`` is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond", 2014): each step is one aggregation and one join, the number of
    steps grows with the logarithm of the size of a component, and every step is stored.
    Exact: the steps end when every component is a star around its smallest node.  With
    ``steps`` they end earlier; a root is then some node of the component, and nodes of one
    root are connected, but a component may have several.
    Self edges and repeated edges are allowed.
    """
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    done = 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least neighbours are stored, so that the joins are between plain exchanges and a hub's edges are split.
        low_of_all = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").hint("shuffle_merge").join(low_of_all.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = stored(large.where("u <> v").distinct(), "edges")
        # Every remaining edge points from the larger to the smaller node.
        low = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.hint("shuffle_merge").join(low.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, stored(low.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "edges")
        discard(before, low_of_all, down, low)
        done += 1
        if done == steps:
            first = now.groupBy("u").agg(F.min("v").alias("v"))
            ends = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            return first.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ends).groupBy("node").agg(F.min("root").alias("root"))
        # Done when all is stars: a node has one edge down, and what is at its end has none.
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("root")))
        open_ = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down > 1 OR (down = 1 AND root = 1)")
        if not open_.agg(F.count("*")).first()[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
