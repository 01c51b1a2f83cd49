"""Sampling, splitting and mixing by hashes of keys: the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key_hash, uniform
from .ranking import ranked
from .selection import sample_least
from .storage import stored


def uniform_sample(rows: DataFrame, k: int, key: str, seed: str = "sample") -> DataFrame:
    """k rows without replacement: those of least hash, whatever k is."""
    return sample_least(rows, k, key, seed)


def stratified_reduction(rows: DataFrame, k: int, key: str, positive: Column, seed: str = "strata") -> DataFrame:
    """k rows, half of them (rounded up) positive; negatives fill up where positives lack, not the other way round.

    ``k`` is at least 6 and both strata must be there, else the job fails.
    """
    if k < 6:
        raise ValueError("a reduced set has at least 6 rows")
    marked = rows.withColumn("_pos", positive)
    have = {r["_pos"]: r["n"] for r in marked.groupBy("_pos").agg(F.count("*").alias("n")).collect()}
    if not have.get(True) or not have.get(False):
        raise ValueError("a stratum is empty")
    n_pos = min(have[True], -(-k // 2))
    pos, neg = sample_least(marked.where("_pos"), n_pos, key, seed), sample_least(marked.where("NOT _pos"), k - n_pos, key, seed)
    return pos.unionByName(neg).drop("_pos")


def sized(rows: DataFrame, within: list[str], order: str, name: str = "_n") -> DataFrame:
    """Ranks within groups, and the size of the group beside each row."""
    out = stored(ranked(rows, [order], within, "_rank"), "ranked")
    n = out.groupBy(*within).agg(F.count("*").alias(name)) if within else out.agg(F.count("*").alias(name))
    if not within:
        return out.withColumn(name, F.lit(n.first()[0]))
    on = [F.col(f"_w_{w}").eqNullSafe(F.col(w)) for w in within]
    return out.join(stored(n.select(*(F.col(w).alias(f"_w_{w}") for w in within), name), "sizes"), on).drop(*(f"_w_{w}" for w in within))


def few_shot_split(rows: DataFrame, task: str, key: str, n_tasks: int, least: int = 100, seed: str = "split") -> DataFrame:
    """Add ``split``: 60 % few-shot pool, about 10 % validation (a share of 300 rows), the rest training.

    A task of fewer than ``least`` rows stops the job.  Rounding is half to even.
    """
    r = sized(rows.withColumn("_h", F.concat(key_hash(seed, F.col(key)), F.lit(":"), F.col(key).cast("string"))), [task], "_h")
    n = F.when(F.col("_n") < least, F.raise_error(F.concat(F.lit("too few rows in task "), F.col(task)))).otherwise(F.col("_n"))
    pool = F.bround(n * 0.6).cast("long")
    val = F.least(F.bround(n * 0.1).cast("long"), F.greatest(F.lit(5), F.bround(F.lit(300) / n_tasks).cast("long")))
    split = F.when(F.col("_rank") < pool, "few_shot").when(F.col("_rank") < pool + val, "validation").otherwise("train")
    return r.withColumn("split", split).drop("_h", "_rank", "_n")


def counted_split(rows: DataFrame, key: str, seed: str = "counts") -> DataFrame:
    """Add ``split``: test a quarter (at most 2,000), validation 5 % (at most 1,000), train before both."""
    r = sized(rows.withColumn("_h", F.concat(key_hash(seed, F.col(key)), F.lit(":"), F.col(key).cast("string"))), [], "_h")
    test = F.least(F.lit(2000), F.bround(F.col("_n") * 0.25).cast("long"))
    val = F.least(F.lit(1000), F.bround(F.col("_n") * 0.05).cast("long"))
    train = F.col("_n") - test - val
    split = F.when(F.col("_rank") < train, "train").when(F.col("_rank") < train + val, "validation").otherwise("test")
    return r.withColumn("split", split).drop("_h", "_rank", "_n")


def stratified_split(rows: DataFrame, label: str, key: str, k: int, name: str = "picked", seed: str = "stratified") -> DataFrame:
    """Add a flag on k rows spread over the labels in proportion: largest remainders, then the label's order."""
    r = sized(rows.withColumn("_h", F.concat(key_hash(seed, F.col(key)), F.lit(":"), F.col(key).cast("string"))), [label], "_h")
    sizes = stored(rows.groupBy(label).agg(F.count("*").alias("_n")), "labels")  # one row a label
    total = sizes.agg(F.sum("_n")).first()[0] or 1
    share = F.col("_n") * min(k, total)
    base = sizes.select(label, F.floor(share / total).cast("long").alias("_q"), (share % total).alias("_r"))
    left = min(k, total) - (base.agg(F.sum("_q")).first()[0] or 0)
    extra = base.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_r"), label)))  # one row a label
    quota = extra.select(F.col(label).alias("_l"), (F.col("_q") + (F.col("_i") <= left).cast("long")).alias("_quota"))
    return r.join(quota, F.col(label).eqNullSafe(F.col("_l"))).withColumn(name, F.col("_rank") < F.col("_quota")).drop("_h", "_rank", "_n", "_l", "_quota")


def group_split(rows: DataFrame, group: str, share: float = 0.1, seed: str = "groups") -> DataFrame:
    """Add ``split`` by a draw for the group, so that its rows stay together; no shuffle."""
    return rows.withColumn("split", F.when(uniform(seed, F.col(group)) < share, "validation").otherwise("train"))


def dropped_with_chance(rows: DataFrame, condition: Column, chance: float, key: str, seed: str = "drop") -> DataFrame:
    """Rows of the condition kept only if their draw is above ``chance``."""
    return rows.where(~condition | (uniform(seed, F.col(key)) > chance))


def weighted_sample(rows: DataFrame, weight: Column, k: int, key: str, seed: str = "weighted") -> DataFrame:
    """k draws with replacement: ``draw, key``; a row's chance is its weight.

    Cumulative weights come from per-partition sums; a draw finds its row by an equi-join
    on a cell of the weight axis and then its range.  There are as many cells as draws (256
    at least, a row may lie in several), so a cell holds a draw or so and comparisons stay
    near the number of rows and draws.  Weights are counted in millionths.
    """
    from .ranking import spread, with_running

    spark = rows.sparkSession
    w = rows.select(key, F.round(weight * 1_000_000).cast("long").alias("_w")).where("_w > 0").withColumn("_h", key_hash(seed, F.col(key)))
    parts = spread(w, "_h", key)
    cum = with_running(parts, ["_h", key], {"_lo": "_w"})
    total = parts.agg(F.sum("_w")).first()[0] or 1
    cell = max(1, total // max(256, k))
    draws = spark.range(k).select(F.col("id").alias("draw"), F.floor(uniform(seed + "-draw", F.col("id")) * total).cast("long").alias("_x")).withColumn("_c", F.floor(F.col("_x") / cell))
    cells = cum.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor((F.col("_lo") + F.col("_w") - 1) / cell))))
    hit = (F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_lo") + F.col("_w"))
    return cells.join(draws, "_c").where(hit).select("draw", key)


def validation_then_test(rows: DataFrame, label: str, key: str, n_validation: int = 100, least_test: int = 500, share: float = 0.05, seed: str = "chain") -> DataFrame:
    """Add ``split``: a stratified validation set, then a stratified test set of the rest, then training rows.

    The test set takes ``share`` of what validation leaves (rounded half to even), at least
    ``least_test`` rows.
    """
    first = stored(stratified_split(rows, label, key, n_validation, "_val", seed + "-val"), "validation")
    rest = first.where("NOT _val").drop("_val")
    n_test = max(least_test, round(share * rest.count()))
    second = stratified_split(rest, label, key, n_test, "_test", seed + "-test")
    out = second.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")
    return first.where("_val").drop("_val").withColumn("split", F.lit("validation")).unionByName(out)


def half_mix(first: DataFrame, second: DataFrame, n: int, key: str, seed: str = "half") -> DataFrame:
    """``n`` rows, half of them (rounded up) from ``first`` and the rest from ``second``, by least hash; ``part`` says which."""
    one = uniform_sample(first, -(-n // 2), key, seed + "-first").withColumn("part", F.lit("first"))
    return one.unionByName(uniform_sample(second, n // 2, key, seed + "-second").withColumn("part", F.lit("second")))


def single_mix(rows: DataFrame, task: str, key: str, main: str, n: int, seed: str = "single") -> DataFrame:
    """``draw, key``: batches of one row; a row of ``main`` weighs so that it makes half of the draws, other tasks share the rest evenly."""
    sizes = stored(rows.groupBy(F.col(task).alias("_t")).agg(F.count("*").alias("_n")), "sizes")
    others = max(1, sizes.where(F.col("_t") != main).count())
    weight = F.when(F.col("_t") == main, F.lit(0.5) / F.col("_n")).otherwise(F.lit(0.5 / others) / F.col("_n"))
    weighed = rows.join(sizes, F.col(task) == F.col("_t")).withColumn("_weight", weight * 1000)
    return weighted_sample(weighed, F.col("_weight"), n, key, seed)


def batch_mix(rows: DataFrame, task: str, key: str, tasks: list[str], main: str, size: int, n_batches: int, seed: str = "mix") -> DataFrame:
    """``batch, slot, task, key``: half of each mini-batch from ``main``, the rest round robin over the other tasks.

    Slot numbers say which rank of a task each slot takes; ranks wrap around, so short
    tasks repeat.
    """
    spark = rows.sparkSession
    others = [t for t in tasks if t != main]
    half = size - size // 2 if others else size
    slots = spark.range(n_batches * size).select(F.floor(F.col("id") / size).cast("long").alias("batch"), (F.col("id") % size).cast("int").alias("slot"))
    turn = F.col("batch") * (size - half) + F.col("slot") - half
    which = F.get(F.array(*map(F.lit, others or [main])), F.pmod(turn, F.lit(max(1, len(others)))).cast("int"))
    slots = slots.withColumn("_t", F.when(F.col("slot") < half, F.lit(main)).otherwise(which))
    slots = slots.withColumn("_k", F.when(F.col("slot") < half, F.col("batch") * half + F.col("slot")).otherwise(F.floor(turn / max(1, len(others)))))
    r = sized(rows.select(F.col(task).alias("task"), key, F.concat(key_hash(seed, F.col(key)), F.lit(":"), F.col(key).cast("string")).alias("_h")), ["task"], "_h")
    n = r.groupBy("task").agg(F.count("*").alias("_size"))  # one row a task
    wanted = slots.join(n, F.col("_t") == F.col("task")).select("batch", "slot", "task", F.pmod("_k", "_size").alias("_rank"))
    return wanted.join(r.select("task", "_rank", key), ["task", "_rank"]).select("batch", "slot", "task", key)


def mixture(rows: DataFrame, key: str, shares: list[tuple[str, float]], rest: str, seed: str = "mixture") -> DataFrame:
    """Add ``part`` by thresholds on one draw: the shares in order, then the rest."""
    u, edge, out = uniform(seed, F.col(key)), 0.0, None
    for name, share in shares:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return rows.withColumn("part", F.lit(rest) if out is None else out.otherwise(rest))


def covering_split(rows: DataFrame, doc: str, classes: str, share: float = 0.15, tries: int = 20, seed: str = "cover") -> tuple[DataFrame, int]:
    """Split documents so that both sides hold every class: the first of ``tries`` seeds that does.

    All seeds are scored in one aggregation; one row a seed reaches the driver.  Fails if none covers.
    """
    pairs = rows.select(doc, F.explode(classes).alias("_c")).distinct()
    seeds = F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))
    side = pairs.withColumn("_s", seeds).withColumn("_v", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_s"), F.col(doc).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 < share)
    full = pairs.select("_c").distinct().count()
    per = side.groupBy("_s").agg(F.countDistinct(F.when(F.col("_v"), F.col("_c"))).alias("v"), F.countDistinct(F.when(~F.col("_v"), F.col("_c"))).alias("t"))
    good = [r["_s"] for r in per.where((F.col("v") == full) & (F.col("t") == full)).select("_s").collect()]
    if not good:
        raise ValueError("no split covers all classes on both sides")
    s = min(good)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(s), F.col(doc).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.withColumn("split", F.when(u < share, "validation").otherwise("train")), s
