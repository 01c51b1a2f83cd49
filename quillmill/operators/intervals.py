"""Joins and unions of half-open intervals, of any number in one group."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import spread, with_running
from .storage import stored

#: Bins are powers of this wide; an interval lies in one or two of the least that are as long as itself.
BASE, LEVELS = 8, 21


def _level(start: str, end: str) -> Column:
    """The number of the least bins that are as long as an interval."""
    length = F.col(end) - F.col(start)
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(length <= BASE**k, k).otherwise(level)
    return level.cast("int")


def stabbed(points: DataFrame, intervals: DataFrame, group: str, point: str, start: str, end: str, levels: Iterable[int] = range(LEVELS)) -> DataFrame:
    """Each point with the intervals of its group that hold it (``start <= point < end``), every pair once.

    An equi-join on bins: an interval is in the one or two bins of its level that it
    touches, a point looks in one bin of each level.  Only intervals of one bin, which are
    about as long as the bin is wide, are compared with a point.  The tables must not share
    column names but ``group``; empty intervals hold nothing.  ``levels`` are those that
    intervals may have, if they are known: points look in no others.
    """
    many = intervals.where(F.col(start) < F.col(end)).withColumn("_level", _level(start, end))
    wide = F.pow(F.lit(BASE), F.col("_level")).cast("long")
    many = many.withColumn("_a", (F.col(start) - F.pmod(F.col(start).cast("long"), wide))).withColumn("_z", F.col(end) - 1 - F.pmod(F.col(end).cast("long") - 1, wide))
    many = many.withColumn("_bin", F.explode(F.array_distinct(F.array("_a", "_z")))).drop("_a", "_z").withColumnRenamed(group, "_group")
    at = F.col(point).cast("long")
    asked = points.withColumn("_b", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), (at - F.pmod(at, F.lit(BASE**k))).alias("bin")) for k in levels))))
    on = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_b.level") == F.col("_level")) & (F.col("_b.bin") == F.col("_bin")) & (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    return asked.join(many, on).drop("_b", "_group", "_level", "_bin")


def overlaps(inner: DataFrame, outer: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """All pairs of one group that share a place, each once: inner columns, outer ones as ``outer_<name>``, ``relation``.

    The relation is ``inside`` (the inner one lies within the outer one), ``around`` (the
    other way round) or ``across`` (each has places of its own).  Either the outer one holds
    the inner one's start, or the inner one holds the outer one's start behind its own: two
    joins by :func:`stabbed`, without a pair in common.  Groups may be null and are then one
    group; empty intervals meet nothing.

    The inner ones are stored: groups without any are left out before the joins, and the
    outer ones' starts look only in bins of lengths that there are.
    """
    o = outer.select(F.col(group), *(F.col(c).alias(f"outer_{c}") for c in outer.columns if c != group))
    s, e = f"outer_{start}", f"outer_{end}"
    cols = [*inner.columns, *(c for c in o.columns if c != group)]
    full = stored(inner.where(F.col(start) < F.col(end)), "inner")
    held = full.select(F.col(group).alias("_held"))
    o = o.join(held, F.col(group).eqNullSafe(F.col("_held")), "left_semi")
    first = stabbed(full, o, group, start, s, e).select(*cols)
    behind = full.withColumn("_from", F.col(start) + 1)
    levels = [r[0] for r in behind.where(F.col("_from") < F.col(end)).select(_level("_from", end)).distinct().collect()]
    second = stabbed(o.where(F.col(s) < F.col(e)), behind.select(F.col(group), *(F.col(c) for c in behind.columns if c != group)), group, s, "_from", end, levels or [0]).select(*cols)
    within = (F.col(start) >= F.col(s)) & (F.col(end) <= F.col(e))
    holds = (F.col(start) <= F.col(s)) & (F.col(end) >= F.col(e))
    return first.unionByName(second).withColumn("relation", F.when(within, "inside").when(holds, "around").otherwise("across"))


def contained(inner: DataFrame, outer: DataFrame, key: str = "doc_id", number: str = "line", partial: str = "drop") -> DataFrame:
    """Inner spans inside an outer span of the same group, offsets from its start.

    ``partial`` says what becomes of an inner span that meets an outer one but is not inside
    it: ``drop``, ``raise`` (the job stops) or ``keep`` (it comes back, its offsets reaching
    beyond the outer span, with all others, and ``whole`` tells them apart).
    """
    if partial not in ("drop", "raise", "keep"):
        raise ValueError("partial is drop, raise or keep")
    o = outer.select(key, number, "start", "end")
    if partial == "drop":
        named = o.select(key, *(F.col(c).alias(f"outer_{c}") for c in (number, "start", "end")))
        met = stabbed(inner, named, key, "start", "outer_start", "outer_end").where("end <= outer_end")
    else:
        met = overlaps(inner, o, key)
    rel = [(F.col(c) - F.col("outer_start")).alias(f"rel_{c}") for c in ("start", "end")]
    cols = [*(F.col(c) for c in inner.columns), F.col(f"outer_{number}").alias("outer"), *rel]
    if partial == "keep":
        return met.select(*cols, (F.col("relation") == "inside").alias("whole"))
    if partial == "raise":
        say = F.concat_ws(" ", F.lit("a span crosses the bounds of another in"), F.col(key).cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
        met = met.where(F.when(F.col("relation") == "inside", True).otherwise(F.raise_error(say).cast("boolean")))
    return met.select(*cols)


def interval_union(spans: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping intervals merged, transitively; intervals that only touch stay apart.

    Where each island begins follows from the greatest end so far, found by partition and
    from one row a partition and group: a group of any size is spread over partitions.
    """
    order = [start, end]
    parts = spread(spans.select(group, start, end), group, *order)
    reached = with_running(parts, order, {}, [group], {"_reach": end})
    fresh = F.when(F.col(start) < F.col("_reach"), 0).otherwise(1).cast("long")
    islands = with_running(reached.withColumn("_fresh", fresh), order, {"_before": "_fresh"}, [group])
    return islands.groupBy(group, (F.col("_before") + F.col("_fresh")).alias("_g")).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")
