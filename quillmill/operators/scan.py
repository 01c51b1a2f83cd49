"""State machines over an ordered table, scanned across partitions.

A row is a function from the state before it to the state behind it.  Such functions can be
composed, so each partition reads its own rows alone, for every state it might begin in; one
row a partition, its composed function, tells the state in which the next one begins.  Sums
that depend on the states are run in the same pass, one for each state it might begin in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .storage import stored

#: States that a machine may have.
MOST_STATES = 64


def _composed(moves: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For each row the state before it, by the state before the first row; a row of ``fresh`` begins anew.

    The functions are composed by doubling: a step joins runs of twice the length.
    """
    n, states = moves.shape
    same = np.arange(states)
    done = moves.copy()  # behind the row, from the beginning of its run of 2**k rows
    # A fresh row leads from any state to where its own beginning does.
    done[fresh] = moves[fresh][:, :1]
    reach = 1
    while reach < n:
        done[reach:] = np.take_along_axis(done[reach:], done[:-reach].astype(np.int64), axis=1)
        reach *= 2
    before = np.vstack([same[None, :].astype(done.dtype), done[:-1]])
    before[fresh] = 0
    return before


def _running(weights: np.ndarray, fresh: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Inclusive running sums of each column; a row of ``fresh`` begins anew, others go on from ``carry``."""
    up_to = np.vstack([np.zeros_like(carry)[None, :], np.cumsum(weights, axis=0)])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1))
    return up_to[1:] - np.where(begin[:, None] >= 0, up_to[begin], -carry)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, width * (n + 1), width), pa.int32()), pa.array(values.ravel(), kind))


def _scanned(kept: list[int], key_at: list[int], moves_at: int, sums_at: list[int], states: int, names: list[str]):
    def run(batches):
        carry = np.arange(states)  # the state now, by that at the partition's begin
        totals = [np.zeros(states, np.int64) for _ in sums_at]
        last, open_ = None, True
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(i).to_pylist() for i in key_at), strict=True))
            moves = np.asarray(b.column(moves_at).flatten(), np.int8).reshape(-1, states)
            fresh = np.array([k != p for k, p in zip(keys, [keys[0] if last is None else last, *keys[:-1]], strict=True)])
            before = np.take_along_axis(_composed(moves, fresh), np.broadcast_to(carry, moves.shape), axis=1).astype(np.int64)
            # Rows of the partition's first key depend on what was before; all others begin at state 0.
            first = np.logical_not(np.logical_or.accumulate(fresh)) if open_ else np.zeros(len(fresh), bool)
            open_ = bool(first[-1])
            behind = np.take_along_axis(moves, before, axis=1)
            sums = []
            for k, at in enumerate(sums_at):
                weights = np.asarray(b.column(at).flatten(), np.int64).reshape(-1, states)
                sums.append(_running(np.take_along_axis(weights, before, axis=1), fresh, totals[k]))
                totals[k] = sums[-1][-1]
            carry = behind[-1].astype(np.int64)
            last = keys[-1]
            lists = [_lists(x, pa.int32()) for x in (before, behind)] + [_lists(x, pa.int64()) for x in sums]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *lists, pa.array(first)], names)

    return run


def scanned(
    rows: DataFrame, key: list[str], order: list[str], moves: str, states: int, name: str = "state", facts: Callable[[DataFrame], DataFrame] | None = None, sums: dict[str, str] | None = None
) -> DataFrame:
    """``name``: the state before each row, state 0 before the first row of each ``key``.

    ``moves`` is a column ``array<int>`` with the state behind the row for each of the
    ``states`` before it; ``order`` tells the rows of a key apart.  ``sums`` maps names of
    results to columns ``array<long>`` with what the row counts for in each state; the result
    is the sum over the key's rows up to and with this one.  These columns and ``moves`` are
    not returned, all others are.

    The table is range-partitioned by key and order and stored once, in column ``_part``;
    keys of any size are spread over partitions.  One row a partition reaches the driver.
    ``facts`` adds columns, ``moves`` among them, behind the exchange: what bounds the ranges
    is drawn from a pass of its own, which then does not make them.
    """
    if not 0 < states <= MOST_STATES:
        raise ValueError(f"a machine has 1 to {MOST_STATES} states")
    spark, sums = rows.sparkSession, sums or {}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(f"`{c}`") for c in [*key, *order]]
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = (facts(placed) if facts else placed).withColumn("_part", F.spark_partition_id())
    cols = placed.columns
    kept = [c for c in cols if c != moves and c not in sums.values()]
    run = {f"_sum_{i}": c for i, c in enumerate(sums)}
    states_of, counts = ArrayType(IntegerType()), ArrayType(LongType())
    made = [("_before", states_of), ("_behind", states_of), *((c, counts) for c in run), ("_first", BooleanType())]
    schema = StructType([StructField(c, kind, True) for c, kind in [*((c, placed.schema[c].dataType) for c in kept), *made]])
    scan = _scanned([cols.index(c) for c in kept], [cols.index(k) for k in key], cols.index(moves), [cols.index(c) for c in sums.values()], states, [f.name for f in schema.fields])
    local = stored(placed.mapInArrow(scan, schema), "scanned", compression="zstd")
    # The first and last key of each partition, and what its last row leads to.
    place, own = F.struct(*by), F.struct(*(F.col(f"`{k}`") for k in key))
    ends = local.groupBy("_part").agg(F.min_by(own, place).alias("a"), F.max_by(F.struct(own.alias("z"), "_behind", *run), place).alias("end"))
    entry, bases, out, last = 0, [0] * len(run), [], None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        if last != r.a:
            entry, bases = 0, [0] * len(run)
        out.append((r["_part"], entry, *bases))
        # Of several keys the last began at state 0, and its function says the same for all.
        bases = [(base if r.a == r.end.z else 0) + r.end[c][entry] for base, c in zip(bases, run, strict=True)]
        entry, last = r.end["_behind"][entry], r.end.z
    begins = spark.createDataFrame(out, ", ".join(["_part int, _entry int", *(f"_base{c} long" for c in run)]))
    met = local.join(F.broadcast(begins), "_part")
    at = F.when(F.col("_first"), F.col("_entry")).otherwise(0)
    counted = [(F.get(c, at) + F.when(F.col("_first"), F.col(f"_base{c}")).otherwise(0)).alias(wanted) for c, wanted in run.items()]
    return met.select(*(met[f"`{c}`"] for c in kept), F.get("_before", at).alias(name), *counted)
