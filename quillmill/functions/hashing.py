"""Deterministic draws: hashes of stable keys stand in for random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed: str, *keys: Column) -> Column:
    """md5 of ``seed:key``; a sort key that no partitioning changes."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in keys)))


def uniform(seed: str, *keys: Column) -> Column:
    """A draw in [0, 1) from the first 32 bits."""
    return F.conv(F.substring(key_hash(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def pick(seed: str, n: int | Column, *keys: Column) -> Column:
    """A draw from 0 to n - 1."""
    return (F.conv(F.substring(key_hash(seed, *keys), 1, 8), 16, 10).cast("long") % n).cast("int")
