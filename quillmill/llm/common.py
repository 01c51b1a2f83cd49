"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.ranking import spread, with_running
from ..operators.storage import discard, shared_dir, stored

__all__ = ["discard", "shared_dir", "spread", "stored", "table", "with_running"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
