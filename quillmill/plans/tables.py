"""Table access and small SQL builders shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_hash(seed: str, *keys: str) -> str:
    return "md5('" + seed + "' || " + " || ".join(f"':' || {k}" for k in keys) + ")"


def sql_draw(seed: str, *keys: str) -> str:
    return f"CAST(('0x' || substr({sql_hash(seed, *keys)}, 1, 8)) AS UBIGINT)"


def sql_uniform(seed: str, *keys: str) -> str:
    return f"({sql_draw(seed, *keys)} / 4294967296.0::DOUBLE)"


def sql_pick(seed: str, n: int | str, *keys: str) -> str:
    return f"CAST({sql_draw(seed, *keys)} % {n} AS INT)"
