"""Row validation in two regimes: rows that are skipped, and errors that stop the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIP = ("arity",)


def row_error(fields: Column, tag: str = "<LM>", end: str = "</s>") -> Column:
    """What is wrong with a raw (input, target) row; ``ok`` if nothing.

    A target that is the end mark alone counts as empty.
    """
    source, target = F.get(fields, F.lit(0)), F.get(fields, F.lit(1))
    return (
        F.when(F.size(fields) != 2, "arity")
        .when(~F.startswith(source, F.lit(tag)), "no_tag")
        .when(~F.endswith(target, F.lit(end)), "no_end")
        .when(F.trim(F.substr(source, F.lit(len(tag) + 1))) == "", "empty_input")
        .when(F.trim(F.substr(target, F.lit(1), F.length(target) - len(end))) == "", "empty_target")
        .otherwise("ok")
    )


def validated(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """Add ``error`` and ``severity`` (none, skip, fatal)."""
    out = rows.withColumn("error", row_error(F.col(fields)))
    return out.withColumn("severity", F.when(F.col("error") == "ok", "none").when(F.col("error").isin(*SKIP), "skip").otherwise("fatal"))


def accepted(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """(input, target) of good rows, line ends unified; a fatal row fails the job when it is read."""
    good = validated(rows, fields).where("severity <> 'skip'")
    stop = F.when(F.col("severity") == "fatal", F.raise_error(F.concat(F.lit("bad row: "), F.col("error")))).otherwise(F.lit(None))
    unix = lambda c: F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return good.withColumn("_stop", stop).where("_stop IS NULL").select(unix(F.get(fields, F.lit(0))).alias("input"), unix(F.get(fields, F.lit(1))).alias("target"))


def error_report(checked: DataFrame) -> DataFrame:
    return checked.groupBy("error", "severity").agg(F.count("*").alias("n"))


def raw_rows(spark: SparkSession) -> DataFrame:
    """A fixed set of good and bad rows."""
    rows = [
        (1, ["<LM>a", "b</s>"]),
        (2, ["a", "b</s>"]),
        (3, ["<LM>a", "b"]),
        (4, ["<LM>a"]),
        (5, ["<LM>a", "b</s>", "c"]),
        (6, ["<LM>", "b</s>"]),
        (7, ["<LM>a", "</s>"]),
        (8, ["<LM>q\r\nr", "b</s>"]),
    ]
    return spark.createDataFrame(rows, "line int, fields array<string>")


def same_tasks(left: DataFrame, right: DataFrame, column: str = "task") -> DataFrame:
    """Tasks that only one of two sets has: ``task, missing_in``; no rows if the sets are equal."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    only = lambda x, y, where: x.join(y, column, "left_anti").select(F.col(column).alias("task"), F.lit(where).alias("missing_in"))
    return only(a, b, "right").unionByName(only(b, a, "left"))


def unique_or_fail(rows: DataFrame, column: str) -> DataFrame:
    """The table, or an error naming a value that stands in several rows."""
    twice = rows.groupBy(column).agg(F.count("*").alias("n"))
    ok = twice.withColumn("_ok", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated: "), F.col(column).cast("string")))).otherwise(F.lit(True)))
    return rows.join(ok.where("_ok").select(column), column, "left_semi")
