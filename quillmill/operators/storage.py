"""Tables stored in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where nothing is set and all
    runs in one process (tests, a laptop) a temporary folder is taken instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_written: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with the writer's ``options``, and read it back: lineage ends here.

    Later passes read the same rows even when executors are lost, and expensive columns
    are not computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # The table ends the lineage, so the shuffle files behind it can go as soon as it is written.
    had = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, had)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them is stored itself."""
    for t in tables:
        path = getattr(t, "_stored_path", None)
        if path in _written:
            _written.remove(path)
            _delete(t.sparkSession, path)


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables that this process has stored so far; results that read them must be written first,
    and no query of the process may still run."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n
