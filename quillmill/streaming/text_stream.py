"""Stateless text operators over streams, and bounded-state de-duplication.

The engine's text functions are column expressions, so they run unchanged on a stream.
What needs all rows (ranks, splits by count, classes) stays a batch operation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import collapse, script_share


def clean_stream(docs: DataFrame, alphabet: str = "[a-zA-Z]", text: str = "text") -> DataFrame:
    """Collapsed texts that are mostly of one alphabet."""
    n, own = script_share(F.col(text), alphabet)
    return docs.where((own > 0) & (2 * own >= n)).withColumn(text, collapse(F.col(text)))


def distinct_stream(docs: DataFrame, time: str, delay: str, text: str = "text") -> DataFrame:
    """Texts not seen before within the watermark; state is bounded by the delay."""
    return docs.withColumn("_h", F.sha2(text, 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def run_to_table(stream: DataFrame, name: str) -> StreamingQuery:
    """Process what is there and stop, into an in-memory table: for tests and small jobs."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
