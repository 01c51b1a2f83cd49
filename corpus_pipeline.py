"""From documents to packed sequences: quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import stored
from quillmill.llm.minhash import near_duplicates
from quillmill.llm.packing import best_fit_packing
from quillmill.llm.quality import quality_cascade
from quillmill.llm.suffix import remove_repeats

MAX_TOKENS = 1024


def _aside(docs: DataFrame, made: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns that an operator would replace under other names, and how to name them back."""
    renamed = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in made}
    return docs.withColumnsRenamed(renamed), {v: k for k, v in renamed.items()}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    Null and empty texts fail; repeated rows are judged one by one; an empty table stays
    empty; extra columns pass through, whatever their names.
    """
    mine, back = _aside(docs, {"kept", "rejected_by"})
    return quality_cascade(mine).where("kept").select(*mine.columns).withColumnsRenamed(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest id, null ids last.

    Rows are told apart by id and text, so repeated and null ids do no harm: of rows with
    one id the class keeps the one of the least text digest, and of equal rows one.  Texts
    without words are one class.
    """
    mine, back = _aside(docs, {"row_key", "turn_of_row", "class_id"})
    rows = mine.withColumn("row_key", F.struct(F.col("doc_id").isNull().alias("nil"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest")))
    classes = near_duplicates(rows, "row_key").select(F.col("class_id")).distinct()
    kept = rows.hint("shuffle_merge").join(classes.hint("shuffle_merge"), rows["row_key"] == F.col("class_id"), "left_semi")
    once = Window.partitionBy("row_key").orderBy("doc_id")
    return kept.withColumn("turn_of_row", F.row_number().over(once)).where("turn_of_row = 1").select(*mine.columns).withColumnsRenamed(back)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the passages that an earlier one has too; ``n_chars`` follows the text.

    Rows with one id don't cut each other, null ids come last, null texts become empty,
    rows stay rows, and extra columns pass through, whatever their names.
    """
    mine, back = _aside(docs, {"kept", "n_bytes", "n_removed", "n_spans"})
    cut = remove_repeats(mine).withColumn("text", F.col("kept"))
    if "n_chars" in mine.columns:
        cut = cut.withColumn("n_chars", F.length("kept").cast(mine.schema["n_chars"].dataType))
    return cut.select(*mine.columns).withColumnsRenamed(back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens.

    A null or empty text is its end token alone; repeated rows and null ids are pieces like
    any other; extra columns are left out.
    """
    packed = best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), MAX_TOKENS)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("packing", packing)]

#: Signatures, byte windows and token ids are beyond SQL: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
