"""Writers: CSV, JSON lines, structured sets, reports, per-document text files, ordered files in fragments."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error") -> None:
    """CSV with a header, minimal quotes doubled inside, empty texts kept apart from nulls.

    ``mode='ignore'`` leaves an existing result alone, so that a job can be resumed.
    """
    rows.select(*(columns or rows.columns)).write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_json_lines(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def write_samples(samples: DataFrame, path: str, mode: str = "error") -> None:
    """The native form of a structured set: Parquet by split and task, read back by partition."""
    samples.write.mode(mode).partitionBy("split", "task").parquet(path)


def structured_json(samples: DataFrame, corpus: DataFrame, pretty: bool = False) -> DataFrame:
    """One row ``json``: the structured set as a single object, for programs that expect the file.

    The object holds the whole set, so this is for sets that such a program can load.  With
    ``pretty`` it is indented; characters beyond ASCII stay as they are.
    """
    per_task = samples.groupBy("split", "task").agg(F.array_sort(F.collect_list(F.array("input", "target"))).alias("_s"))
    per_split = per_task.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "_s")))).alias("_m"))
    sides = per_split.agg(*(F.first(F.when(F.col("split") == s, F.col("_m")), ignorenulls=True).alias(s) for s in ("train", "validation")))
    texts = corpus.select("text").distinct().agg(F.array_sort(F.collect_list("text")).alias("text_corpus"))
    one = sides.withColumn("_k", F.lit(1)).join(texts.withColumn("_k", F.lit(1)), "_k")
    options = {"pretty": "true"} if pretty else {}
    return one.select(F.to_json(F.struct("train", "validation", "text_corpus"), options).alias("json"))


def fragments(spark: SparkSession, path: str) -> list[dict]:
    """Name, first byte and length of each file that ``write_fragments`` has written, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = {s.getPath().getName(): s.getLen() for s in folder.getFileSystem(conf).listStatus(folder) if s.getPath().getName().startswith("part-")}
    out, at = [], 0
    for name in sorted(found):
        out.append({"name": name, "start": at, "length": found[name]})
        at += found[name]
    return out


def write_fragments(lines: DataFrame, path: str, order: list[str], value: str = "value", join: bool = True) -> str | None:
    """One ordered text in fragments: the files of the folder, by name, one behind the other, are the text.

    Range partitions write the fragments, so no task holds or writes all lines, and none
    passes through the driver.  With ``join``, a store that can concatenate files makes one
    of them and its path is returned; else ``_manifest.json`` beside the fragments says
    where in the text each begins.
    """
    spark = lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in order]
    lines.repartitionByRange(n, *by).sortWithinPartitions(*by).select(value).write.text(path)
    parts = fragments(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at("x").getFileSystem(conf)
    files = [p["name"] for p in parts if p["length"]]
    if join and files and fs.hasPathCapability(at(files[0]), "fs.capability.paths.concat"):
        others = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(files) - 1)
        for i, name in enumerate(files[1:]):
            others[i] = at(name)
        if len(files) > 1:
            fs.concat(at(files[0]), others)
        return f"{path}/{files[0]}"
    out = fs.create(at("_manifest.json"), True)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    return None


def write_structured(samples: DataFrame, corpus: DataFrame, path: str) -> str | None:
    """A structured set as one JSON object in fragments, however large: the object that ``structured_json`` has in a row.

    Samples stand by split, task, input and target, texts of the corpus behind them; equal
    ones count once.  What opens a split, a task or the corpus stands before its first row.
    """
    rows = samples.select(F.when(F.col("split") == "train", 0).otherwise(1).alias("part"), "task", "input", "target").distinct()
    texts = corpus.select(F.lit(2).alias("part"), F.lit("").alias("task"), F.col("text").alias("input"), F.lit("").alias("target")).distinct()
    every = rows.unionByName(texts)
    # One row a split and task: where each begins, and which of them opens its split.
    first = every.groupBy("part", "task").agg(F.min(F.struct("input", "target")).alias("_first"))
    opening = first.groupBy(F.col("part").alias("_p")).agg(F.min("task").alias("_opens"))
    starts = first.join(opening, F.col("part") == F.col("_p")).select("part", "task", F.col("_first.input").alias("_i"), F.col("_first.target").alias("_t"), (F.col("task") == F.col("_opens")).alias("_opens"))
    have = {r.part for r in first.select("part").distinct().collect()}
    if not {0, 1} <= have:
        raise ValueError("a structured set has training and validation samples")
    met = every.join(starts, ["part", "task"])
    begins = (F.col("input") == F.col("_i")) & (F.col("target") == F.col("_t"))
    named = F.concat(F.get(F.split(F.to_json(F.array("task")), r"^\[|\]$"), F.lit(1)), F.lit(": ["))
    split = F.when(F.col("part") == 0, '{"train": {').otherwise(']}, "validation": {')
    lead = F.when(F.col("part") == 2, F.when(begins, ']}, "text_corpus": [').otherwise(", "))
    lead = lead.otherwise(F.when(~begins, ", ").when(F.col("_opens"), F.concat(split, named)).otherwise(F.concat(F.lit("], "), named)))
    text = F.to_json(F.array("input"))
    body = F.when(F.col("part") == 2, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(F.to_json(F.array("input", "target")))
    tail = samples.sparkSession.range(1).select(F.lit(3).alias("part"), *(F.lit("").alias(c) for c in ("task", "input", "target")), F.lit("]}" if 2 in have else ']}, "text_corpus": []}').alias("value"))
    return write_fragments(met.select("part", "task", "input", "target", F.concat(lead, body).alias("value")).unionByName(tail), path, ["part", "task", "input", "target"])


def score_report(scored: DataFrame, task: str = "task") -> DataFrame:
    """``task, json``: the mean score and the rows of a task, best first."""
    row = F.struct((-F.col("score")).alias("_o"), F.struct(F.col("input").alias("INPUT"), F.col("predicted").alias("PREDICTED"), F.col("reference").alias("TRUE"), F.col("score").alias("SCORE")).alias("r"))
    g = scored.groupBy(task).agg(F.avg("score").alias("score"), F.array_sort(F.collect_list(row)).alias("_r"))
    return g.select(task, F.to_json(F.struct("score", F.transform("_r", lambda x: x["r"]).alias("rows"))).alias("json"))


def write_spans_by_document(spans: DataFrame, path: str, key: str = "doc", mode: str = "error") -> None:
    """``type start length`` lines, one folder a document, in order of start, length, type."""
    line = F.concat_ws(" ", "class", "start", F.col("end") - F.col("start"))
    ordered = spans.select(key, line.alias("value"), "start", (F.col("end") - F.col("start")).alias("_n"), "class")
    ordered.repartition(key).sortWithinPartitions(key, "start", "_n", "class").select(key, "value").write.mode(mode).partitionBy(key).text(path)


def write_lines(predictions: DataFrame, path: str, order: str, text: str = "predicted", mode: str = "error", one_file: bool = True) -> None:
    """One collapsed prediction a line, in order.

    Programs that score predictions expect one file.  Without ``one_file`` there are as many
    as range partitions, named in order, for sets that no single task should write.
    """
    from ..functions.text import collapse

    in_order = predictions.repartition(1).sortWithinPartitions(order) if one_file else predictions.repartitionByRange(order).sortWithinPartitions(order)
    in_order.select(collapse(F.col(text)).alias("value")).write.mode(mode).text(path)


def write_parts(rows: DataFrame, path: str, part: str, parts: list[str]) -> list[str]:
    """Write a table part by part, each as JSON lines in a folder of its own, and name those written now.

    A part whose folder is complete is left alone, so a job that was stopped goes on where
    it was.
    """
    jvm, done = rows.sparkSession.sparkContext._jvm, []
    conf = rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for p in parts:
        target = f"{path}/{part}={p}"
        mark = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not mark.getFileSystem(conf).exists(mark):
            rows.where(F.col(part) == p).drop(part).write.mode("overwrite").json(target)
            done.append(p)
    return done


def with_scores(rows: DataFrame, **scores) -> DataFrame:
    """Score columns appended to a table, under the given names."""
    return rows.withColumns(scores)
