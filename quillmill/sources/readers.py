"""Readers: instruction tables, dialogues, structured sets, annotated documents, text trees.

All take a path or glob that Spark's own sources can open, and return a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import key_hash
from ..functions.text import ALNUM, LINE_BREAK, collapse, doc_title, tokens, word_count
from ..operators.validate import accepted, validated
from . import schemas

_CSV = {"quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}


def _csv(spark: SparkSession, path: str, header: bool = True, sep: str = ","):
    return spark.read.options(**_CSV, header=header, sep=sep)


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a CSV file, as strings, from its first line."""
    return _csv(spark, path, sep=sep).option("inferSchema", False).csv(path).columns


def instructions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``input, target`` rows with tags; rows of a wrong arity are skipped, other faults stop the job.

    Without ``strict`` all rows come back with ``error`` and ``severity``.
    """
    if csv_header(spark, path)[:2] != ["input", "target"]:
        raise ValueError("an instruction table begins with the columns input and target")
    rows = _csv(spark, path).option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).schema(schemas.INSTRUCTIONS + ", _bad STRING").csv(path)
    fields = rows.select(F.when(F.col("_bad").isNotNull(), F.array(F.lit(""))).otherwise(F.array(F.coalesce("input", F.lit("")), F.coalesce("target", F.lit("")))).alias("fields"))
    return accepted(fields) if strict else validated(fields)


def with_header_prefix(spark: SparkSession, path: str, first: list[str], sep: str = ",") -> DataFrame:
    """A table that must begin with certain columns; further ones are kept."""
    if csv_header(spark, path, sep)[: len(first)] != first:
        raise ValueError(f"the table must begin with {first}")
    return _csv(spark, path, sep=sep).option("inferSchema", False).csv(path)


def triples(spark: SparkSession, path: str, max_length: int | None = None, length=None) -> DataFrame:
    """``INSTRUCTION, RESPONSE, SOURCE`` without rows that lack a cell.

    With ``max_length`` rows whose instruction or response is longer than 0.7 of it (halves to
    even) are left out too; ``length`` counts the tokens of a column, by default its words.
    """
    d = with_header_prefix(spark, path, ["INSTRUCTION", "RESPONSE", "SOURCE"])
    d = d.where(" AND ".join(f"trim(coalesce({c}, '')) <> ''" for c in ("INSTRUCTION", "RESPONSE", "SOURCE")))
    if max_length is None:
        return d
    n, most = length or word_count, round(max_length * 0.7)
    return d.where((n(F.col("INSTRUCTION")) <= most) & (n(F.col("RESPONSE")) <= most))


def several_fields(spark: SparkSession, path: str) -> DataFrame:
    """Rows with more than one filled field."""
    d = _csv(spark, path).option("inferSchema", False).csv(path)
    filled = F.size(F.filter(F.array(*d.columns), lambda x: x.isNotNull()))
    return d.where(filled > 1)


def text_column(spark: SparkSession, path: str, tab: bool = False, header: str | None = None) -> DataFrame:
    """One column of a CSV or TSV, by name or (without a header) the first; blank cells dropped."""
    d = _csv(spark, path, header=header is not None, sep="\t" if tab else ",").option("inferSchema", False).csv(path)
    c = F.trim(F.col(header if header is not None else d.columns[0]))
    return d.select(c.alias("text")).where("text <> ''")


def chats(spark: SparkSession, path: str, user: str = "user", bot: str = "bot") -> DataFrame:
    """JSON lines of dialogues that alternate from a user on, none empty, an even number of turns.

    Lines without the required keys stop the job; other dialogues are left out.
    """
    d = spark.read.schema(schemas.CHAT).json(path)
    lacking = F.col("source").isNull() | F.col("model_name").isNull() | F.col("messages").isNull()
    m = F.when(lacking, F.raise_error(F.lit("a dialogue lacks a required key")).cast(f"ARRAY<{schemas.MESSAGE}>")).otherwise(F.col("messages"))
    d = d.withColumn("messages", m)
    good = F.forall(F.transform("messages", lambda x, i: (x["role"] == F.when(i % 2 == 0, user).otherwise(bot)) & (F.trim(x["content"]) != "")), lambda ok: F.coalesce(ok, F.lit(False)))
    return d.where((F.size("messages") >= 2) & (F.size("messages") % 2 == 0) & good)


def chat_turns(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Dialogues as ``conv_id, turn, role, text`` rows; the key is a hash of the dialogue."""
    d = chats.withColumn(key, F.xxhash64(F.to_json(F.struct("source", "model_name", "messages"))))
    return d.select(key, F.posexplode("messages").alias("turn", "m")).select(key, F.col("turn").cast("long"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def structured(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``split, task, input, target``; ``text``) of a structured set; both splits must hold the same tasks."""
    from ..operators.validate import same_tasks

    d = spark.read.option("multiLine", True).schema(schemas.STRUCTURED).json(path)
    fail = F.when(F.col("train").isNull() | F.col("validation").isNull() | F.col("text_corpus").isNull(), F.raise_error(F.lit("a structured set has train, validation and text_corpus")).cast("boolean")).otherwise(True)
    d = d.where(fail)

    def side(name: str) -> DataFrame:
        pairs = d.select(F.explode(name).alias("task", "_s")).select("task", F.explode("_s").alias("_p"))
        return pairs.select(F.lit(name).alias("split"), "task", F.get("_p", F.lit(0)).alias("input"), F.get("_p", F.lit(1)).alias("target"))

    samples = side("train").unionByName(side("validation"))
    odd = same_tasks(side("train"), side("validation")).first()
    if odd is not None:
        raise ValueError(f"only one split has the task {odd['task']}")
    return samples, d.select(F.explode("text_corpus").alias("text"))


def hub_split(spark: SparkSession, directory: str, split: str, columns: str | None = None) -> DataFrame:
    """One split of a columnar data set laid out as ``<directory>/<split>``."""
    d = spark.read.parquet(f"{directory}/{split}")
    return d.select(*columns.split(",")) if columns else d


def programming_qa(spark: SparkSession, path: str) -> DataFrame:
    """``question, answers`` with positive scores and text only; questions without any are left out."""
    d = spark.read.schema(schemas.PROGRAMMING_QA).json(path).where("answer_count > 0 AND trim(text_markdown) <> ''")
    a = F.transform(F.arrays_zip(F.col("answers.text_markdown").alias("answer"), F.col("answers.score").alias("score")), lambda x: F.struct(x["answer"].alias("answer"), x["score"].alias("score")))
    return d.select(F.col("text_markdown").alias("question"), F.filter(a, lambda x: (x["score"] > 0) & (F.trim(x["answer"]) != "")).alias("answers")).where(F.size("answers") > 0)


def qa_sets(spark: SparkSession, path: str) -> DataFrame:
    """``split, question, answers`` of both kinds of questions."""
    d = spark.read.option("multiLine", True).schema(schemas.QA_SETS).json(path)
    out = None
    for split in ("train", "validation"):
        one = d.select(F.inline(f"{split}.question_and_answer")).select(F.lit(split).alias("split"), "question", F.array(F.struct(F.col("answer"), F.lit(1).alias("score"))).alias("answers"))
        many = d.select(F.inline(f"{split}.question_and_many_answers")).select(F.lit(split).alias("split"), "question", "answers")
        both = one.unionByName(many)
        out = both if out is None else out.unionByName(both)
    return out


def articles(spark: SparkSession, path: str) -> DataFrame:
    """``title, document`` of JSON arrays of articles, read in byte ranges."""
    from .records import json_elements

    return json_elements(spark, path, schemas.ARTICLES).select("element.*")


def whole_texts(spark: SparkSession, directory: str, glob: str = "*.txt", below: int = 0) -> DataFrame:
    """``path, text`` of whole files, carriage returns removed; only files at least ``below`` folders down."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(directory, wholetext=True)
    d = d.select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\r"), F.lit("")).alias("text"))
    if below:
        base = directory.rstrip("/").rsplit("/", 1)[-1]
        depth = F.size(F.split(F.element_at(F.split("path", f"/\\Q{base}\\E/"), -1), "/")) - 1
        d = d.where(depth >= below)
    return d


def plain_texts(spark: SparkSession, directory: str, least: int = 10, most: int = 2000, seed: str = "texts") -> DataFrame:
    """``path, text`` of ``*.txt`` files in folders below a directory: those of least hash of their name, at most ``most``.

    Fewer than ``least`` files stop the job.
    """
    d = whole_texts(spark, directory, "*.txt", below=1)
    if d.select("path").limit(least).count() < least:
        raise ValueError(f"{directory} has fewer than {least} texts")
    name = F.element_at(F.split("path", "/"), -1)
    return d.withColumn("_h", key_hash(seed, name)).orderBy("_h", "path").limit(most).drop("_h")


def books(spark: SparkSession, directory: str) -> DataFrame:
    """``book_*.txt`` whatever the case, with their number; an empty file stops the job."""
    d = whole_texts(spark, directory, "*").withColumn("name", F.lower(F.element_at(F.split("path", "/"), -1))).where(r"name rlike '^book_.*\\.txt$'")
    text = F.when(F.trim("text") == "", F.raise_error(F.concat(F.lit("empty file "), F.col("name")))).otherwise(F.col("text"))
    return d.select("name", F.regexp_extract("name", r"book_(\d+)", 1).try_cast("int").alias("number"), text.alias("text"))


def wiki_lines(spark: SparkSession, directory: str, glob: str = "wiki_*") -> DataFrame:
    """``doc, title, n, line`` of all ``<doc ...>`` blocks in a tree of wiki files.

    Lines break at any of Unicode's line ends.  A document inside another, one that is not
    closed, or an end without a beginning stops the job.
    """
    files = whole_texts(spark, directory, glob)
    # A file is cut at its opening lines inside its row; lines are then made a document at a time, without a window.
    lines = F.split("text", LINE_BREAK)
    opening = lambda l: F.startswith(F.trim(l), F.lit("<doc "))
    closing = lambda l: F.trim(l) == "</doc>"
    cut = files.select("path", lines.alias("_l")).withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: opening(F.get("_l", i))))
    after = lambda i: F.coalesce(F.get("_at", i + 1), F.size("_l"))
    parts = F.transform("_at", lambda a, i: F.struct((i + 1).alias("o"), a.alias("a"), F.slice("_l", a + 1, after(i) - a).alias("l")))
    head = F.slice("_l", F.lit(1), F.coalesce(F.get("_at", F.lit(0)), F.size("_l")))
    stray = F.exists(head, closing)
    stop = lambda say: F.raise_error(F.concat(F.lit(say), F.col("path"))).cast("boolean")
    docs = cut.where(F.when(stray, stop("broken document in ")).otherwise(True)).select("path", F.explode(parts).alias("_d"))
    n_closed = F.size(F.filter("_d.l", closing))
    open_end = F.when(n_closed == 1, True).when(n_closed > 1, stop("broken document in ")).otherwise(stop("document not closed in "))
    docs = docs.where(open_end)
    end = F.array_position(F.transform("_d.l", closing), True).cast("int")
    inside = docs.select(F.concat_ws("#", "path", "_d.o").alias("doc"), doc_title(F.trim(F.get("_d.l", F.lit(0)))).alias("title"), (F.col("_d.a") + 1).alias("_from"), F.slice("_d.l", F.lit(2), F.greatest(end - 2, F.lit(0))).alias("_b"))
    return inside.select("doc", "title", "_from", F.posexplode("_b").alias("_i", "line")).select("doc", "title", (F.col("_from") + F.col("_i")).alias("n"), "line")


def brat(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, text``; ``doc_id, id, class, start, end``) of annotated texts side by side.

    Lines of other than three tab fields are left out; only text-bound annotations count.
    A repeated id, bounds beyond the text, or a surface that differs stops the job.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(txt|ann)$", "")
    texts = whole_texts(spark, directory, "*.txt").select(stem("path").alias("doc_id"), "text")
    notes = whole_texts(spark, directory, "*.ann").select(stem("path").alias("doc_id"), F.explode(F.split("text", "\n")).alias("line"))
    f = F.split("line", "\t")
    bounds = F.split(F.get(f, F.lit(1)), " ")
    e = notes.where((F.size(f) == 3) & F.get(f, F.lit(0)).rlike(r"^T\d+$") & (F.size(bounds) == 3))
    e = e.select("doc_id", F.get(f, F.lit(0)).alias("id"), F.get(bounds, F.lit(0)).alias("class"), F.get(bounds, F.lit(1)).cast("int").alias("start"), F.get(bounds, F.lit(2)).cast("int").alias("end"), F.get(f, F.lit(2)).alias("_surface"))
    j = e.join(texts, "doc_id").withColumn("_twice", F.count("*").over(Window.partitionBy("doc_id", "id")) > 1)
    seen = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    bad = F.col("_twice") | (F.col("start") < 0) | (F.col("end") > F.length("text")) | (seen != F.col("_surface"))
    ok = F.when(bad, F.raise_error(F.concat(F.lit("bad annotation "), F.col("doc_id"), F.lit(" "), F.col("id"))).cast("boolean")).otherwise(True)
    return texts, j.where(ok).select("doc_id", "id", "class", "start", "end")


def span_tables(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, spans, objects) of ``.txt/.spans/.objects`` triples, ready for ``object_bounds``.

    A span line has an id, type, start, length, first token, token count, ``#``, token ids
    and words.  One of too few fields, bad numbers, bounds beyond the text, or words that
    the text does not have there stops the job, and so does an id with two places.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(txt|spans|objects)$", "")
    texts = whole_texts(spark, directory, "*.txt").select(stem("path").alias("doc"), F.regexp_replace("text", r"\s+$", "").alias("text"))

    def lines(glob: str) -> DataFrame:
        d = whole_texts(spark, directory, glob).select(stem("path").alias("doc"), F.explode(F.split("text", "\n")).alias("line"))
        return d.select("doc", F.split(F.trim("line"), r"\s+").alias("f")).where(F.size("f") > 1)

    at = lambda i: F.get("f", F.lit(i))
    number = lambda i: at(i).try_cast("int")
    read = lines("*.spans").join(texts, "doc", "left").select("doc", "f", "text", number(0).alias("span_id"), at(1).alias("type"), number(2).alias("start"), number(3).alias("len"), number(5).alias("_n"))
    words = lambda c: F.array_distinct(F.filter(F.transform(tokens(c), F.lower), lambda t: t.rlike(ALNUM)))
    said = F.array_join(F.slice("f", F.col("_n") + 8, F.greatest(F.size("f") - F.col("_n") - 7, F.lit(0))), " ")
    there = F.substr("text", F.col("start") + 1, F.col("len"))
    numbers = (F.size("f") >= 9) & (F.col("span_id") >= 0) & (F.col("_n") >= 1) & (F.col("start") >= 0) & (F.col("len") > 0) & (F.size("f") > F.col("_n") + 7)
    fits = (F.col("start") + F.col("len") <= F.length("text")) & (F.trim(there) != "")
    same = F.size(F.array_except(words(said), words(there))) == 0
    stop = lambda say: F.raise_error(F.concat(F.lit(say), F.col("doc"), F.lit(": "), F.array_join("f", " "))).cast("boolean")
    good = F.when(~F.coalesce(numbers, F.lit(False)), stop("bad span in ")).when(~F.coalesce(fits, F.lit(False)), stop("span beyond its text in ")).when(~same, stop("other words in ")).otherwise(True)
    spans = read.where(good).select("doc", "span_id", "type", "start", "len").distinct()
    places = F.count("*").over(Window.partitionBy("doc", "span_id"))
    per_place = spans.select("doc", "span_id", "start", "len").distinct().withColumn("_places", places)
    one = per_place.where(F.when(F.col("_places") > 1, F.raise_error(F.concat(F.lit("two places of a span in "), F.col("doc"))).cast("boolean")).otherwise(True)).drop("_places")
    spans = spans.join(one, ["doc", "span_id", "start", "len"], "left_semi").dropDuplicates(["doc", "span_id"])
    objects = lines("*.objects").where(F.size("f") >= 5)
    cut = F.array_position("f", "#")
    ids = F.transform(F.slice("f", F.lit(3), F.when(cut > 0, cut - 3).otherwise(F.size("f") - 2).cast("int")), lambda x: x.cast("int"))
    return texts, spans, objects.select("doc", at(0).cast("int").alias("object_id"), at(1).alias("type"), ids.alias("span_ids"))


def split_directories(read, directory: str, names: dict[str, str] | None = None) -> DataFrame:
    """One reader over ``train``, ``dev`` and ``test`` folders, with the split beside each row."""
    out = None
    for folder, split in (names or {"train": "train", "dev": "validation", "test": "test"}).items():
        part = read(f"{directory}/{folder}").withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def corpus_projection(samples: DataFrame, target_only: Column | None = None, tag: str = "<LM>", end: str = "</s>") -> DataFrame:
    """Collapsed texts of inputs (without tag) and targets (without end mark); for some rows the target alone."""
    source = F.when(F.startswith("input", F.lit(tag)), F.substr("input", F.lit(len(tag) + 1))).otherwise(F.col("input"))
    target = F.when(F.endswith("target", F.lit(end)), F.substr("target", F.lit(1), F.length("target") - len(end))).otherwise(F.col("target"))
    both = F.array(collapse(source), collapse(target))
    picked = both if target_only is None else F.when(target_only, F.array(collapse(target))).otherwise(both)
    return samples.select(F.explode(picked).alias("text")).where("text <> ''")
