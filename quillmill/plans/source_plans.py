"""Queries over readers and writers: small files written for the occasion, and tables written and read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK
from ..operators import spans
from ..operators.storage import shared_dir
from ..sources import readers, records, sinks
from .tables import sql_text, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """One file in whatever store the shared folder is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else sql_text(v).replace("\n", "' || chr(10) || '") if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _lines(spark: SparkSession, parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of several readers as ``reader, line``."""
    out = None
    for name, d in parts:
        one = d.select(F.lit(name).alias("reader"), F.array_join(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in d.columns)), "|").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def wiki_records(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as blocks of large files, read back by byte ranges: lines and text of each."""
    at = _folder(spark, "wiki")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    block = F.concat(F.lit('<doc id="'), F.col("doc_id"), F.lit('" title="No. '), F.col("doc_id"), F.lit('">\n'), F.col("text"), F.lit("\n</doc>"))
    docs.select(block.alias("value")).write.text(at)
    read = records.wiki_documents(spark, at)
    return read.select("title", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("text_md5"))


_RECORDS = rf"""
WITH b AS (SELECT doc_id, regexp_replace(text, {sql_text(LINE_BREAK)}, chr(10), 'g') AS t FROM documents)
SELECT 'No. ' || doc_id AS title, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS BIGINT) AS n_lines, md5(t) AS text_md5 FROM b"""


_INSTRUCTIONS = 'input,target\n"<LM>one, ""two""","a</s>"\n"<LM>line\nline",b</s>\nonly one\n'
_TRIPLES = "INSTRUCTION,RESPONSE,SOURCE\ndo this,done,s1\n,empty,s2\nlong long long long long long long long,done,s3\n"
_CHAT = [{"source": "s", "model_name": "m", "messages": [{"role": r, "content": c} for r, c in x]} for x in ([("user", "hi"), ("bot", "yo")], [("bot", "no"), ("user", "x")], [("user", "a"), ("bot", " ")], [("user", "odd")])]


def reader_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Delimited files: instruction rows, triples with a cap, fields, single columns."""
    at = _folder(spark, "tables")
    _put(spark, f"{at}/i.csv", _INSTRUCTIONS)
    _put(spark, f"{at}/t.csv", _TRIPLES)
    _put(spark, f"{at}/f.csv", "a,b,c\n1,,\n1,2,\n,,\n")
    _put(spark, f"{at}/c.tsv", "x\ty\n\tz\n w \tv\n")
    _put(spark, f"{at}/h.csv", "id,text,more\n7,seven,m\n")
    fields = readers.several_fields(spark, f"{at}/f.csv")
    prefix = readers.with_header_prefix(spark, f"{at}/h.csv", ["id", "text"])
    return _lines(spark, [
        ("instructions", readers.instructions(spark, f"{at}/i.csv")), ("loose", readers.instructions(spark, f"{at}/i.csv", strict=False).select("error", "severity")), ("triples", readers.triples(spark, f"{at}/t.csv")),
        ("capped", readers.triples(spark, f"{at}/t.csv", 10)), ("fields", fields), ("column", readers.text_column(spark, f"{at}/c.tsv", tab=True)), ("named", readers.text_column(spark, f"{at}/h.csv", header="text")), ("prefix", prefix),
    ])


TABLES = [
    ("instructions", '<LM>one, "two"|a</s>'), ("instructions", "<LM>line\nline|b</s>"), ("loose", "ok|none"), ("loose", "ok|none"), ("loose", "arity|skip"), ("triples", "do this|done|s1"), ("triples", "long long long long long long long long|done|s3"),
    ("capped", "do this|done|s1"), ("fields", "1|2|-"), ("column", "x"), ("column", "w"), ("named", "seven"), ("prefix", "7|seven|m"),
]


def reader_objects(spark: SparkSession, sf: str) -> DataFrame:
    """JSON files: dialogues, structured sets, questions with answers, articles; columnar splits."""
    at = _folder(spark, "objects")
    _put(spark, f"{at}/chat.jsonl", "\n".join(map(json.dumps, _CHAT)))
    _put(spark, f"{at}/set.json", json.dumps({"train": {"t": [["a", "b"]]}, "validation": {"t": [["c", "d"]]}, "text_corpus": ["x", "y"]}))
    qa = [{"text_markdown": "q1", "answer_count": 2, "answers": {"text_markdown": ["good", "bad"], "score": [3, -1]}}, {"text_markdown": "q2", "answer_count": 1, "answers": {"text_markdown": ["no"], "score": [0]}}]
    _put(spark, f"{at}/qa.jsonl", "\n".join(map(json.dumps, qa)))
    one = {"question_and_answer": [{"question": "p", "answer": "r"}], "question_and_many_answers": [{"question": "m", "answers": [{"answer": "u", "score": 2}, {"answer": "v", "score": 1}]}]}
    _put(spark, f"{at}/sets.json", json.dumps({"train": one, "validation": {"question_and_answer": [], "question_and_many_answers": []}}))
    _put(spark, f"{at}/art.json", json.dumps([{"title": "T", "document": [{"section_title": "S", "section_body": ["l1", "l2"]}]}]))
    for split in ("train", "test"):
        spark.createDataFrame([(split, 1)], "a string, b int").write.parquet(f"{at}/hub/{split}")
    chats = readers.chats(spark, f"{at}/chat.jsonl")
    samples, corpus = readers.structured(spark, f"{at}/set.json")
    many = readers.qa_sets(spark, f"{at}/sets.json").select("split", "question", F.to_json("answers").alias("answers"))
    split = readers.split_directories(lambda p: spark.read.parquet(p), f"{at}/hub", {"train": "train", "test": "test"})
    tagged = spark.createDataFrame([("<LM>in  put", "tar\nget</s>")], "input string, target string")
    return _lines(spark, [
        ("turns", readers.chat_turns(chats).select("turn", "role", "text")), ("samples", samples), ("corpus", corpus), ("programming", readers.programming_qa(spark, f"{at}/qa.jsonl").select("question", F.to_json("answers").alias("answers"))),
        ("sets", many), ("articles", readers.articles(spark, f"{at}/art.json").select("title", F.to_json("document").alias("document"))), ("hub", readers.hub_split(spark, f"{at}/hub", "test", "b,a")), ("splits", split.select("split", "a")),
        ("projection", readers.corpus_projection(tagged)),
    ])


OBJECTS = [
    ("turns", "0|user|hi"), ("turns", "1|bot|yo"), ("samples", "train|t|a|b"), ("samples", "validation|t|c|d"), ("corpus", "x"), ("corpus", "y"), ("programming", 'q1|[{"answer":"good","score":3}]'), ("sets", 'train|p|[{"answer":"r","score":1}]'),
    ("sets", 'train|m|[{"answer":"u","score":2},{"answer":"v","score":1}]'), ("articles", 'T|[{"section_title":"S","section_body":["l1","l2"]}]'), ("hub", "1|test"), ("splits", "train|train"), ("splits", "test|test"), ("projection", "in put"), ("projection", "tar get"),
]


def reader_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Text trees: plain texts, books, wiki documents, annotated texts of both kinds."""
    at = _folder(spark, "texts")
    for i in range(11):
        _put(spark, f"{at}/plain/sub/{i:02}.txt", f"text {i}\r\n")
    _put(spark, f"{at}/plain/top.txt", "not below")
    _put(spark, f"{at}/books/Book_12.TXT", "twelve")
    _put(spark, f"{at}/books/note.txt", "no book")
    _put(spark, f"{at}/wiki/AA/wiki_00", '<doc id="1" title="A  b">\nA b\n\nline\n</doc>\n<doc id="2" title="C">\nC\n</doc>\n')
    _put(spark, f"{at}/brat/d.txt", "Ann Lee met Bob")
    _put(spark, f"{at}/brat/d.ann", "T1\tPER 0 7\tAnn Lee\nT2\tPER 12 15\tBob\nR1\tsees Arg1:T1 Arg2:T2\tx\nbroken\n")
    _put(spark, f"{at}/tri/d.txt", "Ann Lee met\n")
    _put(spark, f"{at}/tri/d.spans", "1 name 0 3 0 1 # 7 Ann\n2 surname 4 3 1 1 # 8 Lee\n")
    _put(spark, f"{at}/tri/d.objects", "5 Person 1 2 # Ann Lee\n")
    name = F.element_at(F.split("path", "/"), -1)
    _, notes = readers.brat(spark, f"{at}/brat")
    _, found, objects = readers.span_tables(spark, f"{at}/tri")
    return _lines(spark, [
        ("plain", readers.plain_texts(spark, f"{at}/plain", most=100).select(name.alias("name"), F.trim(F.replace("text", F.lit("\n"), F.lit(""))).alias("text"))), ("books", readers.books(spark, f"{at}/books")),
        ("wiki", readers.wiki_lines(spark, f"{at}/wiki").select("title", "n", "line")), ("brat", notes), ("objects", spans.object_bounds(objects, found)),
    ])


TEXTS = [
    *(("plain", f"{i:02}.txt|text {i}") for i in range(11)), ("books", "book_12.txt|12|twelve"), ("wiki", "A b|1|A b"), ("wiki", "A b|2|"), ("wiki", "A b|3|line"), ("wiki", "C|6|C"),
    ("brat", "d|T1|PER|0|7"), ("brat", "d|T2|PER|12|15"), ("objects", "d|5|person|0|7"),
]


def sink_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as CSV, JSON lines and by parts, and samples by split and task, each read back whole."""
    at = _folder(spark, "sinks")
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    sinks.write_csv(d, f"{at}/csv")
    sinks.write_csv(d.limit(1), f"{at}/csv", mode="ignore")
    sinks.write_json_lines(d, f"{at}/json")
    sinks.write_parts(d, f"{at}/parts", "lang", [r.lang for r in d.select("lang").distinct().orderBy("lang").collect()])
    sinks.write_samples(d.select(F.lit("train").alias("split"), F.col("lang").alias("task"), F.col("text").alias("input"), F.col("doc_id").alias("target")), f"{at}/samples")
    csv = spark.read.options(header=True, quote='"', escape='"', multiLine=True).schema("doc_id bigint, text string, lang string").csv(f"{at}/csv")
    lines = spark.read.schema("doc_id bigint, text string, lang string").json(f"{at}/json")
    parts = spark.read.schema("doc_id bigint, text string, lang string").json(f"{at}/parts")
    back = spark.read.parquet(f"{at}/samples").select(F.col("target").cast("bigint").alias("doc_id"), F.col("input").alias("text"), F.col("task").alias("lang"))
    sums = lambda name, x: x.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "doc_id", F.md5("text")))), ",")).alias("digest")).withColumn("sink", F.lit(name))
    return sums("csv", csv).unionByName(sums("json", lines)).unionByName(sums("parts", parts)).unionByName(sums("samples", back))


SINK_TABLES = """
WITH d AS (SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, md5(string_agg(doc_id || ':' || md5(text), ',' ORDER BY doc_id || ':' || md5(text))) AS digest FROM documents GROUP BY lang)
SELECT d.*, sink FROM d, (VALUES ('csv'), ('json'), ('parts'), ('samples')) AS s(sink)"""


def sink_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files for other programs: a structured set, a report, spans by document, predictions, scores."""
    at = _folder(spark, "files")
    s = spark.createDataFrame([("train", "t", "a", "b"), ("validation", "t", "c", "é")], "split string, task string, input string, target string")
    whole = sinks.structured_json(s, spark.createDataFrame([("x",), ("x",)], "text string"))
    pretty = sinks.structured_json(s, spark.createDataFrame([("x",)], "text string"), pretty=True)
    scored = spark.createDataFrame([("t", "i", "p", "r", 0.5), ("t", "i", "q", "r", 1.0)], "task string, input string, predicted string, reference string, score double")
    sinks.write_spans_by_document(spark.createDataFrame([("d", "per", 5, 9), ("d", "loc", 0, 2)], "doc string, class string, start int, end int"), f"{at}/spans")
    sinks.write_lines(spark.createDataFrame([(2, "b  b"), (1, "a\na")], "id int, predicted string"), f"{at}/lines", "id")
    one = spark.read.text(f"{at}/lines", wholetext=True)
    per_doc = spark.read.text(f"{at}/spans/doc=d", wholetext=True)
    scores = sinks.with_scores(scored.select("task", "score"), doubled=F.col("score") * 2)
    return _lines(spark, [("structured", whole), ("pretty", pretty.select(F.size(F.split("json", "\n")).alias("n"), F.instr("json", "é").cast("boolean").alias("plain"))), ("report", sinks.score_report(scored)), ("spans", per_doc), ("lines", one), ("scores", scores)])


FILES = [
    ("structured", '{"train":{"t":[["a","b"]]},"validation":{"t":[["c","é"]]},"text_corpus":["x"]}'), ("pretty", "9|true"),
    ("report", 't|{"score":0.75,"rows":[{"INPUT":"i","PREDICTED":"q","TRUE":"r","SCORE":1.0},{"INPUT":"i","PREDICTED":"p","TRUE":"r","SCORE":0.5}]}'), ("spans", "loc 0 2\nper 5 4\n"), ("lines", "a a\nb b\n"), ("scores", "t|0.5|1.0"), ("scores", "t|1.0|2.0"),
]

_fixed = lambda rows: f"SELECT * FROM (VALUES {_values(rows)}) AS v(reader, line)"
QUERIES = {"wiki_records": wiki_records, "reader_tables": reader_tables, "reader_objects": reader_objects, "reader_texts": reader_texts, "sink_tables": sink_tables, "sink_files": sink_files}
ORACLES = {"wiki_records": _RECORDS, "reader_tables": _fixed(TABLES), "reader_objects": _fixed(OBJECTS), "reader_texts": _fixed(TEXTS), "sink_tables": SINK_TABLES, "sink_files": _fixed(FILES)}
