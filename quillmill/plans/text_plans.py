"""Queries over texts: tokens, cleaning, classification, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog, text
from ..functions.hashing import pick
from ..operators import tasks
from ..operators.validate import error_report, raw_rows, validated
from .tables import sql_pick, sql_text, table

_TOKEN = sql_text(text.TOKEN)
_WS = sql_text(text.WS)
#: Phrases whose presence marks an answer as a refusal, padded by blanks.
REFUSALS = (" as a language model ", " cannot help ", " not able to ", " of that ", " que la ", " in der ")


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.word_count(F.col("text")).alias("n_words"), text.token_count(F.col("text")).alias("n_tokens"))


TOKENIZE = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {_TOKEN}) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(list_sum(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+') THEN 1 ELSE length(x) END)) AS BIGINT) AS n_tokens
FROM t"""


def whitespace_collapse(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", text.collapse(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


COLLAPSE = f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, {_WS}, ' ', 'g')) AS t FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM t"""


def script_share_filter(spark: SparkSession, sf: str) -> DataFrame:
    n, own = text.script_share(F.col("text"), "[a-zA-Z]")
    d = table(spark, sf, "documents").select("doc_id", n.alias("n_tokens"), own.alias("n_script"))
    return d.where((F.col("n_script") > 0) & (2 * F.col("n_script") >= F.col("n_tokens")))


SCRIPT = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {_TOKEN}) AS w FROM documents),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_filter(w, lambda x: regexp_full_match(x, '[a-zA-Z]+'))) AS BIGINT) AS n_script FROM t)
SELECT * FROM c WHERE n_script > 0 AND 2 * n_script >= n_tokens"""


def has_script_letters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.has_lower_letters(F.col("text"), "[a-z]").alias("ok"))


HAS_LETTERS = f"""
WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, {_TOKEN}), lambda x: regexp_full_match(x, '\\p{{L}}+')) AS w FROM conversations)
SELECT conv_id, turn, len(w) = 0 OR len(list_filter(w, lambda x: regexp_matches(x, '[a-z]'))) > 0 AS ok FROM t"""


def refusal_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return tasks.without_refusals(c, "text", REFUSALS, {"é": "e"}).select("conv_id", "turn")


REFUSAL = f"""
WITH t AS (SELECT conv_id, turn, replace(' ' || array_to_string(regexp_extract_all(trim(text), {_TOKEN}), ' ') || ' ', 'é', 'e') AS n
  FROM conversations WHERE role = 'assistant' AND trim(text) <> '')
SELECT conv_id, turn FROM t WHERE NOT ({' OR '.join(f"contains(n, '{p}')" for p in REFUSALS)})"""

_N = len(catalog.CATALOGUE)


def _prompted(spark: SparkSession, sf: str) -> DataFrame:
    """User turns behind a catalogue prompt; some without any, some with the prompt out of place."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    k = pick("prompt", _N + 4, F.col("conv_id"), F.col("turn"))
    prompts = F.array(*(F.lit(p.prompt) for p in catalog.CATALOGUE))
    body = F.when(k < _N, F.concat(F.get(prompts, k), F.lit(" - - "), F.col("text"))).when(k == _N, F.concat(F.lit("Please: "), F.lit(catalog.CATALOGUE[0].prompt))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.concat(F.lit("<LM>"), body).alias("input"))


_PROMPTS = ", ".join(f"({i}, {p.task_idx}, '{p.prompt}')" for i, p in enumerate(catalog.CATALOGUE))
_PROMPTED = f"""
cat AS (SELECT * FROM (VALUES {_PROMPTS}) AS v(ord, task_idx, prompt)),
u AS (SELECT conv_id, turn, text, {sql_pick('prompt', _N + 4, 'conv_id', 'turn')} AS k FROM conversations WHERE role = 'user'),
inp AS (SELECT conv_id, turn, CASE WHEN k < {_N} THEN prompt || ' - - ' || text WHEN k = {_N} THEN 'Please: {catalog.CATALOGUE[0].prompt}' ELSE text END AS body
  FROM u LEFT JOIN cat ON cat.ord = u.k),
hit AS (SELECT conv_id, turn, body, cat.task_idx, cat.prompt, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) AS rn
  FROM inp LEFT JOIN cat ON contains(body, cat.prompt)),
one AS (SELECT conv_id, turn, body, coalesce(prompt, '') AS prompt,
  CASE WHEN task_idx IS NULL THEN -1 WHEN starts_with(body, prompt) THEN task_idx ELSE -2 END AS task_idx FROM hit WHERE rn = 1)"""


def prompt_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _prompted(spark, sf).select("conv_id", "turn", catalog.matched(F.col("input"))["task_idx"].alias("task_idx"))


CLASSIFY = f"WITH {_PROMPTED} SELECT conv_id, turn, CAST(task_idx AS INT) AS task_idx FROM one"


def prompt_strip_context(spark: SparkSession, sf: str) -> DataFrame:
    p = _prompted(spark, sf).withColumn("m", catalog.matched(F.col("input"))).where("m.task_idx >= 0")
    canonical = F.array(*(F.lit(catalog.CANONICAL[i]) for i in sorted(catalog.CANONICAL)))
    again = F.concat(F.lit("<LM>"), F.get(canonical, F.col("m.task_idx")), F.lit(" "), catalog.context(F.col("input")))
    return p.select("conv_id", "turn", again.alias("input"))


_CANON = ", ".join(f"({i}, '{p}')" for i, p in catalog.CANONICAL.items())
STRIP_CONTEXT = f"""WITH {_PROMPTED}, canon AS (SELECT * FROM (VALUES {_CANON}) AS v(task_idx, canonical))
SELECT conv_id, turn, '<LM>' || canonical || ' ' || regexp_replace(regexp_replace(substr(body, length(prompt) + 1), '^[\\s-]+', ''), '\\s+$', '') AS input
FROM one JOIN canon USING (task_idx)"""


def row_validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return error_report(validated(raw_rows(spark)))


_RAW = """raw AS (SELECT * FROM (VALUES (1, ['<LM>a', 'b</s>']), (2, ['a', 'b</s>']), (3, ['<LM>a', 'b']), (4, ['<LM>a']), (5, ['<LM>a', 'b</s>', 'c']),
  (6, ['<LM>', 'b</s>']), (7, ['<LM>a', '</s>']), (8, ['<LM>q' || chr(13) || chr(10) || 'r', 'b</s>'])) AS v(line, fields))"""
VALIDATION = f"""
WITH {_RAW}, e AS (SELECT line, CASE WHEN len(fields) <> 2 THEN 'arity' WHEN NOT starts_with(fields[1], '<LM>') THEN 'no_tag' WHEN NOT ends_with(fields[2], '</s>') THEN 'no_end'
  WHEN trim(substr(fields[1], 5)) = '' THEN 'empty_input' WHEN trim(left(fields[2], -4)) = '' THEN 'empty_target' ELSE 'ok' END AS error FROM raw)
SELECT error, CASE WHEN error = 'ok' THEN 'none' WHEN error = 'arity' THEN 'skip' ELSE 'fatal' END AS severity, count(*) AS n FROM e GROUP BY ALL"""


def eos_strip(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    ended = F.concat(F.lit("  "), F.col("text"), F.lit(" </s></s> \n"))
    return d.select("doc_id", F.md5(text.strip_eos(ended)).alias("text_md5"), F.length(text.ensure_tags(text.strip_eos(ended), "<LM>", "</s>")).cast("long").alias("n_tagged"))


EOS = """
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace('  ' || text || ' </s></s> ' || chr(10), '^\\s+', ''), '(\\s*</s>)*\\s*$', '') AS t FROM documents)
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) + 8 AS BIGINT) AS n_tagged FROM t"""


def text_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct collapsed texts of documents and dialogues, with the longest length beside each."""
    every = table(spark, sf, "documents").select("text").unionByName(table(spark, sf, "conversations").select("text"))
    d = every.select(text.collapse(F.col("text")).alias("text")).where("text <> ''").distinct()
    return d.select("text", F.length("text").cast("long").alias("n_chars"))


CORPUS = f"""
SELECT DISTINCT t AS text, CAST(length(t) AS BIGINT) AS n_chars FROM (
  SELECT trim(regexp_replace(text, {_WS}, ' ', 'g')) AS t FROM documents UNION ALL SELECT trim(regexp_replace(text, {_WS}, ' ', 'g')) FROM conversations) WHERE t <> ''"""

def wiki_links(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with words turned into links, plain, renamed and nested, as their shown text."""
    linked = F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z]+) ([a-z]+) (of|de|und|la) ", "[[$1|$2]] [[$3]] [[never closed ")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("see [[out|[[in|"), F.left("text", F.lit(20)), F.lit("]]]] and [[a|b|c]] [[]] "), linked).alias("s"))
    return d.select("doc_id", F.md5(text.remove_links(F.col("s"))).alias("clean_md5"))


def _sql_links() -> str:
    link = sql_text(text.WIKILINK)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, 'see [[out|[[in|' || left(text, 20) || ']]]] and [[a|b|c]] [[]] ' || regexp_replace(coalesce(text, ''), '([a-z]+) ([a-z]+) (of|de|und|la) ', '[[\\1|\\2]] [[\\3]] [[never closed ', 'g') AS s FROM documents),
r AS (
  SELECT doc_id, trim(regexp_replace(s, {_WS}, ' ', 'g')) AS s, 0 AS i FROM d
  UNION ALL SELECT doc_id, trim(regexp_replace(regexp_replace(s, {link}, '\\1', 'g'), {_WS}, ' ', 'g')), i + 1 FROM r WHERE regexp_matches(s, {link}))
SELECT doc_id, md5(arg_max(s, i)) AS clean_md5 FROM r GROUP BY doc_id"""


def scalar_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-line collapsing, choice letters, decimal points, zeros, verdicts and sub-phrases on fixed rows."""
    rows = [(0, "abc\r\nd  ef g ", "(A) one (B) two", "12.500", "Yes."), (1, "one line", "none", "100", "No, it is not"), (2, "", "(ж)", "0.10", "perhaps"), (3, "a\n\n b", "(1)(2)", "3.", "YES")]
    d = spark.createDataFrame(rows, "k int, raw string, choices string, num string, verdict string")
    return d.select(
        "k",
        F.array_join(text.multiline(F.col("raw")), "|").alias("lines"),
        F.array_join(text.choice_letters(F.col("choices")), ",").alias("letters"),
        text.strip_zeros(F.col("num")).alias("num"),
        text.judged_bad(F.col("verdict")).alias("bad"),
        text.decimal_points(F.concat(F.lit("x 1,5 y "), F.col("num"), F.lit(" z"))).alias("points"),
        text.find_subphrase(F.split("raw", " "), F.split(F.lit("EF g"), " ")).alias("place"),
    )


SCALARS = """SELECT * FROM (VALUES (0, 'abc|d ef g', 'A,B', '12.5', false, 'x 1.5 y 12.500 z', 2), (1, 'one line', '', '100', true, 'x 1.5 y 100 z', -1),
 (2, '', 'ж', '0.1', true, 'x 1.5 y 0.10 z', -1), (3, 'a|b', '1,2', '3', false, 'x 1.5 y 3. z', -1)) AS v(k, lines, letters, num, bad, points, place)"""

QUERIES = {
    "tokenize_counts": tokenize_counts,
    "whitespace_collapse": whitespace_collapse,
    "script_share_filter": script_share_filter,
    "has_script_letters": has_script_letters,
    "refusal_filter": refusal_filter,
    "prompt_classify": prompt_classify,
    "prompt_strip_context": prompt_strip_context,
    "row_validation_report": row_validation_report,
    "eos_strip": eos_strip,
    "text_corpus": text_corpus,
    "wiki_links": wiki_links,
    "scalar_texts": scalar_texts,
}
ORACLES = {
    "tokenize_counts": TOKENIZE,
    "whitespace_collapse": COLLAPSE,
    "script_share_filter": SCRIPT,
    "has_script_letters": HAS_LETTERS,
    "refusal_filter": REFUSAL,
    "prompt_classify": CLASSIFY,
    "prompt_strip_context": STRIP_CONTEXT,
    "row_validation_report": VALIDATION,
    "eos_strip": EOS,
    "text_corpus": CORPUS,
    "wiki_links": _sql_links(),
    "scalar_texts": SCALARS,
}
