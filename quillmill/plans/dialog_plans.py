"""Queries over dialogues and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.hashing import pick
from ..functions.similarity import environment
from ..functions.text import TOKEN, WS, collapse
from ..operators import dialog, models, tasks
from .tables import sql_hash, sql_pick, sql_text, table

_WS, _TOKEN = sql_text(WS), sql_text(TOKEN)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.history_pairs(table(spark, sf, "conversations"))


def history_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("task", "input", "target").distinct()


_PAIRS = f"""
t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, {_WS}, ' ', 'g')) AS text FROM conversations WHERE role <> 'system'),
h AS (SELECT conv_id, turn, role, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS input,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) || '</s>' AS target FROM t),
pairs AS (SELECT conv_id, turn, 'chat' AS task, input, target FROM h WHERE role = 'user' AND next_role = 'assistant')"""
HISTORY = f"WITH {_PAIRS} SELECT DISTINCT task, input, target FROM pairs"


def dialogue_valid(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.dialogue_validity(table(spark, sf, "conversations"))


VALID = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, count(*) AS n_turns,
  bool_and(role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AND trim(text) <> '') AND count(*) >= 2 AND count(*) % 2 = 0 AS valid
FROM r GROUP BY conv_id"""


def preference_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.preference_rows(table(spark, sf, "conversations"), " the ", " THE ")


PREFERENCE = """
WITH m AS (SELECT conv_id, turn, role, replace(text, ' the ', ' THE ') AS text FROM conversations),
s AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'system' AND turn = t0) AS sys FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM m) GROUP BY conv_id),
b AS (SELECT m.*, min(m.turn) OVER (PARTITION BY m.conv_id) AS t0 FROM m),
i AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM b WHERE NOT (role = 'system' AND turn = t0)),
g AS (SELECT conv_id, any_value(n) AS n, max(CASE WHEN i = n - 1 THEN text END) AS query, max(CASE WHEN i = n THEN text END) AS response, max(CASE WHEN i = 2 THEN text END) AS rejected_response,
   string_agg(text, chr(10) ORDER BY i) FILTER (i <= n - 2) AS history,
   bool_and(role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) AS ok FROM i GROUP BY conv_id)
SELECT conv_id, coalesce(sys, '') AS system, query, response, rejected_response, n - 2 AS n_history, history FROM g JOIN s USING (conv_id) WHERE ok AND n >= 4 AND n % 2 = 0"""


def length_cap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs under the caps on either side, on the sum, and on the asymmetric form; tokens are counted once."""
    p = _pairs(spark, sf).select("conv_id", "turn", F.regexp_count("input", F.lit(TOKEN)).alias("n_in"), F.regexp_count("target", F.lit(TOKEN)).alias("n_out"))
    both = p.where((F.col("n_in") <= 2000) & (F.col("n_out") <= 2000))
    return both.select(
        "conv_id", "turn", F.col("n_in").cast("long"), F.col("n_out").cast("long"),
        tasks.under_sum(F.col("n_in"), F.col("n_out"), 500).alias("under_sum"),
        tasks.under_context(F.lit(0), F.col("n_in"), F.col("n_out"), 400).alias("under_rag"),
        tasks.in_range(F.col("n_in"), 50, 1000).alias("in_range"),
    )


CAPS = f"""
WITH {_PAIRS}, n AS (SELECT conv_id, turn, CAST(len(regexp_extract_all(input, {_TOKEN})) AS BIGINT) AS n_in, CAST(len(regexp_extract_all(target, {_TOKEN})) AS BIGINT) AS n_out FROM pairs)
SELECT *, n_in + n_out <= 500 AS under_sum, n_in <= 400 AND n_out < 200 AS under_rag, n_in BETWEEN 50 AND 1000 AS in_range FROM n WHERE n_in <= 2000 AND n_out <= 2000"""


def length_environment(spark: SparkSession, sf: str) -> DataFrame:
    e = _pairs(spark, sf).select(environment(F.length("input"), F.length("target"), 800).alias("env")).groupBy("env").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # at most four rows
    return e.select("env", "n", F.round(100.0 * F.col("n") / total, 6).alias("percent"))


ENVIRONMENT = f"""
WITH {_PAIRS}, e AS (SELECT CAST(CAST(length(input) > 800 AS INT) * 2 + CAST(length(target) > 800 AS INT) AS INT) AS env FROM pairs)
SELECT env, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM e GROUP BY env"""


def fewshot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    c = _pairs(spark, sf)
    samples = c.select(F.concat(F.lit("part"), (F.col("conv_id") % 3).cast("string")).alias("task"), F.concat_ws("-", "conv_id", "turn").alias("id"), "input", "target")
    return dialog.few_shot(samples)


FEWSHOT = f"""
WITH {_PAIRS}, s AS (SELECT 'part' || (conv_id % 3) AS task, conv_id || '-' || turn AS id, input, target FROM pairs WHERE length(input) <= 3500),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {sql_hash('fewshot', 'task', 'id')}, id) - 1 AS r, count(*) OVER (PARTITION BY task) AS n,
  2 + {sql_pick('fewshot-k', 4, 'task', 'id')} AS k FROM s),
j AS (SELECT a.task, a.id, a.k, a.input, a.target, i, 'Question: ' || b.input || chr(10) || 'Answer: ' || b.target AS block
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM r WHERE n > 5) a JOIN r b ON a.task = b.task AND b.r = (a.r + a.i) % a.n)
SELECT task, id, any_value(k) AS k, string_agg(block, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || 'Question: ' || any_value(input) || chr(10) || 'Answer: ' AS input,
  any_value(target) AS target FROM j GROUP BY task, id"""


_PROMPTS = ("Answer the user.", "Go on with the talk.", "Say what comes next.")


def tagged_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Few-shot prompts of tagged instruction rows, with the task's prompt once before the examples."""
    n = F.col("conv_id") % 3
    prompt = F.get(F.array(*map(F.lit, _PROMPTS)), n.cast("int"))
    c = _pairs(spark, sf).select(F.concat(F.lit("part"), n.cast("string")).alias("task"), F.concat_ws("-", "conv_id", "turn").alias("id"), prompt.alias("prompt"), F.concat(F.lit("<LM>"), prompt, F.lit(" "), F.col("input")).alias("input"), "target")
    return dialog.tagged_few_shot(c, system=True)


_CUT = f"""{_PAIRS}, s AS (SELECT 'part' || (conv_id % 3) AS task, conv_id || '-' || turn AS id, trim(input) AS input, regexp_replace(target, '</s>$', '') AS target, target AS own, conv_id % 3 AS n FROM pairs)"""
TAGGED = f"""
WITH {_CUT}, f AS (SELECT * FROM s WHERE length(input) <= 3500),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {sql_hash('fewshot', 'task', 'id')}, id) - 1 AS r, count(*) OVER (PARTITION BY task) AS m,
  2 + {sql_pick('fewshot-k', 4, 'task', 'id')} AS k FROM f),
j AS (SELECT a.task, a.id, a.k, a.input, a.own, a.n, i, 'Question: ' || b.input || chr(10) || 'Answer: ' || b.target AS block
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM r WHERE m > 5) a JOIN r b ON a.task = b.task AND b.r = (a.r + a.i) % a.m)
SELECT task, id, any_value(k) AS k, '<LM>' || CASE any_value(n) WHEN 0 THEN '{_PROMPTS[0]}' WHEN 1 THEN '{_PROMPTS[1]}' ELSE '{_PROMPTS[2]}' END || ' ' || string_agg(block, chr(10) || chr(10) ORDER BY i)
  || chr(10) || chr(10) || 'Question: ' || any_value(input) || chr(10) || 'Answer: ' AS input, any_value(own) AS target FROM j GROUP BY task, id"""


def capped_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of at most 150 white-space words a side, by the injected counter; no part of the dialogues may be left empty."""
    c = _pairs(spark, sf).select(F.concat(F.lit("part"), (F.col("conv_id") % 3).cast("string")).alias("task"), F.concat_ws("-", "conv_id", "turn").alias("id"), "input", "target")
    return models.capped_samples(c, 150).select("task", "id")


CAPPED = f"""WITH {_PAIRS} SELECT 'part' || (conv_id % 3) AS task, conv_id || '-' || turn AS id FROM pairs
WHERE len(regexp_extract_all(input, '\\S+')) <= 150 AND len(regexp_extract_all(target, '\\S+')) <= 150"""


def best_answer(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return dialog.best_answers(d.select("source", F.concat(F.lit("From "), F.col("source")).alias("question"), F.col("text").alias("answer"), F.col("quality").alias("score")), "source", "question", "answer", "score")


BEST = """
WITH d AS (SELECT source, 'From ' || source AS question, text AS answer, quality AS score FROM documents JOIN labels USING (doc_id) WHERE quality > 0 AND text <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, length(answer) DESC, answer) AS i, count(*) OVER (PARTITION BY source) AS n_answers FROM d)
SELECT source, question, answer, score, n_answers FROM r WHERE i = 1"""


def multiple_choice(spark: SparkSession, sf: str) -> DataFrame:
    """For each benchmark item a choice among it and the five items after it, scored by distance."""
    b = table(spark, sf, "benchmark")
    near = b.select(F.col("item_id").alias("other"), F.col("text").alias("answer"))
    pairs = b.select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).join(near, F.col("item_id") + F.col("k") == F.col("other"))
    g = pairs.groupBy("item_id", "text").agg(F.array_sort(F.collect_list(F.struct("k", "answer"))).alias("_a"))
    answers = F.transform("_a", lambda a: F.struct(a["answer"].alias("answer"), (5 - a["k"]).alias("score")))
    prompt, letter = dialog.choice_prompt(F.concat(F.lit("Which is item "), F.col("item_id").cast("string"), F.lit("?")), answers, "mcq", F.col("item_id"))
    return g.select("item_id", prompt.alias("input"), letter.alias("target"))


CHOICE = """
WITH p AS (SELECT a.item_id, k, b.text AS answer FROM (SELECT item_id, unnest(range(0, 6)) AS k FROM benchmark) a JOIN benchmark b ON b.item_id = a.item_id + a.k),
o AS (SELECT item_id, answer, row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS i FROM p),
s AS (SELECT item_id, answer, i, row_number() OVER (PARTITION BY item_id ORDER BY md5('mcq:' || item_id || ':' || i)) AS place FROM o WHERE i < 5)
SELECT item_id, 'Which is item ' || item_id || '?' || chr(10) || string_agg(chr(CAST(64 + place AS INT)) || '. ' || answer, chr(10) ORDER BY place) || chr(10) || 'Answer with one letter: ' AS input,
  max(CASE WHEN i = 0 THEN chr(CAST(64 + place AS INT)) END) AS target FROM s GROUP BY item_id"""


def synonym_expand(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", pick("syn", len(catalog.CANONICAL), F.col("conv_id"), F.col("turn")).alias("task_idx"), collapse(F.col("text")).alias("text"))
    return tasks.with_synonyms(c).select("conv_id", "turn", "task", "canonical", "input")


_CAT = ", ".join(f"({p.task_idx}, '{p.task}', '{p.prompt}', {str(p.canonical).lower()})" for p in catalog.CATALOGUE)
SYNONYMS = f"""
WITH cat AS (SELECT * FROM (VALUES {_CAT}) AS v(task_idx, task, prompt, canonical)),
c AS (SELECT conv_id, turn, {sql_pick('syn', len(catalog.CANONICAL), 'conv_id', 'turn')} AS task_idx, trim(regexp_replace(text, {_WS}, ' ', 'g')) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, task, canonical, '<LM>' || prompt || ' ' || t AS input FROM c JOIN cat USING (task_idx)"""


def rag_negative_context(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("What follows in "), F.col("conv_id").cast("string"), F.lit("?")).alias("question"), F.col("input").alias("context"), F.col("target").alias("response"))
    return dialog.rag_samples(p, "id")


QUERIES = {
    "history_pairs": history_pairs,
    "dialogue_valid": dialogue_valid,
    "preference_rows": preference_rows,
    "length_cap_pairs": length_cap_pairs,
    "length_environment": length_environment,
    "fewshot_prompts": fewshot_prompts,
    "tagged_prompts": tagged_prompts,
    "capped_tasks": capped_tasks,
    "best_answer": best_answer,
    "multiple_choice": multiple_choice,
    "synonym_expand": synonym_expand,
    "rag_negative_context": rag_negative_context,
}
ORACLES = {
    "history_pairs": HISTORY,
    "dialogue_valid": VALID,
    "preference_rows": PREFERENCE,
    "length_cap_pairs": CAPS,
    "length_environment": ENVIRONMENT,
    "fewshot_prompts": FEWSHOT,
    "tagged_prompts": TAGGED,
    "capped_tasks": CAPPED,
    "best_answer": BEST,
    "multiple_choice": CHOICE,
    "synonym_expand": SYNONYMS,
}
