"""Queries over task tables: nested caps, limits, prompts, pairing, tag decoding, model calls with stand-ins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import pick
from ..functions.text import TOKEN, WS
from ..operators import dialog, models, sampling, spans, tasks
from ..operators.ranking import ranked
from .tables import sql_hash, sql_pick, sql_text, table

_TOKEN, _WS = sql_text(TOKEN), sql_text(WS)


def nested_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogues whose first question and all answers keep within the nested caps."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", text.word_count(F.col("text")).alias("n"))
    g = c.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.struct("turn", "n")))["n"].alias("n_question"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("n")))).alias("n_answers"))
    q, a = F.coalesce("n_question", F.lit(0)), F.col("n_answers")
    return g.select("conv_id", q.cast("long").alias("n_question"), F.size("n_answers").cast("long").alias("n_answers"), tasks.under_nested(q, a, 600).alias("train"), tasks.under_nested(q, a, 600, training=False).alias("validation"))


NESTED = f"""
WITH n AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, {_TOKEN})) AS n FROM conversations),
g AS (SELECT conv_id, coalesce(arg_min(n, turn) FILTER (role = 'user'), 0) AS q, count(*) FILTER (role = 'assistant') AS k, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS s, coalesce(max(n) FILTER (role = 'assistant'), 0) AS m FROM n GROUP BY conv_id)
SELECT conv_id, CAST(q AS BIGINT) AS n_question, k AS n_answers, q + s <= 200 AS train, q + s <= 400 AND m <= 600 AS validation FROM g"""


def length_limits(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.length_limits(table(spark, sf, "documents").where("text IS NOT NULL"), "lang", text.word_count(F.col("text")))


LIMITS = f"""
WITH n AS (SELECT lang, len(regexp_extract_all(text, {_TOKEN})) AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT lang, max(n) AS m, count(*) AS k FROM n GROUP BY lang)
SELECT lang, CAST(round_even(CAST(m * 1.1 AS DOUBLE), 0) AS BIGINT) + 3 AS generated, CAST(round_even(CAST(m * 1.5 AS DOUBLE), 0) AS BIGINT) AS padded,
  greatest(CAST(round_even(CAST(k * 0.33 AS DOUBLE), 0) AS BIGINT) + 1, 5) AS reduced FROM g"""


def token_inclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all words of a turn were said in the turn before it."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(text.tokens(F.col("text")), F.lower).alias("w"))
    j = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("before")), ["conv_id", "turn"])
    return j.select("conv_id", "turn", tasks.token_subset(F.col("w"), F.col("before")).alias("inside"), F.size(F.array_except("w", "before")).cast("long").alias("n_new"))


INCLUSION = f"""
WITH w AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, {_TOKEN}), lambda x: lower(x)) AS w FROM conversations),
j AS (SELECT a.conv_id, a.turn, len(list_distinct(list_filter(a.w, lambda x: NOT list_contains(b.w, x)))) AS n FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, n = 0 AS inside, CAST(n AS BIGINT) AS n_new FROM j"""


def qa_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Every fixed prompt and the verifier's statement for user turns and their answers."""
    p = dialog.history_pairs(table(spark, sf, "conversations")).select("conv_id", "turn", F.col("input").alias("q"), text.strip_eos(F.col("target")).alias("a"))
    made = [tasks.prompt(k, text=F.col("q"), question=F.col("q"), answer=F.col("a")) for k in tasks._PROMPTS]
    return p.select("conv_id", "turn", F.md5(F.concat_ws("|", *made)).alias("prompts_md5"), F.md5(tasks.sample_statement(F.col("q"), F.col("a"))).alias("statement_md5"))


_prompt = lambda t: " || ".join(
    {"text": "q", "question": "q", "answer": "a"}[x[1:-1]] if x.startswith("{") else sql_text(x).replace("\n", "' || chr(10) || '") for x in re.split(r"(\{\w+\})", t) if x
)
_closed = lambda c: f"CASE WHEN regexp_matches(trim({c}), '[\\p{{L}}\\p{{N}}]$') THEN trim({c}) || '.' ELSE trim({c}) END"
PROMPTS = f"""
WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, {_WS}, ' ', 'g')) AS text FROM conversations WHERE role <> 'system'),
h AS (SELECT conv_id, turn, role, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS q, lead(role) OVER w AS after, lead(text) OVER w AS a FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, q, regexp_replace(regexp_replace(a, '^\\s+', ''), '(\\s*</s>)*\\s*$', '') AS a FROM h WHERE role = 'user' AND after = 'assistant')
SELECT conv_id, turn, md5({" || '|' || ".join(_prompt(t) for t in tasks._PROMPTS.values())}) AS prompts_md5, md5({_closed('q')} || ' ' || {_closed('a')}) AS statement_md5 FROM p"""


def paired_lines(spark: SparkSession, sf: str) -> DataFrame:
    """English documents beside as many German ones, first with first; their lengths."""
    d = table(spark, sf, "documents")
    n = min(d.where("lang = 'en'").count(), d.where("lang = 'de'").count())
    side = lambda lang: ranked(d.where(F.col("lang") == lang).select("doc_id", F.length("text").alias("n")), ["doc_id"]).where(F.col("rank") < n).drop("rank")
    both = tasks.paired_by_position(side("en").toDF("en_id", "en_n"), side("de").toDF("de_id", "de_n"), ["en_id"], ["de_id"])
    return both.select("row", "en_id", "en_n", "de_id", "de_n")


PAIRED = """
WITH e AS (SELECT doc_id AS en_id, length(text) AS en_n, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents WHERE lang = 'en'),
g AS (SELECT doc_id AS de_id, length(text) AS de_n, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents WHERE lang = 'de')
SELECT row, en_id, en_n, de_id, de_n FROM e JOIN g USING (row)"""


def bio_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of benchmark passages read back as token spans."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    hits = spans.phrase_hits(d, table(spark, sf, "benchmark")).select("doc_id", F.lit("bench").alias("class"), "start", "end").distinct()
    held = d.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    back = spans.decoded_tags(spans.bio_tags(spans.token_spans(held), hits))
    return back.select("doc_id", "class", F.col("start").cast("int"), F.col("end").cast("int"))


BIO_DECODE = f"""
WITH m AS (SELECT doc_id, d.text AS t, b.text AS p, unnest(range(length(d.text) - length(b.text) + 1)) AS i FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
hits AS (SELECT DISTINCT doc_id, i AS s, i + length(p) AS e FROM m WHERE substr(t, i + 1, length(p)) = p),
w AS (SELECT doc_id, regexp_extract_all(text, {sql_text(spans.SPACED_TOKEN)}) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS tok FROM w),
k AS (SELECT doc_id, tok, length(regexp_replace(x, '^\\s+', '')) AS n, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY tok) AS e FROM u),
g AS (SELECT k.doc_id, tok, bool_or(k.e - n = h.s) AS b, count(*) AS c FROM k JOIN hits h ON k.doc_id = h.doc_id AND k.e - n >= h.s AND k.e <= h.e GROUP BY k.doc_id, tok),
x AS (SELECT doc_id, tok, unnest(CASE WHEN b AND c > 1 THEN ['B', 'I'] WHEN b THEN ['B'] ELSE ['I'] END) AS bio FROM g),
f AS (SELECT doc_id, tok, bio, CASE WHEN bio = 'B' OR lag(tok) OVER o IS NULL OR lag(tok) OVER o < tok - 1 THEN 1 ELSE 0 END AS f FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY tok, bio)),
r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY tok, bio ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT doc_id, 'bench' AS class, CAST(min(tok) AS INT) AS start, CAST(max(tok) + 1 AS INT) AS "end" FROM r GROUP BY doc_id, g"""

_NEGATIVE = "nothing here"


def few_shot_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entity questions over user turns: numbers as entities, a fixed sentence where there is none."""
    c = table(spark, sf, "conversations").where("role = 'user' AND text IS NOT NULL")
    found = F.regexp_extract_all("text", F.lit(r"[A-Z]\w+"), 0)
    s = c.select(F.lit("ner").alias("task"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("input"), text.entity_text(F.when(pick("entity-kind", 3, F.col("conv_id"), F.col("turn")) == 0, found).otherwise(F.slice(found, 1, 0)), _NEGATIVE).alias("target"))
    return dialog.few_shot_entities(s, F.size(text.entity_list(F.col("target"), _NEGATIVE)) == 0)


FEW_ENTITIES = f"""
WITH s AS (SELECT 'ner' AS task, conv_id || '-' || turn AS id, text AS input, regexp_extract_all(text, '[A-Z]\\w+') AS f, {sql_pick('entity-kind', 3, 'conv_id', 'turn')} AS c FROM conversations WHERE role = 'user' AND text IS NOT NULL),
t AS (SELECT task, id, input, CASE WHEN c = 0 AND len(f) > 0 THEN array_to_string(f, chr(10)) ELSE '{_NEGATIVE}' END AS target FROM s WHERE length(input) <= 3500),
r AS (SELECT *, target = '{_NEGATIVE}' AS neg, row_number() OVER (ORDER BY {sql_hash('entities', 'task', 'id')}, id) - 1 AS r, count(*) OVER () AS n, 2 + {sql_pick('entities-k', 4, 'task', 'id')} AS k FROM t),
j AS (SELECT a.task, a.id, a.input, a.target, i, b.neg, 'Question: ' || b.input || chr(10) || 'Answer: ' || b.target AS block FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM r WHERE n > 5) a JOIN r b ON b.r = (a.r + a.i) % a.n),
f AS (SELECT *, min(CASE WHEN neg THEN i END) OVER (PARTITION BY id) AS first_neg, bool_or(NOT neg) OVER (PARTITION BY id) AS any_found FROM j)
SELECT task, id, CAST(count(*) AS INT) AS k, string_agg(block, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || 'Question: ' || any_value(input) || chr(10) || 'Answer: ' AS input, any_value(target) AS target
FROM f WHERE any_found AND (NOT neg OR i = first_neg) GROUP BY task, id"""


def _large_e(texts: list[str]) -> list[tuple[str, float]]:
    return [(t.replace("e", "E"), -float(len(t))) for t in texts]


def translation_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in translator that writes one letter large and scores by length; every third text is a program."""
    b = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("# note\n"), F.col("text"), F.lit("\n\nlast line")).alias("text"))
    b = b.withColumn("text", F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit("\nIn Python it runs"))).otherwise(F.col("text"))).withColumn("code", tasks.is_code(F.col("text"), (" Python",)))
    return models.translated(b, lambda: _large_e, code="code").select("item_id", "code", F.md5("translation").alias("translation_md5"), "translation_score")


TRANSLATED = """
WITH b AS (SELECT item_id, '# note' || chr(10) || text || chr(10) || chr(10) || 'last line' || CASE WHEN item_id % 3 = 0 THEN chr(10) || 'In Python it runs' ELSE '' END AS text FROM benchmark),
l AS (SELECT item_id, contains(text, ' Python') AS code, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b),
t AS (SELECT *, trim(line) <> '' AND (NOT code OR starts_with(trim(line), '#')) AS done FROM l)
SELECT item_id, any_value(code) AS code, md5(string_agg(CASE WHEN done THEN replace(trim(line), 'e', 'E') ELSE line END, chr(10) ORDER BY i)) AS translation_md5, min(CASE WHEN done THEN -CAST(length(line) AS DOUBLE) END) AS translation_score FROM t GROUP BY item_id"""


def verifier_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in verifier and classifier over user turns: first five words, greater probability, limits of answers."""
    c = table(spark, sf, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", "text", F.lit("x").alias("other"))
    v = models.verified(c, lambda: lambda texts: [t + "  end" for t in texts], "text")
    p = models.classified(v, lambda: lambda texts: [("bad", 0.25) if t.startswith("x") else ("good", 0.5) for t in texts], "text", "other", "bad")
    a = models.answered(p, lambda: lambda texts, most: [str(n) for n in most], "text", "n_most", limit=models.correction_limit)
    return a.select("conv_id", "turn", "verification", "hallucination_score", "n_most")


VERIFIED = f"""
WITH w AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(list_append(w, 'end')[1:5], ' ') END AS verification, CAST(CASE WHEN starts_with(text, 'x') THEN 0.25 ELSE 0.5 END AS DOUBLE) AS hallucination_score,
  CASE WHEN len(w) = 0 THEN '' ELSE CAST(2 * len(w) + 10 AS VARCHAR) END AS n_most FROM w"""


def sentence_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in vectors of counts of three letters, at length one."""
    b = table(spark, sf, "benchmark")
    v = models.sentence_vectors(b, lambda: lambda texts: [[float(t.count(c)) for c in "aeo"] for t in texts])
    return v.select("item_id", *(F.round(F.get("vector", F.lit(i)), 9).alias(f"v{i}") for i in range(3)))


_count = lambda c: f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE"
VECTORS = f"""
WITH c AS (SELECT item_id, {_count('a')} AS a, {_count('e')} AS e, {_count('o')} AS o FROM benchmark), n AS (SELECT *, sqrt(a * a + e * e + o * o) AS n FROM c)
SELECT item_id, round(coalesce(a / nullif(n, 0), 0), 9) AS v0, round(coalesce(e / nullif(n, 0), 0), 9) AS v1, round(coalesce(o / nullif(n, 0), 0), 9) AS v2 FROM n"""


def token_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """The default tagger's lemmas of each benchmark item, counted."""
    t = models.tagged(table(spark, sf, "benchmark").select("item_id", "text"))
    rows = t.select("item_id", F.inline("tokens"))
    return rows.groupBy("item_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("lemma").alias("n_lemmas"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


LEMMAS = """
WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+')) AS w FROM benchmark)
SELECT item_id, count(*) AS n_tokens, count(DISTINCT lower(w)) AS n_lemmas, CAST(sum(length(w)) AS BIGINT) AS n_chars FROM t GROUP BY item_id"""


def entity_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of capitalised words given as entities, in order of mention."""
    b = table(spark, sf, "benchmark").select("item_id", F.concat("text", F.lit(" </s></s>")).alias("text"), F.filter(text.tokens(F.col("text")), lambda t: t.rlike("^[A-Z]")).alias("entities"))
    out = spans.entity_labels(b, "NAME")
    return out.select("item_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("labels", lambda x: x == "B-NAME")).cast("long").alias("n_found"), F.size("labels").cast("long").alias("n_labels"))


LABELS = """
WITH t AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+') AS w FROM benchmark)
SELECT item_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) AS BIGINT) AS n_found, CAST(len(w) AS BIGINT) AS n_labels FROM t"""


def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of up to 64 tokens a piece: the pieces must tile each one."""
    p = spans.split_texts(table(spark, sf, "documents").select("doc_id", "text"), 64)
    g = p.groupBy("doc_id").agg(F.max("last").alias("n_tokens"), F.sum(F.col("last") - F.col("first")).alias("covered"), F.max(F.col("last") - F.col("first")).alias("longest"))
    return g.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("covered") == F.col("n_tokens")).alias("tiles"), (F.col("longest") <= 64).alias("fits"))


SPLIT = f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {_TOKEN})) AS BIGINT) AS n_tokens, true AS tiles, true AS fits FROM documents WHERE len(regexp_extract_all(text, {_TOKEN})) > 0"""


def split_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Validation, then test, both in proportion to the language."""
    out = sampling.validation_then_test(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", n_validation=40, least_test=50)
    return out.groupBy("lang", "split").agg(F.count("*").alias("n"))


_quota = lambda k, src: f"""(SELECT lang, q + CASE WHEN row_number() OVER (ORDER BY r DESC, lang) <= left_over THEN 1 ELSE 0 END AS k FROM (
  SELECT lang, n * {k} // t AS q, n * {k} % t AS r, {k} - sum(n * {k} // t) OVER () AS left_over FROM (SELECT lang, n, sum(n) OVER () AS t FROM {src})))"""  # noqa: E731
CHAIN = f"""
WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), v AS {_quota('40', 'a')},
b AS (SELECT lang, a.n - v.k AS n FROM a JOIN v USING (lang) WHERE a.n > v.k), z AS (SELECT greatest(50, CAST(round_even(0.05::DOUBLE * sum(n), 0) AS BIGINT)) AS m FROM b),
t AS {_quota('(SELECT m FROM z)', 'b')}
SELECT lang, 'validation' AS split, CAST(k AS BIGINT) AS n FROM v WHERE k > 0 UNION ALL SELECT lang, 'test', CAST(k AS BIGINT) FROM t WHERE k > 0 UNION ALL SELECT lang, 'train', CAST(b.n - t.k AS BIGINT) FROM b JOIN t USING (lang) WHERE b.n > t.k"""


def half_mix(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.half_mix(d.where("lang = 'en'"), d.where("lang <> 'en'"), 101, "doc_id").select("doc_id", "part")


HALF = f"""
SELECT * FROM (SELECT doc_id, 'first' AS part FROM documents WHERE lang = 'en' ORDER BY {sql_hash('half-first', 'doc_id')}, doc_id LIMIT 51)
UNION ALL SELECT * FROM (SELECT doc_id, 'second' AS part FROM documents WHERE lang <> 'en' ORDER BY {sql_hash('half-second', 'doc_id')}, doc_id LIMIT 50)"""


def single_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Draws one by one, half of them from one source: how many came from each side."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    drawn = sampling.single_mix(d, "source", "doc_id", "src0", 2000).join(d, "doc_id")
    return drawn.groupBy((F.col("source") == "src0").alias("main")).agg((F.abs(F.count("*") - 1000) < 150).alias("near_half"))


SINGLE = "SELECT * FROM (VALUES (true, true), (false, true)) AS v(main, near_half)"


def distinct_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct beginnings of a dialogue's turns as one text: lines joined in order, and negative sentences read back."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("task"), F.substring("text", 1, 20).alias("input"), F.lit(_NEGATIVE).alias("target"))
    d = tasks.distinct_samples(c)
    g = tasks.joined_lines(d, ["task"], "input", "input")
    return g.select("task", F.md5("answer").alias("lines_md5"), text.says_only(F.lit("Here: NOTHING!"), _NEGATIVE).alias("says_nothing"))


DISTINCT = """
WITH d AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS task, substr(text, 1, 20) AS input FROM conversations WHERE text IS NOT NULL)
SELECT task, md5(string_agg(input, chr(10) ORDER BY input)) AS lines_md5, true AS says_nothing FROM d GROUP BY task"""

QUERIES = {
    "nested_caps": nested_caps,
    "length_limits": length_limits,
    "token_inclusion": token_inclusion,
    "qa_prompts": qa_prompts,
    "paired_lines": paired_lines,
    "bio_decode": bio_decode,
    "few_shot_entities": few_shot_entities,
    "translation_scores": translation_scores,
    "verifier_rows": verifier_rows,
    "sentence_vectors": sentence_vectors,
    "token_lemmas": token_lemmas,
    "entity_labels": entity_labels,
    "split_texts": split_texts,
    "split_chain": split_chain,
    "half_mix": half_mix,
    "single_mix": single_mix,
    "distinct_samples": distinct_samples,
}
ORACLES = {
    "nested_caps": NESTED,
    "length_limits": LIMITS,
    "token_inclusion": INCLUSION,
    "qa_prompts": PROMPTS,
    "paired_lines": PAIRED,
    "bio_decode": BIO_DECODE,
    "few_shot_entities": FEW_ENTITIES,
    "translation_scores": TRANSLATED,
    "verifier_rows": VERIFIED,
    "sentence_vectors": VECTORS,
    "token_lemmas": LEMMAS,
    "entity_labels": LABELS,
    "split_texts": SPLIT,
    "split_chain": CHAIN,
    "half_mix": HALF,
    "single_mix": SINGLE,
    "distinct_samples": DISTINCT,
}
