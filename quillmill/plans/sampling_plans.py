"""Queries over samples, splits, mixtures and length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling, stats, tasks
from ..operators.validate import same_tasks
from ..operators.generate import without
from .tables import sql_hash, sql_uniform, table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "text", "lang", "source"), "doc_id")


def sample_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.uniform_sample(_docs(spark, sf).select("doc_id", "lang"), 100, "doc_id")


def sample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_reduction(_labelled(spark, sf).select("doc_id", "toxic"), 60, "doc_id", F.col("toxic") == 1)


STRATIFIED = f"""
WITH l AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic = 1 ORDER BY {sql_hash('strata', 'doc_id')}, doc_id) AS r, count(*) FILTER (toxic = 1) OVER () AS p FROM labels JOIN documents USING (doc_id))
SELECT doc_id, toxic FROM l WHERE CASE WHEN toxic = 1 THEN r <= least(p, 30) ELSE r <= 60 - least(p, 30) END"""


def split_601030(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.few_shot_split(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 4, least=10)


SPLIT60 = f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('split', 'doc_id')}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
q AS (SELECT *, CAST(round_even(n * 0.6::DOUBLE, 0) AS BIGINT) AS p, least(CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT), 75) AS v FROM r)
SELECT doc_id, lang, CASE WHEN r < p THEN 'few_shot' WHEN r < p + v THEN 'validation' ELSE 'train' END AS split FROM q"""


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.counted_split(_docs(spark, sf).select("doc_id"), "doc_id")


COUNTS = f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_hash('counts', 'doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
q AS (SELECT *, least(2000, CAST(round_even(n * 0.25::DOUBLE, 0) AS BIGINT)) AS t, least(1000, CAST(round_even(n * 0.05::DOUBLE, 0) AS BIGINT)) AS v FROM r)
SELECT doc_id, CASE WHEN r < n - t - v THEN 'train' WHEN r < n - t THEN 'validation' ELSE 'test' END AS split FROM q"""


def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(_docs(spark, sf).select("doc_id", "source"), "source", "doc_id", 100)


SPLIT_STRATIFIED = f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {sql_hash('stratified', 'doc_id')}, doc_id) AS r FROM documents),
s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n)::BIGINT AS total FROM s),
q AS (SELECT source, (n * least(100, total)) // total AS q, (n * least(100, total)) % total AS rem, least(100, total) AS k FROM s, t),
e AS (SELECT *, row_number() OVER (ORDER BY rem DESC, source) AS i, k - sum(q) OVER () AS extra FROM q)
SELECT doc_id, source, r <= q + CASE WHEN i <= extra THEN 1 ELSE 0 END AS picked FROM r JOIN e USING (source)"""


def split_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.group_split(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id")


def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Draws with replacement: positive rows weigh 1.0, the others 0.3."""
    l = table(spark, sf, "labels")
    return sampling.weighted_sample(l, F.when(F.col("toxic") == 1, 1.0).otherwise(0.3), 500, "doc_id")


WEIGHTED = f"""
WITH w AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 1000000 ELSE 300000 END AS w, {sql_hash('weighted', 'doc_id')} AS h FROM labels),
c AS (SELECT doc_id, w, sum(w) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - w AS lo, sum(w) OVER () AS total FROM w),
d AS (SELECT i AS draw, {sql_uniform('weighted-draw', 'i')} AS u FROM range(500) t(i))
SELECT draw, doc_id FROM c, d WHERE CAST(floor(u * total) AS BIGINT) >= lo AND CAST(floor(u * total) AS BIGINT) < lo + w"""


def batch_mix(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.batch_mix(_docs(spark, sf).select("lang", "doc_id"), "lang", "doc_id", ["de", "en", "es", "fr"], "en", 8, 50)


BATCH = f"""
WITH r AS (SELECT lang AS task, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('mix', 'doc_id')}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT i // 8 AS batch, CAST(i % 8 AS INT) AS slot FROM range(400) t(i)),
k AS (SELECT batch, slot, CASE WHEN slot < 4 THEN 'en' ELSE (['de', 'es', 'fr'])[(batch * 4 + slot - 4) % 3 + 1] END AS task,
  CASE WHEN slot < 4 THEN batch * 4 + slot ELSE (batch * 4 + slot - 4) // 3 END AS k FROM s)
SELECT batch, slot, task, doc_id FROM k JOIN r USING (task) WHERE r.r = k.k % n"""


def mixture_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("arithmetic", 0.05), ("comparison", 0.05), ("choice", 0.05), ("qa", 0.10)]
    return sampling.mixture(_docs(spark, sf).select("doc_id"), "doc_id", parts, "data")


_U = sql_uniform("mixture", "doc_id")
MIXTURE = f"""SELECT doc_id, CASE WHEN {_U} < 0.05::DOUBLE THEN 'arithmetic' WHEN {_U} < 0.1::DOUBLE THEN 'comparison' WHEN {_U} < 0.15000000000000002::DOUBLE THEN 'choice'
  WHEN {_U} < 0.25::DOUBLE THEN 'qa' ELSE 'data' END AS part FROM documents"""


def drop_with_chance(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.dropped_with_chance(table(spark, sf, "labels"), F.col("quality") == 0, 0.5, "doc_id").select("doc_id")


def coverage_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", F.array("lang").alias("classes"))
    return sampling.covering_split(docs, "doc_id", "classes")[0].select("doc_id", "split")


COVERAGE = """
WITH s AS (SELECT seed, doc_id, lang, CAST(('0x' || substr(md5('cover:' || seed || ':' || doc_id), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE < 0.15 AS v FROM documents, range(20) r(seed)),
g AS (SELECT seed FROM s GROUP BY seed HAVING count(DISTINCT CASE WHEN v THEN lang END) = (SELECT count(DISTINCT lang) FROM documents)
  AND count(DISTINCT CASE WHEN NOT v THEN lang END) = (SELECT count(DISTINCT lang) FROM documents))
SELECT doc_id, CASE WHEN v THEN 'validation' ELSE 'train' END AS split FROM s WHERE seed = (SELECT min(seed) FROM g)"""


def derived_task_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sibling rows of toxic documents and their lower-case form, and of short English ones as simplifications."""
    toxic = _labelled(spark, sf).where("toxic = 1").select("doc_id", "text")
    plain = _docs(spark, sf).where("lang = 'en' AND length(text) < 400").select("doc_id", "text")
    detox = tasks.derived_rows(toxic, "doc_id", "text", F.lower("text"), "detox")
    simple = tasks.derived_rows(plain, "doc_id", "text", F.lower("text"), "simplification", seed="simple")
    return detox.withColumn("kind", F.lit("detox")).unionByName(simple.withColumn("kind", F.lit("simplification")))


def _derived_sql(name: str, seed: str, rows: str, toxicity: bool) -> str:
    two = lambda x, y, end: f"SELECT doc_id, 'paraphrase_detection' AS task, {x} || chr(10) || {y} AS input, '{end}</s>' AS target, '{name}' AS kind FROM {name}"
    one = lambda x, end: f"SELECT doc_id, 'toxicity_detection' AS task, {x} AS input, '{end}</s>' AS target, '{name}' AS kind FROM {name}"
    parts = [one("a", "yes"), one("l", "no")] if toxicity else []
    parts += [two("a", "l", "yes"), two("l", "a", "yes"), two("a", "c", "no") + " WHERE n > 1", two("c", "a", "no") + " WHERE n > 1"]
    return f"""SELECT * FROM (WITH t AS (SELECT doc_id, text, row_number() OVER (ORDER BY {sql_hash(seed, 'doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n FROM {rows}),
{name} AS (SELECT a.doc_id, a.text AS a, lower(a.text) AS l, lower(b.text) AS c, a.n FROM t a JOIN t b ON b.r = (a.r + 1) % a.n)
{' UNION ALL '.join(parts)})"""


DERIVED = f"""{_derived_sql('detox', 'derive', '(SELECT doc_id, text FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)', True)}
UNION ALL {_derived_sql('simplification', 'simple', "(SELECT doc_id, text FROM documents WHERE lang = 'en' AND length(text) < 400)", False)}"""


def task_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.task_counts(_docs(spark, sf).select(F.col("lang").alias("split"), F.col("source").alias("task")))


TASK_COUNTS = "SELECT lang AS split, source AS task, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)"


def taskset_equality(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return same_tasks(d.where("lang = 'en'").select(F.col("source").alias("task")), d.where("lang = 'es'").select(F.col("source").alias("task")))


TASKSETS = """
WITH a AS (SELECT DISTINCT source AS task FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source AS task FROM documents WHERE lang = 'es')
SELECT task, 'right' AS missing_in FROM a WHERE task NOT IN (SELECT task FROM b) UNION ALL SELECT task, 'left' FROM b WHERE task NOT IN (SELECT task FROM a)"""


def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.length_stats(_docs(spark, sf), "lang", F.length("text"))


LENGTHS = """SELECT lang, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest, CAST(round_even(avg(length(text)), 0) AS BIGINT) AS mean,
  CAST(quantile_disc(length(text), 0.5) AS BIGINT) AS median, count(*) AS n FROM documents GROUP BY lang"""


def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(_docs(spark, sf), F.length("text"), 20)


HISTOGRAM = """
WITH l AS (SELECT length(text)::BIGINT AS x FROM documents), m AS (SELECT min(x) AS lo, max(x) AS hi, greatest(20, (max(x) - min(x)) // 20) AS bins FROM l)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least((x - lo) * bins // (hi - lo), bins - 1) END AS BIGINT) AS bin, count(*) AS n, min(x) AS shortest, max(x) AS longest FROM l, m GROUP BY bin"""


def dedupe_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts of the other sources that source src0 does not have."""
    d = _docs(spark, sf)
    own, other = (d.where(c).select(F.md5("text").alias("text_md5")) for c in ("source <> 'src0'", "source = 'src0'"))
    return without(own.distinct(), other, "text_md5")


ANTIJOIN = "SELECT md5(text) AS text_md5 FROM (SELECT DISTINCT text FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0'))"

QUERIES = {
    "sample_uniform": sample_uniform,
    "sample_stratified": sample_stratified,
    "split_601030": split_601030,
    "split_counts": split_counts,
    "split_stratified": split_stratified,
    "split_by_group": split_by_group,
    "weighted_sample": weighted_sample,
    "batch_mix": batch_mix,
    "mixture_parts": mixture_parts,
    "drop_with_chance": drop_with_chance,
    "coverage_split": coverage_split,
    "derived_task_rows": derived_task_rows,
    "task_counts": task_counts,
    "taskset_equality": taskset_equality,
    "length_stats": length_stats,
    "length_histogram": length_histogram,
    "dedupe_antijoin": dedupe_antijoin,
}
ORACLES = {
    "sample_uniform": f"SELECT doc_id, lang FROM documents ORDER BY {sql_hash('sample', 'doc_id')}, doc_id LIMIT 100",
    "sample_stratified": STRATIFIED,
    "split_601030": SPLIT60,
    "split_counts": COUNTS,
    "split_stratified": SPLIT_STRATIFIED,
    "split_by_group": f"SELECT conv_id, turn, CASE WHEN {sql_uniform('groups', 'conv_id')} < 0.1::DOUBLE THEN 'validation' ELSE 'train' END AS split FROM conversations",
    "weighted_sample": WEIGHTED,
    "batch_mix": BATCH,
    "mixture_parts": MIXTURE,
    "drop_with_chance": f"SELECT doc_id FROM labels WHERE quality <> 0 OR {sql_uniform('drop', 'doc_id')} > 0.5::DOUBLE",
    "coverage_split": COVERAGE,
    "derived_task_rows": DERIVED,
    "task_counts": TASK_COUNTS,
    "taskset_equality": TASKSETS,
    "length_stats": LENGTHS,
    "length_histogram": HISTOGRAM,
    "dedupe_antijoin": ANTIJOIN,
}
