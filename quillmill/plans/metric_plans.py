"""Queries over scores, similarities, generators and model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import TOKEN
from ..operators import fuzzy, generate, metrics, models
from .tables import sql_hash, sql_pick, sql_text, table

def wer_by_task(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a prediction of the one after it, by role."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return metrics.error_rates(t.join(after, ["conv_id", "turn"]).select(F.col("role").alias("task"), F.col("text").alias("pred"), "ref"), "task", "pred", "ref")


# The table of distances by its diagonals: a cell needs the two diagonals before its own.
WER = f"""
WITH RECURSIVE q AS (
  SELECT row_number() OVER () AS k, role AS task, flatten(list_transform(regexp_extract_all(lower(a.text), {sql_text(TOKEN)}), lambda w: CASE WHEN regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') THEN [w] ELSE string_split(w, '') END)) AS p,
    flatten(list_transform(regexp_extract_all(lower(b.text), {sql_text(TOKEN)}), lambda w: CASE WHEN regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') THEN [w] ELSE string_split(w, '') END)) AS r
  FROM conversations a JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations) b USING (conv_id, turn)),
c AS (SELECT k, p, r, 0 AS d, list_transform(range(len(p) + 1), lambda i: 0::BIGINT) AS a, list_transform(range(len(p) + 1), lambda i: 0::BIGINT) AS b FROM q
  UNION ALL
  SELECT k, p, r, d + 1, b, list_transform(range(len(p) + 1), lambda i: CAST(CASE WHEN d + 1 - i < 0 OR d + 1 - i > len(r) THEN 0 WHEN i = 0 OR i = d + 1 THEN d + 1
    ELSE least(b[i] + 1, b[i + 1] + 1, a[i] + CASE WHEN p[i] = r[d + 1 - i] THEN 0 ELSE 1 END) END AS BIGINT)) FROM c WHERE d < len(p) + len(r)),
d AS (SELECT k, b[len(p) + 1] AS d FROM c WHERE d = len(p) + len(r)),
g AS (SELECT task, count(*) AS n, CAST(sum(d) AS BIGINT) AS distance, CAST(sum(len(r)) AS BIGINT) AS n_ref FROM q JOIN d USING (k) GROUP BY task)
SELECT *, round(CASE WHEN n_ref = 0 THEN 0 ELSE distance / n_ref::DOUBLE END, 6) AS wer, round(1 - CASE WHEN n_ref = 0 THEN 0 ELSE round(distance / n_ref::DOUBLE, 6) END, 6) AS accuracy FROM g"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark passage beside the next, in ASCII (SQL engines differ on other letters)."""
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("t"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return b.join(nxt, "item_id")


_ITEMS = """i AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM benchmark),
p AS (SELECT a.item_id, a.t, b.t AS u FROM i a JOIN i b ON b.item_id = a.item_id + 1)"""


def lexical_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("item_id", F.round(similarity.lexical_similarity(F.col("t"), F.col("u")), 6).alias("similarity"))


LEXICAL = f"WITH {_ITEMS} SELECT item_id, round(greatest(0.0::DOUBLE, 1 - levenshtein(t, u) / length(t)::DOUBLE), 6) AS similarity FROM p"


def scored_report(spark: SparkSession, sf: str) -> DataFrame:
    s = _items(spark, sf).select("item_id", F.col("t").alias("input"), F.col("t").alias("reference"), F.col("u").alias("predicted"), F.round(similarity.lexical_similarity(F.col("t"), F.col("u")), 6).alias("score"))
    return metrics.report(s, "item_id").select("item_id", "score", F.col("place").cast("long"))


REPORT = f"""WITH {_ITEMS}, s AS (SELECT *, round(greatest(0.0::DOUBLE, 1 - levenshtein(t, u) / length(t)::DOUBLE), 6) AS score FROM p)
SELECT item_id, score, row_number() OVER (ORDER BY score DESC, length(t), length(t), length(u), item_id) - 1 AS place FROM s"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    pred = F.when(F.col("quality") == 1, "No, it is fine.").when(F.col("doc_id") % 7 == 0, "Hard to say").otherwise("Yes, no doubt")
    return l.select("lang", pred.alias("pred"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("truth"))


def yesno_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.yes_no_f1(_answers(spark, sf), "lang", "pred", "truth")


YESNO = """
WITH a AS (SELECT lang, CASE WHEN quality = 1 THEN 'no' WHEN doc_id % 7 = 0 THEN '' ELSE 'yes' END AS p, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS t FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (p = 'yes' AND t = 'yes')::DOUBLE AS yt, count(*) FILTER (p = 'yes' AND t <> 'yes') AS yp, count(*) FILTER (p <> 'yes' AND t = 'yes') AS yn,
  count(*) FILTER (p = 'no' AND t = 'no')::DOUBLE AS nt, count(*) FILTER (p = 'no' AND t <> 'no') AS np, count(*) FILTER (p <> 'no' AND t = 'no') AS nn FROM a GROUP BY lang),
f AS (SELECT lang, CASE WHEN yt + yp + yn = 0 THEN 0 ELSE yt / (yt + 0.5::DOUBLE * (yp + yn)) END AS y, CASE WHEN nt + np + nn = 0 THEN 0 ELSE nt / (nt + 0.5::DOUBLE * (np + nn)) END AS n FROM c)
SELECT lang, round(y, 6) AS f1_yes, round(n, 6) AS f1_no, round((y + n) / 2, 6) AS f1 FROM f"""

def entity_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Spans named by language and source, some shifted and some left out, against the whole ones."""
    d = table(spark, sf, "documents")
    last = (F.col("n_chars") % 7 + 1).cast("int")
    by = lambda c, start, end: d.select("doc_id", F.col(c).alias("class"), F.lit(start).alias("start"), end.alias("end"))
    truth = by("lang", 0, last).unionByName(by("source", 10, F.lit(12)))
    made = by("lang", 0, last + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).unionByName(by("source", 10, F.lit(12)).where("doc_id % 11 <> 0"))
    per = metrics.entity_f1(made, truth)
    return per.unionByName(metrics.macro_f1(per).select(F.lit("macro").alias("class"), *(F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn")), F.col("macro_f1").alias("f1")))


ENTITY = """
WITH t AS (SELECT doc_id, lang AS class, 0 AS start, n_chars % 7 + 1 AS fin FROM documents UNION SELECT doc_id, source, 10, 12 FROM documents),
p AS (SELECT doc_id, lang AS class, 0 AS start, n_chars % 7 + 1 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS fin FROM documents UNION SELECT doc_id, source, 10, 12 FROM documents WHERE doc_id % 11 <> 0),
j AS (SELECT coalesce(t.class, p.class) AS class, t.doc_id IS NOT NULL AS is_t, p.doc_id IS NOT NULL AS is_p FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.class = p.class AND t.start = p.start AND t.fin = p.fin),
g AS (SELECT class, count(*) FILTER (is_t AND is_p) AS tp, count(*) FILTER (is_p AND NOT is_t) AS fp, count(*) FILTER (is_t AND NOT is_p) AS fn FROM j GROUP BY class),
f AS (SELECT *, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp / (tp + 0.5::DOUBLE * (fp + fn)) END, 6) AS f1 FROM g)
SELECT * FROM f UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(f1), 6) FROM f"""


def cosine_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label are the tokens of a reference, those of the next label its prediction's."""
    e = table(spark, sf, "embeddings").select("label", "embedding")
    pred = e.select((F.col("label") - 1).alias("label"), "embedding")
    return metrics.greedy_cosine_f1(e, pred, "label")


COSINE = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT DISTINCT label FROM e UNION SELECT label - 1 FROM e),
c AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON b.label = a.label + 1),
r AS (SELECT label, avg(m) AS r FROM (SELECT label, i, max(c) AS m FROM c GROUP BY ALL) GROUP BY label), p AS (SELECT label, avg(m) AS p FROM (SELECT label, j, max(c) AS m FROM c GROUP BY ALL) GROUP BY label)
SELECT CAST(k.label AS INT) AS label, round(coalesce(r, 0), 6) AS recall, round(coalesce(p, 0), 6) AS precision, round(CASE WHEN r > 0 AND p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1
FROM k LEFT JOIN r USING (label) LEFT JOIN p USING (label)"""


def semantic_homogeneity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(similarity.homogeneity(F.col("embedding"), F.col("other")), 6).alias("homogeneity"))


HOMOGENEITY = """SELECT a.vec_id, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS homogeneity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def harmonic_mean(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return metrics.harmonic_mean(l.groupBy("source").agg(F.avg("quality").alias("score")))


HMEAN = "SELECT round(count(*) / sum(1 / greatest(q, 1e-9::DOUBLE)), 6) AS hmean, count(*) AS n FROM (SELECT avg(quality) AS q FROM labels JOIN documents USING (doc_id) GROUP BY source)"


def score_combine(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels")
    return l.select("doc_id", F.least("quality", "toxic").alias("worst"), F.greatest("quality", "toxic").alias("best"), similarity.environment(F.col("quality"), F.col("toxic"), 0).alias("env"))


def arithmetic_rows(spark: SparkSession, sf: str) -> DataFrame:
    a, c, m = generate.arithmetic_rows(spark, 400), generate.comparison_rows(spark, 400), generate.choice_rows(spark, 400)
    kind = lambda d, k: d.select(F.lit(k).alias("kind"), "id", "input", "target")
    return kind(a, "arithmetic").unionByName(kind(c, "comparison")).unionByName(kind(m, "choice"))


def _templates(ts: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + t.replace("\n", "~") + "'" for t in ts) + "]"


_operand = lambda seed: f"CASE WHEN {sql_pick(seed + '-kind', 2, 'id')} = 0 THEN ({sql_pick(seed + '-whole', 201, 'id')} - 100)::BIGINT * 1000000 ELSE {sql_pick(seed + '-micro', 200_000_001, 'id')}::BIGINT - 100000000 END"
_micro = lambda x: f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || (abs({x}) // 1000000)::VARCHAR || regexp_replace('.' || lpad((abs({x}) % 1000000)::VARCHAR, 6, '0'), '\\.?0+$', ''))"
_div = lambda x, y: f"(CASE WHEN ({x} < 0) = ({y} < 0) THEN 1 ELSE -1 END * ((2 * abs({x}) + abs({y})) // nullif(2 * abs({y}), 0)))"
_fills = lambda t, **v: _fills(f"replace({t}, '{{{next(iter(v))}}}', {v[next(iter(v))]})", **dict(list(v.items())[1:])) if v else t
_large = "[" + ", ".join(str(x).lower() for _, x in generate.COMPARISON_WORDS) + "]"
ARITHMETIC = f"""
WITH i AS (SELECT range AS id FROM range(400)),
a AS (SELECT id, {_operand('arithmetic-a')} AS a, {_operand('arithmetic-b')} AS b, {sql_pick('arithmetic-o', 4, 'id')} AS o0, {sql_pick('arithmetic-s', 2, 'id')} AS s, {sql_pick('arithmetic-t', len(generate.ARITHMETIC), 'id')} AS t FROM i),
b AS (SELECT *, CASE WHEN o0 = 3 AND b = 0 THEN 2 ELSE o0 END AS o FROM a),
q AS (SELECT *, CASE o WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN {_div('(a * b)', '1000000')} ELSE {_div('(a * 1000000)', 'b')} END AS r FROM b),
c AS (SELECT id, {_operand('comparison-a')} AS a, {_operand('comparison-b')} AS b, {sql_pick('comparison-w', len(generate.COMPARISON_WORDS), 'id')} AS w, {sql_pick('comparison-t', len(generate.COMPARISON), 'id')} AS t FROM i),
v AS (SELECT id, j, {sql_pick('choice-v', 1000, 'id', 'j')} AS x FROM (SELECT id, unnest(range(0, 5 + {sql_pick('choice-n', 16, 'id')})) AS j FROM i)),
m AS (SELECT id, string_agg(x::VARCHAR, ', ' ORDER BY j) AS l, CASE WHEN {sql_pick('choice-w', 2, 'id')} = 0 THEN max(x) ELSE min(x) END AS best, 2 + {sql_pick('choice-k', 5, 'id')} AS k,
  {sql_pick('choice-c', 4, 'id')} AS c, {sql_pick('choice-w', 2, 'id')} AS w, {sql_pick('choice-l', 2, 'id')} AS lab, {sql_pick('choice-t', len(generate.CHOICE), 'id')} AS t FROM v GROUP BY id),
o AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY {sql_hash('choice-other', 'id', 'x')}, x) AS n FROM (SELECT DISTINCT v.id, x FROM v JOIN m ON v.id = m.id AND x <> best)),
f AS (SELECT o.id, x FROM o JOIN m ON o.id = m.id AND n <= CASE WHEN c = 3 THEN k ELSE k - 1 END UNION ALL SELECT id, best FROM m WHERE c < 3),
p AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY {sql_hash('choice-shown', 'id', 'x')}, x) AS n FROM f),
e AS (SELECT id, x::VARCHAR AS x, n FROM p UNION ALL SELECT p.id, '{generate.NONE_RIGHT}', max(n) + 1 FROM p JOIN m ON p.id = m.id AND c >= 2 GROUP BY p.id),
g AS (SELECT e.id, string_agg(CASE WHEN lab = 0 THEN chr(CAST(64 + n AS INT)) ELSE n::VARCHAR END || ') ' || x, chr(10) ORDER BY n) AS opts,
  max(CASE WHEN (c = 3 AND x = '{generate.NONE_RIGHT}') OR (c < 3 AND x = best::VARCHAR) THEN CASE WHEN lab = 0 THEN chr(CAST(64 + n AS INT)) ELSE n::VARCHAR END END) AS target FROM e JOIN m ON e.id = m.id GROUP BY e.id)
SELECT 'arithmetic' AS kind, id, {_fills(f"({_templates(generate.ARITHMETIC)})[t + 1]", x=_micro('a'), op="(['+', '-', '*', '/'])[o + 1]", y=_micro('b'), s="CASE WHEN s = 1 THEN ' ' ELSE '' END")} AS input, {_micro('r')} AS target FROM q
UNION ALL SELECT 'comparison', id, {_fills(f"({_templates(generate.COMPARISON)})[t + 1]", word=f"({_templates(tuple(w for w, _ in generate.COMPARISON_WORDS))})[w + 1]", x=_micro('a'), y=_micro('b'))},
  {_micro(f'(CASE WHEN ({_large})[w + 1] THEN greatest(a, b) ELSE least(a, b) END)')} FROM c
UNION ALL SELECT 'choice', m.id, {_fills(f"replace(({_templates(generate.CHOICE)})[t + 1], '~', chr(10))", word=f"({_templates(generate.CHOICE_WORDS)})[w + 1]", list="'[' || l || ']'", options='opts')}, target FROM m JOIN g ON m.id = g.id"""


def typo_augment(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return generate.typo_augmented(d, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def _typos_sql() -> str:
    """One step of SQL for each of the edits."""
    draw = lambda i, n: f"CAST(CAST(('0x' || substr(md5(doc_id || ':{i}'), 1, 8)) AS UBIGINT) % ({n}) AS BIGINT)"
    near = "CASE lower(c) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in generate._NEAR.items()) + " END"
    steps = ["s0 AS (SELECT doc_id, coalesce(text, '') AS s, least(5, greatest(1, CAST(floor(length(coalesce(text, '')) * 0.1::DOUBLE) AS INT))) AS edits FROM documents)"]
    for e in range(generate.MOST_TYPOS):
        steps += [
            f"a{e} AS (SELECT *, length(s) AS n, CASE WHEN s <> '' THEN {draw(2 * e, 'length(s)')} END AS i, {draw(2 * e + 1, 4)} AS kind FROM s{e})",
            f"b{e} AS (SELECT *, substr(s, 1, i) AS before, substr(s, i + 1, 1) AS c, substr(s, i + 2) AS after FROM a{e})",
            f"c{e} AS (SELECT *, {near} AS other FROM b{e})",
            f"""s{e + 1} AS (SELECT doc_id, edits, CASE WHEN s = '' OR edits <= {e} THEN s WHEN kind = 0 AND other IS NOT NULL THEN before || substr(other, {draw(2 * e + 100, 'length(other)')} + 1, 1) || after
  WHEN kind = 1 AND i + 1 < n THEN before || substr(after, 1, 1) || c || substr(after, 2) WHEN kind = 2 AND n > 1 THEN before || after ELSE before || c || c || after END AS s FROM c{e})""",
        ]
    return f"WITH {', '.join(steps)} SELECT min(doc_id) AS doc_id, md5(s) AS text_md5 FROM s{generate.MOST_TYPOS} WHERE s NOT IN (SELECT text FROM documents WHERE text IS NOT NULL) GROUP BY s"


def chrf_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-gram score of each benchmark passage and the next."""
    return _items(spark, sf).select("item_id", F.round(fuzzy.chrf_score(F.col("t"), F.col("u")), 6).alias("chrf"))


CHRF = f"""
WITH {_ITEMS},
w AS (SELECT item_id, side, array_to_string(list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+'), lambda k: regexp_matches(k, '[\\p{{L}}\\p{{N}}]')), '') AS s
  FROM (SELECT item_id, 't' AS side, t AS x FROM p UNION ALL SELECT item_id, 'u', u FROM p)),
g AS (SELECT item_id, side, n, substr(s, CAST(i AS INT), CAST(n AS INT)) AS gram FROM (SELECT *, unnest(range(1, length(s) - n + 2)) AS i FROM w, range(1, 7) r(n))),
c AS (SELECT item_id, n, gram, count(*) FILTER (side = 't') AS a, count(*) FILTER (side = 'u') AS b FROM g GROUP BY item_id, n, gram),
h AS (SELECT item_id, n, sum(least(a, b)) AS hit, sum(a) AS na, sum(b) AS nb FROM c GROUP BY item_id, n),
f AS (SELECT item_id, n, CASE WHEN hit = 0 THEN 0.0 ELSE 10.0::DOUBLE * (hit / nb::DOUBLE) * (hit / na::DOUBLE) / (9.0 * (hit / nb::DOUBLE) + hit / na::DOUBLE) END AS f FROM h)
SELECT p.item_id, round(coalesce(avg(f.f), 0.0), 6) AS chrf FROM p LEFT JOIN f USING (item_id) GROUP BY p.item_id"""


def model_answer(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in model that answers in lower case; texts of up to three characters bypass it."""
    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("input"))
    return models.answered(c, lambda: lambda texts: [t.lower() + " ." for t in texts], least_chars=3).select("conv_id", "turn", "predicted")


MODEL = "SELECT conv_id, turn, CASE WHEN length(trim(text)) > 3 THEN lower(trim(text)) || ' .' ELSE trim(text) END AS predicted FROM conversations WHERE role = 'user'"

def fuzzy_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Word-order-free ratio and character n-gram score of each benchmark passage and the next."""
    p = _items(spark, sf)
    return p.select("item_id", F.round(fuzzy.token_sort_ratio(F.col("t"), F.col("u")), 6).alias("ratio"), F.round(fuzzy.chrf_score(F.col("t"), F.col("u")), 6).alias("chrf"))


QUERIES = {
    "fuzzy_scores": fuzzy_scores,
    "chrf_scores": chrf_scores,
    "wer_by_task": wer_by_task,
    "lexical_similarity": lexical_similarity,
    "scored_report": scored_report,
    "yesno_f1": yesno_f1,
    "entity_macro_f1": entity_macro_f1,
    "cosine_f1": cosine_f1,
    "semantic_homogeneity": semantic_homogeneity,
    "harmonic_mean": harmonic_mean,
    "score_combine": score_combine,
    "arithmetic_rows": arithmetic_rows,
    "typo_augment": typo_augment,
    "model_answer": model_answer,
}
ORACLES = {
    "wer_by_task": WER,
    "lexical_similarity": LEXICAL,
    "scored_report": REPORT,
    "yesno_f1": YESNO,
    "entity_macro_f1": ENTITY,
    "cosine_f1": COSINE,
    "semantic_homogeneity": HOMOGENEITY,
    "harmonic_mean": HMEAN,
    "score_combine": "SELECT doc_id, least(quality, toxic) AS worst, greatest(quality, toxic) AS best, CAST(CAST(quality > 0 AS INT) * 2 + CAST(toxic > 0 AS INT) AS INT) AS env FROM labels",
    "arithmetic_rows": ARITHMETIC,
    "model_answer": MODEL,
    "typo_augment": _typos_sql(),
    "chrf_scores": CHRF,
}
