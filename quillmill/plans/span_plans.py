"""Queries over spans, paragraphs, sections and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, WS
from ..operators import intervals, sections, spans
from .tables import sql_text, table

_WS, _TOKEN = sql_text(WS), sql_text(TOKEN)
_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, {sql_text('^' + WS)}, ''), {sql_text(WS + '$')}, '')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def paragraph_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.paragraph_spans(_docs(spark, sf))


_LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)"""
_PARAGRAPHS = f"""{_LINES},
p AS (SELECT doc_id, CAST(line AS INT) AS line, CAST(start + length(raw) - length(regexp_replace(raw, {sql_text('^' + WS)}, '')) AS INT) AS start, length({_TRIM('raw')}) AS n FROM o),
pars AS (SELECT doc_id, line, start, CAST(start + n AS INT) AS "end" FROM p WHERE n > 0)"""


def tiles_check(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their line ends must tile each document."""
    d = _docs(spark, sf)
    b = spans.lines_with_offsets(d)
    n = d.select("doc_id", F.length("text").alias("n"))
    ends = b.join(n, "doc_id").select("doc_id", "start", F.least(F.col("start") + F.length("raw") + 1, F.col("n")).alias("end")).where("end > start")
    return spans.tiles(ends, n)


def containment_join(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    hits = spans.phrase_hits(d, table(spark, sf, "benchmark"))
    return spans.contained(hits, spans.paragraph_spans(d))


_HITS = """m AS (SELECT doc_id, item_id, d.text AS t, b.text AS p, unnest(range(length(d.text) - length(b.text) + 1)) AS i FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
hits AS (SELECT doc_id, item_id, CAST(i AS INT) AS start, CAST(i + length(p) AS INT) AS "end" FROM m WHERE substr(t, i + 1, length(p)) = p)"""
CONTAINED = f"""WITH {_PARAGRAPHS}, {_HITS}
SELECT h.*, p.line AS outer, h.start - p.start AS rel_start, h."end" - p.start AS rel_end FROM hits h JOIN pars p ON h.doc_id = p.doc_id AND h.start >= p.start AND h."end" <= p."end" """.replace("AS outer", 'AS "outer"')


def bio_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens inside benchmark passages, tagged."""
    d = _docs(spark, sf)
    hits = spans.phrase_hits(d, table(spark, sf, "benchmark")).withColumn("class", F.lit("bench"))
    held = d.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return spans.bio_tags(spans.token_spans(held), hits).where("tags <> 'O'")


BIO = f"""
WITH {_HITS}, d AS (SELECT doc_id, regexp_extract_all(text, {sql_text(spans.SPACED_TOKEN)}) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
t AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) - 1 AS tok FROM d),
e AS (SELECT doc_id, tok, regexp_replace(s, '^\\s+', '') AS token, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY tok) AS fin FROM t),
j AS (SELECT e.doc_id, tok, token, h.start, h."end" AS last, CASE WHEN fin - length(token) = h.start THEN 'B-bench' ELSE 'I-bench' END AS tag
  FROM e JOIN hits h ON e.doc_id = h.doc_id AND fin - length(token) >= h.start AND fin <= h."end")
SELECT doc_id, CAST(tok AS INT) AS tok, token, string_agg(tag, ',' ORDER BY start, last) AS tags FROM j GROUP BY doc_id, tok, token"""


def paragraph_segment(spark: SparkSession, sf: str) -> DataFrame:
    pars = sections.document_paragraphs(_docs(spark, sf))
    return sections.segmentation_pairs(pars).select("doc_id", F.col("text_no").cast("long"), "n", F.md5("input").alias("input_md5"), F.md5("target").alias("target_md5"))


SEGMENT = f"""
WITH {_LINES}, x AS (SELECT doc_id, line, trim(regexp_replace(replace(raw, '--', '—'), {_WS}, ' ', 'g')) AS s FROM o),
t AS (SELECT *, regexp_extract_all(s, {_TOKEN}) AS t FROM x),
a AS (SELECT doc_id, line, s, list_filter(t, lambda w: regexp_full_match(w, '\\p{{L}}+')) AS a, len(list_filter(t, lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+'))) > 0 AS wordy FROM t),
f AS (SELECT doc_id, line, s, wordy, coalesce(regexp_full_match(a[1], '\\p{{Lu}}\\p{{Ll}}*'), false) AS title, len(a) > 0 AND len(list_filter(a, lambda w: NOT regexp_full_match(w, '\\p{{Lu}}+'))) = 0 AS up,
  lag(s) OVER w AS ps, lag(wordy) OVER w AS pw FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
b AS (SELECT *, sum(CASE WHEN s <> '' AND (ps IS NULL OR ps = '' OR NOT pw OR regexp_matches(ps, '[.?!…]$') OR regexp_matches(s, '^[—\\-0-9]') OR title OR up OR NOT wordy) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY line) AS par FROM f),
p AS (SELECT doc_id, par, bool_or(wordy) AS wordy, string_agg(s, ' ' ORDER BY line) AS paragraph FROM b WHERE s <> '' GROUP BY doc_id, par),
n AS (SELECT *, sum(CASE WHEN wordy THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY par) AS text_no FROM p)
SELECT doc_id, CAST(text_no AS BIGINT) AS text_no, count(*) AS n, md5(string_agg(paragraph, ' ' ORDER BY par)) AS input_md5, md5(string_agg(paragraph, chr(10) ORDER BY par)) AS target_md5
FROM n WHERE wordy GROUP BY doc_id, text_no"""

def _one_document(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of all documents as those of a single one."""
    return spans.lines_with_offsets(_docs(spark, sf)).select(F.lit(1).alias("book"), "doc_id", "line", "raw")


def joined_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    p = sections.scanned_paragraphs(_one_document(spark, sf), "book", ["doc_id", "line"])
    return p.select("text_no", "par", F.md5("paragraph").alias("paragraph_md5"))


JOINED_PARAGRAPHS = SEGMENT.replace("PARTITION BY doc_id ORDER BY line", "ORDER BY doc_id, line").replace("PARTITION BY doc_id ORDER BY par", "ORDER BY par")
JOINED_PARAGRAPHS = JOINED_PARAGRAPHS.replace("sum(length(raw) + 1) OVER (ORDER BY doc_id, line", "sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line")
JOINED_PARAGRAPHS = JOINED_PARAGRAPHS.replace("SELECT doc_id, par, bool_or(wordy)", "SELECT par, bool_or(wordy)").replace("string_agg(s, ' ' ORDER BY line)", "string_agg(s, ' ' ORDER BY doc_id, line)").replace("GROUP BY doc_id, par)", "GROUP BY par)")
JOINED_PARAGRAPHS = JOINED_PARAGRAPHS[: JOINED_PARAGRAPHS.rindex("SELECT doc_id, CAST(text_no")] + "SELECT CAST(text_no AS BIGINT) AS text_no, CAST(par AS BIGINT) AS par, md5(paragraph) AS paragraph_md5 FROM n WHERE wordy"


def joined_sections(spark: SparkSession, sf: str) -> DataFrame:
    s = sections.scanned_sections(_one_document(spark, sf), "book", ["doc_id", "line"], "raw")
    return s.select("section", "title", F.md5("body").alias("body_md5"))


JOINED_SECTIONS = f"""
WITH {_LINES}, v AS (SELECT doc_id, line, trim(regexp_replace(raw, {_WS}, ' ', 'g')) AS t FROM o),
s AS (SELECT *, len(list_filter(regexp_extract_all(t, {_TOKEN}), lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+'))) <= 7 OR row_number() OVER (ORDER BY doc_id, line) = 1 AS short FROM v WHERE t <> ''),
r AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (ORDER BY doc_id, line) AS run FROM s),
i AS (SELECT *, short AND sum(short::INT) OVER (PARTITION BY run ORDER BY doc_id, line) % 2 = 1 AS is_title FROM r),
k AS (SELECT *, sum(is_title::INT) OVER (ORDER BY doc_id, line) AS section FROM i),
t AS (SELECT *, max(CASE WHEN is_title THEN t END) OVER (PARTITION BY section) AS title FROM k)
SELECT CAST(section AS BIGINT) AS section, title, md5(string_agg(CASE WHEN short THEN title ELSE t END, chr(10) ORDER BY doc_id, line)) AS body_md5 FROM t WHERE NOT is_title GROUP BY section, title"""

def wiki_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each document as those of an article."""
    lines = spans.lines_with_offsets(_docs(spark, sf))
    return sections.wiki_sections(lines, "doc_id", "line", "raw").select("doc_id", F.col("section").cast("long"), "title", F.md5("body").alias("body_md5"))


WIKI = JOINED_SECTIONS.replace("OVER (ORDER BY doc_id, line)", "OVER (PARTITION BY doc_id ORDER BY line)").replace("PARTITION BY run ORDER BY doc_id, line", "PARTITION BY doc_id, run ORDER BY line").replace("PARTITION BY section)", "PARTITION BY doc_id, section)")
WIKI = WIKI.replace("SELECT CAST(section AS BIGINT)", "SELECT doc_id, CAST(section AS BIGINT)").replace("chr(10) ORDER BY doc_id, line)", "chr(10) ORDER BY line)").replace("GROUP BY section, title", "GROUP BY doc_id, section, title")


def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    """Spells of a few minutes behind each event, merged for each of seven groups of users."""
    at = F.unix_timestamp("ts").cast("long")
    spells = table(spark, sf, "events").select((F.col("user_id") % 7).alias("k"), at.alias("s"), (at + 60 * (1 + F.col("event_id") % 9)).alias("e"))
    return intervals.interval_union(spells, "k", "s", "e")


UNION = """
WITH x AS (SELECT user_id % 7 AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 60 * (1 + event_id % 9) AS e FROM events),
f AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, g"""


def span_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages and the pieces of 100 code points of a document, with how they meet."""
    d = _docs(spark, sf)
    hits = spans.phrase_hits(d, table(spark, sf, "benchmark"))
    cut = d.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(100))).alias("line", "start"))
    pieces = cut.select("doc_id", "line", "start", (F.col("start") + 100).alias("end"))
    return intervals.overlaps(hits, pieces, "doc_id").select("doc_id", "item_id", "start", "end", F.col("outer_line").alias("piece"), "relation")


def piece_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages by their place in pieces of 1000 code points, those that cross a bound too."""
    d = _docs(spark, sf)
    hits = spans.phrase_hits(d, table(spark, sf, "benchmark"))
    cut = d.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(1000))).alias("line", "start"))
    return intervals.contained(hits, cut.withColumn("end", F.col("start") + 1000), partial="keep")


_MET = f"""WITH {{hits}}, p AS (SELECT doc_id, CAST(unnest(range(0, greatest(length(text), 1), {{size}})) AS INT) AS a FROM documents)"""
_RELATIONS = _MET.format(hits=_HITS, size=100) + """
SELECT h.doc_id, h.item_id, h.start, h."end", a // 100 AS piece, CASE WHEN h.start >= a AND h."end" <= a + 100 THEN 'inside' WHEN h.start <= a AND h."end" >= a + 100 THEN 'around' ELSE 'across' END AS relation
FROM hits h JOIN p ON h.doc_id = p.doc_id AND h.start < a + 100 AND h."end" > a"""
_OFFSETS = _MET.format(hits=_HITS, size=1000) + """
SELECT h.*, a // 1000 AS "outer", h.start - a AS rel_start, h."end" - a AS rel_end, h.start >= a AND h."end" <= a + 1000 AS whole
FROM hits h JOIN p ON h.doc_id = p.doc_id AND h.start < a + 1000 AND h."end" > a"""


def span_objects(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.createDataFrame([(1, 10, 0, 4), (1, 11, 5, 6), (1, 12, 20, 3), (2, 10, 7, 2)], "doc int, span_id int, start int, len int")
    o = spark.createDataFrame([(1, 1, "Person", [10, 11]), (1, 2, "Org", [12]), (2, 1, "LocOrg", [10]), (1, 3, "Location", [12, 10])], "doc int, object_id int, type string, span_ids array<int>")
    return spans.object_bounds(o, s)


OBJECTS = """
WITH s AS (SELECT * FROM (VALUES (1, 10, 0, 4), (1, 11, 5, 6), (1, 12, 20, 3), (2, 10, 7, 2)) AS v(doc, span_id, start, len)),
o AS (SELECT doc, object_id, type, unnest(ids) AS span_id FROM (VALUES (1, 1, 'person', [10, 11]), (1, 2, 'organization', [12]), (2, 1, 'location', [10]), (1, 3, 'location', [12, 10])) AS v(doc, object_id, type, ids))
SELECT doc, object_id, type AS class, min(start) AS start, max(start + len) AS "end" FROM o JOIN s USING (doc, span_id) GROUP BY doc, object_id, type"""

_QUOTED = "the paper «Morning News» wrote of «a «deep» sea»"


def guillemets(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, 11, 23), (2, 10, 23), (3, 11, 24), (4, 10, 24), (5, 0, 3), (6, 38, 42)]
    d = spark.createDataFrame(rows, "k int, s int, e int")
    a, b = spans.with_quotes(F.lit(_QUOTED), F.col("s"), F.col("e"))
    return d.select("k", a.cast("int").alias("start"), b.cast("int").alias("end"))


GUILLEMETS = """SELECT * FROM (VALUES (1, 10, 24), (2, 10, 24), (3, 10, 24), (4, 10, 24), (5, 0, 3), (6, 37, 43)) AS v(k, start, "end")"""

def entity_align(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document its first two tokens, two from its middle and a word it lacks, placed again in order of mention."""
    t = _docs(spark, sf).select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), 0).alias("tokens"))
    half = F.floor(F.size("tokens") / 2).cast("int")
    pair = lambda i: F.slice("tokens", i + 1, F.lit(2))
    told = F.when(F.size("tokens") >= 6, F.array(pair(F.lit(0)), F.array(F.lit("no"), F.lit("such"), F.lit("word")), pair(half))).otherwise(F.array(F.array(F.lit("nowhere"))))
    return spans.aligned(t.withColumn("entities", told), "doc_id")


ALIGN = f"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, {_TOKEN}), lambda w: lower(w)) AS t FROM documents),
h AS (SELECT doc_id, t, len(t) // 2 AS h FROM t),
s AS (SELECT doc_id, t, list_filter(range(CASE WHEN t[1] = t[h + 1] AND t[2] = t[h + 2] THEN 2 ELSE 1 END, len(t) - 1), lambda i: t[i + 1] = t[h + 1] AND t[i + 2] = t[h + 2])[1] AS m FROM h WHERE len(t) >= 6)
SELECT doc_id, 0 AS start, 2 AS "end", 1 AS misses FROM s
UNION ALL SELECT doc_id, CAST(m AS INT), CAST(m + 2 AS INT), 1 FROM s
UNION ALL SELECT doc_id, -1, -1, 1 FROM t WHERE len(t) < 6"""

def conll_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark passage, a token and its tags a line."""
    d = _docs(spark, sf)
    hits = spans.phrase_hits(d, table(spark, sf, "benchmark")).withColumn("class", F.lit("bench"))
    held = d.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return spans.conll_text(spans.bio_tags(spans.token_spans(held), hits)).select("doc_id", F.md5("target").alias("target_md5"))


CONLL = BIO.replace("SELECT doc_id, CAST(tok AS INT) AS tok, token, string_agg(tag, ',' ORDER BY start, last) AS tags FROM j GROUP BY doc_id, tok, token", """,
g AS (SELECT doc_id, tok, string_agg(tag, ',' ORDER BY start, last) AS tags FROM j GROUP BY doc_id, tok)
SELECT doc_id, md5(string_agg(token || chr(9) || coalesce(tags, 'O'), chr(10) ORDER BY tok)) AS target_md5 FROM e LEFT JOIN g USING (doc_id, tok) GROUP BY doc_id""").replace("\n,\ng AS", ",\ng AS")

QUERIES = {
    "paragraph_spans": paragraph_spans,
    "tiles_check": tiles_check,
    "containment_join": containment_join,
    "bio_tags": bio_tags,
    "paragraph_segment": paragraph_segment,
    "joined_paragraphs": joined_paragraphs,
    "joined_sections": joined_sections,
    "wiki_sections": wiki_sections,
    "interval_union": interval_union,
    "span_relations": span_relations,
    "piece_offsets": piece_offsets,
    "span_objects": span_objects,
    "guillemets": guillemets,
    "entity_align": entity_align,
    "conll_rows": conll_rows,
}
ORACLES = {
    "paragraph_spans": f"WITH {_PARAGRAPHS} SELECT * FROM pars",
    "tiles_check": "SELECT doc_id, length(text) > 0 AS ok FROM documents",
    "containment_join": CONTAINED,
    "bio_tags": BIO,
    "paragraph_segment": SEGMENT,
    "joined_paragraphs": JOINED_PARAGRAPHS,
    "joined_sections": JOINED_SECTIONS,
    "wiki_sections": WIKI,
    "interval_union": UNION,
    "span_relations": _RELATIONS,
    "piece_offsets": _OFFSETS,
    "span_objects": OBJECTS,
    "guillemets": GUILLEMETS,
    "entity_align": ALIGN,
    "conll_rows": CONLL,
}
