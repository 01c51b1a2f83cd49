"""The opN_ queries and their SQL: thin contracts over the operators of this subpackage."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Pieces, bpe_round_trip
from .chat import ChatTemplate, format_conversations, parse_formatted
from .common import stored, table
from .digest import fingerprint_documents
from .html_text import extract_main_text
from .knn import hard_negatives
from .media import media_features, write_media
from .minhash import near_duplicates
from .packing import best_fit_packing
from .quality import quality_cascade
from .resample import resample
from .sharding import shard_by_bytes
from .suffix import remove_repeats
from .warc import read_bundles, write_bundles

N_SHARDS = 40


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    template = ChatTemplate()
    out = format_conversations(talks.unionByName(own), template)
    # All that follows is read back from the formatted text, the loss by the roles found there.
    back = parse_formatted(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter(back, lambda t: t["role"].isin(*template.loss_roles)), lambda t: t["text"]), "")
    read = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size(back).cast("long").alias("n_turns"), read.alias("_read"), loss.alias("_loss"), "formatted", "valid"
    ).select(
        "conv_id",
        "n_turns",
        F.sha2("_read", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in ChatTemplate().controls():
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _op1_sql() -> str:
    t = ChatTemplate()
    fixed = len(t.open) + len(t.between) + len(t.close)
    pairs = ", ".join(f"('{s}', '{r}')" for s, r in (("system", "user"), ("user", "assistant"), ("assistant", "user")))
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    {len(t.begin)} + sum({fixed} + length({_sql_escaped('role')}) + length({_sql_escaped('text')})) AS formatted_chars,
    bool_and((before IS NULL AND role IN ('system', 'user')) OR (coalesce(before, '-'), role) IN ({pairs}))
      AND bool_and(after IS NOT NULL OR role = 'assistant') AS valid
  FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, valid FROM g"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_by_bytes(sized, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = stored(write_media(docs), "media", compression="zstd")
    return media_features(files).drop("clips")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _kept_digest(kept: list[bytes]) -> dict[str, list]:
    return {"kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, finish=_kept_digest, finish_schema="kept_sha256 string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = stored(write_bundles(table(spark, sf_dir, "pages")), "bundles")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS head FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST(('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INT), 5)) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM f"""


def _digests(ids: np.ndarray, at: np.ndarray, pieces: Pieces) -> dict[str, list]:
    cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return {
        "n_tokens": np.diff(at),
        "ids_sha256": [hashlib.sha256(np.ascontiguousarray(ids[a:b], "<u4")).hexdigest() for a, b in cuts],
        "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in pieces.texts(ids, at)],
    }


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_round_trip(docs, ranks, finish=_digests, finish_schema="n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept"
    )


_OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT k, i, CASE WHEN count(*) OVER v = 8 THEN string_agg(word, ' ') OVER v END AS gram FROM t
      WINDOW v AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
c AS (SELECT k, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY k, gram) > 1 THEN 1 ELSE 0 END AS twice FROM g),
r AS (SELECT k, i, max(twice) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM c),
n AS (SELECT k, sum(covered) AS n_repeat_words FROM r GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
p AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
a AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN n USING (k) LEFT JOIN p USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT *, NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 3 * n_words
  OR 10 * n_dup_lines > n_words) AS kept FROM b"""


def op10_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, lambda key: key % 50 == 0)


_OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.k AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.k <> b.k WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.place ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, TRUE AS own, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, FALSE, coalesce(text, '') FROM benchmark),
w AS MATERIALIZED (SELECT k, doc_id, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
f AS MATERIALIZED (SELECT k, own, f, count(*) AS c FROM (
  SELECT k, own, unnest(ws) AS f FROM w
  UNION ALL SELECT k, own, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w) GROUP BY ALL),
h AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS UBIGINT)),
  lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM f), crc),
b AS MATERIALIZED (SELECT k, own, bucket, sum(c) AS c FROM f JOIN h USING (f) GROUP BY ALL),
a AS (SELECT CAST(coalesce(sum(c) FILTER (own), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(c) FILTER (NOT own), 0) AS DOUBLE) AS t_all FROM b),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(c) FILTER (NOT own), 0) + 1) * ((SELECT s_all FROM a) + 10000)
  / ((coalesce(sum(c) FILTER (own), 0) + 1) * ((SELECT t_all FROM a) + 10000)))) AS BIGINT) AS gain FROM b GROUP BY bucket),
p AS (SELECT k, sum(c) AS n, sum(c * gain) AS total FROM b JOIN g USING (bucket) WHERE own GROUP BY k),
v AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
  CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN p USING (k) WHERE w.own),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM v),
r AS (SELECT doc_id, n_features, weight, score, n_words >= 20 AS fit,
  row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) * 25 // 100 FROM r WHERE fit) THEN place END AS rank FROM r"""


def op13_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_sharding": op2_sharding,
    "op3_avi_motion_jpeg": op3_avi_motion_jpeg,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_warc": op6_warc,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_bag_minhash": op8_bag_minhash,
    "op9_quality_cascade": op9_quality_cascade,
    "op10_consensus_html": op10_consensus_html,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_improbable_digest": op13_improbable_digest,
}
ORACLES = {"op1_chat_formatting": _op1_sql(), "op6_warc": _OP6_SQL, "op9_quality_cascade": _OP9_SQL, "op11_hard_negatives": _OP11_SQL, "op12_importance_resampling": _OP12_SQL}
