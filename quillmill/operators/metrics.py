"""Scores: error rates, F1 of answers and entities, greedy cosine F1, means, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import f1, token_distance
from ..functions.text import answer_word, tokenize
from .fuzzy import token_edit_counts
from .ranking import ranked
from .storage import stored

FLOOR = 1e-9


def error_rates(rows: DataFrame, group: str, predicted: str, reference: str) -> DataFrame:
    """``group, n, distance, n_ref, wer, accuracy``: distances of all rows over all reference tokens.

    The rate is 0 where no reference has a token; the accuracy may be negative.
    """
    r = rows.select(group, tokenize(F.lower(predicted)).alias("_p"), tokenize(F.lower(reference)).alias("_r"))
    r = r.select(group, token_edit_counts(F.col("_p"), F.col("_r")).alias("_d"), F.size("_r").cast("long").alias("_n"))
    g = r.groupBy(group).agg(F.count("*").alias("n"), F.sum("_d").alias("distance"), F.sum("_n").alias("n_ref"))
    wer = F.round(F.coalesce(F.try_divide(F.col("distance").cast("double"), F.col("n_ref")), F.lit(0.0)), 6)
    return g.select(group, "n", "distance", "n_ref", wer.alias("wer"), F.round(1 - wer, 6).alias("accuracy"))


def row_score(predicted: Column, reference: Column) -> Column:
    """1 - distance / length of the reference, from 0 to 1."""
    r = tokenize(F.lower(reference))
    return F.greatest(F.lit(0.0), 1 - token_distance(tokenize(F.lower(predicted)), r) / F.greatest(F.size(r), F.lit(1)))


def yes_no_f1(rows: DataFrame, group: str, predicted: str, truth: str, yes: str = "yes", no: str = "no") -> DataFrame:
    """``group, f1_yes, f1_no, f1``: both words scored apart, then the mean.  An answer with neither counts against both."""
    r = rows.select(group, answer_word(F.col(predicted), yes, no).alias("_p"), answer_word(F.col(truth), yes, no).alias("_t"))

    def counts(word: str) -> Column:
        p, t = F.coalesce(F.col("_p") == word, F.lit(False)), F.coalesce(F.col("_t") == word, F.lit(False))
        n = lambda c: F.sum(c.cast("long"))
        return f1(n(p & t), n(p & ~t), n(~p & t))

    g = r.groupBy(group).agg(counts(yes).alias("f1_yes"), counts(no).alias("f1_no"))
    return g.select(group, F.round("f1_yes", 6).alias("f1_yes"), F.round("f1_no", 6).alias("f1_no"), F.round((F.col("f1_yes") + F.col("f1_no")) / 2, 6).alias("f1"))


def entity_f1(predicted: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """``class, tp, fp, fn, f1`` of exactly equal spans, one row a class."""
    cols = [key, "class", "start", "end"]
    p = predicted.select(*cols).distinct().withColumn("_p", F.lit(1))
    t = truth.select(*cols).distinct().withColumn("_t", F.lit(1))
    j = p.join(t, cols, "full").withColumns({"_p": F.coalesce("_p", F.lit(0)), "_t": F.coalesce("_t", F.lit(0))})
    g = j.groupBy("class").agg(F.sum(F.col("_p") * F.col("_t")).cast("long").alias("tp"), F.sum(F.col("_p") * (1 - F.col("_t"))).cast("long").alias("fp"), F.sum((1 - F.col("_p")) * F.col("_t")).cast("long").alias("fn"))
    return g.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


def macro_f1(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("macro_f1"))


#: Vectors of one side that one task compares at a time.
VECTOR_BLOCK = 2048


def greedy_cosine_f1(reference: DataFrame, predicted: DataFrame, pair: str, vector: str = "embedding", block: int = VECTOR_BLOCK) -> DataFrame:
    """``pair, recall, precision, f1`` by greedy matching of token vectors.

    Recall is the mean over reference tokens of the best cosine, precision the same for
    the prediction; F1 is 0 unless both are positive.  Both sides empty give 1, one empty
    side 0.  The vectors of a pair are dealt into blocks; a task multiplies one block of
    either side, and the best of each vector over all blocks is an aggregate, so a pair of
    any size is spread over many tasks.
    """
    sides = {}
    for name, rows in (("a", reference), ("b", predicted)):
        own = stored(rows.select(F.col(pair).alias("pair"), F.col(vector).alias("vector")).withColumn("row", F.monotonically_increasing_id()), "vectors")
        sides[name] = own, own.groupBy("pair").agg(F.count("*").alias(f"n_{name}"))
    sizes = stored(sides["a"][1].join(sides["b"][1], "pair", "full").select("pair", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")), "sizes")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")

    def dealt(name: str, other: str) -> DataFrame:
        with_sizes = sides[name][0].join(sizes.where("n_a > 0 AND n_b > 0"), "pair")
        mine = F.pmod(F.xxhash64("row"), blocks(f"n_{name}")).cast("int").alias(f"block_{name}")
        return with_sizes.select("pair", "row", "vector", mine, F.explode(F.sequence(F.lit(0), blocks(f"n_{other}") - 1)).alias(f"block_{other}"))

    def unit(t: pa.Table) -> np.ndarray:
        m = np.asarray(t.column("vector").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    kind = reference.schema[pair].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"pair": left.column("pair").slice(0, 0), "side": pa.array([], pa.string()), "row": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})
        a, b = unit(left), unit(right)
        best_a, best_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
        for i in range(0, len(a), 512):
            c = a[i : i + 512] @ b.T
            best_a[i : i + 512] = c.max(axis=1)
            best_b = np.maximum(best_b, c.max(axis=0))
        return pa.table({
            "pair": pa.concat_arrays([left.column("pair").combine_chunks(), right.column("pair").combine_chunks()]), "side": ["a"] * len(a) + ["b"] * len(b),
            "row": np.concatenate([np.asarray(left.column("row")), np.asarray(right.column("row"))]), "best": np.concatenate([best_a, best_b]),
        })

    on = ["pair", "block_a", "block_b"]
    met = dealt("a", "b").groupBy(*on).cogroup(dealt("b", "a").groupBy(*on)).applyInArrow(best, f"pair {kind}, side string, row long, best double")
    each = met.groupBy("pair", "side", "row").agg(F.max("best").alias("best"))
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("best")))
    means = each.groupBy("pair").agg(side("a").alias("r"), side("b").alias("p"))
    out = sizes.join(means, "pair", "left")
    empty = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), 1.0).otherwise(0.0)
    r, p = F.coalesce("r", empty), F.coalesce("p", empty)
    f = F.when((r > 0) & (p > 0), 2 * r * p / (r + p)).otherwise(0.0)
    return out.select(F.col("pair").alias(pair), F.round(r, 6).alias("recall"), F.round(p, 6).alias("precision"), F.round(f, 6).alias("f1"))


def harmonic_mean(scores: DataFrame, score: str = "score") -> DataFrame:
    """Harmonic mean of task scores, none below a floor."""
    return scores.agg(F.round(F.count("*") / F.sum(1 / F.greatest(F.col(score), F.lit(FLOOR))), 6).alias("hmean"), F.count("*").alias("n"))


def report(scored: DataFrame, key: str) -> DataFrame:
    """Rows with their place: best score first, then the shorter input, reference and prediction, then the key."""
    r = scored.withColumns({"_s": -F.col("score"), "_i": F.length("input"), "_t": F.length("reference"), "_p": F.length("predicted")})
    return ranked(r, ["_s", "_i", "_t", "_p", key], None, "place").drop("_s", "_i", "_t", "_p")
