"""Task tables: length caps and limits, refusals, prompt variants, derived rows, positional pairing, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.hashing import key_hash
from ..functions.text import WS, closed_sentence, padded_tokens
from .ranking import ranked
from .storage import stored

# -- caps on lengths in tokens -------------------------------------------------------------------


def under_sum(n_input: Column, n_target: Column, most: int) -> Column:
    """Both lengths together are at most ``most``."""
    return n_input + n_target <= most


def under_context(n_question: Column, n_context: Column, n_response: Column, most: int, strict: bool = True) -> Column:
    """Question and context within ``most``, the response under half of it (at least 3); ``strict`` means below, else up to."""
    room = max(3, most // 2)
    return (n_question + n_context <= most) & ((n_response < room) if strict else (n_response <= room))


def under_nested(n_question: Column, n_answers: Column, most: int, training: bool = True) -> Column:
    """The question and all of its answers (an array of lengths) within a third of ``most``; for validation
    within two thirds, and each answer within ``most``."""
    total = n_question + F.aggregate(n_answers, F.lit(0).cast("long"), lambda s, x: s + x)
    if training:
        return total <= most // 3
    return (total <= 2 * most // 3) & F.forall(n_answers, lambda x: x <= most)


def in_range(n: Column, least: int, most: int) -> Column:
    if not 0 <= least < most:
        raise ValueError("a range has 0 <= least < most")
    return n.between(least, most)


def length_limits(rows: DataFrame, group: str, n_tokens: Column, least: int = 5) -> DataFrame:
    """``group, generated, padded, reduced``: limits that follow from the longest text and the number of rows.

    ``3 + round(1.1 * longest)``, ``round(1.5 * longest)`` and ``max(round(0.33 * rows) + 1,
    least)``, halves to even.
    """
    g = rows.groupBy(group).agg(F.max(n_tokens).cast("long").alias("_m"), F.count("*").alias("_n"))
    even = lambda c: F.bround(c.cast("double")).cast("long")
    return g.select(group, (even(F.col("_m") * 1.1) + 3).alias("generated"), even(F.col("_m") * 1.5).alias("padded"), F.greatest(even(F.col("_n") * 0.33) + 1, F.lit(least).cast("long")).alias("reduced"))


# -- texts -----------------------------------------------------------------------------------------


def without_refusals(rows: DataFrame, text: str, phrases: tuple[str, ...], fold: dict[str, str] | None = None) -> DataFrame:
    """Rows whose text is not blank and holds none of the phrases among its tokens (padded by blanks, case matters)."""
    norm = padded_tokens(F.trim(text), fold)
    return rows.where((F.trim(text) != "") & ~F.exists(F.array(*map(F.lit, phrases)), lambda p: F.instr(norm, p) > 0))


def is_code(text: Column, words: tuple[str, ...] = (" Python", " program ")) -> Column:
    """Whether a text speaks of a program: one of the words after white space is collapsed."""
    flat = F.regexp_replace(text, WS, " ")
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.instr(flat, w) > 0)


def token_subset(part: Column, whole: Column) -> Column:
    """Whether every token of one array is in the other."""
    return F.size(F.array_except(part, whole)) == 0


def joined_lines(rows: DataFrame, group: list[str], order: str, text: str, out: str = "answer") -> DataFrame:
    """The texts of a group in order, one a line."""
    g = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_a"))
    return g.select(*group, F.array_join(F.transform("_a", lambda x: x["t"]), "\n").alias(out))


# -- tables ----------------------------------------------------------------------------------------


def distinct_samples(samples: DataFrame, *more: str) -> DataFrame:
    """Distinct samples of each task in order of input and target (a range sort, so written files are in order)."""
    cols = [*more, "task", "input", "target"]
    return samples.select(*cols).distinct().orderBy(*cols)


def paired_by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables side by side, first with first; ``row`` is the place.  Tables of unequal length stop the job.

    Both sides must name their columns apart.
    """
    a = stored(ranked(left, left_order, None, "row"), "left")
    b = stored(ranked(right, right_order, None, "row"), "right")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be paired with {m}")
    return a.join(b, "row")


def with_synonyms(samples: DataFrame, task_idx: str = "task_idx", text: str = "text", tag: str = "<LM>") -> DataFrame:
    """Each sample under every prompt of its task: an equi-join with the fixed catalogue; adds ``task, canonical, input``."""
    cat = F.broadcast(catalog.catalogue(samples.sparkSession))  # fixed values
    return samples.join(cat, task_idx).select(*samples.columns, "task", "canonical", F.concat(F.lit(tag), F.col("prompt"), F.lit(" "), F.col(text)).alias("input"))


def derived_rows(rows: DataFrame, key: str, first: str, second: Column, kind: str, seed: str = "derive", end: str = "</s>") -> DataFrame:
    """Rows of sibling tasks made from pairs of texts: ``key, task, input, target``.

    ``kind`` is ``detox`` (two toxicity rows and four paraphrase rows each) or
    ``simplification`` (four paraphrase rows each).  ``second`` is the rewritten text of
    each row: both orders are a paraphrase, and both orders with the rewritten text of the
    next row in hash order are none.  A single row has no other to differ from: no negatives then.
    """
    if kind not in ("detox", "simplification"):
        raise ValueError(f"unknown kind {kind}")
    r = rows.select(key, F.col(first).alias("_a"), second.alias("_b")).withColumn("_h", key_hash(seed, F.col(key)))
    r = stored(ranked(r, ["_h", key], None, "_r"), "ranked")
    n = r.count()
    other = r.select(F.pmod(F.col("_r") - 1, F.lit(max(n, 1))).alias("_to"), F.col("_b").alias("_c"))
    j = r.join(other, F.col("_r") == F.col("_to"))
    row = lambda task, source, target: F.struct(F.lit(task).alias("task"), source.alias("input"), F.lit(target + end).alias("target"))
    two = lambda x, y: F.concat(x, F.lit("\n"), y)
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    made = [row("toxicity_detection", a, "yes"), row("toxicity_detection", b, "no")] if kind == "detox" else []
    made += [row("paraphrase_detection", two(a, b), "yes"), row("paraphrase_detection", two(b, a), "yes")]
    if n > 1:
        made += [row("paraphrase_detection", two(a, c), "no"), row("paraphrase_detection", two(c, a), "no")]
    return j.select(key, F.explode(F.array(*made)).alias("r")).select(key, "r.*")


# -- prompts ---------------------------------------------------------------------------------------

# Wordings of our own.
_PROMPTS = {
    "question": "Read the text and write one question that it answers.\nText: {text}\nQuestion:",
    "answer": "Answer the question from the text alone.\nText: {text}\nQuestion: {question}\nAnswer:",
    "judge_answer": "Question: {question}\nAnswer: {answer}\nIs the answer right? Say yes or no:",
    "judge_code": "Task: {question}\nSolution: {answer}\nDoes the solution do the task? Say yes or no:",
}


def prompt(kind: str, **parts: Column) -> Column:
    """One of the fixed prompts about a text, a question and an answer.

    Parts go in as they are, whatever braces they hold: the template is cut first.
    """
    out, rest = [], _PROMPTS[kind]
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest))


def sample_statement(question: Column, answer: Column) -> Column:
    """A question and its answer as running text for a verifier, each closed by a full stop if need be."""
    return F.concat(closed_sentence(F.trim(question)), F.lit(" "), closed_sentence(F.trim(answer)))
