"""Dialogues: running history, validity of turn order, preference rows, few-shot and choice prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key_hash, pick
from ..functions.text import collapse
from .fuzzy import token_sort_ratio
from .ranking import ranked
from .storage import stored


def history_pairs(turns: DataFrame, task: str = "chat") -> DataFrame:
    """One row for each user turn that an assistant answers: all texts so far, and the answer.

    System turns are left out.  A dialogue is one window partition; its rows are few.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.where("role <> 'system'").select("conv_id", "turn", "role", collapse(F.col("text")).alias("text"))
    t = t.withColumn("_before", F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumns({"_role": F.lead("role").over(w), "_answer": F.lead("text").over(w)})
    pairs = t.where("role = 'user' AND _role = 'assistant'")
    return pairs.select("conv_id", "turn", F.lit(task).alias("task"), F.array_join("_before", " ").alias("input"), F.concat("_answer", F.lit("</s>")).alias("target"))


def dialogue_validity(turns: DataFrame, first: str = "user", second: str = "assistant") -> DataFrame:
    """``conv_id, n_turns, valid``: strict alternation from ``first`` on, an even number of turns, no empty text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.row_number().over(w)
    want = F.when(n % 2 == 1, first).otherwise(second)
    good = (F.col("role") == want) & (F.trim("text") != "")
    checked = turns.select("conv_id", good.alias("_ok"))
    out = checked.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min(F.coalesce("_ok", F.lit(False)).cast("int")).alias("_all"))
    return out.select("conv_id", "n_turns", ((F.col("_all") == 1) & (F.col("n_turns") >= 2) & (F.col("n_turns") % 2 == 0)).alias("valid"))


def preference_rows(turns: DataFrame, brand: str, replacement: str) -> DataFrame:
    """``conv_id, system, query, response, rejected_response, n_history, history``.

    A dialogue counts if, after an optional system turn, users and assistants alternate
    and an assistant ends it: its last answer is the response, its first one the rejected
    one, and what lies between the start and the last question is the history.  ``brand``
    is replaced everywhere.
    """
    s = F.struct("turn", "role", F.replace("text", F.lit(brand), F.lit(replacement)).alias("text"))
    d = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(s)).alias("_m"))
    d = d.withColumn("system", F.when(F.get("_m", F.lit(0))["role"] == "system", F.get("_m", F.lit(0))["text"]).otherwise(""))
    d = d.withColumn("_m", F.when(F.get("_m", F.lit(0))["role"] == "system", F.slice("_m", F.lit(2), F.greatest(F.size("_m") - 1, F.lit(0)))).otherwise(F.col("_m")))
    turned = F.forall(F.transform("_m", lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    d = d.where((F.size("_m") >= 4) & (F.size("_m") % 2 == 0) & turned)
    n = F.size("_m")
    past = F.slice("_m", F.lit(1), n - 2)
    return d.select(
        "conv_id",
        "system",
        F.get("_m", n - 2)["text"].alias("query"),
        F.get("_m", n - 1)["text"].alias("response"),
        F.get("_m", F.lit(1))["text"].alias("rejected_response"),
        (n - 2).cast("long").alias("n_history"),
        F.array_join(F.transform(past, lambda x: x["text"]), "\n").alias("history"),
    )


def few_shot_block(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)


def few_shot(samples: DataFrame, seed: str = "fewshot", least: int = 2, most: int = 5, max_chars: int = 3500) -> DataFrame:
    """``task, id, k, input, target``: a prompt of k other samples of the task before each sample.

    ``samples`` has ``task, id, input, target``.  Samples stand in hash order within their
    task; the examples of a sample are the k that follow it (around the end), so no row is
    its own example and no random state is needed.  Samples with a longer input than
    ``max_chars`` take no part; a task of fewer than ``most + 1`` samples gives no rows.
    """
    s = samples.where(F.length("input") <= max_chars).withColumn("_h", key_hash(seed, F.col("task"), F.col("id")))
    s = stored(ranked(s, ["_h", "id"], ["task"], "_r"), "ranked")
    sizes = stored(s.groupBy("task").agg(F.count("*").alias("_n")).where(F.col("_n") > most), "sizes")
    s = s.join(sizes, "task")
    s = s.withColumn("k", F.lit(least) + pick(seed + "-k", most - least + 1, F.col("task"), F.col("id")))
    wants = s.select("task", "id", "k", F.col("input").alias("_q"), "target", F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.struct(i.alias("i"), F.pmod(F.col("_r") + i, F.col("_n")).alias("r")))).alias("_e"))
    others = s.select(F.col("task").alias("_t"), F.col("_r").alias("_o"), few_shot_block(F.col("input"), F.col("target")).alias("_block"))
    joined = wants.join(others, (F.col("task") == F.col("_t")) & (F.col("_e.r") == F.col("_o")))
    out = joined.groupBy("task", "id").agg(F.first("k").alias("k"), F.first("_q").alias("_q"), F.first("target").alias("target"), F.array_sort(F.collect_list(F.struct("_e.i", "_block"))).alias("_b"))
    blocks = F.array_join(F.transform("_b", lambda b: b["_block"]), "\n\n")
    return out.select("task", "id", "k", F.concat(blocks, F.lit("\n\nQuestion: "), F.col("_q"), F.lit("\nAnswer: ")).alias("input"), "target")


def tagged_few_shot(samples: DataFrame, system: bool = False, tag: str = "<LM>", end: str = "</s>", seed: str = "fewshot", **bounds) -> DataFrame:
    """:func:`few_shot` of instruction rows ``task, id, prompt, input, target``: inputs hold the tag, the prompt and a question.

    Questions are shown without tag and prompt, answers of examples without their end mark.
    The tag stands once before all, with ``system`` followed by the prompt.  An input without
    its task's prompt, or a task in which some inputs have the tag and others not, stops the
    job.
    """
    tagged = F.startswith("input", F.lit(tag))
    bare = F.when(tagged, F.substr("input", F.lit(len(tag) + 1))).otherwise(F.col("input"))
    stop = lambda say: F.raise_error(F.concat(F.lit(say), F.col("task"))).cast("string")
    question = F.when(F.startswith(bare, F.col("prompt")), F.trim(F.substr(bare, F.length("prompt") + 1))).otherwise(stop("an input lacks the prompt of task "))
    answer = F.when(F.endswith("target", F.lit(end)), F.substr("target", F.lit(1), F.length("target") - len(end))).otherwise(F.col("target"))
    plain = samples.select("task", "id", question.alias("input"), answer.alias("target"))
    shown = few_shot(plain, seed, **bounds)
    # One row a task: its prompt, and that all its inputs have the tag or none.
    heads = samples.groupBy(F.col("task").alias("_task")).agg(F.min("prompt").alias("_prompt"), F.min(tagged).alias("_all"), F.max(tagged).alias("_any"))
    lead = F.when(F.col("_all") & F.col("_any"), tag).when(~F.col("_any"), "").otherwise(F.raise_error(F.concat(F.lit("tagged and untagged inputs in task "), F.col("_task"))).cast("string"))
    heads = heads.select("_task", F.concat(lead, F.concat("_prompt", F.lit(" ")) if system else F.lit("")).alias("_lead"))
    own = samples.select(F.col("task").alias("_t"), F.col("id").alias("_id"), F.col("target").alias("_target"))
    out = shown.join(heads, F.col("task") == F.col("_task")).join(own, (F.col("task") == F.col("_t")) & (F.col("id") == F.col("_id")))
    return out.select("task", "id", "k", F.concat("_lead", "input").alias("input"), F.col("_target").alias("target"))


def choice_prompt(question: Column, answers: Column, seed: str, key: Column, most: int = 5) -> tuple[Column, Column]:
    """(prompt, letter of the best answer) from ``array<struct<answer, score>>``.

    The ``most`` best answers are shown in hash order under letters; among equal scores
    the earlier answer is best.
    """
    placed = F.transform(answers, lambda a, i: F.struct((-a["score"]).alias("s"), i.alias("i"), a["answer"].alias("answer")))
    top = F.slice(F.array_sort(placed), 1, most)
    best = F.get(top, F.lit(0))["i"]
    shown = F.array_sort(F.transform(top, lambda a: F.struct(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), a["i"].cast("string"))).alias("h"), a["i"].alias("i"), a["answer"].alias("answer"))))
    lines = F.transform(shown, lambda a, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), a["answer"]))
    letter = F.char(F.lit(64) + F.array_position(F.transform(shown, lambda a: a["i"]), best))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer with one letter: ")), letter


def best_answers(rows: DataFrame, group: str, question: str, answer: str, score: str) -> DataFrame:
    """The best answer of each group: highest score, then longest, then first in order; only positive scores.

    An aggregate over structs, so a group of any size is reduced before it is shuffled.
    """
    good = rows.where((F.col(score) > 0) & (F.col(answer) != "") & (F.col(question) != ""))
    first = good.groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("s"), (-F.length(answer)).alias("l"), F.col(answer).alias("a"), F.col(question).alias("q"))).alias("_b"), F.count("*").alias("n_answers"))
    return first.select(group, F.col("_b.q").alias(question), F.col("_b.a").alias(answer), (-F.col("_b.s")).alias(score), "n_answers")


RAG_LAYOUTS = (
    "Context: {c}\nQuestion: {q}",
    "Question: {q}\nContext: {c}",
    "Use the text below to answer.\n{c}\n{q}",
    "{q}\nAnswer from this text: {c}",
    "Read: {c}\nThen answer: {q}",
    "{c}\n\n{q}",
    "Question: {q}\nAnswer with the help of: {c}",
    "Text: {c}\nQ: {q}",
)
RAG_REFUSALS = ("The text does not say.", "There is no answer in this text.", "The given text says nothing about it.")
#: Contexts more alike than this (0 to 100) may hold the same answer.
MOST_ALIKE = 70


def rag_samples(rows: DataFrame, key: str, seed: str = "rag", negative_share: float = 0.1) -> DataFrame:
    """``key, negative, input, target`` from ``question, context, response``.

    Some rows get the context of another row and a refusal as target: of the rows after it
    in hash order, in a circle, the first whose context is not too much like their own, by
    the ratio of the words in order.  Rounds of twice as many candidates go on for the rows
    that have none yet; only a row to which all others are too much alike stays positive.
    """
    from ..functions.hashing import uniform

    r = stored(ranked(rows.withColumn("_h", key_hash(seed, F.col(key))), ["_h", key], None, "_r"), "ranked")
    n = max(r.count(), 1)
    left = stored(r.where(uniform(seed + "-neg", F.col(key)) < negative_share).select("_r", F.col("context").alias("_own")), "unresolved")
    others = r.select(F.col("_r").alias("_to"), F.col("context").alias("_other"))
    first, begin, width = None, 1, 2
    while begin < n and left.count():
        end = min(begin + width, n)
        wants = left.select("_r", "_own", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))).alias("_i")).withColumn("_c", F.pmod(F.col("_r") + F.col("_i"), F.lit(n)))
        met = wants.join(others, F.col("_c") == F.col("_to"))
        fit = met.withColumn("_ratio", token_sort_ratio(F.col("_own"), F.col("_other"))).where(F.col("_ratio") <= MOST_ALIKE)
        found = stored(fit.groupBy("_r").agg(F.min(F.struct("_i", "_other"))["_other"].alias("_other")).withColumnRenamed("_r", "_k"), "negatives")
        first = found if first is None else first.unionByName(found)
        left = stored(left.join(found.select(F.col("_k").alias("_r")), "_r", "left_anti"), "unresolved")
        begin, width = end, 2 * width
    if first is None:
        first = r.where("false").select(F.col("_r").alias("_k"), F.col("context").alias("_other"))
    j = r.join(first, F.col("_r") == F.col("_k"), "left")
    neg = F.col("_k").isNotNull()
    shown = F.when(neg, F.col("_other")).otherwise(F.col("context"))
    layout = F.get(F.array(*map(F.lit, RAG_LAYOUTS)), pick(seed + "-layout", len(RAG_LAYOUTS), F.col(key)))
    # The question last: a text may hold a placeholder of its own.
    parts = F.split(layout, r"\{c\}|\{q\}", -1)
    c_first = F.instr(layout, "{c}") < F.instr(layout, "{q}")
    a, b = F.when(c_first, shown).otherwise(F.col("question")), F.when(c_first, F.col("question")).otherwise(shown)
    text = F.concat(F.get(parts, F.lit(0)), a, F.get(parts, F.lit(1)), b, F.get(parts, F.lit(2)))
    refusal = F.get(F.array(*map(F.lit, RAG_REFUSALS)), pick(seed + "-refusal", len(RAG_REFUSALS), F.col(key)))
    return j.select(key, neg.alias("negative"), text.alias("input"), F.when(neg, refusal).otherwise(F.col("response")).alias("target"))


def few_shot_entities(samples: DataFrame, negative: Column, seed: str = "entities", least: int = 2, most: int = 5, max_chars: int = 3500) -> DataFrame:
    """:func:`few_shot` for entity tasks: of the examples of a sample all positive ones and at most one negative.

    ``negative`` says of a target that it names no entity.  A sample whose examples are all
    negative is left out.
    """
    s = samples.where(F.length("input") <= max_chars).withColumn("_neg", negative).withColumn("_h", key_hash(seed, F.col("task"), F.col("id")))
    s = stored(ranked(s, ["_h", "id"], ["task"], "_r"), "ranked")
    s = s.join(stored(s.groupBy("task").agg(F.count("*").alias("_n")).where(F.col("_n") > most), "sizes"), "task")
    k = F.lit(least) + pick(seed + "-k", most - least + 1, F.col("task"), F.col("id"))
    wants = s.select("task", "id", F.col("input").alias("_q"), "target", F.explode(F.transform(F.sequence(F.lit(1), k), lambda i: F.struct(i.alias("i"), F.pmod(F.col("_r") + i, F.col("_n")).alias("r")))).alias("_e"))
    others = s.select(F.col("task").alias("_t"), F.col("_r").alias("_o"), F.col("_neg").alias("_no"), few_shot_block(F.col("input"), F.col("target")).alias("_block"))
    met = wants.join(others, (F.col("task") == F.col("_t")) & (F.col("_e.r") == F.col("_o")))
    g = met.groupBy("task", "id").agg(F.first("_q").alias("_q"), F.first("target").alias("target"), F.array_sort(F.collect_list(F.struct("_e.i", "_no", "_block"))).alias("_b"))
    g = g.where(F.exists("_b", lambda b: ~b["_no"]))
    first_no = F.array_min(F.transform(F.filter("_b", lambda b: b["_no"]), lambda b: b["i"]))
    kept = F.filter("_b", lambda b: ~b["_no"] | (b["i"] == first_no))
    blocks = F.array_join(F.transform(kept, lambda b: b["_block"]), "\n\n")
    return g.select("task", "id", F.size(kept).alias("k"), F.concat(blocks, F.lit("\n\nQuestion: "), F.col("_q"), F.lit("\nAnswer: ")).alias("input"), "target")


def same_tags(examples: Column, tag: str = "<LM>", end: str = "</s>") -> Column:
    """Whether ``array<struct<input, target>>`` all have the tag and end mark, or none has; a prompt must not mix both."""
    tagged = F.transform(examples, lambda e: (F.startswith(e["input"], F.lit(tag)) & F.endswith(e["target"], F.lit(end))))
    bare = F.transform(examples, lambda e: (~F.startswith(e["input"], F.lit(tag)) & ~F.endswith(e["target"], F.lit(end))))
    return F.forall(tagged, lambda x: x) | F.forall(bare, lambda x: x)
