"""The prompt catalogue: thirteen ordered tasks, a canonical prompt each, and synonyms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prompt:
    task_idx: int
    task: str
    prompt: str
    canonical: bool


_TASKS: list[tuple[str, list[str]]] = [
    ("asr_correction", ["Correct the recognition errors in this transcript.", "Repair this speech transcript."]),
    ("simplification", ["Rewrite this text in plain words.", "Make this text easier to read."]),
    ("segmentation", ["Divide this text into paragraphs.", "Insert paragraph breaks here."]),
    ("summarization", ["Give a brief summary of this text.", "Condense this text."]),
    ("ner_person", ["List every person named in this text.", "Which people are mentioned below?"]),
    ("ner_organization", ["List every organization named in this text.", "Which organizations are mentioned below?"]),
    ("ner_location", ["List every place named in this text.", "Which places are mentioned below?"]),
    ("paraphrase_detection", ["Do these two texts say the same thing?", "Decide whether both texts mean the same."]),
    ("paraphrase_generation", ["Say this in other words."]),
    ("toxicity_detection", ["Is this text offensive?", "Tell whether this text insults anyone."]),
    ("detoxification", ["Rewrite this text politely.", "Remove the rudeness from this text."]),
    ("sentiment_analysis", ["What is the mood of this text?", "Name the sentiment expressed here."]),
    ("logical_inference", ["Does the second statement follow from the first?"]),
]

CATALOGUE = [Prompt(i, task, p, k == 0) for i, (task, prompts) in enumerate(_TASKS) for k, p in enumerate(prompts)]
CANONICAL = {p.task_idx: p.prompt for p in CATALOGUE if p.canonical}
NOT_AT_START = -2
UNKNOWN = -1


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of a few dozen rows."""
    return spark.createDataFrame([(p.task_idx, p.task, p.prompt, p.canonical) for p in CATALOGUE], "task_idx int, task string, prompt string, canonical boolean")


def matched(text: Column, tag: str = "<LM>") -> Column:
    """struct(task_idx, prompt): the first prompt contained in the text, by task, canonical first.

    The catalogue is a literal array, so there is no join and no shuffle.  ``task_idx`` is -1 if none is
    contained and -2 if the first one is not right after the tag.
    """
    body = F.when(F.startswith(text, F.lit(tag)), F.substr(text, F.lit(len(tag) + 1))).otherwise(text)
    every = F.array(*(F.struct(F.lit(p.task_idx).alias("task_idx"), F.lit(p.prompt).alias("prompt")) for p in CATALOGUE))
    first = F.get(F.filter(every, lambda p: F.contains(body, p["prompt"])), F.lit(0))
    idx = F.when(first.isNull(), UNKNOWN).when(F.startswith(body, first["prompt"]), first["task_idx"]).otherwise(NOT_AT_START)
    return F.struct(idx.alias("task_idx"), F.coalesce(first["prompt"], F.lit("")).alias("prompt"))


def context(text: Column, tag: str = "<LM>") -> Column:
    """What follows the matched prompt, without white space at its ends and leading dashes."""
    body = F.when(F.startswith(text, F.lit(tag)), F.substr(text, F.lit(len(tag) + 1))).otherwise(text)
    rest = F.substr(body, F.length(matched(text, tag)["prompt"]) + 1)
    return F.regexp_replace(F.regexp_replace(rest, r"^[\s-]+", ""), r"\s+$", "")


def variant(task_idx: Column, key: Column, training: bool = True, seed: str = "variant") -> Column:
    """A prompt of the task: any of its prompts by the row's key for training, the canonical one otherwise."""
    from .hashing import pick

    if not training:
        return F.get(F.array(*(F.lit(CANONICAL[i]) for i in sorted(CANONICAL))), task_idx)
    every = F.array(*(F.array(*(F.lit(p.prompt) for p in CATALOGUE if p.task_idx == i)) for i in sorted(CANONICAL)))
    own = F.get(every, task_idx)
    return F.get(own, pick(seed, F.size(own), key))
