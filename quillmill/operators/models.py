"""Calls to external models as injected functions over batches.

A caller gives a factory; it runs once in each worker and returns a function from a list
of texts to a list of results of the same length.  Nothing here loads a model by itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.text import collapse, judged_bad
from .storage import stored


def _batched(rows: DataFrame, text: str, out: str, kind: str, factory: Callable, batch: int) -> DataFrame:
    """Add a model's results; of the rows that Spark hands over, only those of one call become Python objects."""
    kept = [f.name for f in rows.schema if f.name != out]
    schema = StructType([*(f for f in rows.schema if f.name != out), StructField(out, _parse_datatype_string(kind))])
    made_type, at, text_at = to_arrow_type(schema[out].dataType), [rows.columns.index(c) for c in kept], rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                made = list(call([t or "" for t in part.column(text_at).to_numpy(zero_copy_only=False)]))
                if len(made) != part.num_rows:
                    raise ValueError("a model must answer every text of its batch")
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in at), pa.array(made, made_type, from_pandas=True)], [*kept, out])

    return rows.mapInArrow(run, schema)


def correction_limit(text: str) -> int:
    """The most tokens that a corrected text may have: twice its words, and ten."""
    return 2 * len(text.split()) + 10


def answered(rows: DataFrame, factory: Callable, text: str = "input", out: str = "predicted", least_chars: int = 0, batch: int = 64, limit: Callable[[str], int] | None = None) -> DataFrame:
    """Add a model's text answers, stripped, line ends unified.

    Texts of at most ``least_chars`` characters bypass the model and come back as they are
    (blank ones as empty).  With ``limit`` the model also gets the most tokens that each
    answer may have.
    """

    def clean():
        call = factory()

        def run(texts: list[str]) -> list[str]:
            todo = [i for i, t in enumerate(texts) if len(t.strip()) > least_chars]
            done = [t.strip() for t in texts]
            if todo:
                asked = [texts[i] for i in todo]
                made = call(asked) if limit is None else call(asked, [limit(t) for t in asked])
                for i, a in zip(todo, made, strict=True):
                    done[i] = a.strip().replace("\r\n", "\n")
            return done

        return run

    return _batched(rows, text, out, "string", clean, batch)


def remote_answers(rows: DataFrame, factory: Callable, text: str = "input", out: str = "answer", error: str = "error") -> DataFrame:
    """Answers of a service that takes one prompt at a time; a blank prompt or a failure gives an empty one.

    ``error`` names the failure of a row (null if there was none), so that failures can be
    counted and asked again.
    """

    def safe():
        call = factory()

        def one(t: str) -> dict:
            if not t.strip():
                return {"answer": "", "error": None}
            try:
                return {"answer": call(t), "error": None}
            except Exception as e:  # any failure of the service is an empty answer, and said
                return {"answer": "", "error": f"{type(e).__name__}: {e}"}

        return lambda texts: [one(t) for t in texts]

    made = _batched(rows, text, "_made", "struct<answer:string,error:string>", safe, 64)
    return made.withColumns({out: F.col("_made.answer"), error: F.col("_made.error")}).drop("_made")


def translated(rows: DataFrame, factory: Callable, text: str = "text", code: str | None = None, out: str = "translation", score: str = "translation_score", batch: int = 64) -> DataFrame:
    """Add translations and their scores; the model returns (text, score) for each of a list of texts.

    Texts are translated line by line and keep their line structure; the score is the least
    of the lines' (null where nothing was translated).  Blank lines stay, and where the
    boolean column ``code`` says that a text is a program only its comment lines are
    translated.
    """
    marked = rows.withColumn("_source", F.to_json(F.struct(F.coalesce(F.col(text), F.lit("")).alias("t"), (F.coalesce(F.col(code), F.lit(False)) if code else F.lit(False)).alias("c"))))

    def by_line():
        call = factory()

        def run(texts: list[str]) -> list[dict]:
            todo, sheets = [], []
            for x in map(json.loads, texts):
                lines = x["t"].split("\n")
                sheets.append(lines)
                for i, line in enumerate(lines):
                    if line.strip() and (not x["c"] or line.strip().startswith("#")):
                        todo.append((len(sheets) - 1, i))
            least: list[float | None] = [None] * len(sheets)
            for (k, i), (made, s) in zip(todo, call([sheets[k][i] for k, i in todo]) if todo else [], strict=True):
                sheets[k][i] = made.strip()
                least[k] = s if least[k] is None else min(least[k], s)
            return [{"text": "\n".join(lines), "score": s} for lines, s in zip(sheets, least, strict=True)]

        return run

    made = _batched(marked, "_source", "_made", "struct<text:string,score:double>", by_line, batch)
    return made.withColumns({out: F.col("_made.text"), score: F.col("_made.score")}).drop("_made", "_source")


def classified(rows: DataFrame, factory: Callable, first: str, second: str, positive: str, out: str = "hallucination_score", batch: int = 64) -> DataFrame:
    """The greater probability of ``positive`` for both orders of two texts.

    The model returns (label, score) for each text; a score of another label counts as
    1 - score.
    """

    def probability():
        call = factory()
        return lambda texts: [s if label == positive else 1.0 - s for label, s in call(texts)]

    pair = lambda a, b: F.concat(F.coalesce(F.col(a), F.lit("")), F.lit("\n"), F.coalesce(F.col(b), F.lit("")))
    # Each order is made for its own call only and does not go through the other.
    one = _batched(rows.withColumn("_ab", pair(first, second)), "_ab", "_p1", "double", probability, batch).drop("_ab")
    two = _batched(one.withColumn("_ba", pair(second, first)), "_ba", "_p2", "double", probability, batch)
    return two.withColumn(out, F.greatest("_p1", "_p2")).drop("_ba", "_p1", "_p2")


def verified(rows: DataFrame, factory: Callable, prompt: str, out: str = "verification", most_tokens: int = 5, batch: int = 64) -> DataFrame:
    """A verifier's first words on a prompt, white space collapsed."""
    answers = answered(rows, factory, prompt, "_verdict", batch=batch)
    words = F.filter(F.split(collapse(F.col("_verdict")), " "), lambda w: w != "")
    return answers.withColumn(out, F.array_join(F.slice(words, 1, most_tokens), " ")).drop("_verdict")


def sentence_vectors(rows: DataFrame, factory: Callable, text: str = "text", out: str = "vector", batch: int = 64) -> DataFrame:
    """One vector of length 1 for each text (all zeros stay zeros); the model returns a vector a text."""
    made = _batched(rows, text, "_vector", "array<double>", factory, batch)
    norm = F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda s, x: s + x * x))
    return made.withColumn(out, F.transform("_vector", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))).drop("_vector")


def plain_tags(texts: list[str]) -> list[list[tuple]]:
    """The default tagger: tokens in place, no tags, lower-case forms as lemmas, sentences by their marks."""
    out = []
    for t in texts:
        sentence, tokens = 0, []
        for m in re.finditer(r"\w+|[^\w\s]+", t):
            tokens.append((m.group(), m.start(), m.end(), "", "", m.group().lower(), sentence))
            sentence += m.group()[-1] in ".!?…"
        out.append(tokens)
    return out


def tagged(rows: DataFrame, factory: Callable | None = None, text: str = "text", out: str = "tokens", batch: int = 64) -> DataFrame:
    """Add ``array<struct<token, start, end, tag, dep, lemma, sentence>>`` by an injected tagger."""
    names = ("token", "start", "end", "tag", "dep", "lemma", "sentence")

    def named():
        call = (factory or (lambda: plain_tags))()
        return lambda texts: [[dict(zip(names, t, strict=True)) for t in tokens] for tokens in call(texts)]

    return _batched(rows, text, out, "array<struct<token:string,start:int,end:int,tag:string,dep:string,lemma:string,sentence:int>>", named, batch)


def embedded(rows: DataFrame, factory: Callable, text: str = "text", out: str = "vectors", batch: int = 64) -> DataFrame:
    """Token vectors of each text (``array<array<float>>``); null where a text has no token."""
    return _batched(rows, text, out, "array<array<float>>", factory, batch)


def scored(rows: DataFrame, factory: Callable, text: str = "text", out: str = "score", batch: int = 64) -> DataFrame:
    return _batched(rows, text, out, "double", factory, batch)


def judged(rows: DataFrame, factory: Callable, first: str, second: str, out: str = "hallucination") -> DataFrame:
    """A yes/no judge on two prompts; the second is only asked where the first passes."""
    a = answered(rows, factory, first, "_v1").withColumn("_bad", judged_bad(F.col("_v1")))
    b = answered(a.where("NOT _bad"), factory, second, "_v2")
    kept = b.withColumn(out, judged_bad(F.col("_v2"))).drop("_v1", "_v2", "_bad")
    return a.where("_bad").withColumn(out, F.lit(True)).drop("_v1", "_bad").unionByName(kept)


def token_lengths(texts: list[str]) -> list[int]:
    """The default length of a text where no tokenizer is given: its white-space words."""
    return [len(t.split()) for t in texts]


def capped_samples(samples: DataFrame, most: int, task: str = "task", factory: Callable | None = None) -> DataFrame:
    """The samples whose input and target have at most ``most`` tokens each, by an injected tokenizer.

    A task that the cap leaves without samples stops the job, as a cap that is too strict.
    """
    both = measured(measured(samples, "input", "_n_in", factory), "target", "_n_out", factory)
    sized = stored(both.withColumn("_fits", (F.col("_n_in") <= most) & (F.col("_n_out") <= most)), "sized")
    empty = sized.groupBy(task).agg(F.max("_fits").alias("_any")).where("NOT _any").orderBy(task).first()
    if empty is not None:
        raise ValueError(f"at most {most} tokens leave no samples of task {empty[task]}")
    return sized.where("_fits").drop("_n_in", "_n_out", "_fits")


def measured(rows: DataFrame, text: str, out: str = "n_tokens", factory: Callable | None = None, batch: int = 512) -> DataFrame:
    """Add lengths by an injected tokenizer, once for each row, to filter on."""
    return _batched(rows, text, out, "long", factory or (lambda: token_lengths), batch)
