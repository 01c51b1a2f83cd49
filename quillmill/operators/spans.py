"""Character spans: paragraphs, tokens, unions, containment, tags, span and object tables."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import TOKEN, WS
from .intervals import contained as contained
from .intervals import interval_union as interval_union

#: A token with the white space before it: these tile a text, so their lengths give offsets.
SPACED_TOKEN = r"\s*(?:" + TOKEN + ")"


def running_ends(lengths: Column) -> Column:
    """Running sums of an array of lengths, inclusive: where each of the pieces that tile a text ends.

    Only the lengths leave the JVM, as flat arrays of numbers; no row is shuffled.
    """

    @F.arrow_udf("array<int>")
    def run(arrays: pa.Array) -> pa.Array:
        offsets = np.asarray(arrays.offsets)
        # Sums over all rows may wrap around; the differences within a row are right all the same.
        ends = np.cumsum(np.asarray(arrays.values)[offsets[0] : offsets[-1]], dtype=np.int32)
        offsets = offsets - offsets[0]
        before = np.concatenate([np.zeros(1, np.int32), ends])[offsets[:-1]]
        ends -= np.repeat(before, np.diff(offsets))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends), mask=arrays.is_null())

    return run(lengths)


def lines_with_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line, start, raw``: every line and the code point at which it begins."""
    split = docs.select(key, F.split(text, "\n").alias("_l"))
    ends = split.withColumn("_e", running_ends(F.transform("_l", lambda x: F.length(x) + 1)))
    rows = ends.select(key, F.posexplode(F.arrays_zip("_l", "_e")).alias("line", "_x"))
    return rows.select(key, "line", (F.col("_x._e") - F.length("_x._l") - 1).alias("start"), F.col("_x._l").alias("raw"))


def paragraph_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line, start, end`` of the stripped lines that are not blank (half-open code points)."""
    r = lines_with_offsets(docs, key, text)
    left = F.length("raw") - F.length(F.regexp_replace("raw", f"^{WS}", ""))
    body = F.length(F.regexp_replace(F.regexp_replace("raw", f"^{WS}", ""), f"{WS}$", ""))
    return r.select(key, "line", (F.col("start") + left).alias("start"), (F.col("start") + left + body).alias("end")).where("end > start")


def token_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tok, token, start, end`` of every token."""
    split = docs.select(key, F.regexp_extract_all(text, F.lit(SPACED_TOKEN), 0).alias("_s"))
    ends = split.withColumn("_e", running_ends(F.transform("_s", F.length)))
    rows = ends.select(key, F.posexplode(F.arrays_zip("_s", "_e")).alias("tok", "_x"))
    cut = rows.select(key, "tok", F.regexp_replace("_x._s", r"^\s+", "").alias("token"), F.col("_x._e").alias("end"))
    return cut.select(key, "tok", "token", (F.col("end") - F.length("token")).alias("start"), "end")


def object_bounds(objects: DataFrame, spans: DataFrame, doc: str = "doc") -> DataFrame:
    """``doc, object_id, class, start, end`` from objects that list span ids.

    An unknown span id or one listed twice stops the job, and so does an unknown type.
    """
    kinds = F.create_map(*(F.lit(x) for kv in {"person": "person", "location": "location", "org": "organization", "locorg": "location"}.items() for x in kv))
    twice = F.size("span_ids") != F.size(F.array_distinct("span_ids"))
    ids = objects.select(doc, "object_id", F.lower("type").alias("type"), F.explode(F.when(twice, F.raise_error(F.lit("span listed twice")).cast("array<int>")).otherwise(F.col("span_ids"))).alias("span_id"))
    j = ids.join(spans.select(doc, "span_id", "start", "len"), [doc, "span_id"], "left")
    start = F.when(F.col("start").isNull(), F.raise_error(F.concat(F.lit("unknown span "), F.col("span_id").cast("string"))).cast("int")).otherwise(F.col("start"))
    kind = F.coalesce(F.element_at(kinds, F.col("type")), F.raise_error(F.concat(F.lit("unknown type "), F.col("type"))).cast("string"))
    return j.select(doc, "object_id", kind.alias("class"), start.alias("start"), (start + F.col("len")).alias("end")).groupBy(doc, "object_id", "class").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def with_quotes(text: Column, start: Column, end: Column, left: str = "«", right: str = "»") -> tuple[Column, Column]:
    """Bounds extended to adjacent quotes where the quotes inside are then balanced."""
    count = lambda s, q: F.length(s) - F.length(F.replace(s, F.lit(q), F.lit("")))
    cut = lambda a, b: F.substr(text, a + 1, b - a)
    a = F.when(F.substr(text, start, F.lit(1)) == left, start - 1).otherwise(start)
    b = F.when(F.substr(text, end + 1, F.lit(1)) == right, end + 1).otherwise(end)
    even = lambda x, y: count(cut(x, y), left) == count(cut(x, y), right)
    out = F.when(even(a, b), F.struct(a.alias("s"), b.alias("e"))).when(even(a, end), F.struct(a.alias("s"), end.alias("e"))).when(even(start, b), F.struct(start.alias("s"), b.alias("e"))).otherwise(F.struct(start.alias("s"), end.alias("e")))
    return out["s"], out["e"]


#: Characters of all phrases up to which they are searched for at once, in the memory of each task.
MOST_PHRASE_CHARS = 16 << 20
#: Rows that a Python function hands back at once.
MOST_ROWS = 1 << 14


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", phrase_key: str = "item_id", phrase: str = "text", most_chars: int = MOST_PHRASE_CHARS) -> DataFrame:
    """``key, phrase_key, start, end`` of every place of each phrase in each document, overlapping ones too.

    The size of the phrases is asked first.  Up to ``most_chars`` characters they become one
    automaton, with which each document is read once, in place.  Beyond that, inner words
    of a phrase (its second to fifth) are looked up among all runs of four words of the
    documents by an equi-join on their hash, and what meets is searched for; phrases under
    six words have no such run and go by the automaton, in portions.  Empty and null
    phrases are nowhere.
    """
    given = phrases.select(F.col(phrase_key), F.col(phrase).alias("_p")).where(F.length("_p") > 0)
    rows = docs.select(key, F.col(text).alias("_t"))
    if (given.agg(F.sum(F.length("_p"))).first()[0] or 0) <= most_chars:
        return _searched(rows, given, key, phrase_key)
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    four = lambda w, i: F.xxhash64(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3)))
    split = given.withColumn("_w", words(F.col("_p")))
    p = split.where(F.size("_w") >= 6).select(phrase_key, "_p", four(F.col("_w"), F.lit(1)).alias("_h"))
    d = rows.select(key, words(F.col("_t")).alias("_w"))
    grams = d.where(F.size("_w") >= 4).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_w") - 4), lambda i: four(F.col("_w"), i)))).alias("_h"))
    met = grams.join(p, "_h").select(key, phrase_key, "_p").join(rows, key)
    long = met.withColumn("start", F.explode(_places(F.col("_t"), F.col("_p")))).select(key, phrase_key, "start", (F.col("start") + F.length("_p")).cast("int").alias("end"))
    short = split.where(F.size("_w") < 6).select(phrase_key, "_p")
    portions = -(-(short.agg(F.sum(F.length("_p"))).first()[0] or 0) // most_chars)
    for i in range(portions):
        long = long.unionByName(_searched(rows, short.where(F.pmod(F.xxhash64("_p"), F.lit(portions)) == i), key, phrase_key))
    return long


def _searched(rows: DataFrame, phrases: DataFrame, key: str, phrase_key: str) -> DataFrame:
    """All places of phrases whose size was checked, by one automaton a task."""
    kinds = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{phrase_key}` {phrases.schema[phrase_key].dataType.simpleString()}"
    own_type = to_arrow_type(phrases.schema[phrase_key].dataType)
    by_text: dict[str, list] = {}
    for k, p in phrases.toLocalIterator():
        by_text.setdefault(p, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p, keys in by_text.items():
            machine.add_word(p, (len(p), keys))
        machine.make_automaton()
        for b in batches:
            for i, t in enumerate(b.column(1)):
                # One text at a time becomes a Python string.
                found = [(own, last + 1 - n, last + 1) for last, (n, keys) in machine.iter(t.as_py()) for own in keys] if t.is_valid and t.as_py() else []
                for at in range(0, len(found), MOST_ROWS):
                    own, start, end = zip(*found[at : at + MOST_ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(own))), pa.array(own, own_type), pa.array(start, pa.int32()), pa.array(end, pa.int32())], [key, phrase_key, "start", "end"])

    if not by_text:
        return rows.select(key, F.lit(None).cast(phrases.schema[phrase_key].dataType).alias(phrase_key), F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    return rows.mapInArrow(run, f"{kinds}, start int, end int")


def _places(text: Column, phrase: Column) -> Column:
    def places(t: str, p: str) -> list[int]:
        out, at = [], t.find(p)
        while at >= 0:
            out.append(at)
            at = t.find(p, at + 1)
        return out

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([places(t, p) for t, p in zip(texts, found, strict=True)], dtype=object)

    return run(text, phrase)


def bio_tags(tokens: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, tok, token, tags``: B- for a token at an entity's start, I- inside; several joined by commas, none is O.

    Entities have ``class, start, end``; tags come in the order of start, class, end.
    """
    e = entities.select(F.col(key).alias("_k"), F.col("class"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (tokens[key] == e["_k"]) & (tokens["start"] >= e["_s"]) & (tokens["end"] <= e["_e"])
    tag = F.concat(F.when(tokens["start"] == e["_s"], "B-").otherwise("I-"), F.col("class"))
    j = tokens.join(e, on, "left").withColumn("_t", F.when(F.col("_k").isNotNull(), F.struct("_s", "class", "_e", tag.alias("tag"))))
    g = j.groupBy(key, "tok", "token").agg(F.array_sort(F.collect_list("_t")).alias("_a"))
    return g.select(key, "tok", "token", F.when(F.size("_a") == 0, "O").otherwise(F.array_join(F.transform("_a", lambda x: x["tag"]), ",")).alias("tags"))


def conll_text(tagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token and tags by tabs, one token a line."""
    g = tagged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tok", "token", "tags"))).alias("_a"))
    return g.select(key, F.array_join(F.transform("_a", lambda x: F.concat_ws("\t", x["token"], x["tags"])), "\n").alias("target"))


def tiles(bounds: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, ok``: whether the spans tile the text: from 0 to its length, none empty, no gap or overlap."""
    w = Window.partitionBy(key).orderBy("start", "end")
    checked = bounds.withColumn("_ok", (F.col("start") == F.coalesce(F.lag("end").over(w), F.lit(0))) & (F.col("end") > F.col("start")))
    g = checked.groupBy(key).agg(F.min(F.col("_ok").cast("int")).alias("_all"), F.max("end").alias("_last"))
    return lengths.join(g, key, "left").select(key, (F.coalesce("_all", F.lit(0)) == 1).alias("_a"), (F.coalesce("_last", F.lit(0)) == F.col("n")).alias("_b")).select(key, (F.col("_a") & F.col("_b")).alias("ok"))


# Alignment of entity strings with tokens: inherently procedural, so an Arrow-backed function.


def locate(tokens: list[str], phrase: list[str], start: int = 0) -> int:
    """First place of a token run from ``start`` on, whatever the case; -1 if nowhere, an empty one nowhere."""
    low, want = [t.lower() for t in tokens], [t.lower() for t in phrase]
    if not want:
        return -1
    for i in range(start, len(low) - len(want) + 1):
        if low[i : i + len(want)] == want:
            return i
    return -1


def label_tokens(tokens: list[str], entities: list[list[str]], name: str) -> list[str]:
    """BIO labels from entities in order of mention; the place to search from moves past each hit."""
    out, at = ["O"] * len(tokens), 0
    for e in entities:
        i = locate(tokens, e, at)
        if i >= 0:
            for k in range(len(e)):
                out[i + k] = ("B-" if k == 0 else "I-") + name
            at = i + len(e)
    return out


def align(tokens: list[str], entities: list[list[str]], nested: bool = False) -> tuple[list[tuple[int, int]], int]:
    """Token bounds of entities in order and the number not found, the best of all ways to place them.

    After a hit the next entity may begin behind it or, overlapping, at its start; an
    entity that is not found costs one.  Fewest misses win, then the count of distinct
    bounds nearest to that of the entities, then the least bounds.  Without ``nested``, ways
    with one entity inside another do not count; if none is left there are no bounds.

    Starts never decrease along a way, so what the rest can still gain depends on the place
    and on the bounds that share the last start alone: the ways are layers of such states,
    one layer an entity, and the best rest of each is found from the last layer back.
    """
    low = [t.lower() for t in tokens]
    wanted = [tuple(t.lower() for t in e) for e in entities if e]
    places: dict[tuple, list[int]] = {e: [] for e in wanted}
    by_first: dict[str, list[tuple]] = {}
    for e in places:
        by_first.setdefault(e[0], []).append(e)
    for i, t in enumerate(low):
        for e in by_first.get(t, ()):
            if tuple(low[i : i + len(e)]) == e:
                places[e].append(i)

    # A state: where to search on, and the bounds with the last start (without nesting: the last bounds).
    layers: list[dict[tuple, list[tuple]]] = []
    now = {(0, frozenset())}
    for e in wanted:
        moves: dict[tuple, list[tuple]] = {}
        for at, held in now:
            found = places[e]
            k = bisect_left(found, at)
            if k == len(found):
                moves[at, held] = [((at, held), 1, None)]
                continue
            here = (found[k], found[k] + len(e))
            if here in held:
                fresh, kept = None, held
            elif nested:
                same = held if held and next(iter(held))[0] == here[0] else frozenset()
                fresh, kept = here, same | {here}
            elif any(here[0] == s or here[1] <= f for s, f in held):
                moves[at, held] = []
                continue
            else:
                fresh, kept = here, frozenset([here])
            behind = frozenset() if nested else kept
            moves[at, held] = [((here[1], behind), 0, fresh), ((here[0], kept), 0, fresh)]
        layers.append(moves)
        now = {state for out in moves.values() for state, _, _ in out}
    # Of each state the best rest: misses, distinct bounds (more are better), the bounds.
    best: dict[tuple, tuple] = {state: (0, 0, ()) for state in now}
    for moves in reversed(layers):
        new = {}
        for state, out in moves.items():
            rest = [(best[to][0] + miss, best[to][1] - (fresh is not None), best[to][2] if fresh is None else tuple(sorted((fresh, *best[to][2])))) for to, miss, fresh in out if to in best]
            if rest:
                new[state] = min(rest)
        best = new
    if (0, frozenset()) not in best:
        return [], len(wanted)
    misses, _, bounds = best[0, frozenset()]
    return list(bounds), misses


def aligned(rows: DataFrame, key: str, tokens: str = "tokens", entities: str = "entities") -> DataFrame:
    """``key, start, end, misses`` in token numbers; the tokens of one row at a time become Python strings."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, (t, e) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                bounds, misses = align(t.values.to_numpy(zero_copy_only=False).tolist(), e.as_py())
                out += [(i, s, f, misses) for s, f in bounds] or [(i, -1, -1, misses)]
                if i + 1 == b.num_rows or len(out) >= MOST_ROWS:
                    at, *rest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(x, pa.int32()) for x in rest)], [key, "start", "end", "misses"])
                    out = []

    return rows.select(key, tokens, entities).mapInArrow(run, f"`{key}` {kind}, start int, end int, misses int")


def decoded_tags(tagged: DataFrame, key: str = "doc_id", tok: str = "tok", tags: str = "tags") -> DataFrame:
    """``key, class, start, end`` in token numbers (half-open) from BIO tags, several a token joined by commas.

    A B- tag begins a span, an I- tag goes on with an open one of its class and begins one
    where there is none; anything else ends it.
    """
    each = tagged.select(key, F.col(tok).alias("_t"), F.explode(F.split(tags, ",")).alias("_x")).where("_x <> 'O'")
    each = each.select(key, "_t", F.substring("_x", 1, 1).alias("_bio"), F.substr("_x", F.lit(3)).alias("class"))
    w = Window.partitionBy(key, "class").orderBy("_t", "_bio")
    fresh = F.when((F.col("_bio") == "B") | F.lag("_t").over(w).isNull() | (F.lag("_t").over(w) < F.col("_t") - 1), 1).otherwise(0)
    runs = each.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "class", "_g").agg(F.min("_t").alias("start"), (F.max("_t") + 1).alias("end")).drop("_g")


def entity_labels(rows: DataFrame, name: str, text: str = "text", entities: str = "entities", out: str = "labels", strict: bool = False, end_mark: str = "</s>") -> DataFrame:
    """Add ``tokens`` and a BIO label for each from an array of entity texts in order of mention.

    End marks at a text's end are taken off.  Entities are found greedily from left to
    right; one that is not found is skipped, or stops the job with ``strict``.
    """
    clean = F.regexp_replace(F.col(text), r"(\s*" + re.escape(end_mark) + r")+\s*$", "")
    with_tokens = rows.withColumn("tokens", F.regexp_extract_all(clean, F.lit(TOKEN), 0))
    phrases = F.transform(entities, lambda e: F.regexp_extract_all(e, F.lit(TOKEN), 0))

    @F.pandas_udf("array<string>")
    def run(tokens: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, e in zip(tokens, wanted, strict=True):
            t, e = list(t), [list(x) for x in e]
            labels = label_tokens(t, e, name)
            if strict and sum(x.startswith("B-") for x in labels) != sum(bool(x) for x in e):
                raise ValueError("an entity is not in its text")
            out.append(labels)
        return pd.Series(out, dtype=object)

    return with_tokens.withColumn(out, run(F.col("tokens"), phrases))


def split_texts(rows: DataFrame, most: int, text: str = "text", ends: Callable[[str], list[int]] | None = None) -> DataFrame:
    """Every text as pieces of at most ``most`` tokens: all columns, ``piece, first, last, start, end``.

    A text that is too long is halved at its middle sentence (or middle token) until its
    pieces fit; tokens are ``first`` to ``last`` (half-open), code points ``start`` to
    ``end``.  ``ends`` gives the token numbers behind which sentences end.
    """
    from .fuzzy import sentence_ends

    split = ends or sentence_ends

    @F.pandas_udf("array<struct<first:int,last:int,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            places = [m.span() for m in re.finditer(r"\w+|[^\w\s]+", t or "")]
            bounds = split_long([t[a:b] for a, b in places], split(t or ""), most)
            out.append([{"first": a, "last": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in bounds])
        return pd.Series(out, dtype=object)

    cut = rows.select("*", F.posexplode(run(F.col(text))).alias("piece", "_p"))
    return cut.select(*rows.columns, "piece", "_p.first", "_p.last", "_p.start", "_p.end")


def split_long(tokens: list[str], ends: list[int], most: int) -> list[tuple[int, int]]:
    """Token bounds of pieces of at most ``most`` tokens, by halving at the middle sentence, else the middle token."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(tokens))]
    while todo:
        a, b = todo.pop()
        if b - a <= max(1, most):
            out.append((a, b))
            continue
        inner = [e for e in ends if a < e < b]
        cut = inner[len(inner) // 2] if inner else (a + b) // 2
        todo += [(cut, b), (a, cut)]
    return [x for x in out if x[1] > x[0]]
