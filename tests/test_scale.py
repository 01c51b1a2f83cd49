"""Mechanisms for groups of any size, against plain versions: machines, intervals, alignment, selection, edits."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.operators import dialog, fuzzy, generate, intervals, models, scan, sections, selection, spans


def test_machines_equal_a_walk(spark):
    """Random machines over one hot key, small ones and null, in more batches than partitions."""
    rnd = random.Random(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rows = [(rnd.choice([0, 0, 0, 0, 1, 2, 3, None]), i, [rnd.randrange(5) for _ in range(5)], "x") for i in range(700)]
        df = spark.createDataFrame(rows, "k int, n int, m array<int>, state_of string").repartition(6)
        counted = df.withColumn("w", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: i * (F.col("n") % 3)).cast("array<long>"))
        out = scan.scanned(counted, ["k"], ["n"], "m", 5, sums={"total": "w"})
        assert out.columns == ["k", "n", "state_of", "_part", "state", "total"]
        got = {r.n: (r.state, r.total) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, now = {}, {}
    for k, n, m, _ in rows:
        state, total = now.get(k, (0, 0))
        want[n] = (state, total + (state + 1) * (n % 3))
        now[k] = (m[state], want[n][1])
    assert got == want
    assert {r.n: r.state for r in scan.scanned(df, ["k"], ["n"], "m", 5).collect()} == {n: state for n, (state, _) in want.items()}
    assert scan.scanned(df.where("false"), ["k"], ["n"], "m", 5).collect() == []
    with pytest.raises(ValueError, match="states"):
        scan.scanned(df, ["k"], ["n"], "m", 65)


def test_scanned_paragraphs_equal_those_of_a_row(spark):
    rnd = random.Random(6)
    bits = ["Title here", "and on it goes", "UPPER CASE", "", "  ", "***", "- a dash", "7 of them", "it ends.", "éa élan", "--", "x" * 50, None]
    texts = {k: [rnd.choice(bits) for _ in range(n)] for k, n in ((1, 400), (2, 30), (3, 1), (4, 0))}
    lines = spark.createDataFrame([(k, i, t) for k, ls in texts.items() for i, t in enumerate(ls)], "doc_id int, line int, raw string")
    docs = spark.createDataFrame([(k, "\n".join(t or "" for t in ls)) for k, ls in texts.items() if ls], "doc_id int, text string")
    cols = ["doc_id", "text_no", "par", "paragraph"]
    want = sections.document_paragraphs(docs).select(*cols).collect()
    assert sorted(map(tuple, sections.scanned_paragraphs(lines, "doc_id", ["line"]).select(*cols).collect())) == sorted(map(tuple, want))
    filled = lines.na.fill("")
    got = sections.scanned_sections(lines, "doc_id", ["line"], "raw").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, sections.wiki_sections(filled, "doc_id", "line", "raw").collect()))


def test_overlaps_equal_all_pairs(spark):
    rnd = random.Random(8)
    span = lambda far: (lambda a: (a, a + rnd.choice([0, 1, 1, 3, 30, 400, 9000])))(rnd.randrange(far))
    inner = [(rnd.choice([1, 1, 1, 2, None]), i, *span(20_000)) for i in range(250)]
    outer = [(rnd.choice([1, 1, 1, 2, None]), i, *span(20_000)) for i in range(250)]
    a = spark.createDataFrame(inner, "doc_id int, item int, start int, end int")
    b = spark.createDataFrame(outer, "doc_id int, line int, start int, end int")
    kind = lambda s, e, x, y: "inside" if s >= x and e <= y else "around" if s <= x and e >= y else "across"
    want = sorted((i, j, kind(s, e, x, y)) for k, i, s, e in inner for m, j, x, y in outer if k == m and s < y and x < e and s < e and x < y)
    met = intervals.overlaps(a, b, "doc_id").select("item", "outer_line", "relation").collect()
    assert sorted(map(tuple, met)) == want
    whole = {(i, j) for i, j, r in want if r == "inside"}
    assert {(r.item, r.outer) for r in intervals.contained(a.where("start < end"), b).collect()} == whole
    kept = intervals.contained(a, b, partial="keep").collect()
    assert {(r.item, r.outer) for r in kept if r.whole} == whole and len(kept) == len(want)
    with pytest.raises(Exception, match="crosses"):
        intervals.contained(a, b, partial="raise").collect()


def test_many_intervals_in_one_group(spark):
    """A sweep of 60,000 against 60,000 in one document: pairs in proportion to what meets."""
    n = 60_000
    a = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("item"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end"))
    b = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("line"), (F.col("id") * 10 - 3).alias("start"), (F.col("id") * 10 + 7).alias("end"))
    assert intervals.contained(a, b).count() == n
    union = intervals.interval_union(b.unionByName(a.select("doc_id", F.col("item").alias("line"), "start", (F.col("end") + 4).alias("end"))), "doc_id")
    assert [tuple(r) for r in union.collect()] == [(1, -3, 10 * n - 2)]


def test_alignment_equals_all_ways(spark):
    def every(tokens, entities, nested):
        wanted = [e for e in entities if e]

        def ways(i, at):
            if i == len(wanted):
                return [(0, ())]
            found = spans.locate(tokens, wanted[i], at)
            if found < 0:
                return [(p + 1, b) for p, b in ways(i + 1, at)]
            here = (found, found + len(wanted[i]))
            return list(dict.fromkeys((p, (here, *b)) for p, b in ways(i + 1, here[1]) + ways(i + 1, found)))

        options = [(p, abs(len(set(b)) - len(wanted)), tuple(sorted(set(b)))) for p, b in ways(0, 0)]
        if not nested:
            options = [o for o in options if not any(x != y and y[0] <= x[0] and x[1] <= y[1] for x in o[2] for y in o[2])]
        return (list(min(options)[2]), min(options)[0]) if options else ([], len(wanted))

    rnd = random.Random(3)
    for _ in range(1500):
        tokens = [rnd.choice("abcA") for _ in range(rnd.randrange(14))]
        entities = [[rnd.choice("abc") for _ in range(rnd.choice([0, 1, 1, 2, 3]))] for _ in range(rnd.randrange(9))]
        for nested in (False, True):
            assert spans.align(tokens, entities, nested) == every(tokens, entities, nested)
    tokens = [rnd.choice("abcdefgh") for _ in range(2000)]
    entities = [tokens[i : i + rnd.choice([1, 2, 3])] for i in sorted(rnd.sample(range(1990), 200))]
    began = time.time()
    assert spans.align(tokens, entities, True)[1] == 0 and time.time() - began < 2


def test_selection(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 10)
    monkeypatch.setattr(selection, "FEW", 3)
    rows = spark.range(3000).select((F.col("id") % 900).alias("key"), F.col("id").alias("x"))
    for k in (11, 1500, 2999):
        plain = rows.withColumn("_h", F.md5(F.concat(F.lit("s:"), F.col("key")))).orderBy("_h", "key").limit(k)
        got = selection.sample_least(rows, k, "key", "s")
        assert sorted(r.key for r in got.collect()) == sorted(r.key for r in plain.collect())
        assert "TakeOrdered" not in got._jdf.queryExecution().toString()
    assert selection.sample_least(rows, 4000, "key", "s").count() == 3000
    rnd = random.Random(1)
    values = [(g, v) for g in ("a", "b", None) for v in [rnd.choice([rnd.randrange(-9, 9), rnd.randrange(10**6), 70_000]) for _ in range(rnd.choice([1, 200, 301]))]] + [("c", None)]
    got = {r.g: r.quantile for r in selection.group_quantiles(spark.createDataFrame(values, "g string, v long"), "g", "v", 0.5).collect()}
    assert got == {g: sorted(v for h, v in values if h == g)[(sum(h == g for h, _ in values) + 1) // 2 - 1] for g in ("a", "b", None)}


def test_token_edits():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rnd = random.Random(9)
    for _ in range(600):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 5, 70]))] for _ in range(2))
        assert fuzzy.token_edits(a, b) == table(a, b)
    a = [f"w{rnd.randrange(5000)}" for _ in range(20_000)]
    b = [t if rnd.random() < 0.8 else "z" for t in a]
    began = time.time()
    assert 0 < fuzzy.token_edits(a, b) <= sum(x != y for x, y in zip(a, b)) and time.time() - began < 3


def test_negatives_are_found_however_far(spark):
    """Nearly all contexts are copies: the one that differs is found for each of them."""
    rows = [(i, f"q{i}", "one and the same text in all of these rows" if i else "quite another kind of words", f"a{i}") for i in range(60)]
    got = dialog.rag_samples(spark.createDataFrame(rows, "id int, question string, context string, response string"), "id", negative_share=1.1).collect()
    assert all(r.negative for r in got)
    alike = spark.createDataFrame([r for r in rows if r[0]], "id int, question string, context string, response string")
    assert not any(r.negative for r in dialog.rag_samples(alike, "id", negative_share=1.1).collect())


def test_typos_are_told_apart_by_digests(spark):
    rows = spark.createDataFrame([(1, "some text here"), (1, "other text there"), (2, "some text here"), (3, None), (4, "")], "k int, text string")
    got = generate.typo_augmented(rows, "k").collect()
    assert len({r.text for r in got}) == len(got) and not {r.text for r in got} & {"some text here", "other text there"}
    assert np.all([r.text is not None for r in got])


def _text_of(spark, path):
    import json
    import os

    parts = json.loads(open(f"{path}/_manifest.json").read())
    data = b"".join(open(f"{path}/{p['name']}", "rb").read() for p in parts)
    assert [p["length"] for p in parts] == [os.path.getsize(f"{path}/{p['name']}") for p in parts] and sum(p["length"] for p in parts) == len(data)
    return data.decode(), parts


def test_structured_sets_in_fragments(spark, tmp_path):
    import json

    from quillmill.sources import sinks

    rnd = random.Random(5)
    rows = [(rnd.choice(["train", "validation"]), rnd.choice(['a "b"]', "c[", "ü"]), f"in {i % 90} \n{{[", f'out "{i % 7}]') for i in range(300)]
    samples = spark.createDataFrame(rows, "split string, task string, input string, target string").repartition(5)
    corpus = spark.createDataFrame([(f"text ]}} {i % 40}",) for i in range(80)], "text string")
    assert sinks.write_structured(samples, corpus, str(tmp_path / "set")) is None  # this store cannot concatenate
    text, parts = _text_of(spark, str(tmp_path / "set"))
    assert sum(p["length"] > 0 for p in parts) > 1
    assert json.loads(text) == json.loads(sinks.structured_json(samples.distinct(), corpus).first()[0])
    sinks.write_structured(samples, corpus.where("false"), str(tmp_path / "bare"))
    assert json.loads(_text_of(spark, str(tmp_path / "bare"))[0])["text_corpus"] == []
    with pytest.raises(ValueError, match="training and validation"):
        sinks.write_structured(samples.where("split = 'train'"), corpus, str(tmp_path / "odd"))


def test_prompts_and_caps_that_must_fail(spark):
    from quillmill.operators import models

    rows = [("t", i, "Do it.", f"{'<LM>' if i else ''}Do it. q{i}", f"a{i}</s>") for i in range(8)]
    schema = "task string, id int, prompt string, input string, target string"
    with pytest.raises(Exception, match="tagged and untagged"):
        dialog.tagged_few_shot(spark.createDataFrame(rows, schema)).collect()
    with pytest.raises(Exception, match="lacks the prompt"):
        dialog.tagged_few_shot(spark.createDataFrame([*rows[1:], ("t", 9, "Do it.", "<LM>Do that. q", "a</s>")], schema)).collect()
    got = dialog.tagged_few_shot(spark.createDataFrame(rows[1:], schema), system=True).collect()
    assert len(got) == 7 and all(r.input.startswith("<LM>Do it. Question: q") and "</s>" not in r.input and r.target.endswith("</s>") for r in got)
    pairs = spark.createDataFrame([("a", "x y", "z"), ("b", "x y z w", "z")], "task string, input string, target string")
    assert [r.task for r in models.capped_samples(pairs, 4).orderBy("task").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="task b"):
        models.capped_samples(pairs, 3)


class Handed:
    """Stands for a table: keeps the function that would run in tasks."""

    def __init__(self, table):
        self.schema, self.columns = table.schema, table.columns

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_model_calls_hold_the_rows_of_one_call(spark):
    """Of a batch of any size only the rows of one call become Python objects; each call's rows are handed on at once."""
    asked = []

    def factory():
        return lambda texts: asked.append(len(texts)) or [t + "!" for t in texts]

    run = models._batched(Handed(spark.createDataFrame([], "k long, text string, made string")), "text", "made", "string", factory, 64)
    rows = pa.RecordBatch.from_pydict({"k": list(range(1000)), "text": [None if i == 3 else f"t{i}" for i in range(1000)], "made": ["x"] * 1000})
    out = run(iter([rows]))
    first = next(out)
    assert asked == [64] and first.num_rows == 64 and first.schema.names == ["k", "text", "made"]
    parts = [first, *out]
    assert max(p.num_rows for p in parts) == 64
    assert [x for p in parts for x in p.column(2).to_pylist()] == ["!" if i == 3 else f"t{i}!" for i in range(1000)]


def test_overlaps_leave_out_groups_without_spans(spark, monkeypatch):
    """Outer spans of other groups are in neither join, and starts look only in bins of lengths that there are."""
    whole, seen = intervals.stabbed, []

    def counted(points, many, *names, **more):
        out = whole(points, many, *names, **more)
        seen.append((points.count(), many.count(), list(more.get("levels", names[4] if len(names) > 4 else range(intervals.LEVELS)))))
        return out

    monkeypatch.setattr(intervals, "stabbed", counted)
    inner = spark.createDataFrame([(1, 5, 130), (None, 250, 260), (2, 7, 7)], "k int, start int, end int")
    outer = spark.createDataFrame([(k, s, s + 100) for k in (1, 2, 3, 4, None) for s in range(0, 1000, 100)], "k int, start int, end int")
    got = sorted(((r.k or 0), r.start, r.outer_start, r.relation) for r in intervals.overlaps(inner, outer, "k").collect())
    assert got == [(0, 250, 200, "inside"), (1, 5, 0, "across"), (1, 5, 100, "across")]
    assert [(p, m, len(levels)) for p, m, levels in seen] == [(2, 20, intervals.LEVELS), (20, 2, 2)]


def test_phrases_are_searched_for_text_by_text(spark):
    """A task hands hits back in bounded batches; keys of any kind, nulls and empty texts."""
    docs, phrases = spark.createDataFrame([], "doc_id string, _t string"), spark.createDataFrame([(7, "aa"), (8, "ba")], "item_id long, p string")
    run = spans._searched(Handed(docs), phrases, "doc_id", "item_id")
    n = 3 * spans.MOST_ROWS
    parts = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": ["x", None, "y", "z"], "_t": ["a" * (n + 1), None, "", "cba"]})])))
    assert max(p.num_rows for p in parts) == spans.MOST_ROWS
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert got == [("x", 7, i, i + 2) for i in range(n)] + [("z", 8, 1, 3)]


def test_running_ends_of_odd_arrays(spark):
    rows = spark.createDataFrame([(1, [3, 4]), (2, None), (3, []), (4, [2_000_000_000]), (5, [2_000_000_000, 1]), (6, [5, 0, 1])], "k int, a array<int>").coalesce(1)
    assert [r.e for r in rows.select("k", spans.running_ends(F.col("a")).alias("e")).orderBy("k").collect()] == [[3, 7], None, [], [2_000_000_000], [2_000_000_000, 2_000_000_001], [5, 5, 6]]


def test_alignment_hands_rows_back_in_parts(spark, monkeypatch):
    """The tokens of one row at a time become Python strings; rows come back in bounded batches, in order."""
    monkeypatch.setattr(spans, "MOST_ROWS", 10)
    run = spans.aligned(Handed(spark.createDataFrame([], "k long, tokens array<string>, entities array<array<string>>")), "k")
    rows = pa.RecordBatch.from_pydict({"k": list(range(35)), "tokens": [["A", "b", "c"]] * 34 + [[]], "entities": [[["a"], ["b", "C"]]] * 34 + [[["q"]]]})
    parts = list(run(iter([rows.slice(1)])))
    assert len(parts) == 7 and max(p.num_rows for p in parts) == 10
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == [x for k in range(1, 34) for x in ((k, 0, 1, 0), (k, 1, 3, 0))] + [(34, -1, -1, 1)]
