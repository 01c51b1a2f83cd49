"""Small cases of single operators, with a plain-Python model where there is one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import catalog, similarity, text
from quillmill.operators import dialog, metrics, models, sampling, sections, spans, validate
from quillmill.sources import readers, sinks


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return d.select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, d", [("river", "river", 0), ("river", "rivulet", 3), ("stone", "tone", 1), ("", "ab", 2), ("", "", 0)])
def test_token_distance(spark, a, b, d):
    letters = lambda s: F.array(*map(F.lit, s)) if s else F.array().cast("array<string>")
    assert one(spark, similarity.token_distance(letters(a), letters(b))) == d


def test_token_distance_of_many_tokens(spark):
    """Code points beyond the basic plane: more distinct tokens than the basic plane has room for."""
    a = [f"t{i}" for i in range(36_000)]
    b = [*a[-3:], "new"]
    assert spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(similarity.token_distance(F.col("a"), F.col("b")).alias("x")).first().x == 36_000 - 3 + 1


@pytest.mark.parametrize("s, want", [(" abc\n", "abc"), ("abc </s> ", "abc"), ("ab\nc</s>", "ab\nc"), ("", ""), ("a</s></s> </s>", "a")])
def test_strip_eos(spark, s, want):
    assert one(spark, text.strip_eos(F.col("s")), s=s) == want


def test_tokenize(spark):
    assert one(spark, text.tokenize(F.col("s")), s="foo_bar ... x1!") == list("foo_bar") + list("...") + ["x1", "!"]
    assert one(spark, text.token_count(F.col("s")), s="foo_bar ... x1!") == 12
    for t in ["", "a_b c__ _", "x1!?..", "naïve über_all 漢字_", "one two", "__", "a-b_c-d", "😀😀 ok"]:
        assert one(spark, text.token_count(F.col("s")), s=t) == len(one(spark, text.tokenize(F.col("s")), s=t)), t
        n, own = text.script_share(F.col("s"), "[a-zA-Z]")
        found = one(spark, text.tokens(F.col("s")), s=t)
        assert one(spark, n, s=t) == len(found) and one(spark, own, s=t) == sum(x.isascii() and x.isalpha() for x in found), t
    assert one(spark, text.remove_links(F.col("s")), s="deep [[a|[[b|[[c|[[d|e]]]]]]]] [[x") == "deep e [[x"
    assert one(spark, text.multiline(F.col("s")), s="abc\r\nd  ef g ") == ["abc", "d ef g"]


def test_find_subphrase(spark):
    words = F.split(F.lit("a b c d e"), " ")
    for phrase, want in (("b c", 1), ("C", 2), ("a b c d e f", -1), ("x", -1)):
        assert one(spark, text.find_subphrase(words, F.split(F.lit(phrase), " "))) == want
    assert one(spark, text.find_subphrase(words, F.array().cast("array<string>"))) == 0


def test_catalogue(spark):
    p = catalog.CATALOGUE
    synonym = next(x for x in p if not x.canonical)
    assert one(spark, catalog.matched(F.col("s")), s="<LM>" + p[0].prompt + " q").task_idx == 0
    assert one(spark, catalog.matched(F.col("s")), s=synonym.prompt + " q").task_idx == synonym.task_idx
    assert one(spark, catalog.matched(F.col("s")), s="hello").task_idx == catalog.UNKNOWN
    assert one(spark, catalog.matched(F.col("s")), s="<LM>well, " + p[0].prompt).task_idx == catalog.NOT_AT_START
    # The text is cut after the prompt that matched, synonym or not.
    assert one(spark, catalog.context(F.col("s")), s="<LM>" + synonym.prompt + " - - tail ") == "tail"


def test_validation(spark):
    rows = validate.raw_rows(spark)
    assert {r.error for r in validate.error_report(validate.validated(rows)).collect()} == {"ok", "no_tag", "no_end", "arity", "empty_input", "empty_target"}
    assert [tuple(r) for r in validate.accepted(rows.where("line IN (1, 4, 8)")).orderBy("input").collect()] == [("<LM>a", "b</s>"), ("<LM>q\nr", "b</s>")]
    with pytest.raises(Exception, match="no_tag"):
        validate.accepted(rows.where("line = 2")).collect()


def paragraphs_model(lines):
    """The rules for paragraphs, line by line."""
    import re

    texts, pars, prev, prev_wordy, number = [], [], None, True, 0
    for raw in lines:
        s = " ".join(raw.replace("--", "—").split())
        toks = re.findall(r"\w+|[^\w\s]+", s)
        wordy = any(t.isalnum() for t in toks)
        alpha = [t for t in toks if t.isalpha()]
        if s:
            fresh = prev is None or prev == "" or not prev_wordy or prev[-1] in ".?!…" or s[0] in "—-0123456789" or bool(alpha and alpha[0].istitle()) or bool(alpha and all(a.isupper() for a in alpha)) or not wordy
            if fresh or not pars:
                pars.append([wordy, [s]])
            else:
                pars[-1][1].append(s)
        prev, prev_wordy = s, wordy
    for wordy, ls in pars:
        if wordy:
            texts.append((number, " ".join(ls)))
        else:
            number += 1
    return texts


def test_paragraphs_like_the_model(spark):
    rnd = random.Random(3)
    pieces = ["Upper case start", "lower goes on", "ALL CAPS", "ends here.", "", "***", "- dash", "1 first", "what?", "—", "mid, word", "--"]
    docs = [[rnd.choice(pieces) for _ in range(rnd.randint(0, 12))] for _ in range(300)]
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(docs)], "doc_id int, text string")
    got = {}
    for r in sections.paragraphs(spans.lines_with_offsets(d)).orderBy("doc_id", "par").collect():
        got.setdefault(r.doc_id, []).append((r.text_no, r.paragraph))
    for i, x in enumerate(docs):
        assert got.get(i, []) == paragraphs_model("\n".join(x).split("\n")), x
    whole = {}
    for r in sections.document_paragraphs(d).orderBy("doc_id", "par").collect():
        whole.setdefault(r.doc_id, []).append((r.text_no, r.paragraph))
    assert whole == got
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a\ufdd0b \ufdd1c")], "doc_id int, text string")
    assert [tuple(r) for r in sections.document_paragraphs(odd).collect()] == [(3, 0, 1, "ab c")]


def sections_model(lines, words):
    out, state = [], None
    for i, s in enumerate(x for x in lines if x):
        short = words(s) <= sections.SHORT_LINE or i == 0
        if short and (state is None or state == "body"):
            out.append([s, []])
            state = "title"
        elif state == "title":
            out[-1][1].append(out[-1][0] if short else s)
            state = "body" if not short else "body"
        else:
            out[-1][1].append(s)
    return [(t, "\n".join(b)) for t, b in out if b]


def test_sections_like_the_model(spark):
    rnd = random.Random(5)
    long = "one two three four five six seven eight nine"
    docs = [[rnd.choice(["t%d" % k, long + " %d" % k]) for k in range(rnd.randint(1, 9))] for _ in range(200)]
    d = spark.createDataFrame([(i, n, s) for i, x in enumerate(docs) for n, s in enumerate(x)], "doc int, n int, line string")
    got = {}
    for r in sections.wiki_sections(d).orderBy("doc", "section").collect():
        got.setdefault(r.doc, []).append((r.title, r.body))
    for i, x in enumerate(docs):
        assert got.get(i, []) == sections_model(x, lambda s: len(s.split())), x


def test_interval_union_random(spark):
    rnd = random.Random(1)
    rows = [(k, s, s + rnd.randint(1, 9)) for k in range(40) for s in (rnd.randint(0, 40) for _ in range(6))]
    got = {}
    for r in spans.interval_union(spark.createDataFrame(rows, "k int, start int, end int"), "k").collect():
        got.setdefault(r.k, set()).add((r.start, r.end))
    for k in range(40):
        own = sorted((s, e) for kk, s, e in rows if kk == k)
        want = []
        for s, e in own:
            if want and s < want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], e))
            else:
                want.append((s, e))
        assert got[k] == set(want)


def test_object_faults(spark):
    s = spark.createDataFrame([(1, 10, 0, 4)], "doc int, span_id int, start int, len int")
    schema = "doc int, object_id int, type string, span_ids array<int>"
    for ids, kind, word in (([11], "Person", "unknown span"), ([10, 10], "Person", "listed twice"), ([10], "Thing", "unknown type")):
        with pytest.raises(Exception, match=word):
            spans.object_bounds(spark.createDataFrame([(1, 1, kind, ids)], schema), s).collect()


def test_alignment():
    assert spans.align([], [["x"], ["y"], ["z"]]) == ([], 3)
    assert spans.align("a b c".split(), [[]]) == ([], 0)
    assert spans.align("a b c".split(), [["a", "b", "c"], ["b"]], nested=True) == ([(0, 3), (1, 2)], 0)
    assert spans.align("a b c".split(), [["a", "b", "c"], ["b"]])[0] in ([(0, 3)], [])
    assert spans.label_tokens("a b c".split(), [["B"], ["z"]], "X") == ["O", "B-X", "O"]
    pieces = spans.split_long(list("abcdefghij"), [3, 7, 10], 4)
    assert pieces[0][0] == 0 and pieces[-1][1] == 10 and all(b - a <= 4 for a, b in pieces)
    assert all(x[1] == y[0] for x, y in zip(pieces, pieces[1:], strict=False))


def test_tiles(spark):
    b = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5), (2, 6, 9), (3, 0, 9), (3, 9, 9)], "doc_id int, start int, end int")
    n = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 0)], "doc_id int, n int")
    assert {r.doc_id: r.ok for r in spans.tiles(b, n).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_greedy_f1_empty_sides(spark):
    s = "k int, embedding array<float>"
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], s)
    b = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], s)
    got = {r.k: r.f1 for r in metrics.greedy_cosine_f1(a, b, "k").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


def test_sampling_faults(spark):
    d = spark.range(20).withColumn("pos", F.col("id") < 2)
    with pytest.raises(ValueError):
        sampling.stratified_reduction(d, 5, "id", F.col("pos"))
    with pytest.raises(ValueError):
        sampling.stratified_reduction(d, 8, "id", F.col("id") < 0)
    got = sampling.stratified_reduction(d, 8, "id", F.col("pos"))
    assert got.count() == 8 and got.where("pos").count() == 2
    with pytest.raises(Exception, match="too few"):
        sampling.few_shot_split(d.withColumn("task", F.lit("t")), "task", "id", 1).collect()


def test_models(spark):
    d = spark.createDataFrame([(1, " abc "), (2, ""), (3, "long text"), (4, None)], "id int, input string")
    got = {r.id: r.predicted for r in models.answered(d, lambda: lambda ts: [t.upper() + "\r\n!" for t in ts], least_chars=3).collect()}
    assert got == {1: "abc", 2: "", 3: "LONG TEXT\n!", 4: ""}

    def failing():
        def call(t):
            if "x" in t:
                raise RuntimeError
            return t[::-1]

        return call

    e = spark.createDataFrame([(1, "ab"), (2, "x"), (3, " ")], "id int, input string")
    assert {r.id: r.answer for r in models.remote_answers(e, failing).collect()} == {1: "ba", 2: "", 3: ""}
    with pytest.raises(Exception, match="every text"):
        models.scored(d, lambda: lambda ts: [], text="input").collect()
    assert {r.id: r.n_tokens for r in models.measured(d, "input").collect()} == {1: 1, 2: 0, 3: 2, 4: 0}


def test_csv_round_trip(spark, tmp_path):
    rows = [("<LM>a, \"q\"\nb", "x</s>"), ("<LM>c", "- y\nz</s>")]
    d = spark.createDataFrame(rows, "input string, target string")
    sinks.write_csv(d, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in readers.instructions(spark, str(tmp_path / "t")).collect()) == sorted(rows)
    assert readers.with_header_prefix(spark, str(tmp_path / "t"), ["input"]).count() == 2
    with pytest.raises(ValueError):
        readers.triples(spark, str(tmp_path / "t"))


def test_chats(spark, tmp_path):
    m = lambda *rc: [{"role": r, "content": c} for r, c in rc]
    lines = [m(("user", "q"), ("bot", "a")), m(("bot", "a"), ("user", "q")), m(("user", "q")), m(("user", " "), ("bot", "a")), m(("user", "q"), ("bot", "a"), ("user", "r"), ("bot", "b"))]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"source": "s", "model_name": "n", "messages": x}) for x in lines))
    d = readers.chats(spark, str(tmp_path / "c.jsonl"))
    assert sorted(len(r.messages) for r in d.collect()) == [2, 4]
    assert readers.chat_turns(d).count() == 6
    (tmp_path / "bad.jsonl").write_text(json.dumps({"source": "s", "messages": []}))
    with pytest.raises(Exception, match="required key"):
        readers.chats(spark, str(tmp_path / "bad.jsonl")).collect()


def test_structured(spark, tmp_path):
    rows = [("train", "a", "i1", "t1"), ("train", "b", "i2", "t2"), ("validation", "a", "i3", "t3"), ("validation", "b", "i4", "t4")]
    d = spark.createDataFrame(rows, "split string, task string, input string, target string")
    corpus = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    out = sinks.structured_json(d, corpus).first().json
    (tmp_path / "s.json").write_text(json.dumps(json.loads(out), indent=4))
    samples, texts = readers.structured(spark, str(tmp_path / "s.json"))
    assert sorted(tuple(r) for r in samples.select("split", "task", "input", "target").collect()) == sorted(rows)
    assert sorted(r.text for r in texts.collect()) == ["x", "y"]
    (tmp_path / "odd.json").write_text(json.dumps({"train": {"a": [["i", "t"]]}, "validation": {}, "text_corpus": []}))
    with pytest.raises(ValueError):
        readers.structured(spark, str(tmp_path / "odd.json"))
    sinks.write_samples(d, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("split = 'train' AND task = 'a'").count() == 1


def test_text_trees(spark, tmp_path):
    (tmp_path / "w" / "AA").mkdir(parents=True)
    (tmp_path / "w" / "AA" / "wiki_00").write_text('<doc id="1" title="First one">\nFirst one\n\nbody\u2028more\n</doc>\n<doc id="2" title="Two">\nTwo\nx\n</doc>\n')
    lines = readers.wiki_lines(spark, str(tmp_path / "w")).orderBy("doc", "n").collect()
    assert [(r.title, r.line) for r in lines if r.line] == [("First one", "First one"), ("First one", "body"), ("First one", "more"), ("Two", "Two"), ("Two", "x")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "wiki_01").write_text('<doc id="1" title="A">\nx\n')
    with pytest.raises(Exception, match="not closed"):
        readers.wiki_lines(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "top.txt").write_text("a")
    (tmp_path / "t" / "sub" / "in.txt").write_text("b\r\nc")
    assert [r.text for r in readers.whole_texts(spark, str(tmp_path / "t"), below=1).collect()] == ["b\nc"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "Book_12.txt").write_text("hello")
    (tmp_path / "b" / "other.txt").write_text("no")
    assert [(r.number, r.text) for r in readers.books(spark, str(tmp_path / "b")).collect()] == [(12, "hello")]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Ann met Bob")
    (tmp_path / "a.ann").write_text("T1\tPER 0 3\tAnn\nR1\tx y\nbroken\nT2\tPER 8 11\tBob\n")
    texts, e = readers.brat(spark, str(tmp_path))
    assert sorted((r.id, r.start, r.end) for r in e.collect()) == [("T1", 0, 3), ("T2", 8, 11)]
    (tmp_path / "b.txt").write_text("Ann")
    (tmp_path / "b.ann").write_text("T1\tPER 0 3\tBob\n")
    with pytest.raises(Exception, match="bad annotation"):
        readers.brat(spark, str(tmp_path))[1].collect()
    t = tmp_path / "triples"
    t.mkdir()
    (t / "d.txt").write_text("Ann Lee met\n")
    (t / "d.spans").write_text("1 name 0 3 0 1 # 7 Ann\n2 surname 4 3 1 1 # 8 Lee\n")
    (t / "d.objects").write_text("5 Person 1 2 # Ann Lee\n")
    _, s, o = readers.span_tables(spark, str(t))
    assert [(r["class"], r.start, r.end) for r in spans.object_bounds(o, s).collect()] == [("person", 0, 7)]


def test_sinks(spark, tmp_path):
    sinks.write_spans_by_document(spark.createDataFrame([("d", "per", 5, 9), ("d", "loc", 0, 2)], "doc string, class string, start int, end int"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s" / "doc=d")).collect()] == ["loc 0 2", "per 5 4"]
    sinks.write_lines(spark.createDataFrame([(2, "b  b"), (1, "a\na")], "id int, predicted string"), str(tmp_path / "l"), "id")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a a", "b b"]
    d = spark.createDataFrame([("t", "i", "p", "r", 0.5), ("t", "i", "q", "r", 1.0)], "task string, input string, predicted string, reference string, score double")
    got = json.loads(sinks.score_report(d).first().json)
    assert got["score"] == 0.75 and [r["SCORE"] for r in got["rows"]] == [1.0, 0.5]


def test_history_ignores_system_and_unanswered(spark):
    d = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", " a  b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")], "conv_id int, turn int, role string, text string")
    assert [(r.input, r.target) for r in dialog.history_pairs(d).collect()] == [("a b", "c</s>")]


def test_stream(spark, tmp_path):
    from quillmill.streaming.text_stream import clean_stream, run_to_table

    spark.createDataFrame([(1, "plain  words"), (2, "123 456 !!")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    run_to_table(clean_stream(stream), "cleaned")
    assert [tuple(r) for r in spark.table("cleaned").collect()] == [(1, "plain words")]


def test_fuzzy_scores(spark):
    from quillmill.operators import fuzzy

    rnd = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 15))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.common_subsequence(a, b) == table[-1][-1]
    d = spark.createDataFrame([("New York, city", "city new york"), ("", ""), ("abc", "xyz")], "a string, b string")
    got = [tuple(r) for r in d.select(fuzzy.token_sort_ratio(F.col("a"), F.col("b")), fuzzy.chrf_score(F.col("a"), F.col("a"))).collect()]
    assert got == [(100.0, 1.0), (100.0, 0.0), (0.0, 1.0)]
    assert fuzzy.sentence_ends("One. Two three! four") == [2, 5, 6] and fuzzy.normal_words("A, b! 1") == "a b 1"


def test_draws_of_sections_and_prompts(spark):
    doc = "array(named_struct('section_title', 'A', 'section_body', array('x', 'y')), named_struct('section_title', 'B', 'section_body', array('z')))"
    rows = spark.range(50).withColumn("d", F.expr(doc))
    assert {r.c for r in rows.select(sections.section_context(F.col("id"), F.col("d")).alias("c")).collect()} == {"A\n\nx\ny", "B\n\nz"}
    seen = {r.p for r in spark.range(50).select(catalog.variant(F.lit(0), F.col("id")).alias("p")).collect()}
    assert seen == {p.prompt for p in catalog.CATALOGUE if p.task_idx == 0}
    assert spark.range(1).select(catalog.variant(F.lit(3), F.col("id"), training=False).alias("p")).first().p == catalog.CANONICAL[3]


def test_stored_tables(spark):
    from quillmill.operators import ranking, storage

    d = spark.createDataFrame([(i % 3, i) for i in range(40)] + [(None, 5), (1, 4)], "g int, x int").repartition(6)
    got = sorted(((r.g is not None, r.g or 0), r.x, r["rank"]) for r in ranking.ranked(d, ["x"], ["g"]).collect())
    want, seen = [], {}
    for g, x in sorted(((r.g is not None, r.g or 0), r.x) for r in d.collect()):
        want.append((g, x, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert got == want
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert storage.clear_stored(spark) > 0 and storage.clear_stored(spark) == 0


def test_phrase_hits_finds_every_place(spark):
    from quillmill.operators import spans

    long = "one two three four five six"
    texts = {1: f"{long} and {long}", 2: "aa b aa b aa", 3: "nothing", 4: None}
    phrases = {10: long, 11: "aa b aa", 12: "", 13: None}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    p = spark.createDataFrame(list(phrases.items()), "item_id long, text string")
    want = sorted((k, i, at, at + len(q)) for k, t in texts.items() for i, q in phrases.items() if q for at in range(len(t or "")) if t.startswith(q, at))
    assert len(want) == 4
    for most in (1 << 20, 10):
        assert sorted(tuple(r) for r in spans.phrase_hits(d, p, most_chars=most).collect()) == want
    assert spans.phrase_hits(d, p.where("item_id > 11")).count() == 0


def test_rag_negatives_like_the_model(spark):
    """The first of the next three contexts in hash order that is unlike enough, for the rows that are drawn."""
    import hashlib

    from quillmill.operators import fuzzy

    rnd = random.Random(4)
    texts = ["red cats sit on mats", "red cats sat on mats", "a green boat far at sea", "seven words that have nothing in common", "on mats sit red cats"]
    rows = [(i, f"q{i}", rnd.choice(texts), f"a{i}") for i in range(150)]
    draw = lambda name, i: int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:8], 16)
    order = sorted(rows, key=lambda r: (hashlib.md5(f"rag:{r[0]}".encode()).hexdigest(), r[0]))
    norm = lambda t: " ".join(sorted(t.split()))
    want = {}
    for at, (i, _, c, a) in enumerate(order):
        other = None
        if draw("rag-neg", i) / 2**32 < 0.5:
            near = [order[(at + k) % len(order)][2] for k in range(1, len(order))]
            other = next((x for x in near if fuzzy.ratio(norm(c), norm(x)) <= dialog.MOST_ALIKE), None)
        want[i] = (other is not None, dialog.RAG_REFUSALS[draw("rag-refusal", i) % 3] if other else a)
        want[i] += (dialog.RAG_LAYOUTS[draw("rag-layout", i) % 8].replace("{q}", f"q{i}").replace("{c}", other or c),)
    got = dialog.rag_samples(spark.createDataFrame(rows, "id int, question string, context string, response string"), "id", negative_share=0.5).collect()
    assert {r.id: (r.negative, r.target, r.input) for r in got} == want
    drawn = sum(draw("rag-neg", i) / 2**32 < 0.5 for i in want)
    assert sum(n for n, _, _ in want.values()) == drawn > 20 and dialog.rag_samples(spark.createDataFrame([], "id int, question string, context string, response string"), "id").count() == 0


def test_positions_and_failures(spark, tmp_path):
    from quillmill.operators import tasks

    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(10, "u"), (30, "w"), (20, "v")], "m int, y string")
    assert sorted((r.x, r.y) for r in tasks.paired_by_position(a, b, ["k"], ["m"]).collect()) == [("a", "u"), ("b", "v"), ("c", "w")]
    with pytest.raises(ValueError, match="cannot be paired"):
        tasks.paired_by_position(a, b.where("m > 10"), ["k"], ["m"])

    def service():
        def call(t):
            if t == "b":
                raise OSError("no line")
            return t * 2

        return call

    got = {r.x: (r.answer, r.error) for r in models.remote_answers(a, service, "x").collect()}
    assert got == {"a": ("aa", None), "b": ("", "OSError: no line"), "c": ("cc", None)}
    assert sinks.write_parts(a, str(tmp_path / "parts"), "k", ["1", "2"]) == ["1", "2"]
    assert sinks.write_parts(a, str(tmp_path / "parts"), "k", ["1", "2", "3"]) == ["3"]
    examples = F.array(F.struct(F.lit("<LM>a").alias("input"), F.lit("b</s>").alias("target")), F.struct(F.lit("c").alias("input"), F.lit("d").alias("target")))
    assert one(spark, dialog.same_tags(F.slice(examples, 1, 1))) and one(spark, dialog.same_tags(F.slice(examples, 2, 1))) and not one(spark, dialog.same_tags(examples))


def test_entities_that_are_missing(spark):
    d = spark.createDataFrame([("Ann met Bob</s></s>", ["Ann", "Eve", "Bob"])], "text string, entities array<string>")
    assert spans.entity_labels(d, "P").first().labels == ["B-P", "O", "B-P"]
    with pytest.raises(Exception, match="not in its text"):
        spans.entity_labels(d, "P", strict=True).collect()


def test_articles_keys_and_vectors(spark):
    d = spark.createDataFrame([("T", [("S ", ["a", "", "", "b"]), ("U", ["c"])])], "title string, document array<struct<section_title:string,section_body:array<string>>>")
    assert d.select(sections.article_text(squeezed=False).alias("x")).first().x == "T\n\nS \n\na\n\n\nb\n\nU\n\nc"
    assert d.select(sections.article_text().alias("x")).first().x == "T\n\nS\n\na\n\nb\n\nU\n\nc"
    k = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    assert validate.unique_or_fail(k.where("x <> 'c'"), "k").count() == 2
    with pytest.raises(Exception, match="repeated: 2"):
        validate.unique_or_fail(k, "k").collect()
    assert one(spark, F.round(metrics.row_score(F.lit("a b x"), F.lit("a b c d")), 6)) == 0.5
    assert one(spark, metrics.row_score(F.lit("a b c d e f"), F.lit("z"))) == 0.0
    v = models.embedded(k, lambda: lambda texts: [[[float(ord(t)), 1.0]] if t != "b" else None for t in texts], "x").collect()
    assert {r.x: r.vectors for r in v} == {"a": [[97.0, 1.0]], "b": None, "c": [[99.0, 1.0]]}


@pytest.mark.parametrize("block", [2, 2048])
def test_cosine_f1_in_blocks(spark, block):
    rnd = random.Random(9)
    vectors = lambda n: [[rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] for _ in range(n)]
    sides = {k: (vectors(n), vectors(m)) for k, n, m in ((1, 7, 5), (2, 1, 9), (3, 3, 0), (4, 0, 2))}
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v]
    table = lambda i: spark.createDataFrame([(k, v) for k, s in sides.items() for v in s[i]], "pair int, embedding array<double>")
    got = {r.pair: (r.recall, r.precision, r.f1) for r in metrics.greedy_cosine_f1(table(0), table(1), "pair", block=block).collect()}
    for k, (a, b) in sides.items():
        if not a or not b:
            assert got[k] == (0.0, 0.0, 0.0)
            continue
        c = [[sum(x * y for x, y in zip(unit(p), unit(q), strict=True)) for q in b] for p in a]
        r, p = sum(map(max, c)) / len(a), sum(max(row[j] for row in c) for j in range(len(b))) / len(b)
        assert got[k] == pytest.approx((r, p, 2 * r * p / (r + p) if r > 0 and p > 0 else 0.0), abs=2e-6)
