"""Hard negatives, importance resampling, improbable-feature digests and article texts against brute-force versions and odd rows."""

from __future__ import annotations

import collections
import hashlib
import html.parser
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import digest, html_text, knn, queries, resample
from quillmill.llm import kernel as K

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
have_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# -- hard negatives -----------------------------------------------------------------------


def mined(rows, every, positives=5, negatives=3):
    """All pairs, plainly; rows are (key, label, vector)."""
    rows = [(k, y, [math.floor(256 * x) for x in v]) for k, y, v in rows if k is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (k, y, v) in enumerate(rows):
        if k % every:
            continue
        others = [(-score(v, w), m, z) for j, (m, z, w) in enumerate(rows) if j != i]
        for s, m, _ in sorted(x for x in others if x[2] == y)[:positives]:
            hard = sorted((t, n) for t, n, z in others if z != y and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out += [(k, m, rank, n, -s, -t) for rank, (t, n) in enumerate(hard, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, nth string, cell string"


def found(df, every):
    return sorted(tuple(r) for r in knn.hard_negatives(df, lambda k: k % every == 0).collect())


@pytest.mark.parametrize("seed", range(2))
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, seed):
    """Clusters, a hot vector, ties, unequal norms; small groups and slices, so that every bound is at work."""
    monkeypatch.setattr(knn, "GROUP", 4)
    monkeypatch.setattr(knn, "LEAST", 8)
    monkeypatch.setattr(knn, "SLICE", 32)
    monkeypatch.setattr(knn, "BLOCK", 3)
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(400):
        c = centres[0] if rnd.random() < 0.33 else rnd.choice(centres)
        v = list(centres[0]) if i % 3 == 0 else [x * rnd.uniform(0.2, 2) + rnd.gauss(0, 0.1) for x in c]
        rows.append((i, rnd.randrange(4), v))
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], VECTORS).repartition(5)
    assert found(df, 10) == mined(rows, 10)


def test_bounds_send_few_rows(spark, monkeypatch):
    """Far clusters: the second join gets a small part of rows x groups."""
    monkeypatch.setattr(knn, "GROUP", 16)
    monkeypatch.setattr(knn, "LEAST", 64)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(0, 1, (30, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    of = rnd.integers(0, 30, 3000)
    x = centres[of] + rnd.normal(0, 0.01, (3000, 16))
    sent = {}
    monkeypatch.setattr(knn, "stored", lambda df, name, _s=knn.stored, **o: sent.setdefault((name, len(sent)), _s(df, name, **o)))
    monkeypatch.setattr(knn, "discard", lambda *t: None)
    df = spark.createDataFrame([(i, int(of[i]), x[i].tolist(), "a", "b") for i in range(3000)], VECTORS)
    assert knn.hard_negatives(df, lambda k: k % 10 == 0).count() >= 0
    moved = [t.count() for (name, _), t in sent.items() if name == "sent"]
    groups = sent[next(k for k in sent if k[0] == "placed")].select("grp").distinct().count()
    assert groups > 10 and moved[1] < 0.25 * 3000 * groups


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [0.9, 2.0]), (2, 2, [0.6, 1.4]), (3, 2, [0.6, 1.4]), (None, 2, [0.6, 1.4]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [None, 1.0]),
        (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [1.5]), (10, 3, []), (11, 3, [-1.0, 0.25]), (20, 1, [1.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], VECTORS)
    filled = [(k, y, v if v is None else list(v) + [0.0] * (2 - len(v))) for k, y, v in rows]
    assert found(df, 10) == mined(filled, 10) != []
    assert found(df.where("vec_id = 10"), 10) == []
    assert knn.hard_negatives(df.where("false"), lambda k: k % 10 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # Products that doubles don't hold, and some that 64 bits don't.
    big = [(0, 1, [2.0**20 + 1, 3.0]), (1, 1, [2.0**20 - 1, 5.0]), (2, 2, [2.0**19 + 1, 7.0]), (3, 2, [2.0**19 + 1, 6.0])]
    assert found(spark.createDataFrame([(*r, "a", "b") for r in big], VECTORS), 10) == mined(big, 10) != []
    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0], [2.0**30, 0.0], [2.0**40, 0.0]])
    assert knn.inner(a, b).tolist() == [[2**60 + 1, 2**60, 2**62]]


# -- importance resampling ------------------------------------------------------------------

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def resampled(docs, target, percent=25, least=20):
    of = [features(t) for _, t in docs]
    s = collections.Counter(b for _, f in of for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for (k, _), (words, f) in zip(docs, of):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = len(fit) * percent // 100
    return sorted(map(repr, [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)] + [(*r[:4], None) for r in rows if not r[4]]))


def test_resampling_equals_plain_version(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "delta's", "é", "漢字漢字", "x1", "the", "the", "the", "w" * 70, "w" * 49]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 19, 20, 60])))) for i in range(120)]
    docs += [(7, None), (8, ""), (None, "beta " * 30), (None, "beta " * 30), (9, "the " * 30), (9, "the " * 30), (200, "\x00 \x7f _"), (201, "long " * 40_000), (202, "z" * 900_000 + " end")]
    target = ["Alpha beta x1", None, "", "é é é"]
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in docs], "doc_id long, text string, score string, batch int").repartition(3)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    want = resampled(docs, target)
    got = lambda: sorted(map(repr, (tuple(r) for r in resample.resample(df, aims).collect())))
    assert got() == want
    monkeypatch.setattr(resample, "BATCH_BYTES", 500)
    monkeypatch.setattr(resample, "BATCH_DOCS", 7)
    monkeypatch.setattr(K, "CHUNK_BYTES", 100)
    assert got() == want


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    none = docs.where("false")
    assert resample.resample(none, docs).collect() == []
    assert [tuple(r) for r in resample.resample(docs, none, percent=100).collect()] == [tuple(eval(x)) for x in resampled([(1, "a b " * 20)], [], 100)]  # noqa: S307
    assert resample.resample(docs.withColumnRenamed("doc_id", "rank"), none, key="rank").columns[0] == "rank"


def test_checksums_of_joined_strings():
    rnd = random.Random(1)
    pairs = [(rnd.randbytes(rnd.choice([0, 1, 7, 300])), rnd.randbytes(rnd.choice([0, 1, 2, 65, 5000]))) for _ in range(200)]
    crc = lambda i: np.array([zlib.crc32(p[i]) for p in pairs], np.uint32)
    got = resample.joined_crcs(crc(0), crc(1), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# -- digests ----------------------------------------------------------------------------------


def plain_digest(raw, ranks):
    """Entropies, votes and filters one by one."""
    picked = []
    for s, scale in enumerate(digest.SCALES):
        if len(raw) < scale.window or (scale.longest is not None and len(raw) > scale.longest):
            continue
        rank = []
        for i in range(len(raw) - scale.window + 1):
            counts = collections.Counter(raw[i : i + scale.window]).values()
            fixed = lambda c: round(c * math.log2(c) * 2**20)
            rank.append(ranks[s][int((fixed(scale.window) - sum(map(fixed, counts))) * (1000 / float(fixed(scale.window))))])
        spans = [range(i, i + scale.span) for i in range(len(rank) - scale.span + 1)] or [range(len(rank))]
        votes = collections.Counter(min(span, key=lambda i: (rank[i], i)) for span in spans)
        picked += [raw[i : i + scale.window] for i in sorted(votes) if votes[i] >= min(scale.votes, len(spans))]
    if raw and len(raw) < min(s.window for s in digest.SCALES):
        picked.append(raw)
    prints = []
    for x in picked:
        data = np.frombuffer(x, np.uint8)
        h = int(K.slices(K.prefix(data), np.array([0]), np.array([len(x)]))[0])
        if h not in prints:
            prints.append(h)
    filters = []
    for i in range(0, len(prints), digest.FULL):
        bits = np.zeros(digest.BITS, bool)
        for h in prints[i : i + digest.FULL]:
            bits[[h >> 11 * j & 2047 for j in range(digest.HASHES)]] = True
        filters.append(bits)
    return len(prints), filters


def plain_likeness(a, b):
    if not a[0] or not b[0]:
        return float(a[0] == b[0])

    def toward(x, y):
        total = 0
        for i, f in enumerate(x[1]):
            best = 0.0
            for g in y[1]:
                common, most = int((f & g).sum()), min(f.sum(), g.sum())
                chance = f.sum() * g.sum() / digest.BITS
                cut = chance + digest.CUTOFF * max(most - chance, 0)
                best = max(best, 1.0 if (f == g).all() else min(max((common - cut) / max(most - cut, 1e-9), 0), 1))
            total += best * min(digest.FULL, x[0] - digest.FULL * i)
        return total / x[0]

    return max([toward(a, b)] * (a[0] <= b[0]) + [toward(b, a)] * (b[0] <= a[0]))


def bytes_and_edges(raw):
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


@pytest.mark.parametrize("limit", [64, 1000, 512 << 10])
def test_digests_equal_plain_version(monkeypatch, limit):
    rnd = random.Random(3)
    words = ["the", "of", "and", "zebra", "é", "漢字", "x9", "----------------", "\n"]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (0, 1, 2, 5, 9, 15, 40, 90, 130, 700, 3000)] + ["", "a", "ab", "abc", "a" * 700, "ab" * 31, "q" * 63, "q" * 64]
    raw = [t.encode() for t in texts]
    data, edges = bytes_and_edges(raw)
    ranks = digest.rarity(digest.histograms(data, edges))
    want = [plain_digest(x, ranks) for x in raw]
    monkeypatch.setattr(K, "CHUNK_BYTES", limit)
    monkeypatch.setattr(digest, "PAIR_BLOCK", 3)
    monkeypatch.setattr(digest, "FILTER_BLOCK", 2)
    assert (ranks == digest.rarity(digest.histograms(data, edges))).all()
    got = digest.digests(data, edges, ranks)
    assert got.features.tolist() == [n for n, _ in want]
    bits = np.unpackbits(got.filters.view(np.uint8), axis=1).astype(bool)
    assert all((bits[got.at[i] : got.at[i + 1]] == np.array(f).reshape(-1, digest.BITS)).all() for i, (_, f) in enumerate(want))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(raw)), np.arange(len(raw))))
    assert np.allclose(digest.likeness(got, i, got, j), [plain_likeness(want[a], want[b]) for a, b in zip(i, j)])
    back = digest.read_digest(got.text(10))
    assert (back.filters == got.one(10).filters).all() and back.features[0] == got.features[10]


def in_order(rows):
    """Rows as their operator orders them, texts of one key apart."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def check_documents(got, rows):
    """Distinct keys: every column from the texts alone, digests from the returned ones."""
    order = in_order(rows)
    by_key = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    of_text = {}
    for (k, own), (_, after) in zip(order, order[1:] + order[:1]):
        own, after, r = own or "", after or "", by_key[k]
        changed = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert of_text.setdefault(own, r.fingerprint) == r.fingerprint and of_text.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        near = lambda a, b: digest.likeness(digest.read_digest(a), np.array([0]), digest.read_digest(b), np.array([0]))[0]
        assert r.near_edited == pytest.approx(near(r.fingerprint, r.edited_fingerprint))
        follows = of_text.get(after) or digest.read_digest and by_key[order[(order.index((k, rows_text(rows, k))) + 1) % len(order)][0]].fingerprint
        assert r.near_next == pytest.approx(near(r.fingerprint, follows))


def rows_text(rows, key):
    return next(t for k, t in rows if k == key)


@have_tables
def test_digest_query_equals_plain_version(spark):
    """The registered query over its whole table, digests of some texts one by one."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_improbable_digest(spark, SF).collect()
    check_documents(got, rows)
    data, edges = bytes_and_edges([(t or "").encode() for _, t in rows])
    ranks = digest.rarity(digest.histograms(data, edges))
    texts = dict(rows)
    for r in got[::9]:
        n, filters = plain_digest((texts[r.doc_id] or "").encode(), ranks)
        mine = digest.read_digest(r.fingerprint)
        assert mine.features[0] == n and (np.unpackbits(mine.filters.view(np.uint8), axis=1).astype(bool) == np.array(filters).reshape(-1, digest.BITS)).all()
    # An edit of a third leaves about two thirds; strangers have little in common.
    assert np.median([r.near_edited for r in got]) > 0.55 and np.median([r.near_next for r in got]) < 0.05


def test_digests_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, "plain words here"), (2, None), (3, ""), (4, " \n\t "), (5, "é漢字😀" * 30), (6, "same text " * 30), (7, "same text " * 30), (None, "no key " * 12), (8, long), (9, long + " end"), (10, "a" * 5000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, part int").repartition(4)
    got = digest.fingerprint_documents(df).collect()
    check_documents(got, rows)
    by = {r.doc_id: r for r in got}
    assert by[7].near_next == 1 and by[3].near_next == 1 and by[9].near_next > 0.95 and by[2].n_chars == 0
    same = digest.fingerprint_documents(df.where("doc_id = 8").union(df.where("doc_id = 8")).union(df.where("doc_id = 8"))).collect()
    assert len(same) == 3 and {r.near_next for r in same} == {1.0}
    assert [r.near_next for r in digest.fingerprint_documents(df.where("doc_id = 5")).collect()] == [1.0]
    assert digest.fingerprint_documents(df.where("false")).collect() == []


# -- articles ---------------------------------------------------------------------------------

_P = "<p>" + "some words of the text " * 20 + "</p>"
_T = " ".join(("some words of the text " * 20).split())


@pytest.mark.parametrize("name", ["legal", "share-price", "menu-planning", "comment-of-the-day", "ad-hoc", "footer-notes", "cookie-recipes"])
def test_parts_of_an_article_stay(name):
    assert html_text.main_text(f'<body><article><h1>A</h1>{_P}<div class="{name}"><p>kept</p></div><section id="{name}">too</section></article></body>', None) == f"A\n{_T}\nkept\ntoo"


@pytest.mark.parametrize("name", ["related-posts", "ad-box", "post-comments", "share-buttons", "ad", "newsletter-signup", "comments", "sidebar-left", "user-comments"])
def test_noise_in_an_article_goes(name):
    assert html_text.main_text(f'<body><article><h1>A</h1>{_P}<div class="{name}"><p>gone</p></div></article></body>', None) == f"A\n{_T}"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><form id="aspnetForm"><div class="content"><h1>A</h1>{_P}</div><input></form></body>',
        f'<body><form action="x"><nav>n</nav><article><h1>A</h1>{_P}</article></form></body>',
        f'<div class="page"><h1>A</h1><div class="body">{_P}</div></div>',
        f'<body><h1>A</h1><div class="article-body">{_P}</div><div>other</div></body>',
        f"<body><article><h1>A</h1>{_P}<form><p>subscribe</p></form></article></body>",
        f'<body><form>search</form><div class="story"><h1>A</h1>{_P}</div></body>',
    ],
)
def test_forms_and_headlines(page):
    assert html_text.main_text(page, None) == f"A\n{_T}"


@pytest.mark.parametrize("bit", ["<div>x", '<a "', "<a <script x", "<a \"'>x", "<li><div>x", "<b class=x>y", '<a b="c>x ', "</p>x", "<!--", "<table><tr><td>x"])
def test_hostile_pages_take_time_in_proportion(bit):
    def took(n):
        began = time.process_time()
        html_text.main_text(bit * (n // len(bit)), None)
        return time.process_time() - began

    took(20_000)
    assert took(400_000) < 10 * max(took(100_000), 0.1)  # the square would be 16 times


def test_broken_quotes_lose_no_text():
    assert html_text.main_text("<article>" + '<a b="c>x ' * 40 + "<p>end</p></article>", None).endswith("end")
    assert html_text.main_text("<article><p>a < b</p><p>c", None) == "a < b\nc"
    assert html_text.main_text("<article><p>a</p><script>var x = '<p>no</p>'; y", None) == "a"


class _Article(html.parser.HTMLParser):
    """The text of articles by another parser: blocks at every tag but inline ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style", "nav", "aside", "footer", "form")
        self.blocks += [""] * (tag not in ("b", "i", "a", "em", "strong", "span", "br", "code"))
        self.handle_data(" " * (tag == "br"))

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style", "nav", "aside", "footer", "form")
        self.blocks += [""] * (tag not in ("b", "i", "a", "em", "strong", "span", "br", "code"))

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


@have_tables
def test_article_query_equals_another_parser(spark):
    """The registered query over its whole table: pages with an article, by Python's own parser."""
    got = {r.page_id: r for r in queries.op10_consensus_html(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    seen = 0
    for p in pages:
        if p.html and "<article" in p.html:
            walk = _Article()
            walk.feed(p.html)
            want = "\n".join(x for x in (" ".join(b.split()) for b in walk.blocks) if x)
            assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)
            seen += 1
    assert seen > len(pages) // 3
