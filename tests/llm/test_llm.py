"""The training-data operators against brute-force versions, round trips and edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import os
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bpe, chat, html_text, media, minhash, packing, pretoken, quality, queries, sharding, suffix, warc
from quillmill.llm import kernel as K

public_tokenizers = pytest.importorskip("public_tokenizers")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
have_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, "plain words here, it's fine"), (2, None), (3, ""), (4, " \n\t "), (5, "é ü 漢字 😀 it's we'll"), (5, "é ü 漢字 😀 it's we'll"), (6, "same text " * 30), (7, "same text " * 30), (None, "no key " * 12), (8, LONG), (9, LONG + " end"), (10, "a" * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and an extra column with a clashing name."""
    return spark.createDataFrame([(k, t, "x", 1.5) for k, t in ODD], "doc_id long, text string, kept string, length double").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# -- long texts in parts ----------------------------------------------------------------------


@pytest.mark.parametrize("limit", [12, 64, 1000])
def test_parts_of_long_texts_change_nothing(monkeypatch, limit):
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    bits = ["a", "é", "1", " ", " ", "\n", "　", "'", "'s", "'re", "'ll", "'v", ".", "漢", "😀", "\t", "the ", "<|endoftext|>", "w1 w2 w3 w4 w5 w6 w7 w8 "]
    docs = ["".join(rnd.choice(bits) for _ in range(rnd.choice([0, 5, 40, 900]))) for _ in range(200)] + ["x" * 3000, " " * 3000, ("x y " * 400 + "\n") * 3 + "x y " * 400]
    data, offsets = K.buffers(pa.array(docs))

    def counts():
        return [f(data, offsets) for f in (quality.count_words, quality.count_lines, quality.count_repeats)], minhash.bags(data, offsets)

    (whole, bag_whole), sign = counts(), minhash.bag_minhash(*minhash.bags(data, offsets), len(docs))
    monkeypatch.setattr(K, "CHUNK_BYTES", limit)
    monkeypatch.setattr(minhash, "SHINGLE_BLOCK", limit)
    parts, bag_parts = counts()
    for a, b in zip(whole, parts, strict=True):
        assert all((a[k] == b[k]).all() for k in a)
    assert all((a == b).all() for a, b in zip(bag_whole, bag_parts, strict=True))
    assert (sign == minhash.bag_minhash(*bag_parts, len(docs))).all()
    tok = Tokenizer.from_file(VOCABULARY)
    ids, at = packing.encode_with_added(packing.word_table(VOCABULARY), packing.added_tokens(VOCABULARY), data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tok.encode(x, add_special_tokens=False).ids for x in docs]


# -- registered queries against SQL ------------------------------------------------------


@have_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{SF}/{t}.parquet') else ''}')")
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(list, got.select(*cols).collect()))) == sorted(map(repr, map(list, cur.fetchall())))


# -- 1 chat --------------------------------------------------------------------------------


def test_chat_round_trip_and_states(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b\\\\<|end|>\n", "<|turn|>user<|text|>", "", "\\", "<<SYS>>x<</SYS>>"]
    rows = [(c, t, ("user", "assistant")[t % 2], nasty[(c + t) % len(nasty)]) for c in range(6) for t in range(4)]
    rows += [(10, 0, "assistant", "x"), (11, 0, "user", None), (11, 1, "assistant", None), (12, None, None, "t"), (13, 0, "user", "q"), (13, 0, "user", "q")]
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(d).withColumn("back", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    for c in range(6):
        want = [(r, t) for cc, _, r, t in rows if cc == c]
        assert [(b.role, b.text) for b in out[c].back] == want
        assert out[c].loss == "".join(t for r, t in want if r == "assistant")
        assert out[c].valid and "".join(s.text for s in out[c].segments) == out[c].formatted
        assert out[c].formatted.count("[INST]") == 0
    assert not out[10].valid and out[10].state == "reject"
    assert out[11].valid and out[11].loss == ""
    assert not out[12].valid and [(b.role, b.text) for b in out[12].back] == [("", "t")]
    assert not out[13].valid and out[13].n_turns == 2
    assert chat.format_conversations(d.where("false")).count() == 0
    clash = d.selectExpr("*", "'x' AS formatted", "1 AS segments", "2 AS state", "3 AS _t", "4 AS _talk")
    again = {r.conv_id: r.formatted for r in chat.format_conversations(clash).collect()}
    assert again == {k: r.formatted for k, r in out.items()}
    assert {r.conv_id: r.loss for r in out.values()} == {
        k: "".join(b.text for b in r.back if b.role == "assistant") for k, r in out.items()
    }


# -- 2 sharding ------------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(16, 400)) for i in range(2000)] + [(5, 20), (None, 30)]
    d = spark.createDataFrame(rows, "doc_id int, size long").repartition(5)
    got = sharding.shard_by_bytes(d, 7).collect()
    assert len(got) == len(rows)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.size)
    got.sort(key=key)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    slots, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(v == list(range(len(v))) for v in slots.values())
    target = sum(size.values()) / 7
    assert all(abs(v - target) <= 400 for v in size.values())
    assert sharding.shard_by_bytes(d.where("false"), 7).count() == 0


def test_shards_with_clashing_names(spark):
    rows = [(i % 9, 20 + i % 3, "a", i, 7, 8, 9, None) for i in range(50)] + [(None, None, None, None, None, None, None, None)] * 2
    d = spark.createDataFrame(rows, "doc_id long, size long, shard string, SLOT int, _one int, _part int, _row int, before int")
    got = sharding.shard_by_bytes(d, 3)
    assert got.columns == ["doc_id", "size", "_one", "_part", "_row", "before", "shard", "slot"]
    out = warc.stored(got, "clash").collect()
    assert len(out) == 52 and {r._one for r in out} == {7, None} and all(r.size is not None for r in out)


@have_tables
def test_shard_query_like_a_model(spark):
    docs = sorted((r.doc_id, len((r.text or "").encode()) + 16) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    total, before, want, slots = sum(n for _, n in docs), 0, {}, collections.Counter()
    for k, n in docs:
        shard = min((before + n // 2) * queries.N_SHARDS // total, queries.N_SHARDS - 1)
        want[k] = (n, "bytes", shard, slots[shard], None)
        slots[shard] += 1
        before += n
    assert {r.doc_id: (r.size, r.law, r.shard, r.slot, r.grown_shard) for r in queries.op2_sharding(spark, SF).collect()} == want


@have_tables
def test_shard_query_checksums(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_sharding(spark, SF).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(k, len(v) + 16, zlib.crc32(v)) for k, v in docs.items()}


# -- 3 media ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 70001])
def test_media_round_trip(n):
    for data in (os.urandom(n), b"\xff" * n, b"\xff\x00\xff\xd0" * (n // 4)):
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64
        back, clips, hist = media.read_media(media.encode_avi(payload))
        assert back == payload
        assert clips[0][0] == 0 and clips[-1][1] == len(hist) and all(a[1] == b[0] for a, b in zip(clips, clips[1:], strict=False))


def plain_jpeg(data):
    """A slow decoder of baseline grey JPEG, bit by bit, written for this test alone: (coefficients in zigzag order, pixels) of each block."""
    import math

    def words(at):
        return data[at] << 8 | data[at + 1]

    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    at, codes, quant = 2, {}, []
    while data[at + 1] != 0xDA:
        kind, size, body = data[at + 1], words(at + 2), at + 4
        if kind == 0xC4:
            code, p = 0, body + 17
            for n in range(1, 17):
                for _ in range(data[body + n]):
                    codes[data[body] >> 4, n, code] = data[p]
                    code, p = code + 1, p + 1
                code <<= 1
        elif kind == 0xDB:
            quant = list(data[body + 1 : body + 65])
        elif kind == 0xC0:
            height, width = words(body + 1), words(body + 3)
        at += 2 + size
    at += 2 + words(at + 2)
    bits, segments = [], []
    while at < len(data) - 2:
        if data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7:
            segments.append(bits)
            bits, at = [], at + 2
            continue
        bits += [data[at] >> k & 1 for k in range(7, -1, -1)]
        at += 2 if data[at] == 0xFF else 1
    segments.append(bits)
    order = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    out = []
    for bits in segments:
        place, coefficients = 0, []
        while len(coefficients) < 64:
            code = n = 0
            while (len(coefficients) > 0, n, code) not in codes:
                code, n, place = code << 1 | bits[place], n + 1, place + 1
            symbol = codes[len(coefficients) > 0, n, code]
            assert symbol >> 4 == 0
            size = symbol & 15
            v = int("".join(map(str, bits[place : place + size])), 2)
            place += size
            coefficients.append((v if v >> size - 1 else v - (1 << size) + 1) * quant[len(coefficients)])
        grid = {p[::-1]: v for p, v in zip(order, coefficients, strict=True)}
        scale = lambda u: math.sqrt(0.125) if u == 0 else 0.5
        cos = [[scale(u) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
        half = [[sum(grid[u, v] * cos[u][x] for u in range(8)) for v in range(8)] for x in range(8)]
        out.append((coefficients, [[min(255, max(0, math.floor(sum(half[x][v] * cos[v][y] for v in range(8)) + 128.5))) for x in range(8)] for y in range(8)]))
    return out, width, height


def test_frames_like_an_independent_decoder():
    rnd = random.Random(3)
    for n in (1, 9, 64):
        blocks = np.frombuffer(bytes(rnd.choice([0, 255, 127, 128, rnd.randint(0, 255)]) for _ in range(64 * n)), np.uint8).reshape(n, 64)
        found, width, height = plain_jpeg(media.encode_frame(blocks, 8 * n, 8))
        assert (width, height, len(found)) == (8 * n, 8, n)
        own, grey = media.coefficients(blocks).reshape(n, 64)[:, media._ZIGZAG], media.pixels(blocks)
        for k, (coefficients, pixels) in enumerate(found):
            assert coefficients == own[k].tolist()
            assert max(abs(int(a) - b) for x, y in zip(grey[k].tolist(), np.array(pixels).tolist(), strict=True) for a, b in zip(x, y, strict=True)) <= 1


def test_media_query_values(spark):
    texts = {1: "short", 2: None, 3: "text of several frames, é 漢 " * 700, 4: "\x00\x7f"}
    d = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, media string")
    files = {r.doc_id: bytes(r.media) for r in media.write_media(d).collect()}
    features = media.media_features(media.write_media(d))
    for r in features.collect():
        raw = (texts[r.doc_id] or "").encode()
        payload, data = media.padded(raw), files[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(data))
        assert (r.payload_sha256, r.media_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(data).hexdigest(), zlib.crc32(payload[-64:]))
        # The RIFF file walked by its chunks alone; every frame through the slow decoder.
        assert data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") == len(data) - 8
        at, frames = data.index(b"movi") + 4, []
        while data[at : at + 4] == b"00dc":
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            frames.append(plain_jpeg(data[at + 8 : at + 8 + size])[0])
            at += 8 + size + size % 2
        bytes_ = b"".join(bytes(v + 255 if v < 0 else v for v in c) for f in frames for c, _ in f)
        assert bytes_[: len(payload)] == payload and r.feature.startswith(f"frames={len(frames)};shots={len(r.clips)};")
        assert sum(map(int, r.feature.split("grey=")[1].split(","))) == 64 * sum(map(len, frames))
    rows = media.clip_rows(features).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.start_ms < r.end_ms and r.end_ms == r.end * 40 for r in rows)


def test_shots_adapt():
    flat, other = np.full((20, 16), 256), np.zeros((20, 16), int)
    other[:, 0] = 4096
    assert media.shots(np.concatenate([flat, other, flat])) == [0, 20, 40]
    assert media.shots(flat) == [0] and media.shots(np.zeros((0, 16), int)) == [0]


def test_media_columns(odd, empty):
    got = media.media_features(media.write_media(odd)).collect()
    assert len(got) == len(ODD)
    want = collections.Counter((k, hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for k, t in ODD)
    assert collections.Counter((r.doc_id, r.payload_sha256) for r in got) == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (6, 7)}) == 1
    assert media.media_features(media.write_media(empty)).count() == 0


# -- 4 packing -------------------------------------------------------------------------------


def check_packing(rows, docs, full):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter()
    for k, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first, at, piece = len(ids) % full or full, 0, 0
        while at < len(ids):
            part = ids[at : at + (first if piece == 0 else full)]
            want[k, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            at, piece = at + len(part), piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= full
    return len(seqs), sum(r.length for r in rows)


def test_packing_odd_rows(odd, empty):
    rows = packing.best_fit_packing(odd, VOCABULARY, 64).collect()
    check_packing(rows, ODD, 64)
    assert packing.best_fit_packing(empty, VOCABULARY, 64).count() == 0


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    tok, t = Tokenizer.from_file(VOCABULARY), "<|endoftext|>"
    texts = [f"a {t} b", t, t + t, f"{t}it's", f"x  {t}  y{t}", "<|endof", "text|> z", f"é{t}漢", "", "plain", f"<|{t}|>", f"end {t}", f"{t} begin", None]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), VOCABULARY, 1024, 2, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: tok.encode(x or "", add_special_tokens=False).ids + [2] for k, x in enumerate(texts)}


@have_tables
def test_packing_is_near_the_bound(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, total = check_packing(queries.op4_best_fit_packing(spark, SF).collect(), docs, 1024)
    assert n <= -(-total // 1024) * 1.02 + 1


def test_word_table_that_overflows(encoding):
    table = pretoken.WordTable(lambda ws: [encoding._core_bpe.encode_single_piece(w) for w in ws], most=64)
    docs = [" ".join(f"word{i * k}" for i in range(120)) for k in (1, 3, 5)] * 2
    data, offsets = K.buffers(pa.array(docs))
    ids, at = packing.encode_chunk(table, data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encoding.encode_ordinary(x) for x in docs]


@pytest.mark.parametrize("lengths", [range(10, 251), range(10, 331), range(200, 331), range(260, 321, 7), range(30, 41), [100], [1, 2, 5]])
def test_short_lengths_are_fitted_too(lengths):
    """Three pieces fill no sequence: lengths repeat, and the fit is no worse than best fit."""
    rnd = random.Random(3)
    counts = {k: rnd.randint(800, 3000) for k in lengths}
    columns = packing.patterns(list(counts), 1024, 32)
    assert len(set(columns)) == len(columns) and all(sum(p) <= 1024 and len(set(p)) <= 3 for p in columns)
    assert {max(p) for p in columns} == set(counts)
    fitted, left = packing._realised(columns, counts)
    used = collections.Counter(left)
    for p, n in fitted:
        for v in p:
            used[v] += n
    assert used == counts and fitted
    assert sum(n for _, n in packing.plan(counts, 1024)) <= sum(n for _, n in packing.best_fit(counts, 1024))


def test_plan_places_every_length_and_is_no_worse_than_best_fit():
    rnd = random.Random(4)
    sparse = {rnd.randint(1, 1023): rnd.randint(1, 5000) for _ in range(300)}
    dense = {k: 1000 + k % 7 for k in range(1, 1024)}
    middle = {k: random.Random(k).randint(1, 300) for k in range(200, 700, 3)}
    few = {k: random.Random(k).randint(1, 3) for k in range(1, 1025, 5)}
    for counts in (sparse, dense, middle, few, {1024: 3}, {1: 5000}, {600: 7, 500: 3}, {}):
        used, bins = collections.Counter(), 0
        for items, n in packing.plan(counts, 1024):
            assert n > 0 and sum(items) <= 1024
            bins += n
            for v in items:
                used[v] += n
        assert used == collections.Counter(counts)
        assert bins <= sum(n for _, n in packing.best_fit(counts, 1024))
    assert sum(n for _, n in packing.plan(dense, 1024)) <= 1.001 * (-(-sum(k * v for k, v in dense.items()) // 1024))


# -- 5 suffixes ------------------------------------------------------------------------------


def cut_model(docs):
    """Bytes to remove, window by window."""
    least: dict[bytes, float] = {}
    order = lambda k: float("inf") if k is None else k
    for k, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, float("inf")), order(k))
    out = []
    for k, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < order(k):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def digest(rows):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("batch", [2_000, 1 << 24])
def test_repeats_like_the_model(spark, monkeypatch, batch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", batch)
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "dé", "eps", "zeta"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(n))
    shared = [text(20) for _ in range(5)]
    docs = []
    for k in range(60):
        parts = [text(rnd.randint(0, 15)), rnd.choice(shared)[rnd.randint(0, 20) :], text(rnd.randint(0, 9)), rnd.choice(shared)]
        docs.append((rnd.randint(0, 45), " ".join(parts[: rnd.randint(0, 4)])))
    docs += [(100, "ab" * 200), (101, "ab" * 150), (102, "a" * 300), (103, "b" + "a" * 120), (None, shared[0]), (None, shared[0]), (104, None), (105, ""), (106, "short")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = suffix.remove_repeats(d, finish=queries._kept_digest, finish_schema="kept_sha256 string").collect()
    assert digest(got) == cut_model(docs)


def test_long_texts_are_cut_in_pieces(monkeypatch):
    """Runs that meet, cross or end at the bounds of pieces, and windows of other documents."""
    monkeypatch.setattr(suffix, "_PIECE", 64)
    rnd = random.Random(4)
    for _ in range(60):
        sizes = [rnd.choice([0, 10, 60, 64, 65, 128, 700, 701]) for _ in range(4)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data, flag = np.frombuffer(rnd.randbytes(int(offsets[-1])), np.uint8), np.zeros(int(offsets[-1]) + 1, bool)
        gone = np.zeros(len(data), bool)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for x in range(a, b - 49):
                if rnd.random() < rnd.choice([0.001, 0.02]) or rnd.random() < 0.05 and x % 64 in (13, 14, 15, 63, 0):
                    flag[x] = True
                    gone[x : x + 50] = True
        for i, j in [(0, 4), *((k, k + 1) for k in range(4))]:
            kept, cut, spans = suffix._remains(data, flag, offsets, i, j)
            for d in range(i, j):
                own = gone[offsets[d] : offsets[d + 1]]
                assert kept[d - i] == data[offsets[d] : offsets[d + 1]][~own].tobytes() and cut[d - i] == own.sum()
                assert spans[d - i] == sum(1 for k, g in enumerate(own) if g and (k == 0 or not own[k - 1]))


def test_repeats_odd_rows(odd, empty):
    got = suffix.remove_repeats(odd, finish=queries._kept_digest, finish_schema="kept_sha256 string").collect()
    docs = [d for d in ODD if d[0] not in (8, 9)]
    assert digest([r for r in got if r.doc_id not in (8, 9)]) == cut_model(docs)
    assert {r.n_removed for r in got if r.doc_id == 8} == {0} and {r.n_removed for r in got if r.doc_id == 9} == {len(LONG)}
    out = suffix.remove_repeats(odd)
    assert out.columns == ["doc_id", "length", "n_bytes", "n_removed", "n_spans", "kept"]
    assert suffix.remove_repeats(empty).count() == 0


def test_merge_keeps_order_and_lengths():
    rnd = random.Random(8)
    width = suffix._WIDTH
    runs = [sorted({bytes(rnd.choice(b"ab") for _ in range(width)) if rnd.random() < 0.5 else b"a" * rnd.randint(0, width - 1) + b"b" * width for _ in range(rnd.randint(0, 30))}) for _ in range(7)]
    runs = [[x[:width] for x in r] for r in runs]
    coded = []
    for r in runs:
        rows = np.frombuffer(b"".join(sorted(set(r))), np.uint8).reshape(-1, width)
        if len(rows):
            coded.append(suffix._decode_run(*suffix._front_coded(rows)))
    out, last = [], None
    for _, shared, x in suffix.merge_runs(coded):
        if last is not None:
            assert shared == (len(os.path.commonprefix([last, x])))
        out.append(x)
        last = x
    assert out == sorted(x for r in runs for x in set(r))


# -- 6 warc ----------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}\r\nx", ["<p>a\r\n\r\nb</p>", "", None, "é" * 50][i % 4] + "" if i % 4 != 2 else None) for i in range(40)]
    rows += [(39, "again", rows[39][2]), (None, "n", "<p>a\r\n\r\nb</p>"), (77, None, "WARC/1.1\r\n\r\n")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    b = warc.stored(warc.write_bundles(d, frame_bytes=300, bundle_bytes=900), "t")
    got = warc.read_bundles(b).collect()
    heads: dict = {}
    for k, _, h in rows:
        p = (h or "").encode()
        heads[p] = max(heads.get(p, -1), -1 if k is None else k)
    want = collections.Counter()
    for k, _, h in rows:
        p = (h or "").encode()
        sha = base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = k == heads[p]
        want[k, len(p), sha, "response" if first else "revisit", None if first else heads[p]] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert collections.Counter((r.page_id, r.url) for r in got) == collections.Counter((k, u) for k, u, _ in rows)
    stored_bundles = b.collect()
    assert len(stored_bundles) > 1
    for r in stored_bundles:
        for x in r["index"]:
            head, _ = warc.read_record(bytes(r.data), x.frame, x.offset)
            assert warc.page_of(head["WARC-Record-ID"]) == (None if x.id is None else str(x.id))
    assert warc.write_bundles(d.where("false")).count() == 0


def test_warc_keys_of_any_text(spark):
    rows = [("a>b\r\nc", "u v", "same"), ("None", None, "same"), (None, "", "x"), ("%41", "é\n", "same"), ("Z", " h ", None)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id string, url string, html string, index string")
    got = warc.read_bundles(warc.stored(warc.write_bundles(d), "t")).collect()
    assert {(r.page_id, r.url) for r in got} == {(k, u) for k, u, _ in rows}
    assert {r.page_id: r.refers_to for r in got} == {"a>b\r\nc": None, "None": "a>b\r\nc", None: None, "%41": "a>b\r\nc", "Z": None}


# -- 7 tokens --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_pretokens_like_the_pattern():
    import regex

    pat, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    bits = ["a", "é", "1", "²", " ", " ", "\n", " ", "　", "'", "'s", "'re", "'ll", "'v", "'t", "d", ".", "漢", "😀", "_", "\t", "\x1c", "́"]
    docs = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    for i, j, data, off in K.chunks(*K.buffers(pa.array(docs))):
        s = pretoken.starts(data, off)
        raw, ends, row = data.tobytes(), np.append(s[1:], len(data)), np.searchsorted(off, s, "right") - 1
        got: list[list[str]] = [[] for _ in range(j - i)]
        for a, b, r in zip(s, ends, row, strict=True):
            got[r].append(raw[a:b].decode())
        assert got == [pat.findall(x) for x in docs[i:j]]


def test_merges_of_long_words(encoding):
    ranks, rnd = bpe.load_ranks(RANKS), random.Random(3)
    for _ in range(300):
        w = bytes(rnd.choice(b"abe tions\xc3\xa9 ") for _ in range(rnd.randint(1, 80)))
        assert bpe.merge_long(w, ranks) == encoding._core_bpe.encode_single_piece(w)


def test_bpe_odd_rows(odd, empty, encoding, monkeypatch):
    for long_word, limit, shared in ((2048, 1 << 25, 1024), (8, 20_000, 1)):
        monkeypatch.setattr(bpe, "SHARED_PARTITIONS", shared)
        got = bpe.bpe_round_trip(odd, RANKS, limit=limit, long_word=long_word).collect()
        want = collections.Counter((k, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for k, t in ODD)
        assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.bpe_round_trip(empty, RANKS).count() == 0


@have_tables
def test_bpe_query_like_tiktoken(spark, encoding):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = encoding.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_byte_bpe(spark, SF).collect()} == want


# -- 8 near duplicates -----------------------------------------------------------------------


def bag(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def alike(a, b):
    return (not a and not b) or 10 * sum((a & b).values()) >= 8 * sum((a | b).values())


def classes_model(docs):
    bags = [bag(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if alike(bags[i], bags[j]):
                up[find(i)] = find(j)
    low: dict = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    size = collections.Counter(find(i) for i in range(len(docs)))
    return collections.Counter((k, low.get(find(i)), size[find(i)]) for i, (k, _) in enumerate(docs))


def test_signature_is_unbiased():
    rnd, docs, true = random.Random(1), [], []
    for _ in range(250):
        w = [rnd.choice("ab") for _ in range(rnd.randint(3, 300))]
        v = [x if rnd.random() > 0.03 else rnd.choice("abc") for x in w]
        a, b = bag(" ".join(w)), bag(" ".join(v))
        true.append(sum((a & b).values()) / sum((a | b).values()))
        docs += [" ".join(w), " ".join(v)]
    row, g, c = minhash.bags(*K.buffers(pa.array(docs)))
    assert c.max() > 3
    s = minhash.bag_minhash(row, g, c, len(docs), 512)
    err = (s[::2] == s[1::2]).mean(1) - np.array(true)
    assert abs(err.mean()) < 0.005 and err.std() < 0.03


def test_near_duplicates_like_the_model(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for f in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 200))]
        for _ in range(rnd.choice([1, 2, 8, 30])):
            v = list(base)
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = rnd.choice(vocab)
            docs.append((len(docs), " ".join(v)))
    docs += [(1000 + i, "few words only") for i in range(3)] + [(1100, "x y"), (None, docs[0][1]), (1200, None), (1201, ""), (1202, " \n"), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(d).collect())
    assert got == classes_model(docs)


@pytest.mark.parametrize("block", [16])
def test_links_that_no_centre_has(spark, monkeypatch, block):
    """A crowded family: centres alone leave nineteen classes where there are nine."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd, docs = random.Random(5), []
    for f in range(60):
        v, spots = [f"w{i}" for i in range(300)], range(10, 290, 6)
        for at in rnd.sample(spots, 4):
            v[at] = f"edit{f}x{at}"
        w = list(v)
        for at in rnd.sample([x for x in spots if not v[x].startswith("edit")], 3):
            w[at] = f"twin{f}x{at}"
        docs += [(2 * f, " ".join(v)), (2 * f + 1, " ".join(w))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = classes_model(docs)
    assert len({c for _, c, _ in want}) == 9
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(d).collect()) == want


def test_multisets_that_share_a_name(spark, monkeypatch):
    """Eight names for all multisets: the second digest tells them apart."""
    whole = minhash._digests
    monkeypatch.setattr(minhash, "_digests", lambda *x: (whole(*x)[0] % 8, *whole(*x)[1:]))
    # A function of a module is imported anew by workers; under another name it goes as it is here.
    bags_of = types.FunctionType(minhash._shingles.__code__, vars(minhash), "few_names")
    bags_of.__qualname__ = "few_names"
    monkeypatch.setattr(minhash, "_shingles", bags_of)
    rnd, docs = random.Random(9), [(None, "a b"), (900, ""), (901, None), (902, "a b")]
    for f in range(25):
        base = [f"w{rnd.randrange(200)}" for _ in range(80)]
        for e in range(rnd.choice([1, 2, 5])):
            docs.append((len(docs), " ".join([*base[:40], f"edit{e % 3}", *base[41:]])))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(d).collect()) == classes_model(docs)


def test_undecided_pairs_of_a_large_component(spark, monkeypatch):
    """Blocks of the largest component meet those of what is outside; all pairs of different components come out, once."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    root = {n: 0 if n < 97 else n for n in range(100)} | {n: 200 for n in range(200, 205)} | {n: n for n in range(300, 340)}
    placed = spark.createDataFrame([(0 if n < 300 else 7, n, 100, 1) for n in root] + [(9, n, 4, 1) for n in range(4)], "bucket long, node long, n int, fame int")
    roots = spark.createDataFrame([(n, r) for n, r in root.items() if n < 300], "node long, root long")
    one = minhash._pack_bag(np.arange(1, 60, dtype=np.uint64) << np.uint64(20), np.ones(59, np.int64))
    bags_of = spark.createDataFrame([(n, bytearray(one)) for n in root], "node long, bag binary")
    got = [(r.a, r.b) for r in minhash._possible(placed, roots, bags_of, 0.8, minhash.stored).collect()]
    buckets = collections.defaultdict(set)
    for r in placed.where("n > 3").collect():
        buckets[r.bucket].add(r.node)
    assert sorted(got) == sorted({(a, b) for ns in buckets.values() for a in ns for b in ns if a < b and root[a] != root[b]})
    # Outside the 97 are three components of one and one of five.
    assert len(got) == 97 * 8 + 3 + 3 * 5 + 40 * 39 // 2


def test_a_pair_comes_from_one_of_its_buckets(spark, monkeypatch):
    """Families whose pairs share many buckets: as many rows as pairs, however many buckets they share."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    made, compare = spark.sparkContext.accumulator(0), minhash._undecided

    def counted(threshold):
        run = compare(threshold)

        def counting(table):
            out = run(table)
            made.add(out.num_rows)
            return out

        return counting

    monkeypatch.setattr(minhash, "_undecided", counted)
    # Node n is in those of the buckets 1 to 11 that do not divide n + 1; four more hold all nodes.
    placed = [(b, n) for n in range(40) for b in range(-3, 12) if b < 1 or (n + 1) % b]
    rows = spark.createDataFrame([(b, n, 40, 1) for b, n in placed], "bucket long, node long, n int, fame int")
    roots = spark.createDataFrame([(n, 0) for n in range(0, 40, 3)], "node long, root long")
    one = minhash._pack_bag(np.arange(1, 60, dtype=np.uint64) << np.uint64(20), np.ones(59, np.int64))
    bags_of = spark.createDataFrame([(n, bytearray(one)) for n in range(40)], "node long, bag binary")
    got = sorted((r.a, r.b) for r in minhash._possible(rows, roots, bags_of, 0.8, minhash.stored).collect())
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 or b % 3]
    assert made.value == len(got)


def test_sketches_never_rule_out_a_link():
    rnd = random.Random(7)
    for _ in range(200):
        a = collections.Counter(rnd.choices(range(1, 400), k=rnd.choice([20, 300, 40_000])))
        b = a + collections.Counter(rnd.choices(range(1, 400), k=rnd.randint(0, 60)))
        g, c = (lambda x: np.array(sorted(x), np.uint64)), (lambda x: np.array([x[k] for k in sorted(x)]))
        x, y = minhash.sketch(g(a), c(a)).astype(int), minhash.sketch(g(b), c(b)).astype(int)
        assert abs(x - y).sum() <= sum(((a - b) + (b - a)).values())


def test_near_duplicates_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.class_id for r in got}
    assert by[6] == by[7] == 6 and by[8] == by[9] == 8 and by[2] == by[3] == by[4] == 2 and by[5] == 5
    assert minhash.near_duplicates(empty).count() == 0


# -- 9 quality -------------------------------------------------------------------------------


def counts_model(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_odd_rows(odd, empty):
    got = quality.quality_cascade(odd, report=True).collect()
    want = collections.Counter((k, *counts_model(t)) for k, t in ODD)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        c = {n: np.array([r[n]]) for n in quality.FEATURES}
        assert r.kept == (not any(rule.fails(c)[0] for rule in quality.RULES)) == (r.rejected_by is None)
    assert quality.quality_cascade(empty).count() == 0


def test_the_cascade_counts_only_what_it_must(monkeypatch):
    seen = collections.Counter()

    def counting(f):
        def run(data, offsets):
            seen[f.__name__] += len(offsets) - 1
            return f(data, offsets)

        return run

    made = {f: counting(f) for f in set(quality.FEATURES.values())}
    monkeypatch.setattr(quality, "FEATURES", {k: made[f] for k, f in quality.FEATURES.items()})
    texts = ["too short"] * 90 + [" ".join(f"w{i}k{k}" for i in range(40)) for k in range(10)]
    by = quality.judge(quality.Chunk(*K.buffers(pa.array(texts))), quality.RULES)
    assert (by[:90] == 0).all() and (by[90:] == -1).all()
    assert seen == {"count_words": 100, "count_repeats": 10, "count_lines": 10}


def test_order_of_rules_does_not_matter(odd):
    short = {(r.doc_id, r.kept) for r in quality.quality_cascade(odd).collect()}
    turned = {(r.doc_id, r.kept) for r in quality.quality_cascade(odd, rules=quality.RULES[::-1], sample_rows=1).collect()}
    assert short == turned
    m = [("a", 100, 0, 1.0), ("b", 100, 50, 1.0), ("c", 100, 50, 0.1)]
    rules = tuple(quality.Rule(n, (), None) for n in "abc")
    assert [r.name for r in quality.order_rules(m, rules)] == ["c", "b", "a"]


# -- 10 html ---------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><script>if (a<b) x("<p>no</p>")</script></head><body><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div class="c{n}"><h1>Head &amp; more</h1><p>One <b>bold</b>&nbsp;word<br>next line<p>Two &lt;x&gt;
 wide   space</p><div class="ad-box">Buy</div><ul><li>first<li>second</ul><section id="comments"><p>nice page</p></section></div>
<aside>side</aside><form><input>q</form><footer>foot</footer></body></html>"""
TEXT = "Head & more\nOne bold word next line\nTwo <x> wide space\nfirst\nsecond"


def test_html_main_text(spark):
    rows = [(i, f"http://user@Host.example:80/{i}", PAGE.replace("{n}", str(i))) for i in range(9)]
    rows += [(20, None, None), (21, "", ""), (22, "x", "just words"), (23, "http://host.example/", "<p>lone</p>"), (24, "http://host.example/", PAGE.replace("{n}", "7")[:-60]), (24, "http://host.example/", PAGE.replace("{n}", "7")[:-60])]
    d = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_main_text(d).collect())
    assert [g for g in got if g[0] < 9] == [(i, TEXT, len(TEXT)) for i in range(9)]
    assert [g[1] for g in got if g[0] >= 20] == ["", "", "just words", "lone", TEXT, TEXT]
    won = {r.host: r.path for r in html_text.consensus_paths(d).collect()}
    assert won["host.example"] == "html>body>div.c0"
    assert html_text.extract_main_text(d.where("false")).count() == 0


def test_html_consensus_corrects_a_page():
    boiler = "<div class='x'><p>" + "filler words of a long box " * 30 + "</p></div>"
    page = f"<html><body>{boiler}<div class='story'><p>Short piece.</p></div></body></html>"
    assert html_text.main_text(page, "html>body>div.story") == "Short piece."
    assert html_text.main_text("<b>" * 5000 + "deep" + "</b>" * 5000, None) == "deep"
    assert html_text.main_text("<div " + "a='" * 3000, None) is not None


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content with-sidebar"><p>Hello there</p></div>', "Hello there"),
        ('<div id="page" class="has-cookie-banner"><article>Body</article></div>', "Body"),
        ('<section class="alert-story"><p>Story</p></section>', "Story"),
        ('<div class="modal"><p>All of the text</p></div>', "All of the text"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Text</p><footer>tags</footer></article>', "Title\nText"),
        ('<main><header><h1>Title</h1></header><p>Hi <b class="ad">BUY <i class="x">now</i></b>there <a class="ads" href="/">Buy</a>all</p></main>', "Title\nHi there all"),
        ('<p>a <svg class="i"/> b</p><p>c <svg><text>no</text></svg></p>', "a b\nc"),
        ("<p>a <math><mi>x</mi></math> b</p><p>c <video src=v> d</p><p>e</p>", "a x b\nc\ne"),
        ("<head><title>t</title><body><p>in the body", "in the body"),
        ('<div class="post"><p>Post</p><div class="post-comments"><p>first!</p></div><div class="related-posts"><p>more</p></div><div id="siteFooter">f</div></div>', "Post"),
        ('<div class="comments"><p>only comments</p></div>', ""),
        ('<div class="cookie-notice">' + "We use cookies. " * 50 + "</div><article><p>short</p></article>", "short"),
    ],
)
def test_html_names_of_elements(page, want):
    assert html_text.main_text(page, None) == want


def test_html_like_a_tree_walk(spark):
    """Generated pages of several layouts a host against an independent extractor on the tree they were made from."""
    rnd = random.Random(11)
    words = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet tempor".split()) for _ in range(n))
    noise = [("nav", ""), ("aside", ""), ("footer", ""), ("form", ""), ("div", "ad"), ("div", "side-bar"), ("div", "cookie-banner"), ("section", "reader-comments"), ("ul", "main-menu"), ("div", "newsletter-signup")]
    rows, want = [], {}
    for k in range(120):
        host, layout = f"h{k % 4}.example", k % 4
        blocks, lines = [], []
        for _ in range(rnd.randint(1, 6)):
            kind = rnd.choice(["p", "h2", "li", "quote", "inline"])
            a, b = words(rnd.randint(3, 30)), words(3)
            if kind == "inline":
                blocks.append(f'<p>{a} <span class="ad-slot">{words(2)}</span> &amp; <em>{b}</em></p>')
                lines.append(f"{a} & {b}")
            else:
                tag = {"p": "p", "h2": "h2", "li": "li", "quote": "blockquote"}[kind]
                blocks.append(f"<{tag}>{a}<!-- {b} -->\n  <b>{b}</b></{tag}>")
                lines.append(f"{a} {b}")
            if rnd.random() < 0.4:
                t, c = rnd.choice(noise)
                blocks.append(f'<{t} class="{c}"><p>{words(rnd.randint(1, 40))}</p></{t}>')
        body = "".join(blocks)
        inner = {0: f"<article>{body}</article>", 1: f'<div class="wrap with-sidebar"><div class="entry">{body}</div></div>', 2: f'<main id="content">{body}</main>', 3: f'<div class="c{k}"><div class="story-body">{body}</div></div>'}[layout]
        around = "".join(f'<{t} class="{c}">{words(rnd.randint(1, 12))}</{t}>' for t, c in rnd.sample(noise, 3))
        rows.append((k, f"http://{host}/{k}", f"<html><head><title>x</title></head><body><header>Site</header>{around}{inner}<footer>f</footer><script>var a='<p>';</script></body></html>"))
        want[k] = "\n".join(lines)
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("x"))).collect()}
    assert got == want


# -- pipeline: stages on odd rows -------------------------------------------------------------

CLASH = "doc_id long, text string, kept string, rejected_by int, n_bytes string, n_chars int, row_key string, class_id string"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, t, "own", 3, "x", 9, "r", "c") for k, t in ODD]
    return spark.createDataFrame(rows, CLASH).repartition(3).cache()


def test_quality_stage_odd_rows(spark, clashing):
    import corpus_pipeline as pipeline

    got = pipeline.quality(spark, clashing, "")
    assert got.columns == clashing.columns
    verdict = collections.Counter((r.doc_id, r.text) for r in quality.quality_cascade(clashing).where("kept").collect())
    rows = got.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == verdict and {r.kept for r in rows} <= {"own"} and {r.rejected_by for r in rows} <= {3}
    assert pipeline.quality(spark, clashing.where("false"), "").count() == 0


def test_near_dedup_stage_keeps_one_row_a_class(spark):
    import corpus_pipeline as pipeline

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    for rows, want in (
        ([(0, a), (1, a), (1, b)], {(0, a), (1, b)}),
        ([(0, a), (None, a), (None, b)], {(0, a), (None, b)}),
        ([(None, a), (None, a), (5, b), (5, b), (None, None), (7, "")], {(None, a), (5, b), (7, "")}),
    ):
        d = spark.createDataFrame([(k, t, "own", 3, "x", 9, "r", "c") for k, t in rows], CLASH).repartition(2)
        got = pipeline.near_dedup(spark, d, "")
        out = got.collect()
        assert got.columns == d.columns and len(out) == len(want) and {(r.doc_id, r.text) for r in out} == want
        assert {r.row_key for r in out} == {"r"} and {r.class_id for r in out} == {"c"}
    assert pipeline.near_dedup(spark, spark.createDataFrame([], CLASH), "").count() == 0


def test_passages_and_packing_stages_odd_rows(spark, clashing):
    import corpus_pipeline as pipeline

    got = pipeline.passages(spark, clashing, "")
    rows = got.collect()
    assert got.columns == clashing.columns and len(rows) == len(ODD)
    assert {r.kept for r in rows} == {"own"} and {r.n_bytes for r in rows} == {"x"} and all(r.n_chars == len(r.text) for r in rows)
    assert pipeline.passages(spark, clashing.where("false"), "").count() == 0
    packed = pipeline.packing(spark, clashing, "").collect()
    check_packing(packed, ODD, pipeline.MAX_TOKENS)
    assert pipeline.packing(spark, clashing.where("false"), "").count() == 0


# -- pipeline --------------------------------------------------------------------------------


@have_tables
def test_pipeline_like_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    verdict = {r.doc_id: r.kept for r in queries.op9_quality_cascade(spark, SF).collect()}
    kept = [(k, t) for k, t in docs if verdict[k]]
    low = {k: c for k, c, _ in classes_model(kept)}
    kept = [(k, t) for k, t in kept if low[k] == k]
    cut = {r[0]: r[4] for r in cut_model(kept)}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:3]:
        frame = pipeline.stored(stage(spark, frame, SF), name)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = [(r.doc_id, r.text) for r in frame.collect()]
    assert {k for k, _ in texts} == {k for k, _ in kept}
    # Texts compare by digest where no character was cut in two.
    assert sum(hashlib.sha256(t.encode()).hexdigest() == cut[k] for k, t in texts) >= 0.97 * len(texts)
    check_packing(pipeline.run(spark, SF).collect(), texts, pipeline.MAX_TOKENS)
