"""Best-fit packing of token sequences by length patterns and non-negative least squares."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import pretoken as P
from .common import spread, stored, with_running

_tables: dict[str, P.WordTable] = {}
_added: dict[str, AddedTokens | None] = {}


class AddedTokens:
    """The added tokens of a vocabulary file, found in raw bytes before any other step.

    At one place the longest wins, as in the library.
    """

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        self.pattern = re.compile(b"|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True)))


def added_tokens(vocabulary: str) -> AddedTokens | None:
    if vocabulary not in _added:
        with open(vocabulary, encoding="utf-8") as f:
            listed = json.load(f).get("added_tokens") or []
        if any(t.get(flag) for t in listed for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        _added[vocabulary] = AddedTokens({t["content"].encode(): t["id"] for t in listed}) if listed else None
    return _added[vocabulary]


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_table(vocabulary: str) -> P.WordTable:
    """The word table of a byte-level BPE vocabulary file (tokenizers' JSON), one per worker process.

    The merges of such a file are in the order of the ids that they make, so that ids serve
    as ranks; this is checked when the file is read.
    """
    if vocabulary not in _tables:
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        own = byte_alphabet()
        special = {t for t in model["vocab"] if not all(c in own for c in t)}
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(b <= a for a, b in zip(ids, ids[1:], strict=False)):
            raise ValueError("the merges of this vocabulary are not in the order of their ids")
        merged = set(ids)
        ranks = {bytes(own[c] for c in t): i for t, i in model["vocab"].items() if t not in special and (i in merged or len(t) == 1)}
        core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        _tables[vocabulary] = P.WordTable(lambda found: [core.encode_single_piece(w) for w in found])
    return _tables[vocabulary]


def encode_chunk(words: P.WordTable, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all documents of a chunk, one after another, and where each document's begin."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    fine = P.cut_long(data, offsets)
    for _, _, part, off in K.chunks(data, fine):
        s = P.starts(part, off)
        e = np.append(s[1:], len(part))
        h = K.slices(K.prefix(part), s, e)
        per_row = np.zeros(len(off) - 1, np.int64)
        row = np.searchsorted(off, s, "right") - 1
        # Many short words may be more than the table holds; a part of them never is.
        for i in range(0, len(s), words.most // 2):
            cut = slice(i, i + words.most // 2)
            at, size = words.lookup(h[cut], part, s[cut], e[cut])
            ids.append(P.gather(words.pool, at, size))
            np.add.at(per_row, row[cut], size)
        sizes.append(per_row)
    total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    # Edges at one place have no bytes, so no ids, between them.
    return np.concatenate(ids), total[np.searchsorted(fine, offsets)]


def encode_with_added(words: P.WordTable, added: AddedTokens | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode_chunk``, with the added tokens cut out first; what is between them is encoded by itself."""
    hits = [(m.start(), m.end(), added.ids[m.group()]) for m in added.pattern.finditer(memoryview(np.ascontiguousarray(data)))] if added else []
    # A match over the end of a document is none; the documents are then searched one by one.
    if any(np.searchsorted(offsets, a, "right") != np.searchsorted(offsets, b, "left") for a, b, _ in hits):
        edge = offsets.tolist()
        hits = [(p + m.start(), p + m.end(), added.ids[m.group()]) for p, q in zip(edge[:-1], edge[1:], strict=True) for m in added.pattern.finditer(data[p:q].tobytes())]
    if not hits:
        return encode_chunk(words, data, offsets)
    start, end, own = (np.array(x, np.int64) for x in zip(*hits, strict=True))
    # Without the tokens' bytes; each place of a token is an edge between two texts.
    gone = np.concatenate([[0], np.cumsum(end - start)])
    to = lambda x: x - gone[np.searchsorted(start, x, "left")]
    rest = np.concatenate([data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True)])
    edges = np.unique(np.concatenate([to(offsets), to(start)]))
    ids, at = encode_chunk(words, rest, edges)
    before = at[np.searchsorted(edges, to(start))]
    where = at[np.searchsorted(edges, to(offsets))] + np.searchsorted(start, offsets, "left")
    return np.insert(ids, before, own), where


def token_pieces(docs: DataFrame, vocabulary: str, max_tokens: int, eos: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, append ``eos``, cut what is longer than ``max_tokens``.

    Returns ``key, piece, start, length, ids_crc32`` (and ``ids`` if asked for).  The first
    piece takes the remainder, all others are full.  A null or empty text is ``eos`` alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        words, added = word_table(vocabulary), added_tokens(vocabulary)
        for b in batches:
            keys = b.column(0)
            for i, j, data, offsets in K.chunks(*K.buffers(b.column(1))):
                ids, at = encode_with_added(words, added, data, offsets)
                row, piece, start, length, crc, lists = [], [], [], [], [], []
                for d in range(j - i):
                    own = np.append(ids[at[d] : at[d + 1]], eos).astype("<u4")
                    cuts = [0, *range(len(own) % max_tokens or max_tokens, len(own) + 1, max_tokens)]
                    for k in range(len(cuts) - 1):
                        part = own[cuts[k] : cuts[k + 1]]
                        row.append(i + d)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            lists.append(part.astype(np.int32))
                cols = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(key, text).mapInArrow(run, schema)


def _repeated(a: int, have: np.ndarray, below: np.ndarray, full: int, gap: int, each: int) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, pattern) of a length too short for three to fill a sequence: ``a`` and a shorter length several times, then a third.

    Every number of times that ``a`` fits has its share of the ``each`` patterns.  Where none
    leaves as little as ``gap``, the one of least waste stays, so that each length has one.
    """
    times = full // a
    out = [(full - times * a, (a,) * times)]
    b = have[have < a]
    share = max(2, each // times)
    for k in range(1, times + 1):
        room = full - k * a
        fits = b[b <= room]
        m = room // fits
        left = room - m * fits
        c = below[left]
        waste = left - c
        for i in np.lexsort((-fits, waste))[:share].tolist():
            out.append((int(waste[i]), (a,) * k + (int(fits[i]),) * int(m[i]) + ((int(c[i]),) if c[i] else ())))
    return [x for x in out if x[0] <= gap] or [min(out)]


def patterns(lengths: list[int], full: int, gap: int, each: int = 48) -> list[tuple[int, ...]]:
    """Sets of at most three lengths that leave at most ``gap`` of a sequence, least waste first.

    For every longest length the ``each`` best completions by one or two others are kept,
    so that there are at most about ``full * each`` patterns.  Pieces of three such lengths
    fill a sequence, or, where the longest is too short for that, the first two repeat.
    """
    have = np.array(sorted(set(lengths)), np.int64)
    below = np.zeros(full + 1, np.int64)
    below[have] = have
    below = np.maximum.accumulate(below)
    out: set[tuple[int, tuple[int, ...]]] = set()
    for a in have[::-1].tolist():
        if 3 * a < full - gap:
            out.update(_repeated(a, have, below, full, gap, each))
            continue
        room = full - a
        if room <= gap:
            out.add((room, (a,)))
        b = have[have <= min(a, room)]
        # The largest third length that still fits beside each second one; 0 for none.
        c = np.concatenate([below[np.minimum(b, room - b)], np.zeros(len(b), np.int64)])
        b = np.concatenate([b, b])
        waste = room - b - c
        best = np.lexsort((-b, c > 0, waste))[:each]
        for i in best[waste[best] <= gap].tolist():
            out.add((int(waste[i]), (a, int(b[i]), int(c[i])) if c[i] else (a, int(b[i]))))
    return [p for _, p in sorted(out, key=lambda t: (t[0], len(t[1]), [-x for x in t[1]]))]


def fit(columns: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 12) -> list[float]:
    """Non-negative least squares: repeats of each pattern that best reproduce the histogram.

    Coordinate descent; a pattern touches at most three lengths, so a sweep costs a few
    operations a pattern whatever the number of documents.
    """
    left = {k: float(v) for k, v in counts.items()}
    x = [0.0] * len(columns)
    shape = []
    for p in columns:
        m: dict[int, int] = defaultdict(int)
        for v in p:
            m[v] += 1
        shape.append((tuple(m.items()), sum(c * c for c in m.values())))
    for _ in range(sweeps):
        moved = 0.0
        for j, (items, norm) in enumerate(shape):
            new = max(0.0, x[j] + sum(c * left[v] for v, c in items) / norm)
            step = new - x[j]
            if step:
                for v, c in items:
                    left[v] -= c * step
                x[j] = new
                moved += abs(step)
        if moved < 0.5:
            break
    return x


def best_fit(counts: dict[int, int], full: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: groups of equal sequences move together."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(space: int, items: tuple[int, ...], n: int) -> None:
        if n:
            room[space][items] = room[space].get(items, 0) + n

    for v in sorted(counts, reverse=True):
        left = counts[v]
        for space in range(v, full):
            # A sequence that still has room for this length after taking it is met again below.
            while left and room.get(space):
                items, n = next(iter(room[space].items()))
                del room[space][items]
                take = min(space // v, left)
                each = take if n * take <= left else max(1, min(take, left // n)) if left >= n else 1
                used = min(n, left // each)
                put(space - each * v, items + (v,) * each, used)
                left -= used * each
                if n > used:
                    put(space, items, n - used)
        if left:
            each = full // v
            put(full - each * v, (v,) * each, left // each)
            if left % each:
                put(full - (left % each) * v, (v,) * (left % each), 1)
    return [(items, n) for group in room.values() for items, n in group.items()]


def _realised(columns: list[tuple[int, ...]], counts: dict[int, int]) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """The fitted repeats, rounded and kept to what there is, and the counts that are left."""
    left, out = dict(counts), []
    for p, x in zip(columns, fit(columns, counts), strict=True):
        n = min(int(x + 0.5), *(left[v] // p.count(v) for v in set(p)))
        if n > 0:
            out.append((p, n))
            for v in p:
                left[v] -= n
    return out, {v: n for v, n in left.items() if n}


def _repaired(out: list[tuple[tuple[int, ...], int]], full: int, rounds: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences with gaps, and in turn a third of the full ones, taken apart and packed best-fit again where that needs fewer."""
    least = -(-sum(n * sum(p) for p, n in out) // full)
    gaps = (1, full // 64, full // 8)
    for t in range(rounds):
        for choice in range(len(gaps) + 1):
            if sum(n for _, n in out) <= least:
                return out
            keep: dict[tuple[int, ...], int] = defaultdict(int)
            pool: dict[int, int] = defaultdict(int)
            for i, (p, n) in enumerate(out):
                gap = full - sum(p)
                if gap >= gaps[choice] if choice < len(gaps) else gap or i % 3 == t % 3:
                    for v in p:
                        pool[v] += n
                else:
                    keep[p] += n
            again = best_fit(pool, full)
            if sum(keep.values()) + sum(n for _, n in again) < sum(n for _, n in out):
                for p, n in again:
                    keep[p] += n
                out = list(keep.items())
    return out


def plan(counts: dict[int, int], full: int, rounds: int = 8) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) covering a histogram of piece lengths.

    Patterns with a length over half a sequence are fitted first, since each such piece
    needs a sequence of its own; what best-fit leaves of the short ones is fitted by
    patterns of short lengths.  Repeats are rounded, residuals packed best-fit, and gaps
    repaired.
    """
    gap = full // 32
    out, left = _realised([p for p in patterns(list(counts), full, gap) if 2 * p[0] > full], counts)
    short: dict[int, int] = defaultdict(int)
    for p, n in best_fit(left, full):
        if 2 * max(p) > full:
            out.append((p, n))
        else:
            for v in p:
                short[v] += n
    if short:
        more, left = _realised(patterns(list(short), full, gap), short)
        out += more + best_fit(left, full)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for p, n in out:
        merged[p] += n
    return _repaired(list(merged.items()), full, rounds)


def pack(pieces: DataFrame, max_tokens: int, key: str = "doc_id") -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset`` in as few sequences as it can.

    The histogram of lengths (at most ``max_tokens`` rows) is all that reaches the driver.
    There, patterns of at most three lengths that fill a sequence or nearly so are fitted to
    it by non-negative least squares, rounded, and the rest is packed best-fit.  The plan
    says which ranks of a length go to which run of sequences, so it is small however many
    pieces there are; ranks within a length come from per-partition counts.

    Null keys, repeated rows and ties are pieces like any other; an empty table gives no rows.
    """
    rows = pieces.withColumn("_one", F.lit(1).cast("long"))
    order = ["length", key, "piece"]
    parts = spread(rows, *order)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = with_running(parts, order, {"_rank": "_one"}, within=["length"])
    entries, used, sequence = [], defaultdict(int), 0
    for items, n in plan(counts, max_tokens):
        offset = 0
        for v in items:
            entries.append((v, used[v], used[v] + n, sequence - used[v], offset))
            used[v] += n
            offset += v
        sequence += n
    spark = pieces.sparkSession
    table = spark.createDataFrame(entries or [(0, 0, 0, 0, 0)], "length long, _from long, _to long, _base long, offset long")
    # Bounded by the lengths up to max_tokens, not by the pieces: patterns and runs of equal sequences.
    on = (ranked["length"] == table["length"]) & (ranked["_rank"] >= table["_from"]) & (ranked["_rank"] < table["_to"])
    return ranked.join(F.broadcast(table), on).select(*(ranked[c] for c in pieces.columns), (F.col("_rank") + F.col("_base")).alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, vocabulary: str, max_tokens: int = 1024, eos: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack documents: a row per piece with its sequence and place in it."""
    pieces = stored(token_pieces(docs, vocabulary, max_tokens, eos, key, text), "pieces")
    return pack(pieces, max_tokens, key)
