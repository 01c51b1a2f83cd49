"""Improbable-feature digests: rare byte windows in chained Bloom filters, and their likeness.

A feature is a window of bytes.  Its rarity is that of its entropy among all windows of the
corpus.  Slid over the features of a text, a span votes for its rarest one (the leftmost of
equals); what gets enough votes goes, in text order and each once, into Bloom filters of a
fixed size, a new one whenever the last is full.  Two digests are compared filter by
filter: common bits beyond those that chance gives, as a share of the most there could be.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import stored

U = np.uint64
#: Thousandths of the greatest entropy; windows under WEAK are taken only where nothing else is there.
STEPS, WEAK = 1000, 100
#: Bits of a filter, features of a filter, bits of a feature, and the share of chance and most that counts as none.
BITS, FULL, HASHES, CUTOFF = 2048, 160, 5, 0.1
#: Pairs of filters that are compared at once, and filters that are filled at once.
PAIR_BLOCK, FILTER_BLOCK = 1 << 14, 1 << 12
_ONE = 1 << 20


@dataclass(frozen=True)
class Scale:
    """Bytes of a feature, features of a voting span, votes that select, and the bytes of the longest text it is for."""

    window: int
    span: int
    votes: int
    longest: int | None = None


#: Every text has the wide features; a text under 512 bytes, which has few of them, narrow ones too, and one under 64 every three bytes.
SCALES = (Scale(32, 32, 8), Scale(8, 8, 2, 511), Scale(3, 1, 1, 63))


def entropies(data: np.ndarray, window: int) -> np.ndarray:
    """Entropy of every window of bytes, in thousandths of the greatest, rounded down.

    The sum of c * log2(c) over the bytes of a window changes, from one window to the next,
    by the byte that leaves and the one that comes; whole numbers keep it exact, so equal
    windows have equal values wherever they stand.
    """
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for j in range(1, window):
        same = (data[:-j] == data[j:]).view(np.uint8)
        ahead[:-j] += same
        behind[j:] += same
    f = np.zeros(window + 1, np.int32)
    f[2:] = [round(c * np.log2(c) * _ONE) for c in range(2, window + 1)]
    step = np.append(0, np.diff(f)).astype(np.int32)
    total = np.empty(n, np.int32)
    total[0] = f[np.bincount(data[:window], minlength=256)].sum()
    total[1:] = step[behind[window:]] - step[ahead[: n - 1]]
    np.cumsum(total, out=total)
    return ((f[window] - total) * (STEPS / float(f[window]))).astype(np.int16)


def _of_scale(scale: Scale, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that a scale is for: bytes, offsets, rows."""
    size = np.diff(offsets)
    good = size >= scale.window if scale.longest is None else (size >= scale.window) & (size <= scale.longest)
    if good.all():
        return data, offsets, np.arange(len(size))
    return data[np.repeat(good, size)], np.concatenate([[0], np.cumsum(size[good])]), np.flatnonzero(good)


def _parts(data: np.ndarray, offsets: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, begin): runs of texts, and parts of the long ones that overlap by ``reach`` bytes."""
    for i, j, part, off in K.chunks(data, offsets):
        if j - i > 1 or len(part) <= K.CHUNK_BYTES + reach:
            yield part, off, np.arange(i, j), np.zeros(j - i, np.int64)
            continue
        for a in range(0, len(part) - reach, K.CHUNK_BYTES):
            piece = part[a : a + K.CHUNK_BYTES + reach]
            yield piece, np.array([0, len(piece)]), np.array([i]), np.array([a])


def histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(scale, thousandth) counts of all windows of these texts."""
    out = np.zeros((len(SCALES), STEPS + 1), np.int64)
    for s, scale in enumerate(SCALES):
        bytes_, edges, _ = _of_scale(scale, data, offsets)
        for part, off, _, _ in _parts(bytes_, edges, scale.window - 1):
            e = entropies(part, scale.window)
            out[s] += np.bincount(e[_within(off, scale.window, len(e))], minlength=STEPS + 1)
    return out


def _within(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of ``n`` places, those from which ``width`` places are in one text."""
    good = np.ones(max(n, int(offsets[-1])), bool)
    for k in range(1, width):
        good[np.maximum(offsets[1:] - k, offsets[:-1])[offsets[1:] > offsets[:-1]]] = False
    return good[:n]


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of every entropy by scale, the rarest first and the weak ones last."""
    value = np.arange(STEPS + 1)
    return np.stack([np.argsort(np.lexsort((value, c, value < WEAK))) for c in counts])


def _selected(scale: Scale, rank: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, fingerprint) of the selected features of texts that this scale is for."""
    bytes_, edges, row_of = _of_scale(scale, data, offsets)
    size, span = np.diff(edges), scale.span
    found = []
    for part, off, rows, begin in _parts(bytes_, edges, scale.window - 1 + span - 1):
        n = len(part) - scale.window + 1
        if n <= 0:
            continue
        # The rank above, the place below: the least is the leftmost of the rarest.
        key = rank[entropies(part, scale.window)].astype(np.int64) << 32 | np.arange(n)
        least, reach = key, 1
        while reach < span and len(least):
            step = min(reach, span - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        voted = least[_within(off, scale.window + span - 1, len(least))] & 0xFFFFFFFF
        votes = np.bincount(voted, minlength=n)
        # A text with fewer features than a span holds has one span of all of them.
        feats = np.diff(off) - scale.window + 1
        for r in np.flatnonzero((feats > 0) & (feats < span)).tolist():
            votes[key[off[r] : off[r] + feats[r]].min() & 0xFFFFFFFF] += 1
        at = np.flatnonzero(votes)
        owner = np.searchsorted(off, at, "right") - 1
        prints = K.slices(K.prefix(part), at, at + scale.window)
        found.append((rows[owner], at - off[owner] + begin[owner], votes[at], prints))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    row, place, votes, prints = (np.concatenate(x) for x in zip(*found, strict=True))
    # A feature near the edge of two parts has votes from both.
    order = np.lexsort((place, row))
    row, place, votes, prints = row[order], place[order], votes[order], prints[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    fresh = np.flatnonzero(fresh)
    votes = np.add.reduceat(votes, fresh) if len(fresh) else votes
    row, place, prints = row[fresh], place[fresh], prints[fresh]
    spans = np.maximum(size[row] - scale.window + 1 - span + 1, 1)
    ok = votes >= np.minimum(scale.votes, spans)
    return row_of[row[ok]], place[ok], prints[ok]


@dataclass
class Digests:
    """Digests of texts: features of each, first filter of each (one more at the end), filters as 64-bit words, bits set."""

    features: np.ndarray
    at: np.ndarray
    filters: np.ndarray
    ones: np.ndarray

    def text(self, i: int) -> str:
        """Number of features, a colon, and the filters in base 64."""
        return f"{self.features[i]}:{base64.b64encode(self.filters[self.at[i] : self.at[i + 1]].tobytes()).decode()}"

    def one(self, i: int) -> Digests:
        cut = slice(self.at[i], self.at[i + 1])
        return Digests(self.features[i : i + 1], np.array([0, self.at[i + 1] - self.at[i]]), self.filters[cut], self.ones[cut])


def read_digest(text: str) -> Digests:
    """The digest that :meth:`Digests.text` wrote."""
    n, _, rest = text.partition(":")
    filters = np.frombuffer(base64.b64decode(rest), U).reshape(-1, BITS // 64)
    return Digests(np.array([int(n)]), np.array([0, len(filters)]), filters, np.bitwise_count(filters).sum(axis=1, dtype=np.int64))


def joined(*parts: Digests) -> Digests:
    at = np.cumsum(np.concatenate([[0], *(np.diff(p.at) for p in parts)]))
    return Digests(np.concatenate([p.features for p in parts]), at, np.concatenate([p.filters for p in parts]), np.concatenate([p.ones for p in parts]))


def digests(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> Digests:
    """Digests of texts, by the ranks of :func:`rarity`."""
    size = np.diff(offsets)
    picked = [_selected(scale, ranks[s], data, offsets) for s, scale in enumerate(SCALES)]
    # A text shorter than any window is one feature, the whole of it.
    tiny = np.flatnonzero((size > 0) & (size < min(s.window for s in SCALES)))
    if len(tiny):
        bytes_ = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in tiny.tolist()])
        edge = np.concatenate([[0], np.cumsum(size[tiny])])
        picked.append((tiny, np.zeros(len(tiny), np.int64), K.slices(K.prefix(bytes_), edge[:-1], edge[1:])))
    which = np.concatenate([np.full(len(p[0]), s) for s, p in enumerate(picked)])
    row, place, prints = (np.concatenate(x) for x in zip(*picked, strict=True))
    order = np.lexsort((place, which, row))
    row, prints = row[order], prints[order]
    _, first = np.unique(K.in_row(prints, row), return_index=True)
    first = np.sort(first)
    row, prints = row[first], prints[first]
    n = np.bincount(row, minlength=len(size))
    at = np.concatenate([[0], np.cumsum(-(-n // FULL))])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    slot = at[row] + nth // FULL
    filters = np.zeros((at[-1], BITS // 64), U)
    for lo in range(0, int(at[-1]), FILTER_BLOCK):
        a, b = np.searchsorted(slot, [lo, lo + FILTER_BLOCK])
        rows = min(FILTER_BLOCK, int(at[-1]) - lo)
        bits = np.zeros((rows, BITS), bool)
        for j in range(HASHES):
            bits[slot[a:b] - lo, (prints[a:b] >> U(11 * j)).astype(np.int64) % BITS] = True
        filters[lo : lo + rows] = np.packbits(bits, axis=1).view(U)
    return Digests(n, at, filters, np.bitwise_count(filters).sum(axis=1, dtype=np.int64))


def _toward(a: Digests, i: np.ndarray, b: Digests, j: np.ndarray) -> np.ndarray:
    """For pairs (i of a, j of b): the mean, by features, of the best match of each filter of i."""
    ka, kb = a.at[i + 1] - a.at[i], b.at[j + 1] - b.at[j]
    # One entry for each filter of i; its matches are all filters of j.
    pair = np.repeat(np.arange(len(i)), ka)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(ka) - ka, ka)
    fa = a.at[i][pair] + nth
    held = np.minimum(FULL, a.features[i][pair] - FULL * nth)
    best = np.zeros(len(pair))
    many = kb[pair]
    step = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < len(pair):
        hi = max(lo + 1, int(np.searchsorted(step, step[lo] + PAIR_BLOCK, "right")) - 1)
        m = many[lo:hi]
        own = np.repeat(np.arange(lo, hi), m)
        other = b.at[j][pair[own]] + np.arange(len(own)) - np.repeat(step[lo:hi] - step[lo], m)
        for x in range(0, len(own), PAIR_BLOCK):
            p, q = own[x : x + PAIR_BLOCK], other[x : x + PAIR_BLOCK]
            common = np.bitwise_count(a.filters[fa[p]] & b.filters[q]).sum(axis=1, dtype=np.int64)
            na, nb = a.ones[fa[p]], b.ones[q]
            most, chance = np.minimum(na, nb), na * nb / BITS
            cut = chance + CUTOFF * np.maximum(most - chance, 0)
            score = np.where(common == np.maximum(na, nb), 1.0, np.clip((common - cut) / np.maximum(most - cut, 1e-9), 0, 1))
            np.maximum.at(best, p, score)
        lo = hi
    weight = np.bincount(pair, held, len(i))
    return np.bincount(pair, best * held, len(i)) / np.maximum(weight, 1)


def likeness(a: Digests, i: np.ndarray, b: Digests, j: np.ndarray) -> np.ndarray:
    """0 to 1 for pairs (i of a, j of b), the same either way round.

    The digest with fewer features is looked for in the other; of two of one size the
    better way counts.  Two digests without features are alike, one without is like none.
    """
    out = np.zeros(len(i))
    na, nb = a.features[i], b.features[j]
    out[(na == 0) & (nb == 0)] = 1.0
    some = (na > 0) & (nb > 0)
    x = np.flatnonzero(some & (na <= nb))
    out[x] = _toward(a, i[x], b, j[x])
    y = np.flatnonzero(some & (nb <= na))
    out[y] = np.maximum(out[y], _toward(b, j[y], a, i[y]))
    return out


def _counted(batches):
    total = np.zeros((len(SCALES), STEPS + 1), np.int64)
    for b in batches:
        for _, _, data, offsets in K.chunks(*K.buffers(b.column(0))):
            total += histograms(data, offsets)
    scale, value = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(scale, pa.int32()), pa.array(value, pa.int32()), pa.array(total[scale, value])], ["scale", "value", "n"])


def entropy_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks by rarity from the windows of all texts; at most 1001 counts a scale reach the driver."""
    counts = np.zeros((len(SCALES), STEPS + 1), np.int64)
    found = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(_counted, "scale int, value int, n long")
    for r in found.groupBy("scale", "value").agg(F.sum("n").alias("n")).collect():
        counts[r.scale, r.value] = r.n
    return rarity(counts)


def edited(own: str, other: str) -> str:
    """``own`` with its last third (rounded down) replaced by as much of the beginning of ``other``."""
    n = len(own) // 3
    return own[: len(own) - n] + other[:n]


def _of_strings(texts: list[str], ranks: np.ndarray) -> Digests:
    raw = [t.encode() for t in texts]
    return digests(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), ranks)


def _compared(texts: list[str], after: list[str], own: Digests, following: Digests, ranks: np.ndarray) -> dict[str, list]:
    """The columns of texts and of those that come after them."""
    changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
    new = _of_strings(changed, ranks)
    every = np.arange(len(texts))
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [own.text(i) for i in range(len(texts))],
        "edited_fingerprint": [new.text(i) for i in range(len(texts))],
        "near_edited": likeness(own, every, new, every).tolist(),
        "near_next": likeness(own, every, following, every).tolist(),
    }


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _in_order(ranks: np.ndarray):
    """Over rows in order: results of all but the last, and first and last text for the neighbours."""

    def run(batches):
        held = None  # the last row so far: key, text, digest
        part = None

        def batch(kind: int, keys, texts, cols: dict[str, list]) -> pa.RecordBatch:
            n = len(keys)
            none = [None] * n
            kept = texts if kind else none
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), keys, pa.array(kept, pa.string()), pa.array(cols.get("n_chars", none), pa.int64())]
                + [pa.array(cols.get(c, none), pa.string()) for c in _NAMES[1:4]]
                + [pa.array(cols.get(c, none), pa.float64()) for c in _NAMES[4:]],
                ["kind", "part", "key", "text", *_NAMES],
            )

        for b in batches:
            _, sizes = K.buffers(b.column(1))
            for i, j, _, _ in K.chunks(np.zeros(0, np.uint8), sizes):
                keys, texts = b.column(0).slice(i, j - i), b.column(1).slice(i, j - i).to_pylist()
                now = _of_strings(texts, ranks)
                if held is None:
                    part = b.column(2)[0].as_py()
                    yield batch(1, keys.slice(0, 1), texts[:1], {})
                else:
                    keys, texts, now = pa.concat_arrays([held[0], keys]), [held[1], *texts], joined(held[2], now)
                last = len(texts) - 1
                if last:
                    following = Digests(now.features[1:], now.at[1:], now.filters, now.ones)
                    yield batch(0, keys.slice(0, last), texts[:last], _compared(texts[:last], texts[1:], now, following, ranks))
                held = keys.slice(last, 1), texts[last], now.one(last)
        if held:
            yield batch(2, held[0], [held[1]], {})

    return run


def _at_edges(ranks: np.ndarray):
    def run(batches):
        for b in batches:
            for i, j, _, _ in K.chunks(*K.buffers(b.column(1))):
                own, after = (b.column(c).slice(i, j - i).to_pylist() for c in (1, 2))
                cols = _compared(own, after, _of_strings(own, ranks), _of_strings(after, ranks), ranks)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(cols[c]) for c in _NAMES)], ["key", *_NAMES])

    return run


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """A row for each document: its digest, that of its text after an edit, and likenesses.

    The edit replaces the last third of the text (code points, rounded down) by as much of
    the beginning of the next document in descending ``key`` order; after the last comes the
    first.  ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` (likeness of the text's digest to that of the edited text) and
    ``near_next`` (to that of the next document).  ``ranks`` come from
    :func:`entropy_ranks`, by default of all these documents; digests of different ranks
    don't compare.

    The table is range-partitioned once and read in order.  What crosses the edge of a
    partition, one text on either side, is joined afterwards.

    A null text is empty; the digest of an empty text has no features, and two of them are
    alike.  Null keys come last; rows of one key are ordered by a digest of their texts, and
    equal rows have each other as next ones.  A table of one row has itself as its next one;
    an empty table gives no rows.  Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if ranks is None:
        ranks = entropy_ranks(rows)
    kind = docs.schema[key].dataType.simpleString()
    # The last of these tells equal rows apart, so that any number of them is split; their order makes no difference.
    order = [F.col("key").desc_nulls_last(), F.col("digest"), F.col("nth")]
    placed = rows.select("key", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("nth"))
    placed = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    read = stored(placed.select("key", "text", F.spark_partition_id().alias("part")).mapInArrow(_in_order(ranks), f"kind int, part int, key {kind}, text string, {_RESULT}"), "digests", compression="zstd")
    edges = read.where("kind > 0").select("kind", "part", "key", "text")
    # One number for each partition that has rows: in a circle, each with the next.
    parts = sorted(r.part for r in edges.where("kind = 1").select("part").collect())
    circle = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    ends = edges.where("kind = 2").join(F.broadcast(circle), "part").select("key", "text", "following")
    starts = edges.where("kind = 1").select(F.col("part").alias("following"), F.col("text").alias("after"))
    last = ends.join(starts, "following").select("key", "text", "after").mapInArrow(_at_edges(ranks), f"key {kind}, {_RESULT}")
    return read.where("kind = 0").select("key", *_NAMES).unionByName(last).withColumnRenamed("key", key)
