"""Near duplicates by BagMinHash signatures of weighted word shingles, bands, and exact checks.

A document is the multiset of its five-word shingles.  A shingle of weight w owns the
points of independent Poisson processes on the dyadic pieces [0, 1), [1, 2), [2, 4), ...
of the weight axis, up to w; each point has a time and a signature component.  The least
time of a component is equal in two documents with the probability of their weighted
Jaccard similarity.  A shingle stops as soon as its next point is later than the latest
component of its document, so most shingles cost one or two points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, stored
from .graph import connected_components

SHINGLE = 5
THRESHOLD = 0.8
#: At the threshold a pair shares no band with probability (1 - 0.8**5)**32 < 4e-6.
BANDS, ROWS = 32, 5
#: Rounds of second centres, for links that no first centre has.
SECOND_CENTRES = 1
#: Shingles whose points are drawn together.
SHINGLE_BLOCK = 1 << 17
#: Rows of a block in which the undecided members of one bucket are compared.
BLOCK = 512
#: Bins of the sketch that rules pairs out without their bags.
BINS = 256
U = np.uint64


def bags(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint, count) of the distinct shingles, in order of row, then fingerprint.

    A text of fewer words than a shingle has one shingle of all its words.
    """
    h, row = K.word_prints(data, offsets)
    g, at = K.grams(h, row, shingle)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((n_words > 0) & (n_words < shingle))
    if len(few):
        first = np.searchsorted(row, few)
        total = np.zeros(len(few), U)
        for j in range(shingle - 1):
            on = n_words[few] > j
            total[on] += h[first[on] + j] * U(K._ODD[j])
        g = np.concatenate([g, K.mix(total + n_words[few].astype(U))])
        at_row = np.concatenate([row[at], few])
    else:
        at_row = row[at]
    if len(offsets) == 2:
        g = np.sort(g)
    else:
        order = np.lexsort((g, at_row))
        g, at_row = g[order], at_row[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (at_row[1:] != at_row[:-1])
    begin = np.flatnonzero(fresh)
    return at_row[begin], g[begin], np.diff(np.append(begin, len(g)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(row: np.ndarray, g: np.ndarray, count: np.ndarray, n_rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n_rows, m) float32 least times; a row without shingles has infinities."""
    best = np.full(n_rows * m, np.inf)
    # The least times of some shingles go into those of the next: memory is that of a block.
    for i in range(0, len(g), SHINGLE_BLOCK):
        part = slice(i, i + SHINGLE_BLOCK)
        _draw(row[part], g[part], count[part], n_rows, m, best)
    return best.reshape(n_rows, m).astype(np.float32)


def _draw(row: np.ndarray, g: np.ndarray, count: np.ndarray, n_rows: int, m: int, best: np.ndarray) -> None:
    """Lower ``best`` by the points of these shingles."""
    # One process for each shingle and dyadic piece of its weight.
    level = np.zeros(len(count), np.int64)
    level[count > 1] = np.ceil(np.log2(count[count > 1])).astype(np.int64)
    which = np.repeat(np.arange(len(count)), level + 1)
    piece = np.arange(len(which)) - np.repeat(np.cumsum(level + 1) - (level + 1), level + 1)
    length = np.where(piece == 0, 1.0, 2.0 ** np.maximum(piece - 1, 0))
    low = np.where(piece == 0, 0.0, length)
    share = np.minimum(1.0, (count[which] - low) / length)
    seed = K.mix(g[which] ^ K.mix(piece.astype(U) + U(0x51ED270B)))
    owner = row[which].astype(np.int64)
    latest = best.reshape(n_rows, m).max(axis=1)
    at = np.zeros(len(seed))
    live, drawn, width = np.arange(len(seed)), 0, 1
    while len(live):
        step = np.arange(drawn + 1, drawn + width + 1, dtype=np.int64).astype(U)
        bits = K.mix(seed[live][:, None] + step[None, :] * U(0x9E3779B97F4A7C15))
        gap = -np.log(_uniform(bits)) / (length[live] * m)[:, None]
        when = at[live][:, None] + np.cumsum(gap, axis=1)
        at[live] = when[:, -1]
        more = K.mix(bits ^ U(0xA5A5A5A55A5A5A5A))
        comp = ((more >> U(32)) * U(m) >> U(32)).astype(np.int64)
        own = owner[live][:, None]
        good = (when < latest[own]) & ((more & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < share[live][:, None])
        np.minimum.at(best, (own * m + comp)[good], when[good])
        rows = np.unique(owner[live]) if len(live) < n_rows else np.arange(n_rows)
        latest[rows] = best.reshape(n_rows, m)[rows].max(axis=1)
        live = live[at[live] < latest[owner[live]]]
        drawn += width
        if drawn >= 2:
            width = min(64, width * 2)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) int64 bucket keys; the band's number is part of the key."""
    bits = signature.view(np.uint32).astype(U).reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1).astype(U) * U(K._ODD[2]), bits.shape[:2]).copy()
    for r in range(rows):
        h = K.mix(h + bits[:, :, r] * U(K._ODD[r]))
    return h.astype(np.int64)


def _digests(row: np.ndarray, g: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's multiset, whatever the order, and its total weight."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF):
        item = K.mix(K.mix(g + U(salt)) + count.astype(U) * U(K._ODD[4]))
        pre = np.concatenate([np.zeros(1, U), np.cumsum(item, dtype=U)])
        edge = np.searchsorted(row, np.arange(n + 1))
        out.append(K.mix(pre[edge[1:]] - pre[edge[:-1]] + U(salt)).astype(np.int64))
    return out[0], out[1], np.bincount(row, weights=count, minlength=n).astype(np.int64)


def _signatures(key: str):
    def run(batches):
        for b in batches:
            for i, j, data, offsets in K.chunks(*K.buffers(b.column(1))):
                row, g, count = bags(data, offsets)
                d1, d2, weight = _digests(row, g, count, j - i)
                bands = band_keys(bag_minhash(row, g, count, j - i))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(d1), pa.array(d2), pa.array(weight), lists], [key, "node", "check", "weight", "bands"])

    return run


#: Bytes of a shingle's fingerprint and count where two bags are compared.
_FP, _COUNT = 6, 4


def _pack_bag(g: np.ndarray, count: np.ndarray) -> bytes:
    """48-bit fingerprints in order, then counts unless all are one."""
    fp = (g >> U(64 - 8 * _FP)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_FP]
    return len(g).to_bytes(4, "little") + fp.tobytes() + (b"" if (count == 1).all() else count.astype("<u4").tobytes())


def _unpack_bag(x) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(x.as_buffer(), np.uint8)
    n = int.from_bytes(raw[:4].tobytes(), "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :_FP] = raw[4 : 4 + _FP * n].reshape(n, _FP)
    rest = raw[4 + _FP * n :]
    return wide.view("<u8").ravel(), rest.copy().view("<u4").astype(np.int64) if len(rest) else np.ones(n, np.int64)


def _shingles(batches):
    for b in batches:
        for i, j, data, offsets in K.chunks(*K.buffers(b.column(0))):
            row, g, count = bags(data, offsets)
            d1, d2, _ = _digests(row, g, count, j - i)
            edge = np.searchsorted(row, np.arange(j - i + 1)).tolist()
            blobs = [_pack_bag(g[p:q], count[p:q]) for p, q in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(blobs, pa.binary())], ["node", "check", "bag"])


def similarity(g1: np.ndarray, c1: np.ndarray, g2: np.ndarray, c2: np.ndarray) -> tuple[int, int]:
    """(common weight, weight of the union) of two bags in order of fingerprint."""
    at = np.minimum(np.searchsorted(g2, g1), max(len(g2) - 1, 0))
    same = g2[at] == g1 if len(g2) else np.zeros(len(g1), bool)
    both = int(np.minimum(c1[same], c2[at[same]]).sum())
    return both, int(c1.sum()) + int(c2.sum()) - both


def _similar(threshold: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                both, either = similarity(*_unpack_bag(x), *_unpack_bag(y))
                keep.append(both >= threshold * either)
            hit = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], ["a", "b"])

    return run


def _verified(edges: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The edges whose exact weighted Jaccard similarity reaches the threshold.

    Both joins are between plain exchanges, so that a node with very many edges is split
    by adaptive execution.
    """
    left = edges.hint("shuffle_merge").join(shingles.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")).hint("shuffle_merge"), "b")
    full = left.hint("shuffle_merge").join(shingles.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")).hint("shuffle_merge"), "a")
    return stored(full.select("a", "b", "bag_a", "bag_b").mapInArrow(_similar(threshold), "a long, b long"), "links")


def sketch(g: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weight of a bag by bins of the fingerprint, at most 255 a bin.

    Adding up and cutting off never make two bags differ more, so the sum of differences
    of two sketches is at most that of the bags.
    """
    return np.minimum(np.bincount((g % U(BINS)).astype(np.int64), weights=count, minlength=BINS), 255).astype(np.uint8)


def _sketches(batches):
    for b in batches:
        bags_of = [_unpack_bag(x) for x in b.column(1)]
        weight = [int(c.sum()) for _, c in bags_of]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight, pa.int64()), pa.array([sketch(g, c).tobytes() for g, c in bags_of], pa.binary())], ["node", "weight", "sketch"])


def _undecided(threshold: float):
    """Pairs of two blocks of a bucket, in different components, that their sketches leave possible.

    With total weight w and sum of differences d the similarity is (w - d) / (w + d), and
    a sketch's d is never above the bag's: no pair that reaches the threshold is ruled out.
    ``lower`` holds the lesser open buckets of a node: a pair comes from the least bucket that
    it shares, so once, not once a bucket.
    """

    def run(table: pa.Table) -> pa.Table:
        node, root, weight, block = (np.asarray(table.column(c)) for c in ("node", "root", "weight", "block"))
        rows = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
        lists = table.column("lower").combine_chunks()
        at, lower = np.diff(np.asarray(lists.offsets)), np.zeros((len(lists), BANDS), np.int64)
        held = np.arange(BANDS) < at[:, None]
        lower[held] = np.asarray(lists.flatten())
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        most = (1 - threshold) / (1 + threshold) * (1 + 1e-9)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left:
            ok = root[right] != root[i]
            if first == second:
                ok &= node[right] > node[i]
            j = right[ok]
            j = j[np.abs(weight[j] - weight[i]) <= most * (weight[j] + weight[i])]
            j = j[np.abs(rows[j] - rows[i]).sum(axis=1, dtype=np.int64) <= most * (weight[j] + weight[i])]
            j = j[~(np.isin(lower[j], lower[i][held[i]]) & held[j]).any(axis=1)]
            a.append(np.minimum(node[i], node[j]))
            b.append(np.maximum(node[i], node[j]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _possible(placed: DataFrame, roots: DataFrame, shingles: DataFrame, threshold: float, scratch: Callable) -> DataFrame:
    """All pairs that share a bucket, are in different components and are not ruled out by their sketches.

    In a bucket of up to three nodes the centres have met every pair.  The members of a
    bucket's largest component need not meet each other: their blocks meet those of the
    others only, so that the rows grow with the undecided pairs.  Each pair comes once, however
    many buckets it shares.
    """
    rooted = scratch(placed.where("n > 3").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "rooted")
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("_top"), F.sum("n").alias("n")).where("n > _top.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = scratch(open_.select("bucket", F.col("_top.root").alias("top_root"), blocks(F.col("n") - F.col("_top.n")).alias("few"), blocks(F.col("_top.n")).alias("many")), "open")
    inside = scratch(rooted.hint("shuffle_merge").join(open_.hint("shuffle_merge"), "bucket"), "inside")
    wanted = shingles.hint("shuffle_merge").join(inside.select("node").distinct().hint("shuffle_merge"), "node", "left_semi")
    sketches = scratch(wanted.select("node", "bag").mapInArrow(_sketches, "node long, weight long, sketch binary"), "sketches")
    # Blocks 0 to few - 1 hold what is outside the largest component, the others its members.
    place, largest = F.xxhash64("node"), F.col("root") == F.col("top_root")
    held = inside.groupBy("node").agg(F.collect_set("bucket").alias("_held"))
    facts = scratch(sketches.hint("shuffle_merge").join(held.hint("shuffle_merge"), "node"), "facts")
    drawn = inside.hint("shuffle_merge").join(facts.hint("shuffle_merge"), "node")
    drawn = drawn.withColumn("lower", F.filter("_held", lambda x: x < F.col("bucket")))
    drawn = drawn.withColumn("block", F.when(largest, F.col("few") + F.pmod(place, F.col("many"))).otherwise(F.pmod(place, F.col("few"))).cast("int"))
    pairs = drawn.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(largest, 0).otherwise(F.col("many")))))
    pairs = pairs.select("bucket", F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"), "block", "node", "root", "weight", "sketch", "lower")
    return pairs.groupBy("bucket", "first", "second").applyInArrow(_undecided(threshold), "a long, b long")


def told_apart(rows: DataFrame, clashing: DataFrame) -> DataFrame:
    """Rows whose ``node`` is one of ``clashing``, a name of several multisets, get one made of both digests."""
    other = clashing.select(F.col("node").alias("_clash")).distinct()
    met = rows.join(other, rows["node"] == other["_clash"], "left")
    return met.withColumn("node", F.when(F.col("_clash").isNotNull(), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("_clash")


def _rows(table: DataFrame) -> int:
    """Rows of a stored table, from its files' footers."""
    return table.count()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, second_centres: int = SECOND_CENTRES) -> DataFrame:
    """``key, class_id, class_size``: the class of every row; ``class_id`` is its smallest key.

    Classes are the connected components of "weighted Jaccard similarity of five-word
    shingles is at least ``threshold``".  Texts with equal multisets are one node from the
    start, so copies are never compared.  Within a bucket every node is first compared with
    the bucket's centre, the node whose buckets are the fullest; where that leaves several
    components, also with a second centre.  What is then undecided, all pairs of a bucket in
    different components, is compared in blocks: sketches rule out pairs that cannot reach
    the threshold, the others are compared exactly.  So every pair that shares a bucket is
    decided, whatever ``second_centres`` is (rounds that only make the undecided part small);
    the work on sketches grows with the members of a family outside its largest component,
    times all of its members.

    A node is named by a 64-bit digest of its multiset; where several multisets share one, as
    some pairs among 10**10 texts do, a second digest tells them apart.

    A null text is an empty one; texts without words form one class.  Keys need not be
    unique; null keys are allowed and never a ``class_id`` unless the class has no other.
    Repeated rows come back as often as they came in; an empty table gives no rows; extra
    columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    rows = stored(source.mapInArrow(_signatures(key), f"`{key}` {kind}, node long, check long, weight long, bands array<long>"), "signatures")
    # What is stored on the way is deleted once the classes are.
    temporary: list[DataFrame] = []

    def made(table: DataFrame) -> DataFrame:
        temporary.append(table)
        return table

    def scratch(df: DataFrame, name: str) -> DataFrame:
        return made(stored(df, name))

    def grouped(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("node").agg(
            F.min(key).alias("first_key"), F.count("*").alias("copies"), F.max("weight").alias("weight"), F.first("bands").alias("bands"), F.min("check").alias("_lo"), F.max("check").alias("_hi")
        )
        return scratch(each, "nodes")

    nodes = grouped(rows)
    clashing = nodes.where("_lo <> _hi")
    # Few if any; where there is none, no name needs a join.
    named_anew = _rows(clashing) > 0
    if named_anew:
        rows = stored(told_apart(rows, clashing), "signatures")
        nodes = grouped(rows)
    worded = nodes.where("weight > 0")

    # Stored wherever both sides of a join would come from one exchange: adaptive execution
    # splits the hot partitions of joins between plain exchanges only.
    members = worded.select("node", F.explode("bands").alias("bucket"))
    buckets = scratch(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = scratch(members.hint("shuffle_merge").join(buckets.hint("shuffle_merge"), "bucket"), "shared")
    # The middle of a family of copies shares buckets with most of it: a bucket's centre is
    # the node whose buckets are the fullest.
    fame = scratch(shared.groupBy("node").agg(F.sum("n").alias("fame")), "fame")
    placed = scratch(shared.hint("shuffle_merge").join(fame.hint("shuffle_merge"), "node").select("bucket", "node", "n", "fame"), "placed")
    centres = scratch(placed.groupBy("bucket").agg(F.max(F.struct("fame", "node")).alias("c")).select("bucket", F.col("c.fame").alias("c_fame"), F.col("c.node").alias("centre")), "centres")
    rays = placed.hint("shuffle_merge").join(centres.hint("shuffle_merge"), "bucket").where("node <> centre")
    star = scratch(rays.groupBy("centre", "node").agg(F.max("c_fame").alias("c_fame")), "star")

    wanted = worded.hint("shuffle_merge").join(fame.select("node").hint("shuffle_merge"), "node", "left_semi").select(F.col("first_key").alias("_k")).distinct()
    texts = source.hint("shuffle_merge").join(wanted.hint("shuffle_merge"), source[key].eqNullSafe(F.col("_k")), "left_semi").select(text)
    # Rows that repeat a key and text come to one bag a node.
    shingles = texts.mapInArrow(_shingles, "node long, check long, bag binary")
    if named_anew:
        shingles = told_apart(shingles, clashing)
    shingles = scratch(shingles.groupBy("node").agg(F.first("bag").alias("bag")), "bags")

    # First each node against the fullest centre that it shares a bucket with.  What is linked
    # then has the centre as its root; roots only spare comparisons until the last step.
    first = scratch(star.groupBy("node").agg(F.max(F.struct("c_fame", "centre")).alias("c")).select(F.col("node").alias("a"), F.col("c.centre").alias("b")), "first")
    links = made(_verified(first, shingles, threshold))
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def compared(edges: DataFrame, last: bool = False) -> None:
        """Verify edges that were not tried yet, and join what they link."""
        nonlocal tried, links, roots
        more = scratch(edges.join(tried, ["a", "b"], "left_anti"), "more")
        found = made(_verified(more, shingles, threshold)) if _rows(more) else more
        tried = tried.unionByName(more)
        if _rows(found):
            links = links.unionByName(found)
        if last or _rows(found):
            roots = scratch(connected_components(links, steps=None if last else 1), "roots")

    # ... then the other rays that would still join two components ...
    rest = star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    compared(_open(rest, roots))
    # ... then, where a bucket still holds several components, rays from a second centre:
    # the fullest node outside the first one's component.
    for _ in range(second_centres):
        rooted = scratch(placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        top = scratch(rooted.groupBy("bucket").agg(F.max(F.struct("fame", "node", "root")).alias("t"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("bucket", F.col("t.root").alias("top_root")), "top")
        if not _rows(top):
            break
        outside = scratch(rooted.hint("shuffle_merge").join(top.hint("shuffle_merge"), "bucket").withColumn("_out", F.col("root") != F.col("top_root")), "outside")
        second = scratch(outside.where("_out").groupBy("bucket").agg(F.max(F.struct("fame", "node", "root")).alias("t")).select("bucket", F.col("t.node").alias("centre"), F.col("t.root").alias("c_root")), "second")
        rays = outside.hint("shuffle_merge").join(second.hint("shuffle_merge"), "bucket").where("root <> c_root")
        compared(rays.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    # ... then all pairs of a bucket that are still in different components.
    compared(_possible(placed, roots, shingles, threshold, scratch), last=True)

    classed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classed = scratch(classed.select("node", "root", "first_key", "copies"), "classed")
    named = scratch(classed.groupBy("root").agg(F.min("first_key").alias("class_id"), F.sum("copies").alias("class_size")), "named")
    of_node = stored(classed.select("node", "root").hint("shuffle_merge").join(named.hint("shuffle_merge"), "root").select("node", "class_id", "class_size"), "classes")
    discard(*temporary)
    return rows.select(key, "node").hint("shuffle_merge").join(of_node.hint("shuffle_merge"), "node").select(key, "class_id", "class_size")


def _open(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges between different components."""
    at = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left")
    return at.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")
