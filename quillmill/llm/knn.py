"""Exact nearest-neighbour joins by inner product over a Voronoi partition, and hard negatives from them.

Vectors get one more component, so that all have the same norm: the largest inner product
is then the least Euclidean distance.  Rows and anchors belong to the cell of their nearest
pivot; anchors of neighbouring cells form groups.  An anchor asks for its best rows between
two scores.  A first join meets each row with the one group of its own cell, which gives
every request a bar; from the bars follow, for each group and cell, the distances to the
pivot outside which a row can serve no anchor there, and a second join sends each row only
to the groups that it might serve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Pivots: so many at most, and their components at most.  They are a sample of the rows; any would do.
PIVOTS, PIVOT_VALUES = 512, 1 << 20
#: Anchors of a group and rows of a slice that meet in one task; there are at most so many groups, of more anchors if need be.
GROUP, SLICE, GROUPS = 1024, 8192, 4096
#: Small tables are cut finer, into so many slices of at least LEAST rows.
SLICES, LEAST = 48, 256
#: Requests that are compared with a slice at once.
BLOCK = 256
#: Below this the inner product of two norms is exact in doubles, whatever the order of its terms.
EXACT = 2.0**53
#: Scores beyond these count as these.
LEAST_SCORE, GREATEST_SCORE = -(2**62), 2**62


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter ones are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(lists.flatten(), np.float64)
    size = np.diff(np.asarray(lists.offsets))
    if (size == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exact: by doubles while they hold them, else by Python's integers."""
    na, nb = (np.sqrt((x * x).sum(axis=1)).max(initial=0) for x in (a, b))
    if na * nb < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(exact(a) @ exact(b).T, LEAST_SCORE, GREATEST_SCORE).astype(np.int64)


class Cells:
    """Pivots, and the distances of augmented vectors to them."""

    def __init__(self, pivots: np.ndarray, square: float) -> None:
        self.pivots, self.square = pivots, square
        self.rest = np.sqrt(np.maximum(square - (pivots * pivots).sum(axis=1), 0))
        #: More than rounding can move a distance.
        self.slack = 1e-6 * np.sqrt(square) + 1e-9

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Of rows, which end on the sphere, or of anchors, whose further component is 0."""
        own = (x * x).sum(axis=1)
        cross = x @ self.pivots.T
        if not anchors:
            cross += np.sqrt(np.maximum(self.square - own, 0))[:, None] * self.rest[None, :]
            own = np.full(len(x), self.square)
        return np.sqrt(np.maximum(own[:, None] + self.square - 2 * cross, 0))

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from an anchor at which a row has this score."""
        return np.sqrt(np.maximum((x * x).sum(axis=1) + self.square - 2 * score, 0))


def _chain(pivots: np.ndarray) -> np.ndarray:
    """Cells in an order in which neighbours are near: always the nearest one left."""
    left = np.ones(len(pivots), bool)
    order = [0]
    left[0] = False
    for _ in range(len(pivots) - 1):
        d = ((pivots - pivots[order[-1]]) ** 2).sum(axis=1)
        order.append(int(np.argmin(np.where(left, d, np.inf))))
        left[order[-1]] = False
    return np.array(order)


def _dealt(order: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first number, how many) for each cell: cells in order share a number up to ``size`` rows, a larger one gets several."""
    first, many = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
    now, held = 0, 0
    for c in order.tolist():
        if held and held + rows[c] > size:
            now, held = now + 1, 0
        first[c], many[c] = now, max(1, -(-int(rows[c]) // size))
        if many[c] > 1:
            now, held = now + int(many[c]), 0
        else:
            held += int(rows[c])
    return first, many


def _spread(number: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A share of 0 to many - 1 for each row number."""
    h = (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (h % many.astype(np.uint64)).astype(np.int64)


def _in_cells(cells: Cells, dim: int):
    """Rows and anchors of each cell; there are at most PIVOTS cells."""

    def run(batches):
        found = np.zeros((2, len(cells.pivots)), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                x = matrix(part.column(0), dim)
                asks = np.asarray(part.column(1).fill_null(False))
                found[0] += np.bincount(cells.distances(x).argmin(axis=1), minlength=len(found[0]))
                if asks.any():
                    found[1] += np.bincount(cells.distances(x[asks], anchors=True).argmin(axis=1), minlength=len(found[0]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found[0])), pa.int32()), pa.array(found[0]), pa.array(found[1])], ["cell", "n", "anchors"])

    return run


class Plan:
    """Where rows and anchors go."""

    def __init__(self, cells: Cells, dim: int, rows: np.ndarray, anchors: np.ndarray) -> None:
        self.cells, self.dim = cells, dim
        order = _chain(cells.pivots)
        size = max(LEAST, min(SLICE, -(-int(rows.sum()) // SLICES)))
        self.slices = _dealt(order, rows, size)
        self.groups = _dealt(order, anchors, max(GROUP, -(-int(anchors.sum()) // GROUPS)))

    def slice_of(self, cell: np.ndarray, nth: np.ndarray) -> np.ndarray:
        return self.slices[0][cell] + _spread(nth, self.slices[1][cell])

    def group_of(self, cell: np.ndarray, nth: np.ndarray) -> np.ndarray:
        return self.groups[0][cell] + _spread(nth, self.groups[1][cell])


_ROW = "nth long, id long, label string, vec array<double>"


def _sent(plan: Plan, bounds: np.ndarray | None):
    """Rows to the group of their own cell or, with bounds (group, cell, nearest, farthest), to all others they might serve."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                nth = np.asarray(part.column(0))
                far = plan.cells.distances(matrix(part.column(3), plan.dim))
                cell = far.argmin(axis=1)
                home, piece = plan.group_of(cell, nth), plan.slice_of(cell, nth)
                if bounds is None:
                    yield from _batch(part, np.arange(len(nth)), home, piece)
                    continue
                for g in np.unique(bounds["group"]).tolist():
                    may = np.zeros(len(nth), bool)
                    for _, c, near, most in bounds[bounds["group"] == g].tolist():
                        # A distance that is no number rules nothing out.
                        may |= ~((far[:, c] > most) | (far[:, c] < near))
                    at = np.flatnonzero(may & (home != g))
                    if len(at):
                        yield from _batch(part, at, np.full(len(at), g), piece[at])

    return run


def _batch(part: pa.RecordBatch, at: np.ndarray, group: np.ndarray, piece: np.ndarray):
    taken = part.take(pa.array(at))
    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(piece), *taken.columns], ["grp", "piece", "nth", "id", "label", "vec"])


_FOUND = "request long, nth long, id long, score long"


def _met(plan: Plan, k: int, same: bool):
    """The best ``k`` rows of a slice for each request of a group."""

    def run(requests: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if requests.num_rows and rows.num_rows:
            ids = np.asarray(rows.column("id"))
            rows = rows.take(pa.array(np.lexsort((np.asarray(rows.column("nth")), ids))))
            ids, nth = np.asarray(rows.column("id")), np.asarray(rows.column("nth"))
            b = matrix(rows.column("vec"), plan.dim)
            labels = rows.column("label").combine_chunks().dictionary_encode()
            known = {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
            label = np.asarray(labels.indices)
            mine = np.array([known.get(v, -1) for v in requests.column("label").to_pylist()])
            number, anchor = np.asarray(requests.column("request")), np.asarray(requests.column("anchor"))
            low, high = (np.asarray(requests.column(c))[:, None] for c in ("low", "high"))
            a = matrix(requests.column("vec"), plan.dim)
            for i in range(0, len(number), BLOCK):
                cut = slice(i, i + BLOCK)
                score = inner(a[cut], b)
                good = (score >= low[cut]) & (score <= high[cut]) & ((label[None, :] == mine[cut][:, None]) == same) & (nth[None, :] != anchor[cut][:, None])
                if good.sum() > 8 * k * len(score) and score.shape[1] > k:
                    # Most are below the k-th best: these go first, ties with it stay.
                    bar = -np.partition(-np.where(good, score, LEAST_SCORE - 1), k - 1, axis=1)[:, k - 1]
                    good &= score >= bar[:, None]
                r, c = np.nonzero(good)
                s = score[r, c]
                # By request, score, and then in the order of the slice, that of the ids.
                order = np.lexsort((-s, r))
                r, c, s = r[order], c[order], s[order]
                first = np.searchsorted(r, r, "left")
                keep = np.arange(len(r)) - first < k
                out.append((number[cut][r[keep]], nth[c[keep]], ids[c[keep]], s[keep]))
        cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4)]
        return pa.table(dict(zip(("request", "nth", "id", "score"), cols, strict=True)))

    return run


def _bounded(plan: Plan):
    """For each group and cell of its anchors, the distances to the pivot within which a row might serve one of them."""

    def run(batches):
        for b in batches:
            x = matrix(b.column(2), plan.dim)
            # A bound reaches what its score does, and a little more.
            low, high = (np.asarray(b.column(c)).astype(np.float64) for c in (3, 4))
            own = plan.cells.distances(x, anchors=True)[np.arange(len(x)), np.asarray(b.column(1))]
            outer, hole = plan.cells.radius(x, low) + plan.cells.slack, plan.cells.radius(x, high) - plan.cells.slack
            near = np.maximum(own - outer, hole - own) - plan.cells.slack
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near), pa.array(own + outer + plan.cells.slack)], ["grp", "cell", "near", "far"])

    return run


def _joined(plan: Plan, rows: DataFrame, requests: DataFrame, bounds: np.ndarray | None, k: int, same: bool, name: str) -> DataFrame:
    """The best rows of each slice for each request, stored."""
    sent = stored(rows.select("nth", "id", "label", "vec").mapInArrow(_sent(plan, bounds), f"grp int, piece long, {_ROW}"), "sent", compression="zstd")
    # Anchors go where rows have gone.
    met = sent.select(F.col("grp").alias("to_grp"), F.col("piece").alias("to_piece")).distinct()
    asked = requests.join(met, F.col("grp") == F.col("to_grp")).select("to_grp", "to_piece", "request", "anchor", "label", "vec", "low", "high")
    found = stored(asked.groupBy("to_grp", "to_piece").cogroup(sent.groupBy("grp", "piece")).applyInArrow(_met(plan, k, same), _FOUND), name)
    discard(sent)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("request").orderBy(F.col("score").desc(), "id", "nth")
    return found.withColumn("place", F.row_number().over(over)).where(F.col("place") <= k)


def best_rows(plan: Plan, rows: DataFrame, requests: DataFrame, k: int, same: bool) -> DataFrame:
    """``request, nth, id, score, place``: the best ``k`` rows of each request, by score, then id, exactly.

    A request has its anchor's ``grp, cell, label, vec``, and the least and greatest score it
    asks for, ``low`` and ``high``; ``same`` says whether rows have its label or another one.
    The anchor itself is never among its rows.
    """
    first = _joined(plan, rows, requests, None, k, same, "near")
    # The k-th best so far is a bar that later rows must reach.
    bar = _best(first, k).where(F.col("place") == k).select("request", F.col("score").alias("bar"))
    raised = stored(requests.join(bar, "request", "left").withColumn("low", F.greatest("low", "bar")).drop("bar"), "raised", compression="zstd")
    spans = raised.select("grp", "cell", "vec", "low", "high").mapInArrow(_bounded(plan), "grp int, cell int, near double, far double")
    # At most one row for each cell and group: there are at most PIVOTS cells and GROUPS groups.
    held = spans.groupBy("grp", "cell").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max(F.isnan("near") | F.isnan("far")).alias("odd")).collect()
    bounds = np.array([(r.grp, r.cell, -np.inf if r.odd else r.near, np.inf if r.odd else r.far) for r in held], [("group", "i8"), ("cell", "i8"), ("near", "f8"), ("far", "f8")])
    more = _joined(plan, rows, raised, bounds, k, same, "far")
    out = stored(_best(first.unionByName(more), k), "best")
    discard(first, raised, more)
    return out


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, key: str = "vec_id", vector: str = "embedding", label: str = "label", steps: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(steps * x), x as a double, and a score is the inner product of
    these, exact.  An anchor (``is_anchor`` is a condition on ``key``) has as positives its
    best ``positives`` other rows of its label; for each of them come the best ``negatives``
    rows of other labels with ``least``/100 to ``most``/100 of the positive's score.  Scores
    are ordered from high to low, ties by smaller key.  Searches are exact.

    Rows with a null key, label or vector, or a null or non-finite component (also after the
    product with ``steps``) take no part.  A vector shorter than others counts as filled up
    with zeros.  Rows with one key are rows of their own, each an anchor if one is; ties
    between them are broken by their place in the table.  Scores beyond 2**62 either way
    count as that.  An empty table gives no rows; extra columns are ignored, whatever their
    names.
    """
    spark = rows.sparkSession
    wide = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") * steps)
    fit = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a 64-bit number in SQL: beyond 2**52 every double is whole already.
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    taken = rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).where(fit)
    clean = taken.select(F.monotonically_increasing_id().alias("nth"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), whole.alias("vec"))
    clean = stored(clean.withColumn("asks", is_anchor(F.col("id"))).withColumn("square", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), "vectors", compression="zstd")
    n, square, dim = clean.agg(F.count("*"), F.max("square"), F.max(F.size("vec"))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not dim:
        dim, square = max(dim or 0, 1), square or 0.0
    # Pivots spread over the table by a digest; equal vectors have one.
    many = max(1, min(PIVOTS, PIVOT_VALUES // dim, int(np.sqrt(n or 1))))
    drawn = clean.select("vec", F.xxhash64("vec").alias("h")).groupBy("h").agg(F.first("vec").alias("vec")).orderBy("h").limit(many).collect()
    if not drawn:
        return spark.createDataFrame([], result)
    cells = Cells(matrix(pa.array([r.vec for r in drawn], pa.list_(pa.float64())), dim), float(square))

    rows_of, anchors_of = np.zeros(len(drawn), np.int64), np.zeros(len(drawn), np.int64)
    for r in clean.select("vec", "asks").mapInArrow(_in_cells(cells, dim), "cell int, n long, anchors long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("anchors").alias("anchors")).collect():
        rows_of[r.cell], anchors_of[r.cell] = r.n, r.anchors
    plan = Plan(cells, dim, rows_of, anchors_of)

    placed = clean.where("asks").select("nth", "id", "label", "vec").mapInArrow(_placed(plan), f"grp int, cell int, {_ROW}")
    anchors = stored(placed, "placed", compression="zstd")
    asked = anchors.select("grp", "cell", F.col("nth").alias("request"), F.col("nth").alias("anchor"), "label", "vec", F.lit(LEAST_SCORE).alias("low"), F.lit(GREATEST_SCORE).alias("high"))
    found = best_rows(plan, clean, asked, positives, same=True)
    # A positive's number is its anchor's and its place: what asks for negatives.
    pairs = found.select(F.col("request").alias("anchor"), "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = stored(pairs.join(anchors.select(F.col("nth").alias("anchor"), F.col("id").alias("anchor_id"), "grp", "cell", "label", "vec"), "anchor").withColumn("request", F.monotonically_increasing_id()), "positives", compression="zstd")
    # Hundredths of a score, rounded up and down, without a product that leaves 64 bits.
    rest = F.pmod(F.col("positive_score"), F.lit(100))
    hundreds = pairs.withColumn("rest", rest).withColumn("hundreds", F.expr("(positive_score - rest) div 100"))
    low = F.col("hundreds") * least + F.ceil(F.col("rest") * least / 100).cast("long")
    high = F.col("hundreds") * most + F.floor(F.col("rest") * most / 100).cast("long")
    wanted = hundreds.select("grp", "cell", "request", "anchor", "label", "vec", low.alias("low"), high.alias("high")).where("low <= high")
    hard = best_rows(plan, clean, stored(wanted, "wanted", compression="zstd"), negatives, same=False)
    named = hard.select("request", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.select("request", "anchor_id", "positive_id", "positive_score").join(named, "request").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _placed(plan: Plan):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                nth = np.asarray(part.column(0))
                cell = plan.cells.distances(matrix(part.column(3), plan.dim), anchors=True).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(plan.group_of(cell, nth), pa.int32()), pa.array(cell, pa.int32()), *part.columns], ["grp", "cell", "nth", "id", "label", "vec"])

    return run
