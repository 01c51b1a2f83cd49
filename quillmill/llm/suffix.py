"""Repeated passages removed by a distributed merge sort of sparse suffixes.

Every 50-byte window has an anchor: the 20-byte gram of least fingerprint in it (leftmost
if equal).  Equal windows have equal anchors at equal places, so it is enough to sort the
suffixes that begin at anchors, each with the few bytes to its left that its windows need.

1. Fingerprints of anchors, sorted and delta-coded, meet by range; those seen once drop out.
2. Each batch sorts the suffixes of its remaining anchors, joins equal ones, and sends them
   front-coded: the length of the prefix shared with the suffix before, then the rest.
3. Sorted runs are merged by a loser tree that keeps, for every suffix, the length of the
   prefix it shares with the last one that came out; known prefixes are never compared
   again, and equal suffixes are found by that length alone.
4. The smallest document of each window is known there; windows of later documents go back
   to their batches, and covered bytes are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import stored

U = np.uint64
WINDOW = 50
GRAM = 20
_SPAN = WINDOW - GRAM + 1
#: Text bytes of a batch, and of the pieces of one document that are anchored at a time.
BATCH_BYTES = 8 << 20
#: Text bytes whose anchors and suffixes meet in one range: what a task holds at a time, however large the input.
RANGE_BYTES = 4 << 20
#: Text bytes for which there is a task, and the most tasks of a stage; beyond these a task takes more ranges, one by one.
TASK_BYTES, MOST_TASKS = 16 << 20, 50_000
_PIECE = 1 << 20
_PLACE = 24
#: A suffix as it is sorted: 50 bytes from the anchor on, then up to 30 bytes before it, then both lengths.
_RIGHT, _LEFT = WINDOW, _SPAN - 1
_WIDTH = _RIGHT + _LEFT + 2


def _zip(a: np.ndarray, level: int = 1) -> bytes:
    """An integer array, byte planes apart, compressed."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(len(a), -1).T if a.itemsize > 1 else a
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(raw).tobytes())


def _unzip(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if size > 1 else raw.view(kind)


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, anchor, first window, last window) of each run of windows with one anchor.

    ``ends[i]`` is the end of the document that byte i belongs to; no window crosses it.
    """
    none = (np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(data) < WINDOW:
        return none
    pre = K.prefix(data)
    _, inv = K.powers(len(pre))
    gram = K.mix((pre[GRAM:] - pre[:-GRAM]) * inv[: len(pre) - GRAM])
    low = U((1 << _PLACE) - 1)
    least = (gram & ~low) | np.arange(len(gram)).astype(U)
    span = 1
    while span * 2 <= _SPAN:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < _SPAN:
        least = np.minimum(least[: len(least) - (_SPAN - span)], least[_SPAN - span :])
    s = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[: len(least)])
    if not len(s):
        return none
    p = (least[s] & low).astype(np.int64)
    fresh = np.ones(len(s), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(fresh)
    return gram[p[begin]], p[begin], s[begin], s[np.append(begin[1:], len(s)) - 1]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(base, bytes, ends) of chunks to anchor; a long document is taken in overlapping pieces."""
    for i, _, chunk, off in K.chunks(data, offsets):
        base = int(offsets[i])
        if len(chunk) <= _PIECE:
            yield base, chunk, np.repeat(off[1:], np.diff(off))
        else:
            for a in range(0, len(chunk), _PIECE):
                part = chunk[a : a + _PIECE + WINDOW - 1]
                yield base + a, part, np.full(len(part), len(part))


def _all_anchors(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    parts = []
    for base, chunk, ends in _pieces(data, offsets):
        g, p, lo, hi = _anchors(chunk, ends)
        parts.append((g, p + base, lo + base, hi + base))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, U), *(np.zeros(0, np.int64),) * 3]


def pack_batches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per about 8 MB of texts: all other columns as an Arrow stream, offsets, compressed bytes, plain size."""

    def flush(held):
        rows = pa.Table.from_batches([b.drop_columns([text]) for b in held]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        parts = [K.buffers(b.column(b.schema.get_field_index(text))) for b in held]
        sizes = np.concatenate([np.diff(o) for _, o in parts])
        data = np.concatenate([d for d, _ in parts])
        keys = rows.column(key).combine_chunks().cast(pa.int64()).fill_null(2**63 - 1)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        # Stored once, so that a name from the bytes is only a name.
        sha = hashlib.sha1(data)
        sha.update(np.asarray(keys).tobytes())
        name = int.from_bytes(sha.digest()[:8], "little", signed=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), _zip(np.asarray(keys)), _zip(offsets), zstandard.ZstdCompressor(level=1).compress(data))), pa.array([len(data)], pa.int64())],
            ["batch", "meta", "keys", "offsets", "data", "size"],
        )

    def run(batches):
        held, size = [], 0
        for b in batches:
            _, off = K.buffers(b.column(b.schema.get_field_index(text)))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(off, off[at] + max(BATCH_BYTES - size, 1), "right")) - 1)
                held.append(b.slice(at, end - at))
                size += int(off[end] - off[at])
                at = end
                if size >= BATCH_BYTES or sum(x.num_rows for x in held) >= 200_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "batch long, meta binary, keys binary, offsets binary, data binary, size long")


def _open(table: pa.Table | pa.RecordBatch, row: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, offsets, bytes of a packed batch."""
    raw = zstandard.ZstdDecompressor().decompress(table.column("data")[row].as_py())
    return _unzip(table.column("keys")[row].as_py(), "<i8"), _unzip(table.column("offsets")[row].as_py(), "<i8"), np.frombuffer(raw, np.uint8)


def _short(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-bit fingerprints that occur, and how often.  Equal ones of different grams only cost work."""
    return np.unique(gram >> U(_PLACE), return_counts=True)


def _runs_of(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values of an array in order."""
    at, begin = np.unique(part, return_index=True)
    return list(zip(at.tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True))


def _ranges(values: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """The ranges, of ``n`` equal ones of all 40-bit fingerprints, that these in order fall into; n is under 2**24."""
    return _runs_of((values * U(n)) >> U(40))


def _send_anchors(n_ranges: int) -> Callable:
    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                _, offsets, data = _open(b, row)
                values, _ = _short(_all_anchors(data, offsets)[0])
                cuts = _ranges(values, n_ranges)
                blobs = [_zip(np.diff(values[i:j], prepend=U(0))) for _, i, j in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("batch")[row].as_py()] * len(cuts), pa.int64()), pa.array([r for r, _, _ in cuts], pa.int32()), pa.array(blobs, pa.binary())], ["batch", "range", "anchors"]
                )

    return run


def _find_repeated(table: pa.Table) -> pa.Table:
    """For each batch of a range: which of its anchors another batch has too."""
    lists = [np.cumsum(_unzip(x, "<u8"), dtype=U) for x in table.column("anchors").to_pylist()]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    masks = []
    for v in lists:
        hit = twice[np.minimum(np.searchsorted(twice, v), len(twice) - 1)] == v if len(twice) else np.zeros(len(v), bool)
        masks.append(zstandard.ZstdCompressor(level=1).compress(np.packbits(hit).tobytes()))
    return pa.table({"batch": table.column("batch"), "range": table.column("range"), "mask": pa.array(masks, pa.binary())})


def _front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Prefix lengths shared with the row before, and the remaining bytes end to end."""
    same = rows[1:] == rows[:-1]
    shared = np.zeros(len(rows), np.uint8)
    shared[1:] = np.where(same.all(axis=1), _WIDTH, np.argmin(same, axis=1))
    return shared, rows[np.arange(_WIDTH)[None, :] >= shared[:, None]].tobytes()


_RUN = "range int, batch long, n int, shared binary, rest binary, keys binary, places binary, local boolean"


def _send_runs(n_ranges: int) -> Callable:
    names = [x.split()[0] for x in _RUN.split(", ")]

    def run(packed: pa.Table, masks: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
        out: list[list] = [[] for _ in names]
        hits = {r: zstandard.ZstdDecompressor().decompress(m) for r, m in zip(masks.column("range").to_pylist(), masks.column("mask").to_pylist(), strict=True)}
        for row in range(packed.num_rows):
            batch = packed.column("batch")[row].as_py()
            keys, offsets, data = _open(packed, row)
            gram, place, low, high = _all_anchors(data, offsets)
            values, counts = _short(gram)
            again = counts > 1
            for r, i, j in _ranges(values, n_ranges):
                if r in hits:
                    again[i:j] |= np.unpackbits(np.frombuffer(hits[r], np.uint8))[: j - i].astype(bool)
            keep = again[np.searchsorted(values, gram >> U(_PLACE))] if len(gram) else np.zeros(0, bool)
            gram, place, low, high = gram[keep], place[keep], low[keep], high[keep]
            if not len(gram):
                continue
            # Equal grams go to one range; within it the order is that of the bytes.
            part = ((gram & U((1 << _PLACE) - 1)) % U(n_ranges)).astype(np.int64)
            doc = np.searchsorted(offsets, low, "right") - 1
            order_in = np.argsort(part, kind="stable")
            for r, i, j in _runs_of(part[order_in]):
                at = order_in[i:j]
                p, lo, hi, d = place[at], low[at], high[at], doc[at]
                right, left = hi + WINDOW - p, p - lo
                m = np.zeros((len(at), _WIDTH), np.uint8)
                cols = np.arange(_RIGHT)
                m[:, :_RIGHT] = np.where(cols < right[:, None], data[np.minimum(p[:, None] + cols, len(data) - 1)], 0)
                cols = np.arange(_LEFT)
                m[:, _RIGHT : _RIGHT + _LEFT] = np.where(cols < left[:, None], data[np.minimum(lo[:, None] + cols, len(data) - 1)], 0)
                m[:, -2], m[:, -1] = left, p - hi
                order = np.argsort(m.view(f"S{_WIDTH}").ravel(), kind="stable")
                m, d, lo, hi = m[order], d[order], lo[order], hi[order]
                fresh = np.ones(len(m), bool)
                fresh[1:] = (m[1:] != m[:-1]).any(axis=1)
                begin = np.flatnonzero(fresh)
                which = np.cumsum(fresh) - 1
                first = np.minimum.reduceat(keys[d], begin)
                later = keys[d] > first[which]
                # Copies of a suffix in later documents of this batch are settled here.
                if later.any():
                    rest = np.stack([d[later], lo[later] - offsets[d[later]], hi[later] - lo[later] + 1], axis=1).astype("<i4")
                    for name, v in zip(names, (r, batch, len(rest), b"", b"", b"", _zip(rest.ravel()), True), strict=True):
                        out[names.index(name)].append(v)
                own = ~later
                spots = np.stack([which[own], d[own], lo[own] - offsets[d[own]]], axis=1).astype("<i4")
                shared, tail = _front_coded(m[begin])
                row_out = (r, batch, len(begin), _zip(shared), zstandard.ZstdCompressor(level=3).compress(tail), _zip(first), _zip(spots.ravel()), False)
                for column, v in zip(out, row_out, strict=True):
                    column.append(v)
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return run


def _decode_run(shared: np.ndarray, tail: bytes) -> Iterator[tuple[int, bytes]]:
    last, at = b"", 0
    for n in shared.tolist():
        size = _WIDTH - n
        last = last[:n] + tail[at : at + size]
        at += size
        yield n, last


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, length shared with the suffix before, suffix) of all runs in order.

    A loser tree over runs that know each suffix's prefix shared with the one before it in
    its run.  Each candidate carries the length it shares with the last suffix that came
    out: a longer one wins unseen; only equal lengths are compared, from that length on.
    """
    end = b"\xff" * (_WIDTH + 1)
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes] = [end] * k
    for i, r in enumerate(runs):
        heads[i] = next(r, (0, end))[1]

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and its length, loser and its length to the winner."""
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = heads[a], heads[b]
        n = min(len(x), len(y))
        i = la
        while i + 16 <= n and x[i : i + 16] == y[i : i + 16]:
            i += 16
        while i < n and x[i] == y[i]:
            i += 1
        if i == n:
            return (a, la, b, i) if len(x) <= len(y) else (b, lb, a, i)
        return (a, la, b, i) if x[i] < y[i] else (b, lb, a, i)

    loser, loser_shared = [0] * k, [0] * k
    winners: list[tuple[int, int]] = [(i, 0) for i in range(k)]
    node = k // 2
    while len(winners) > 1:
        up = []
        for i in range(0, len(winners), 2):
            w, lw, lose, ll = play(*winners[i], *winners[i + 1])
            loser[node + i // 2], loser_shared[node + i // 2] = lose, ll
            up.append((w, lw))
        winners = up
        node //= 2
    w, lw = winners[0]
    while heads[w] is not end:
        yield w, lw, heads[w]
        n, x = next(runs[w], (0, end))
        heads[w] = x
        lw = n
        node = (w + k) // 2
        while node:
            w, lw, loser[node], loser_shared[node] = play(w, lw, loser[node], loser_shared[node])
            node //= 2


def _windows(x: bytes) -> list[bytes]:
    """The windows of a suffix, first to last."""
    left, least = x[-2], x[-1]
    whole = x[_RIGHT : _RIGHT + left] + x[:_RIGHT]
    return [whole[t : t + WINDOW] for t in range(left - least + 1)]


def _merge(table: pa.Table) -> pa.Table:
    """Merge the runs of a range; per batch: (document row, first window, bits of the windows to cut)."""
    found: dict[int, list[np.ndarray]] = {}
    local = np.asarray(table.column("local"))
    batches = table.column("batch").to_pylist()
    runs, spots, starts, owners, firsts = [], [], [], [], []
    for i in range(table.num_rows):
        places = _unzip(table.column("places")[i].as_py(), "<i4").reshape(-1, 3)
        if local[i]:
            bits = ((np.int64(1) << places[:, 2].astype(np.int64)) - 1).astype(np.int64)
            found.setdefault(batches[i], []).append(np.stack([places[:, 0].astype(np.int64), places[:, 1], bits], axis=1))
            continue
        shared = _unzip(table.column("shared")[i].as_py(), "u1")
        tail = zstandard.ZstdDecompressor().decompress(table.column("rest")[i].as_py())
        runs.append(_decode_run(shared, tail))
        firsts.append(_unzip(table.column("keys")[i].as_py(), "<i8").tolist())
        spots.append(places)
        starts.append(np.searchsorted(places[:, 0], np.arange(len(shared) + 1)))
        owners.append(batches[i])
    hits: list[list[tuple[int, int]]] = [[] for _ in runs]
    count = [0] * len(runs)
    group: list[tuple[bytes, list[tuple[int, int, int]]]] = []

    def settle() -> None:
        """All suffixes that begin with one gram: mark windows whose smallest document is another."""
        if len(group) == 1:
            x, seen = group[0]
            if len(seen) > 1:
                least = min(seen)[0]
                every = (1 << (x[-2] - x[-1] + 1)) - 1
                for doc, run, i in seen:
                    if doc > least:
                        hits[run].append((i, every))
            return
        smallest: dict[bytes, int] = {}
        cut = [(_windows(x), seen) for x, seen in group]
        for windows, seen in cut:
            least = min(seen)[0]
            for w in windows:
                if smallest.get(w, least) >= least:
                    smallest[w] = least
        for windows, seen in cut:
            low = [smallest[w] for w in windows]
            for doc, run, i in seen:
                bits = sum(1 << t for t, v in enumerate(low) if v < doc)
                if bits:
                    hits[run].append((i, bits))

    for run, shared, x in merge_runs(runs):
        i = count[run]
        count[run] += 1
        item = (firsts[run][i], run, i)
        if shared == _WIDTH:
            group[-1][1].append(item)
        elif shared >= GRAM:
            group.append((x, [item]))
        else:
            if group:
                settle()
            group = [(x, [item])]
    if group:
        settle()
    for run, marks in enumerate(hits):
        if marks:
            m = np.array(marks, np.int64)
            a, b = starts[run][m[:, 0]], starts[run][m[:, 0] + 1]
            at = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))
            s = spots[run][at]
            found.setdefault(owners[run], []).append(np.stack([s[:, 1].astype(np.int64), s[:, 2], np.repeat(m[:, 1], b - a)], axis=1))
    names = list(found)
    return pa.table({"batch": pa.array(names, pa.int64()), "cuts": pa.array([_zip(np.concatenate(found[b]).ravel()) for b in names], pa.binary())})


def _covered(flag: np.ndarray, a: int, b: int, floor: int) -> np.ndarray:
    """Which bytes from ``a`` to ``b`` are in a window that starts at a flag, at ``floor`` or later."""
    low = max(a - WINDOW + 1, floor)
    sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(flag[low:b], dtype=np.int32)])
    x = np.arange(a - low, b - low)
    return sums[x + 1] > sums[np.maximum(x - WINDOW + 1, 0)]


def _remains(data: np.ndarray, flag: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Kept bytes, number of bytes cut and of cut runs of documents ``i`` to ``j``; one that is long is taken in pieces."""
    start, end = int(offsets[i]), int(offsets[j])
    if j == i + 1 and end - start > _PIECE:
        kept, cut, runs, before = [], 0, 0, False
        for a in range(start, end, _PIECE):
            b = min(a + _PIECE, end)
            gone = _covered(flag, a, b, start)
            kept.append(data[a:b][~gone].tobytes())
            cut += int(gone.sum())
            runs += int(gone[0] and not before) + int((gone[1:] & ~gone[:-1]).sum())
            before = bool(gone[-1])
        return [b"".join(kept)], np.array([cut]), np.array([runs])
    off = offsets[i : j + 1] - start
    gone = _covered(flag, start, end, start)
    total = np.concatenate([[0], np.cumsum(gone)])
    edge = np.zeros(end - start + 1, bool)
    edge[off] = True
    begins = gone.copy()
    begins[1:] &= ~gone[:-1] | edge[1:-1]
    spans = np.concatenate([[0], np.cumsum(begins)])
    left_over = data[start:end][~gone].tobytes()
    kept_at = (off - total[off]).tolist()
    return [left_over[a:b] for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)], np.diff(total[off]), np.diff(spans[off])


def kept_text(kept: list[bytes]) -> dict[str, list]:
    """The default result: the remaining text (a character cut in two is dropped)."""
    return {"kept": [x.decode("utf-8", "ignore") for x in kept]}


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", finish: Callable = kept_text, finish_schema: str = "kept string"
) -> DataFrame:
    """Cut every byte covered by a 50-byte string that also starts in a row with a smaller key.

    All columns but ``text`` come back, with ``n_bytes, n_removed, n_spans`` and what
    ``finish`` makes of the remaining bytes of each row (a column of such a name is
    replaced).  Matches are judged on the input, overlap, and never cross rows.

    Keys are whole numbers.  Rows with equal keys are one document to each other: neither
    cuts the other.  A null key counts as larger than any other.  Null and empty texts,
    and texts shorter than 50 bytes, stay as they are; repeated rows stay rows; an empty
    table gives no rows.  However often a passage occurs, a batch sends it once.
    """
    made = ["n_bytes", "n_removed", "n_spans", *(x.split()[0] for x in finish_schema.split(", "))]
    carried = [c for c in docs.columns if c != text and c.lower() not in made]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema] + ["n_bytes long, n_removed long, n_spans long", finish_schema])
    # Equal names of batches (rows that repeat whole batches) stay together and are handled row by row.
    packed = stored(pack_batches(docs.select(*carried, F.col(text)), key, text), "packed")
    total = packed.agg(F.sum("size")).first()[0] or 0
    n, tasks = min(max(1, -(-total // RANGE_BYTES)), (1 << 24) - 1), max(1, min(MOST_TASKS, -(-total // TASK_BYTES)))
    bytes_ = packed.select("batch", "keys", "offsets", "data")
    sent = bytes_.mapInArrow(_send_anchors(n), "batch long, range int, anchors binary")
    masks = sent.repartition(tasks, "range").groupBy("range").applyInArrow(_find_repeated, "batch long, range int, mask binary")
    runs = bytes_.repartition(tasks, "batch").groupBy("batch").cogroup(masks.repartition(tasks, "batch").groupBy("batch")).applyInArrow(_send_runs(n), _RUN)
    cuts = stored(runs.repartition(tasks, "range").groupBy("range").applyInArrow(_merge, "batch long, cuts binary"), "cuts")

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        marks = [_unzip(x, "<i8").reshape(-1, 3) for x in right.column("cuts").to_pylist()]
        mark = np.concatenate(marks) if marks else np.zeros((0, 3), np.int64)
        for row in range(left.num_rows):
            _, offsets, data = _open(left, row)
            rows = pa.ipc.open_stream(left.column("meta")[row].as_py()).read_all()
            start = offsets[mark[:, 0]] + mark[:, 1]
            flag = np.zeros(len(data) + 1, bool)
            for t in range(_SPAN):
                flag[start[(mark[:, 2] >> t) & 1 == 1] + t] = True
            for i, j, _, off in K.chunks(data, offsets):
                kept, cut, spans = _remains(data, flag, offsets, i, j)
                cols = finish(kept)
                own = rows.slice(i, j - i)
                arrays = [*(own.column(c).combine_chunks() for c in carried), *(pa.array(v, pa.int64()) for v in (np.diff(off), cut, spans)), *(pa.array(cols[c]) for c in made[3:])]
                tables.append(pa.Table.from_arrays(arrays, [*carried, *made]))
        return pa.concat_tables(tables)

    return packed.repartition(tasks, "batch").groupBy("batch").cogroup(cuts.repartition(tasks, "batch").groupBy("batch")).applyInArrow(apply, schema)
