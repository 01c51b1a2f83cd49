"""Byte-level BPE: higher-order functions fold ranked merges over the distinct words of a corpus.

1. Documents are cut into words by the public pattern, in groups of a partition.  A group
   keeps its words as numbers into its own list of distinct words.
2. The distinct words of all groups meet by word; each is encoded by a fold of
   ``aggregate`` over its bytes with a literal table of ranked merges, once for every
   thousand partitions, so that the list of groups that hold a word stays short however
   large the corpus is.
3. The ids go back to the groups that hold the word, and each document's ids are put
   together from its word numbers; decoding concatenates the pieces of the ids.

No text is shuffled; what is shuffled is the chunks' word numbers (compressed), their
distinct words, and the ids of these.  Nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import pretoken as P

#: Text bytes, and distinct words, of documents whose words are numbered together.
GROUP_BYTES = 32 << 20
GROUP_WORDS = 1 << 20
#: Partitions that share the encoding of a word.
SHARED_PARTITIONS = 1024
#: The fold copies its arrays at each merge.  Longer words take a heap instead, with the same result.
LONG_WORD = 2048
_NONE = 2**31 - 1
_loaded: dict[str, dict[bytes, int]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """``token rank`` lines, tokens in base64."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return _loaded[path]


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id << 20 | right id -> id, for all pairs of pieces whose bytes together are a piece."""
    out = {}
    for word, k in ranks.items():
        for cut in range(1, len(word)):
            a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
            if a is not None and b is not None:
                out[a << 20 | b] = k
    return out


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def cuckoo(table: dict[int, int]) -> tuple[list[int], list[int]]:
    """Two arrays in which each pair sits at its number modulo the one or the other length.

    An entry is ``pair << 21 | id + 1``, so that a lookup is two array accesses at most.
    """
    n = _prime(int(len(table) * 1.3) + 11)
    sides = ([0] * n, [0] * _prime(n + 1000))
    for pair, k in table.items():
        entry, side = pair << 21 | (k + 1), 0
        for _ in range(10_000):
            at = (entry >> 21) % len(sides[side])
            entry, sides[side][at] = sides[side][at], entry
            if not entry:
                break
            side = 1 - side
        else:
            raise ValueError("the merge table can't be laid out")
    return sides


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it under a name: lambdas know no common subexpressions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def encode_word(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a binary word: the leftmost pair of lowest rank is merged until none is left."""
    left, right = cuckoo(merge_table(ranks))
    single = [ranks[bytes([b])] for b in range(256)]
    table = F.from_json(F.lit(json.dumps({"a": left, "b": right, "c": single})), "struct<a:array<bigint>,b:array<bigint>,c:array<int>>")

    def rank(t: Column, x: Column, y: Column) -> Column:
        found = lambda e: (e.bitwiseAND(F.lit((1 << 21) - 1))).cast("int") - 1
        second = lambda pair: _let(
            F.get(t["b"], (pair % len(right)).cast("int")), lambda e: F.when(F.shiftright(e, 21) == pair, found(e)).otherwise(F.lit(_NONE))
        )
        return _let(
            F.shiftleft(x.cast("bigint"), 20) + y,
            lambda pair: _let(F.get(t["a"], (pair % len(left)).cast("int")), lambda e: F.when(F.shiftright(e, 21) == pair, found(e)).otherwise(second(pair))),
        )

    none = F.array().cast("array<int>")

    def fold(t: Column, ids: Column) -> Column:
        pairs = F.when(F.size(ids) > 1, F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: rank(t, F.get(ids, i), F.get(ids, i + 1))))

        def step(state: Column, _: Column) -> Column:
            p, r = state["p"], state["r"]

            def merge(best: Column) -> Column:
                def at(i: Column) -> Column:
                    before = F.when(i > 1, F.array(rank(t, F.get(p, i - 2), best))).otherwise(none)
                    after = F.when(i < F.size(r), F.array(rank(t, best, F.get(p, i + 1)))).otherwise(none)
                    return F.struct(
                        F.concat(F.slice(p, F.lit(1), i - 1), F.array(best), F.slice(p, i + 2, F.size(p))).alias("p"),
                        F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, F.size(r))).alias("r"),
                    )

                return F.when(best < _NONE, _let(F.array_position(r, best).cast("int"), at)).otherwise(state)

            return _let(F.coalesce(F.array_min(r), F.lit(_NONE)), merge)

        start = F.struct(ids.alias("p"), F.coalesce(pairs, none).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), start, step)["p"]

    bytes_ = F.split(F.decode(word, "ISO-8859-1"), "")
    return _let(table, lambda t: _let(F.transform(bytes_, lambda c: F.get(t["c"], F.ascii(c))), lambda ids: fold(t, ids)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and a linked list, for words too long for the fold."""
    n = len(word)
    end = list(range(1, n + 1))
    back = list(range(-1, n - 1))
    live = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i] if live[i] else n
        if not live[i] or j >= n or end[j] != to:
            continue
        live[j] = False
        end[i] = to
        if to < n:
            back[to] = i
        for a in (i, back[i]):
            if a >= 0 and end[a] < n:
                k = ranks.get(word[a : end[end[a]]])
                if k is not None:
                    heapq.heappush(heap, (k, a, end[end[a]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Group:
    """Documents of one partition whose words are numbered together by one growing dictionary."""

    def __init__(self, with_numbers: bool) -> None:
        self.with_numbers = with_numbers
        self.bytes = 0
        self.keys: list[pa.Array] = []
        self.per_doc, self.numbers, self.mark = [], [], np.uint64(0)
        #: Fingerprints in order, the number of each, and by number: bytes, sizes, occurrences.
        self.known, self.number_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.sizes, self.seen = [], [], np.zeros(0, np.int64)

    def add(self, keys: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        fine = P.cut_long(data, offsets)
        per_part = []
        for _, _, part, off in K.chunks(data, fine):
            s = P.starts(part, off)
            e = np.append(s[1:], len(part))
            pre = K.prefix(part)
            self._number(part, s, e, K.slices(pre, s, e))
            per_part.append(np.diff(np.searchsorted(s, off)))
            with np.errstate(over="ignore"):
                self.mark = K.mix(np.array([self.mark + pre[-1] + np.uint64(len(part) * 31 + len(keys))]))[0]
        # Words before each part, then before each document.
        before = np.concatenate([[0], np.cumsum(np.concatenate(per_part))])
        self.per_doc.append(np.diff(before[np.searchsorted(fine, offsets)]).astype(np.int32))
        self.keys.append(keys)
        self.bytes += len(data)

    def _number(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> None:
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        number = np.empty(len(h), np.int32)
        if len(self.known):
            number[~new] = self.number_of[at[~new]]
        n = int(new.sum())
        number[new] = np.arange(len(self.seen), len(self.seen) + n)
        if n:
            size = (e - s)[first[new]]
            self.pool.append(P.gather(data, s[first[new]], size))
            self.sizes.append(size.astype(np.int32))
            where = np.searchsorted(self.known, h[new])
            self.known, self.number_of = np.insert(self.known, where, h[new]), np.insert(self.number_of, where, number[new])
            self.seen = np.concatenate([self.seen, np.zeros(n, np.int64)])
        self.seen[number] += np.bincount(inverse, minlength=len(h))
        if self.with_numbers:
            self.numbers.append(number[inverse])

    def finish(self) -> tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array]:
        """Chunk number, keys, words per document, word numbers (frequent words first), distinct words."""
        order = np.argsort(-self.seen, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        numbers = np.empty(int(self.seen.sum()) if self.with_numbers else 0, np.int32)
        at = 0
        for i, part in enumerate(self.numbers):
            numbers[at : at + len(part)] = rank[part]
            at += len(part)
            self.numbers[i] = None
        sizes = np.concatenate([np.zeros(0, np.int32), *self.sizes]).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        pool = P.gather(np.concatenate([np.zeros(0, np.uint8), *self.pool]), start[order], sizes[order])
        edges = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(edges), pa.py_buffer(pool)])
        keys = pa.concat_arrays(self.keys)
        return int(self.mark.astype(np.int64)) ^ len(keys), keys, np.concatenate(self.per_doc), numbers, words


def _groups(batches, limit: int, with_numbers: bool):
    group = _Group(with_numbers)
    for b in batches:
        for i, j, data, offsets in K.chunks(*K.buffers(b.column(1))):
            group.add(b.column(0).slice(i, j - i), data, offsets)
            if group.bytes >= limit or len(group.seen) >= GROUP_WORDS:
                yield group.finish()
                group = _Group(with_numbers)
    if group.keys:
        yield group.finish()


def _planes(a: np.ndarray) -> bytes:
    """int32 values as four runs of bytes, compressed: the high ones are nearly all zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplanes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


class Pieces:
    """The bytes of each id, end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values()) + 1)
        for w, k in ranks.items():
            by_id[k] = w
        self.size = np.array([len(w) for w in by_id], np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return P.gather(self.pool, self.start[ids], self.size[ids])

    def texts(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The bytes of documents whose ids stand end to end."""
        text = self.decode(ids)
        if len(at) == 2:
            return [text]
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[at].tolist()
        return [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def ids_and_bytes(ids: np.ndarray, at: np.ndarray, pieces: Pieces) -> dict[str, list]:
    """The default result: the ids and the decoded bytes of each document."""
    return {"ids": np.split(ids, at[1:-1]), "decoded": [x.tobytes() for x in pieces.texts(ids, at)]}


def bpe_round_trip(
    docs: DataFrame,
    ranks_path: str,
    key: str = "doc_id",
    text: str = "text",
    finish: Callable = ids_and_bytes,
    finish_schema: str = "ids array<int>, decoded binary",
    limit: int = GROUP_BYTES,
    long_word: int = LONG_WORD,
) -> DataFrame:
    """Encode every whole text and decode the ids: a row per document, ``key`` and what ``finish`` makes.

    ``finish(ids, at, pieces)`` gets the ids of some documents end to end, where each
    begins, and the pieces to decode with; it returns a list of values for each column of
    ``finish_schema``.  The default returns the ids and the decoded bytes.

    Null and empty texts have no ids.  Repeated rows, null keys and equal texts are rows
    like any other; an empty table gives no rows; extra columns are ignored.  ``docs``
    must read the same rows in the same order each time (a stored table does): it is read
    once for the words and once for the word numbers.
    """
    ranks = load_ranks(ranks_path)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(key, text)

    def distinct_words(batches):
        share = TaskContext.get().partitionId() // SHARED_PARTITIONS
        for chunk, _, _, _, found in _groups(batches, limit, with_numbers=False):
            size = np.diff(np.frombuffer(found.buffers()[1], np.int32))
            for a in range(0, len(found), 50_000):
                number = np.flatnonzero(size[a : a + 50_000] <= long_word) + a
                n = len(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, chunk)), pa.array(number.astype(np.int32)), found.take(pa.array(number)), pa.array(np.full(n, share, np.int32))], ["chunk", "number", "word", "share"]
                )

    def word_numbers(batches):
        for chunk, keys, per_doc, numbers, found in _groups(batches, limit, with_numbers=True):
            own = load_ranks(ranks_path)
            size = np.diff(np.frombuffer(found.buffers()[1], np.int32))
            long = [(i, merge_long(found[i].as_py(), own)) for i in np.flatnonzero(size > long_word).tolist()]
            at = np.array([x for i, ids in long for x in (i, len(ids), *ids)], np.int32)
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), lists, pa.array([len(found)], pa.int32()), *(pa.array([_planes(x)], pa.binary()) for x in (per_doc, numbers, at))],
                ["chunk", "keys", "n_words", "per_doc", "numbers", "long_words"],
            )

    words = source.mapInArrow(distinct_words, "chunk long, number int, word binary, share int")
    met = words.groupBy("word", "share").agg(F.collect_list(F.struct("chunk", "number")).alias("where"))
    encoded = met.select("where", encode_word(F.col("word"), ranks).alias("ids"))

    def by_chunk(batches):
        """The ids of this partition's words, one blob for each chunk that holds some of them."""

        def flush(parts):
            chunk, number, size, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            start = np.cumsum(size) - size
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order])) + 1
            runs = [r for r in np.split(order, cuts) if len(r)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(chunk[r[0]]) for r in runs], pa.int64()),
                    *(pa.array([_planes(x(r)) for r in runs], pa.binary()) for x in (lambda r: number[r], lambda r: size[r], lambda r: P.gather(ids, start[r], size[r]))),
                ],
                ["chunk", "numbers", "sizes", "ids"],
            )

        parts, held = [], 0
        for b in batches:
            where, ids = b.column(0), b.column(1)
            refs = where.flatten()
            n_refs = np.diff(np.asarray(where.offsets)).astype(np.int64)
            flat, off = np.asarray(ids.flatten()), np.asarray(ids.offsets).astype(np.int64)
            off = off - off[0]
            size, start = np.repeat(np.diff(off), n_refs), np.repeat(off[:-1], n_refs)
            parts.append((np.asarray(refs.field(0)), np.asarray(refs.field(1)), size, P.gather(flat, start, size)))
            held += len(size)
            if held >= 500_000:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    blobs = encoded.mapInArrow(by_chunk, "chunk long, numbers binary, sizes binary, ids binary")
    streams = source.mapInArrow(word_numbers, f"chunk long, keys array<{kind}>, n_words int, per_doc binary, numbers binary, long_words binary")
    names = [p.split()[0] for p in finish_schema.split(", ")]
    out_schema = f"`{key}` {kind}, {finish_schema}"

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = Pieces(load_ranks(ranks_path))
        none = np.zeros(0, np.int32)
        number, size, pool = (np.concatenate([none, *(_unplanes(x.as_py()) for x in right.column(c))]) for c in ("numbers", "sizes", "ids"))
        begin = np.cumsum(size, dtype=np.int64) - size
        tables = []
        for row in range(left.num_rows):
            keys = left.column("keys").combine_chunks()[row].values
            n_words = left.column("n_words")[row].as_py()
            per_doc, numbers, long = (_unplanes(left.column(c)[row].as_py()) for c in ("per_doc", "numbers", "long_words"))
            at, n = np.full(n_words, -1, np.int64), np.zeros(n_words, np.int64)
            at[number], n[number] = begin, size
            tail, k, extra = [], 0, len(pool)
            while k < len(long):
                at[long[k]], n[long[k]] = extra, long[k + 1]
                tail.append(long[k + 2 : k + 2 + long[k + 1]])
                extra += int(long[k + 1])
                k += 2 + int(long[k + 1])
            ids_pool = np.concatenate([pool, *tail]) if tail else pool
            if (at < 0).any():
                raise RuntimeError("documents changed between two reads of the same table")
            edges = np.concatenate([[0], np.cumsum(per_doc.astype(np.int64))])
            for i, j, _, _ in K.chunks(numbers, edges, 200_000):
                w = numbers[edges[i] : edges[j]]
                size_w = n[w]
                ids = P.gather(ids_pool, at[w], size_w)
                where = np.concatenate([[0], np.cumsum(size_w)])[edges[i : j + 1] - edges[i]]
                cols = finish(ids, where, pieces)
                tables.append(pa.Table.from_arrays([keys.slice(i, j - i), *(pa.array(cols[c]) for c in names)], [key, *names]))
        return pa.concat_tables(tables)

    return streams.groupBy("chunk").cogroup(blobs.groupBy("chunk")).applyInArrow(assemble, out_schema)
