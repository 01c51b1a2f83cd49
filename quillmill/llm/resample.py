"""Importance resampling toward a target corpus, by inverted postings dealt by feature bucket.

A feature is a run of one or two words, hashed into a bucket.  The corpus becomes postings
(bucket, document, count), kept as packed lists of a range of buckets and a batch of
documents.  The postings meet the gains of their buckets, found from the counts of both
corpora, on their bucket; each list gives the contributions of its batch's documents, and
these are added up by document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, spread, stored, with_running

U = np.uint64
BUCKETS = 10_000
#: Buckets of one list of postings.
RANGE = 100
#: Bytes of text, and documents, of one batch.
BATCH_BYTES, BATCH_DOCS = 8 << 20, 1 << 16
#: Words of more bytes get their checksum one by one.
LONG_WORD = 48

#: Lower case for A to Z; all that is no word byte becomes a blank.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()
_moves: dict[int, np.ndarray] = {}


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of byte slices."""
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    at, n = start[order], size[order]
    long = int(np.searchsorted(-n, -LONG_WORD, "left"))
    out = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for j in range(int(n[long]) if long < len(n) else 0):
        live = slice(long, int(np.searchsorted(-n, -j, "left")))
        c = out[live]
        out[live] = _CRC[(c ^ data[at[live] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = ~out
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + n[i]])
    back = np.empty_like(out)
    back[order] = out
    return back


def _move(k: int) -> np.ndarray:
    """(4, 256) what the four bytes of a checksum become after 2**k bytes of zeros."""
    if k not in _moves:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        if k == 0:
            image = _CRC[bits & np.uint32(255)] ^ (bits >> np.uint32(8))
        else:
            image = _moved(_moved(bits, np.full(32, 1 << (k - 1))), np.full(32, 1 << (k - 1)))
        byte = np.arange(256)
        table = np.zeros((4, 256), np.uint32)
        for b in range(32):
            table[b // 8] ^= np.where(byte >> (b % 8) & 1, image[b], np.uint32(0)).astype(np.uint32)
        _moves[k] = table
    return _moves[k]


def _moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums carried over ``size`` further bytes: a linear map, applied by the bits of the size."""
    out = crc.copy()
    top = int(size.max()).bit_length() if len(size) else 0
    for k in range(top):
        on = np.flatnonzero(size >> k & 1)
        if len(on):
            t, c = _move(k), out[on]
            out[on] = t[0][c & np.uint32(255)] ^ t[1][c >> np.uint32(8) & np.uint32(255)] ^ t[2][c >> np.uint32(16) & np.uint32(255)] ^ t[3][c >> np.uint32(24)]
    return out


def joined_crcs(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two strings one after the other, from theirs and the bytes of the second."""
    return _moved(first, size) ^ second


_BLANK = np.uint32(zlib.crc32(b" "))


def postings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) in order, and the words of each row; a long text is taken in parts."""
    n = len(offsets) - 1
    folded = _FOLD[data]
    words = np.zeros(n, np.int64)
    if n == 1 and len(data) > K.CHUNK_BYTES:
        counts = np.zeros(BUCKETS, np.int64)
        before = None  # the last word of the part before
        for part, off, _ in K.parts(folded, offsets, K.SPACE):
            for _, crc, size, bucket in _buckets(part, off, before):
                counts += np.bincount(bucket, minlength=BUCKETS)
                words += len(crc)
                before = crc[-1:] if len(crc) else before
        held = np.flatnonzero(counts)
        return np.zeros(len(held), np.int64), held, counts[held], words
    keys = []
    for row, crc, _, bucket in _buckets(folded, offsets, None):
        words += np.bincount(row[: len(crc)], minlength=n)
        keys.append(row * BUCKETS + bucket)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count, words


def _buckets(folded: np.ndarray, offsets: np.ndarray, before: np.ndarray | None):
    """(rows, checksums of words, their sizes, buckets of words and then of pairs), ``before`` being the word before the first."""
    start, end, row = K.words(folded, offsets)
    crc = word_crcs(folded, start, end - start)
    size = end - start
    # The checksum of a blank and a word, carried behind the word before.
    tail = joined_crcs(np.full(len(crc), _BLANK, np.uint32), crc, size)
    pair = np.flatnonzero(row[1:] == row[:-1]) + 1
    both = joined_crcs(crc[pair - 1], tail[pair], size[pair] + 1)
    rows = np.concatenate([row, row[pair]])
    if before is not None and len(crc):
        both, rows = np.concatenate([joined_crcs(before, tail[:1], size[:1] + 1), both]), np.concatenate([row, row[:1], row[pair]])
    yield rows, crc, size, np.concatenate([crc, both]).astype(np.int64) % BUCKETS


def _pack(bucket: np.ndarray, row: np.ndarray, count: np.ndarray) -> bytes:
    """Postings of one range of buckets, by bucket and document: lengths of the lists, documents, counts.

    Counts take a byte; those of 255 and more follow in full at the end.
    """
    lists = np.bincount(bucket, minlength=RANGE).astype("<u4")
    more = np.flatnonzero(count >= 255)
    return lists.tobytes() + row.astype("<u2").tobytes() + np.minimum(count, 255).astype(np.uint8).tobytes() + count[more].astype("<u8").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = np.frombuffer(blob, "<u4", RANGE)
    n = int(lists.sum())
    row = np.frombuffer(blob, "<u2", n, 4 * RANGE)
    count = np.frombuffer(blob, np.uint8, n, 4 * RANGE + 2 * n).astype(np.int64)
    more = np.flatnonzero(count == 255)
    count[more] = np.frombuffer(blob, "<u8", len(more), 4 * RANGE + 3 * n)
    return np.repeat(np.arange(RANGE), lists), row, count


def _inverted(key_type: pa.DataType):
    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        names = ["batch", "range", "postings", "totals", "keys", "n_words"]
        held: list[tuple] = []
        docs = size = 0

        def emit():
            nonlocal held, docs, size, nth
            batch = (part << 32) + nth
            row, bucket, count = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((row, bucket))
            row, bucket, count = row[order], bucket[order], count[order]
            edges = np.searchsorted(bucket, np.arange(0, BUCKETS + 1, RANGE))
            ranges, blobs, totals = [], [], []
            for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    inside = bucket[a:b] - r * RANGE
                    ranges.append(r)
                    blobs.append(_pack(inside, row[a:b], count[a:b]))
                    totals.append(np.bincount(inside, count[a:b], RANGE).astype(np.int64))
            m = len(ranges)
            if m:
                sums = pa.ListArray.from_arrays(pa.array(np.arange(0, RANGE * (m + 1), RANGE), pa.int32()), pa.array(np.concatenate(totals)))
                yield pa.RecordBatch.from_arrays([pa.array([batch] * m, pa.int64()), pa.array(ranges, pa.int32()), pa.array(blobs, pa.binary()), sums, pa.nulls(m, pa.list_(key_type)), pa.nulls(m, pa.list_(pa.int64()))], names)
            keys = pa.concat_arrays([x[3] for x in held])
            edge = pa.array([0, len(keys)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.ListArray.from_arrays(edge, keys), pa.ListArray.from_arrays(edge, pa.array(np.concatenate([x[4] for x in held])))], names)
            held, docs, size = [], 0, 0
            nth += 1

        for b in batches:
            for i, j, data, offsets in K.chunks(*K.buffers(b.column(1))):
                if docs and (size + len(data) > BATCH_BYTES or docs + j - i > BATCH_DOCS):
                    yield from emit()
                for lo in range(i, j, BATCH_DOCS):
                    hi = min(j, lo + BATCH_DOCS)
                    cut = offsets[lo - i : hi - i + 1]
                    row, bucket, count, words = postings(data[cut[0] : cut[-1]], cut - cut[0])
                    if docs + hi - lo > BATCH_DOCS:
                        yield from emit()
                    held.append((row + docs, bucket, count, b.column(0).slice(lo, hi - lo), words))
                    docs += hi - lo
                size += len(data)
        if held:
            yield from emit()

    return run


def _contributions(batches):
    for b in batches:
        blobs = []
        for blob, gains in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            bucket, row, count = _unpack(blob)
            gain = np.zeros(RANGE, np.int64)
            gain[: len(gains.values)] = np.asarray(gains.values)
            total = np.zeros(int(row.max()) + 1, np.int64)
            np.add.at(total, row, gain[bucket] * count)
            blobs.append(total.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], ["batch", "part"])


def _reduced(key_type: pa.DataType):
    def run(info: pa.Table, parts: pa.Table) -> pa.Table:
        keys = info.column("keys").combine_chunks()
        words = np.asarray(info.column("n_words").combine_chunks().values)
        total = np.zeros(len(words), np.int64)
        for x in parts.column("part").to_pylist():
            part = np.frombuffer(x, "<i8")
            total[: len(part)] += part
        return pa.table({"key": keys.values.cast(key_type), "n_words": pa.array(words), "total": pa.array(total)})

    return run


def _both(key_type: pa.DataType):
    """Whatever type Arrow gives the cogroup, the keys keep theirs."""
    reduced = _reduced(key_type)
    return lambda left, right: reduced(left, right)


def importance_weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight`` for each document.

    A bucket with s of the S features of ``docs`` and t of the T of ``target`` has the gain
    floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))); a document's
    weight is the mean of the gains of its features, floored, 0 without features.  Both
    corpora are read whole, texts in parts of 512 kB.

    A null text has no features; keys may be null or repeat; an empty table, of documents or
    targets, counts as one without features; extra columns are ignored, whatever their names.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    aims = target.select(F.lit(None).cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def inverted(rows: DataFrame, name: str) -> DataFrame:
        kind = rows.schema["key"].dataType
        schema = f"batch long, range int, postings binary, totals array<long>, keys array<{kind.simpleString()}>, n_words array<long>"
        return stored(rows.mapInArrow(_inverted(_arrow(rows)), schema), name, compression="zstd")

    lists, aimed = inverted(source, "postings"), inverted(aims, "target")

    def totals(t: DataFrame, corpus: str, other: str) -> DataFrame:
        every = t.where("range >= 0").select("range", F.posexplode("totals").alias("at", "n"))
        return every.select("range", "at", F.col("n").alias(corpus), F.lit(0).cast("long").alias(other))

    # Both corpora by bucket: one row a bucket.
    counts = stored(totals(lists, "s", "t").unionByName(totals(aimed, "t", "s")).groupBy("range", "at").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "counts")
    whole = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + 1) * F.lit(float(whole[0] + BUCKETS)) / ((F.col("s") + 1) * F.lit(float(whole[1] + BUCKETS)))
    gains = counts.withColumn("gain", F.floor(1000 * F.log(ratio)).cast("long"))
    by_range = stored(gains.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("at", "gain"))).alias("g")).select("range", F.transform("g", lambda x: x["gain"]).alias("gains")), "gains")

    # Stored on either side, so that a hot range is split by adaptive execution.
    met = lists.where("range >= 0").select("batch", "range", "postings").hint("shuffle_merge").join(by_range.hint("shuffle_merge"), "range")
    parts = met.select("batch", "postings", "gains").mapInArrow(_contributions, "batch long, part binary")
    info = lists.where("range = -1").select("batch", "keys", "n_words")
    kind = source.schema["key"].dataType.simpleString()
    summed = info.groupBy("batch").cogroup(parts.groupBy("batch")).applyInArrow(_both(_arrow(source)), f"key {kind}, n_words long, total long")
    weighed = stored(summed, "weights")
    discard(lists, aimed, counts, by_range)
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("long")
    weight = F.when(n > 0, F.floor(F.col("total").cast("decimal(38,0)") / F.greatest(n, F.lit(1)).cast("decimal(20,0)"))).otherwise(0).cast("long")
    return weighed.select("key", "n_words", n.alias("n_features"), weight.alias("weight")).withColumnRenamed("key", key)


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["key"].dataType)


def noise(key, seed: int = 7):
    """floor(1000 times a Gumbel draw), drawn by a digest of the seed and the key; the same for a key wherever it stands."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_features, weight, score, rank``: draws without replacement, in proportion to the weights.

    The score is the weight and Gumbel noise; of the documents with ``least_words`` words or
    more the best ``percent`` of a hundred (rounded down) are drawn and have a ``rank`` from
    1, highest scores first, ties to the smaller key, null keys last; rows of one key and
    score are ranked by their features and weight.  All documents come back, the others
    without a rank.  Other cases are as in :func:`importance_weights`.
    """
    # The key under a private name: it may be called as a column made here.
    weighed = importance_weights(docs, target, key, text).withColumnRenamed(key, "_key")
    weighed = weighed.withColumn("score", F.col("weight") + noise(F.col("_key"), seed))
    ready = stored(weighed.select("*", F.col("_key").isNull().alias("_nil"), (-F.col("score")).alias("_order"), (F.col("n_words") >= least_words).cast("long").alias("_in")), "scores")
    drawn = (ready.agg(F.coalesce(F.sum("_in"), F.lit(0))).first()[0] * percent) // 100
    order = ["_order", "_nil", "_key", "n_features", "weight"]
    placed = with_running(spread(ready.where("_in = 1"), *order), order, {"_before": "_in"})
    ranked = placed.withColumn("rank", F.when(F.col("_before") < drawn, F.col("_before") + 1).cast("long"))
    rest = ready.where("_in = 0").withColumn("rank", F.lit(None).cast("long"))
    cols = ["_key", "n_features", "weight", "score", "rank"]
    return ranked.select(*cols).unionByName(rest.select(*cols)).withColumnRenamed("_key", key)
