"""WARC records in seekable Zstandard bundles with an index from record to frame offset.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, and a
seek table in a skippable frame at its end (the public seekable format).  The index, kept
beside each bundle, maps a record id to (frame, offset in the frame): records are read by
it, and one record by inflating one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Plain bytes of a frame and compressed bytes of a bundle at which the next one begins.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 8 << 20
# Fixed values of the seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str | None) -> str:
    """The URN of a page; whatever a header line cannot hold is percent-coded."""
    return "<urn:null>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def page_of(urn: str) -> str | None:
    return None if urn == "<urn:null>" else unquote(urn[len("<urn:page:") : -1])


def record(kind: str, page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and names the response that holds it."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if url is not None:
        # A URL with line ends is no URL; it is kept all the same, coded, in a header of its own.
        odd = any(c in url for c in "\r\n") or url != url.strip()
        head.append(f"X-Coded-URI: {quote(url, safe='')}" if odd else f"WARC-Target-URI: {url}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def url_of(head: dict) -> str | None:
    return unquote(head["X-Coded-URI"]) if "X-Coded-URI" in head else head.get("WARC-Target-URI")


def parse_records(plain: bytes, at: int = 0):
    """(headers, block) of each record of an inflated frame, from ``at`` on."""
    while at < len(plain):
        cut = plain.index(b"\r\n\r\n", at)
        lines = plain[at:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, plain[cut + 4 : cut + 4 + size]
        at = cut + 8 + size


class Bundle:
    """Collects records into frames, and frames into a bundle with its seek table."""

    def __init__(self, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.open: list[bytes] = []
        self.open_bytes = 0
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []

    def add(self, rec: bytes) -> tuple[int, int]:
        """(frame, offset in the inflated frame) of the record."""
        where = len(self.frames), self.open_bytes
        self.open.append(rec)
        self.open_bytes += len(rec)
        if self.open_bytes >= self.frame_bytes:
            self.close_frame()
        return where

    def close_frame(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            self.frames.append(self.zstd.compress(plain))
            self.sizes.append((len(self.frames[-1]), len(plain)))
            self.open, self.open_bytes = [], 0

    def bytes_so_far(self) -> int:
        return sum(c for c, _ in self.sizes)

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(bundle: bytes | pa.Buffer) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the end of the bundle."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE or flags & 0x80:
        raise ValueError("no seek table")
    out, at, entry = [], 0, len(bundle) - 9 - 8 * n
    for i in range(n):
        c, p = struct.unpack("<II", bundle[entry + 8 * i : entry + 8 * i + 8])
        out.append((at, c, p))
        at += c
    return out


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict, bytes]:
    """One record by its index entry: only its frame is inflated."""
    at, c, p = seek_table(bundle)[frame]
    plain = zstandard.ZstdDecompressor().decompress(bundle[at : at + c], max_output_size=p)
    return next(parse_records(plain, offset))


def with_responses(pages: DataFrame, key: str, html: str, min_bytes: int = 0) -> DataFrame:
    """Add ``_kind`` and ``_refers``: of equal payloads the one with the largest id is the response.

    Only digests of payloads that occur more than once meet in the join, summed up per
    partition first, so a digest that many pages share is one row; the pages themselves
    stay in place unless they are copies.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    pages = pages.withColumn("_digest", F.sha1(payload.cast("binary"))).withColumn("_size", F.octet_length(payload))
    heads = pages.groupBy(F.col("_digest").alias("_d")).agg(F.max(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # Stored, so that the join is between plain exchanges: adaptive execution then splits a hot digest.
    heads = stored(heads, "heads")
    joined = pages.hint("shuffle_merge").join(heads.hint("shuffle_merge"), F.col("_digest") == F.col("_d"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first")) & (F.col("_size") >= min_bytes)
    return joined.select(*pages.columns, F.when(revisit, F.col("_first")).alias("_refers")).drop("_digest", "_size")


def write_bundles(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Write pages as WARC records into bundles: a row per bundle, ``bundle, data, index``.

    ``index`` is an array of (``id, frame, offset``), an entry a record, ids of the key's
    own type.  A bundle's name is the digest of its bytes.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the largest
    key is a response and the others revisit it (rows that repeat the largest key are all
    responses); a null key is never the largest.  Null html is an empty payload, null urls
    are left out, keys and urls come back as they were whatever their characters.  An empty
    table gives no rows; other columns are ignored.
    """
    kind = pages.schema[key].dataType.simpleString()
    schema = f"bundle string, data binary, index array<struct<id:{kind},frame:int,offset:bigint>>"

    def run(batches):
        own, index = Bundle(frame_bytes=frame_bytes), []

        def flush(keys: pa.DataType):
            data = own.finish()
            entries = pa.array([{"id": k, "frame": f, "offset": o} for k, f, o in index], pa.struct([("id", keys), ("frame", pa.int32()), ("offset", pa.int64())]))
            lists = pa.ListArray.from_arrays(pa.array([0, len(index)], pa.int32()), entries)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary()), lists], ["bundle", "data", "index"])

        kinds = None
        for b in batches:
            kinds = b.column(0).type
            for k, u, h, to in zip(*(b.column(i) for i in range(4)), strict=True):
                page, refers = k.as_py(), to.as_py()
                payload = h.as_buffer().to_pybytes() if h.is_valid else b""
                text = lambda x: None if x is None else str(x)
                index.append((page, *own.add(record("response" if refers is None else "revisit", text(page), u.as_py(), payload, text(refers)))))
                if own.bytes_so_far() >= bundle_bytes:
                    yield flush(kinds)
                    own, index = Bundle(frame_bytes=frame_bytes), []
        if index:
            yield flush(kinds)

    return with_responses(pages.select(key, url, html), key, html, min_bytes).select(key, url, html, "_refers").mapInArrow(run, schema)


def read_bundles(bundles: DataFrame, key: str = "page_id") -> DataFrame:
    """All records that the index names: ``key, url, record_type, payload_bytes, payload_digest, refers_to, payload``.

    Each is read at its place in its frame, and a frame is inflated once for its records.
    ``payload`` is null for a revisit: its response holds the bytes.  Digests and sizes of
    responses are those of the bytes that were read; a record with another id than its
    entry, or a payload with another digest than its header, stops the job.
    """
    kind = bundles.schema["index"].dataType.elementType["id"].dataType.simpleString()

    def run(batches):
        names = [key, "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for data, entries in zip(b.column(0), b.column(1), strict=True):
                raw, at = data.as_buffer(), entries.values
                frames, offsets = np.asarray(at.field("frame")), np.asarray(at.field("offset")).tolist()
                table = seek_table(raw)
                for f in np.unique(frames).tolist():
                    mine = np.flatnonzero(frames == f)
                    start, size, plain_size = table[f]
                    plain = unzip.decompress(raw[start : start + size], max_output_size=plain_size)
                    ids = at.field("id").take(pa.array(mine))
                    rows = []
                    for i, own in zip(mine.tolist(), ids.to_pylist(), strict=True):
                        head, body = next(parse_records(plain, offsets[i]))
                        if page_of(head["WARC-Record-ID"]) != (None if own is None else str(own)):
                            raise ValueError("the index names another record")
                        full = head["WARC-Type"] == "response"
                        sha = digest(body) if full else head["WARC-Payload-Digest"][len("sha1:") :]
                        if full and head["WARC-Payload-Digest"] != f"sha1:{sha}":
                            raise ValueError("a record's payload does not match its digest")
                        rows.append((url_of(head), head["WARC-Type"], len(body) if full else int(head["X-Payload-Length"]), sha, None if full else page_of(head["WARC-Refers-To"]), body if full else None))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    out = bundles.select("data", "index").mapInArrow(run, f"`{key}` {kind}, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")
    return out.withColumn("refers_to", F.col("refers_to").cast(kind))
