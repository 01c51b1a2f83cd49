"""AVI motion-JPEG columns: write, index, decode intra frames, detect shots.

Payload bytes are stored as the format's own unit, the quantised coefficients of 8 x 8
blocks.  Every coefficient is coded with the one symbol "run 0, size 8" (a Huffman code of
eight zero bits), whose eight extra bits are the byte itself; a restart marker after each
block keeps the DC coefficients independent.  So a baseline JPEG stream holds any bytes
without loss, a block is always 128 bytes before byte stuffing, codes stay on byte bounds
(stored files compress as well as their texts), and both directions are vectorised.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

BLOCK = 64
#: Blocks of a full frame (64 x 64 pixels) and frames a second.
FRAME_BLOCKS = 64
FPS = 25

# Fixed values of the JPEG and AVI formats.
_SOI, _EOI = b"\xff\xd8", b"\xff\xd9"
_DQT = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64)
_DHT = b"".join(b"\xff\xc4" + struct.pack(">HB", 20, cls) + bytes([0] * 7 + [1] + [0] * 8) + b"\x08" for cls in (0x00, 0x10))
_DRI = b"\xff\xdd" + struct.pack(">HH", 4, 1)
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)
_ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), key=lambda p: p[0] if s % 2 else p[1])])


def _sof(width: int, height: int) -> bytes:
    return b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)


def encode_frame(blocks: np.ndarray, width: int, height: int) -> bytes:
    """One baseline JPEG image from an (n, 64) byte array in zigzag order."""
    n = len(blocks)
    # Each block, a code before each byte, is followed by its restart marker; then 0xFF bytes of the data are stuffed.
    marked = np.zeros((n, 2 * BLOCK + 2), np.uint8)
    marked[:, 1 : 2 * BLOCK : 2] = blocks
    marked[:, 2 * BLOCK] = 0xFF
    marked[:, 2 * BLOCK + 1] = 0xD0 + np.arange(n) % 8
    flat = marked.ravel()[:-2]
    stuff = np.flatnonzero(blocks.ravel() == 0xFF)
    out = np.insert(flat, stuff // BLOCK * (2 * BLOCK + 2) + stuff % BLOCK * 2 + 2, 0) if len(stuff) else flat
    return _SOI + _DQT + _sof(width, height) + _DHT + _DRI + _SOS + out.tobytes() + _EOI


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, int, int]:
    """The (n, 64) coefficients in zigzag order as bytes, width and height of such an image."""
    at, width, height = 2, 0, 0
    while jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at + 1] == 0xC0:
            height, width = struct.unpack(">HH", jpeg[at + 5 : at + 9])
        at += 2 + size
    at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
    flat = np.frombuffer(jpeg, np.uint8)[at:-2]
    # Behind 0xFF: a stuffed zero goes, a restart marker goes with it.
    after = np.flatnonzero(flat[:-1] == 0xFF) + 1
    marker = (flat[after] >= 0xD0) & (flat[after] <= 0xD7)
    keep = np.ones(len(flat), bool)
    keep[after] = False
    keep[after[marker] - 1] = False
    return flat[keep].reshape(-1, BLOCK, 2)[:, :, 1], width, height


def coefficients(blocks: np.ndarray) -> np.ndarray:
    """The signed values that a decoder sees: size-8 codes are -255..-128 and 128..255."""
    v = blocks.astype(np.int32)
    v = np.where(v < 128, v - 255, v)
    out = np.empty_like(v)
    out[:, _ZIGZAG] = v
    return out


_SCALE = 4096
_cos = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_COS = np.rint(_cos * _SCALE)


def pixels(blocks: np.ndarray) -> np.ndarray:
    """(n, 8, 8) grey values.  The cosines are whole numbers, so that every product and sum is exact."""
    c = coefficients(blocks).reshape(-1, 8, 8).astype(np.float64)
    p = np.matmul(np.matmul(_COS.T, c), _COS)
    return np.clip(np.floor(p / _SCALE**2 + 128.5), 0, 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold ``payload`` (a multiple of 64 bytes, at least one block).

    The last frame is filled up with zero blocks; the payload's length is in the stream's
    own data chunk.
    """
    n = len(payload) // BLOCK
    per = -(-n // -(-n // FRAME_BLOCKS))
    width, height = 8 * (min(per, 8)), 8 * -(-per // 8)
    per = width // 8 * (height // 8)
    frames = -(-n // per)
    blocks = np.zeros((frames * per, BLOCK), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    jpegs = [encode_frame(blocks[i * per : (i + 1) * per], width, height) for i in range(frames)]
    movi, index, at = [], [], 4
    for j in jpegs:
        body = _chunk(b"00dc", j)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(j)))
        movi.append(body)
        at += len(body)
    largest = max(map(len, jpegs))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload))))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> dict:
    """Frame places and times from the RIFF headers and the index: no frame is touched."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"payload": 0, "micros": 0, "frames": []}
    movi, todo = 0, [(12, 8 + int.from_bytes(data[4:8], "little"))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                else:
                    todo.append((body + 4, body + size))
            elif name == b"avih":
                out["micros"] = int.from_bytes(data[body : body + 4], "little")
            elif name == b"strd":
                out["payload"] = int.from_bytes(data[body : body + 8], "little")
            elif name == b"idx1":
                for k in range(body, body + size, 16):
                    flags, place, length = struct.unpack("<III", data[k + 4 : k + 16])
                    if data[k : k + 4] == b"00dc":
                        out["frames"].append((movi + place + 8, length, bool(flags & 0x10)))
            at = body + size + size % 2
    return out


def shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.1) -> list[int]:
    """Frames that begin a shot: a histogram difference well above those just before it.

    The bar adapts: mean plus ``factor`` deviations of the last ``window`` differences of
    the shot, and at least ``least`` of all pixels.
    """
    cuts, recent = [0], []
    total = max(1, int(histograms[0].sum())) if len(histograms) else 1
    for i in range(1, len(histograms)):
        d = int(np.abs(histograms[i] - histograms[i - 1]).sum()) / (2 * total)
        m = sum(recent) / len(recent) if recent else 0.0
        s = (sum((x - m) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(least, m + factor * s):
            cuts.append(i)
            recent = []
        else:
            recent = (recent + [d])[-window:]
    return cuts


def read_media(data: bytes) -> tuple[bytes, list[tuple[int, int, int, int]], np.ndarray]:
    """Payload, clips (first frame, end frame, start ms, end ms), and frame histograms of 16 bins."""
    info = parse_avi(data)
    parts, hist = [], []
    for at, size, _ in info["frames"]:
        blocks, _, _ = decode_frame(data[at : at + size])
        parts.append(blocks.tobytes())
        hist.append(np.bincount((pixels(blocks) >> 4).ravel(), minlength=16))
    h = np.array(hist).reshape(-1, 16)
    cuts = shots(h)
    ends = [*cuts[1:], len(h)]
    ms = info["micros"] / 1000
    clips = [(a, b, round(a * ms), round(b * ms)) for a, b in zip(cuts, ends, strict=True) if b > a]
    return b"".join(parts)[: info["payload"]], clips, h


def padded(text: bytes) -> bytes:
    """The payload of a text: zero bytes up to a positive multiple of 64."""
    return text + b"\0" * ((-len(text)) % BLOCK or (0 if text else BLOCK))


def write_media(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, media``: each whole text as an AVI file in a binary column.

    A null or empty text becomes one block of zeros.  Equal texts give equal files.
    Repeated rows and null keys are kept, other columns are ignored, an empty table gives
    no rows.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, j, data, offsets in K.chunks(*K.buffers(b.column(1)), 2 << 20):
                raw = data.tobytes()
                files = [encode_avi(padded(raw[p:q])) for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offsets), pa.int64()), pa.array(files, pa.binary())], [key, "n_bytes", "media"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def clip_rows(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, clip, first, end, start_ms, end_ms``: a row for every timed clip (shot) of the files that :func:`media_features` read.

    Files that are null have none; repeated keys and files have theirs each time.
    """
    return features.select(F.col(key), F.posexplode("clips").alias("clip", "_c")).select(key, "clip", "_c.first", "_c.end", "_c.start_ms", "_c.end_ms")


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read stored files back: payload digest and size, clips, and a feature string.

    The feature names frames, shots, the first clip and the histogram of all grey values.
    A null file gives nulls.
    """
    carried = [c for c in media.columns if c in (key, "n_bytes")]
    schema = media.select(*carried).schema
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first:int,end:int,start_ms:long,end_ms:long>>"

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        payload, clips, h = read_media(data)
        feature = f"frames={len(h)};shots={len(clips)};first={clips[0][3] if clips else 0}ms;grey=" + ",".join(map(str, h.sum(0).tolist()))
        named = [{"first": a, "end": b, "start_ms": c, "end_ms": d} for a, b, c, d in clips]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, named

    def run(batches):
        clip = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip]
        names = [p.split()[0] for p in more.split(", ")]
        for b in batches:
            at = b.schema.get_field_index("media")
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = list(zip(*(one(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column(at)), strict=True))
                if made:
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carried), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], [*carried, *names])

    return media.select(*carried, "media").mapInArrow(run, f"{head}, {more}")
