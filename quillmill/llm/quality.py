"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K

#: Rows that are timed to order the rules, and partitions that they come from; more only sharpens
#: the order, never the verdict.
SAMPLE_ROWS = 512
SAMPLE_PARTITIONS = 8

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Chunk:
    """Documents of a chunk with counts that are made when a rule first asks, for live rows only."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.cols: dict[str, np.ndarray] = {}
        self.done: dict[str, np.ndarray] = {}

    def get(self, name: str, live: np.ndarray) -> np.ndarray:
        feature = FEATURES[name]
        missing = live[~self.done.setdefault(feature, np.zeros(self.n, bool))[live]]
        if len(missing):
            if len(missing) == self.n:
                data, offsets = self.data, self.offsets
            else:
                parts = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in missing]
                data = np.concatenate(parts)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            for k, v in feature(data, offsets).items():
                self.cols.setdefault(k, np.zeros(self.n, np.int64))[missing] = v
            self.done[feature][missing] = True
        return self.cols[name][live]


def count_words(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols")}
    for part, off, rows in K.parts(data, offsets, K.SPACE):
        _, _, row = K.words(part, off)
        # Code points begin at bytes that do not continue one; white space here is ASCII.
        points = np.concatenate([[0], np.cumsum(((part & 0xC0) != 0x80) & ~K.SPACE[part])])
        symbols = np.concatenate([[0], np.cumsum(SYMBOL[part])])
        for k, v in (("n_words", np.bincount(row, minlength=len(rows))), ("word_chars", np.diff(points[off])), ("n_symbols", np.diff(symbols[off]))):
            np.add.at(out[k], rows, v)
    return out


def line_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of each line with a word."""
    n = len(offsets) - 1
    cut = np.flatnonzero(data == 10)
    # A line ends at each newline and at each row's end.
    ends = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
    row = np.concatenate([np.searchsorted(offsets, cut, "right") - 1, np.arange(n)])
    row = row[np.argsort(np.concatenate([cut, offsets[1:]]), kind="stable")]
    starts = np.concatenate([[0], ends[:-1] + 1])
    fresh = np.concatenate([[True], row[1:] != row[:-1]])
    starts[fresh] = offsets[row[fresh]]
    ink = np.concatenate([[0], np.cumsum(~K.SPACE[data])])
    worded = ink[ends] > ink[starts]
    starts, ends, row = starts[worded], ends[worded], row[worded]
    return K.slices(K.prefix(data), starts, ends), row


def long_line_print(line: np.ndarray) -> np.ndarray:
    """The fingerprint of a line that is longer than a chunk, from its pieces of a chunk's length; none if it has no word."""
    h, inked = np.zeros(1, K.U), False
    for i in range(0, len(line), K.CHUNK_BYTES):
        piece = line[i : i + K.CHUNK_BYTES]
        inked = inked or not K.SPACE[piece].all()
        h = K.mix(h * K.U(K._ODD[3]) + K.slices(K.prefix(piece), np.zeros(1, np.int64), np.array([len(piece)])))
    return h if inked else h[:0]


def count_lines(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    found = []
    for part, off, rows in K.parts(data, offsets, K.NEWLINE):
        # Parts end with a newline or a document, so one that is longer than a chunk is a single line.
        line = part[:-1] if len(off) == 2 and part[-1:].tobytes() == b"\n" else part
        if len(off) == 2 and len(line) > K.CHUNK_BYTES:
            h = long_line_print(line)
            found.append((h, np.repeat(rows, len(h))))
        else:
            h, row = line_prints(part, off)
            found.append((h, rows[row]))
    h, row = (np.concatenate(x) for x in zip(*found, strict=True))
    key = K.in_row(h, row)
    order = np.argsort(key, kind="stable")
    again = np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(key) else np.zeros(0, bool)
    return {"n_dup_lines": np.bincount(row[order][again], minlength=len(offsets) - 1)}


def count_repeats(data: np.ndarray, offsets: np.ndarray, width: int = 8) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    h, row = K.word_prints(data, offsets)
    g, at = K.grams(h, row, width)
    twice = at[K.repeated(K.in_row(g, row[at]))]
    step = np.zeros(len(h) + 1, np.int32)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + width, -1)
    return {"n_repeat_words": np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=n)}


FEATURES: dict[str, Callable] = {"n_words": count_words, "word_chars": count_words, "n_symbols": count_words, "n_dup_lines": count_lines, "n_repeat_words": count_repeats}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``fails(counts)`` is true; ``counts`` maps the named columns to arrays."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[dict], np.ndarray]


#: The base of the verdict: too few words, or too much of the text in repeated eight-word runs.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda c: c["n_words"] < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
)
#: Beyond it, only what no ordinary text shows; all in whole numbers.
MORE_RULES = (
    Rule("word_length", ("n_words", "word_chars"), lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])),
    Rule("symbols", ("n_words", "n_symbols"), lambda c: 10 * c["n_symbols"] > 3 * c["n_words"]),
    Rule("dup_lines", ("n_words", "n_dup_lines"), lambda c: 10 * c["n_dup_lines"] > c["n_words"]),
)
RULES = BASE_RULES + MORE_RULES


def _apply(rule: Rule, chunk: Chunk, live: np.ndarray) -> np.ndarray:
    return rule.fails({k: chunk.get(k, live) for k in rule.needs})


def judge(chunk: Chunk, ordered: tuple[Rule, ...]) -> np.ndarray:
    """Which rule first rejects each row, -1 for none; a rule sees only rows that all earlier ones kept."""
    by, live = np.full(chunk.n, -1), np.arange(chunk.n)
    for i, r in enumerate(ordered):
        if not len(live):
            break
        bad = _apply(r, chunk, live)
        by[live[bad]] = i
        live = live[~bad]
    return by


def measure_rules(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, int, int, float]]:
    """(rule, rows, rejected, seconds) of each rule alone on a sample of about ``sample_rows`` rows.

    Spark runs a few partitions at first and more only while counts lack (``limit``), each
    of which times its share of rows, drawn by the checksum of their texts.  Only a line a
    rule leaves a partition; the sample decides the order of work alone.
    """
    share = -(-sample_rows // SAMPLE_PARTITIONS)

    def run(batches):
        drawn, first = [], []
        for b in batches:
            for x in b.column(0):
                raw = x.as_buffer() if x.is_valid else b""
                if len(first) < share:
                    first.append(x)
                if zlib.crc32(raw) % 8 == 0:
                    drawn.append(x)
                if len(drawn) >= share:
                    break
            if len(drawn) >= share:
                break
        rows, bad, took = 0, np.zeros(len(rules), np.int64), np.zeros(len(rules))
        column = pa.array([x.as_py() for x in (drawn if len(drawn) >= min(share, 8) else first)], pa.large_string())
        for _, _, data, offsets in K.chunks(*K.buffers(column)):
            rows += len(offsets) - 1
            for i, r in enumerate(rules):
                chunk, began = Chunk(data, offsets), time.perf_counter()
                bad[i] += int(_apply(r, chunk, np.arange(chunk.n)).sum())
                took[i] += time.perf_counter() - began
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array([rows] * len(rules)), pa.array(bad), pa.array(took)], ["rule", "rows", "bad", "s"])

    out: dict[str, list] = {}
    measured = docs.select(text).mapInArrow(run, "rule string, rows long, bad long, s double")
    for r in measured.limit(SAMPLE_PARTITIONS * len(rules)).collect():
        had = out.setdefault(r.rule, [0, 0, 0.0])
        out[r.rule] = [had[0] + r.rows, had[1] + r.bad, had[2] + r.s]
    return [(r.name, *out.get(r.name, [0, 0, 0.0])) for r in rules]


def order_rules(measured: list[tuple[str, int, int, float]], rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """Most rejections per second first; a smoothed rate, so that a rule that rejected nothing still has its cost."""
    rate = {name: (bad + 0.5) / (rows + 1) / max(s, 1e-9) for name, rows, bad, s in measured}
    return tuple(sorted(rules, key=lambda r: -rate[r.name]))


def quality_cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", report: bool = False, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Add ``kept`` and ``rejected_by`` (the rule that first rejected the row, else null).

    Rules run in the measured order and each sees only rows that all earlier ones kept, so
    costly counts are made for few rows.  The verdict does not depend on the order.  With
    ``report`` all counts are returned too (for all rows, after the verdict).

    Words are runs of bytes other than ASCII white space.  A null or empty text has no
    words and fails ``few_words``.  Repeated rows and ties are judged one by one, an empty
    table gives no rows, and every other column passes through untouched (a column of the
    name of a result is replaced).  Texts are read whole, however long; counts compare
    words and lines of one document by 64-bit fingerprints.
    """
    names = list(FEATURES) if report else []
    ordered = order_rules(measure_rules(docs, rules, text, sample_rows), rules)
    made = ["kept", "rejected_by", *names]
    carried = [c for c in docs.columns if c.lower() not in made]
    carried_schema = docs.select(*carried).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried_schema] + ["kept boolean", "rejected_by string"] + [f"{n} long" for n in names])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            parts = {"by": [], **{n: [] for n in names}}
            for _, _, data, offsets in K.chunks(*K.buffers(b.column(at))):
                chunk = Chunk(data, offsets)
                parts["by"].append(judge(chunk, ordered))
                for n in names:
                    parts[n].append(chunk.get(n, np.arange(chunk.n)))
            if not parts["by"]:
                continue
            by = np.concatenate(parts["by"])
            labels = [r.name for r in ordered] + [None]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(b.num_columns)), pa.array(by < 0), pa.array([labels[i] for i in by], pa.string()), *(pa.array(np.concatenate(parts[n]), pa.int64()) for n in names)],
                [*carried, "kept", "rejected_by", *names],
            )

    return docs.select(*carried).mapInArrow(run, schema)
