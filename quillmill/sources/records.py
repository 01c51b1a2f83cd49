"""Records of files that are one large document: found in byte ranges, so that no task reads a whole file.

Spark's text source cuts a file into ranges and, within these, at a mark of our choice.  The
pieces between marks are shorter than records or equal to them: a mark inside a text is no
bound.  Each range puts its pieces together; only what crosses the edge of two ranges, at
most two fragments of a range, is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import LINE_BREAK, doc_title
from ..operators.storage import stored

#: What a row of the assembled table is: a whole record, the end of one, the beginning of one, or a part of neither.
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
#: Rows that are put together at once.
_BLOCK = 4096


def pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """``path, at, value``: what stands between marks, in order within each byte range that begins ``at`` a byte."""
    rows = spark.read.option("lineSep", mark).option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether it opens another byte range, some rows of one range)."""
    last = None
    for b in batches:
        for i in range(0, b.num_rows, _BLOCK):
            part = b.slice(i, _BLOCK)
            where = list(zip(part.column("path").to_pylist(), part.column("at").to_pylist(), strict=True))
            a = 0
            while a < len(where):
                e = a + 1
                while e < len(where) and where[e] == where[a]:
                    e += 1
                yield where[a] != last, part.slice(a, e - a)
                last = where[a]
                a = e


def _put_together(mark: str, bounds):
    """Rows (path, at, nth, kind, text); ``bounds(part, opens)`` says behind which pieces a record ends."""

    def run(batches):
        held: list[str] = []
        path = at = None
        nth, ended = 0, False

        def row(kind: int, text: str) -> tuple:
            return path, at, nth, kind, text

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "at", "nth", "kind", "text"])

        for opens, part in _runs(batches):
            out = []
            if opens:
                if held:
                    out.append(row(TAIL if ended else MIDDLE, mark.join(held)))
                held, nth, ended = [], 0, False
                path, at = part.column("path")[0].as_py(), part.column("at")[0].as_py()
            for text, end in zip(part.column("value").to_pylist(), bounds(part, opens).tolist(), strict=True):
                held.append(text)
                if end:
                    out.append(row(WHOLE if ended else HEAD, mark.join(held)))
                    held, ended = [], True
                    nth += 1
            if out:
                yield batch(out)
        if held:
            yield batch([row(TAIL if ended else MIDDLE, mark.join(held))])

    return run


_SCHEMA = "path string, at long, nth long, kind int, text string"


def _assembled(parts: DataFrame, mark: str, bounds) -> DataFrame:
    """``path, at, nth, text, first, last``: the records of each file, in the order of ``at`` and ``nth``.

    The parts need the columns ``path, at, value`` and those that ``bounds`` reads.  The last
    record of a file is what follows the last bound; ``first`` and ``last`` mark the outer
    ones.
    """
    rows = stored(parts.mapInArrow(_put_together(mark, bounds), _SCHEMA), "records", compression="zstd")
    edges = rows.where(f"kind <> {WHOLE}")
    # At most two rows of a range, without texts: as many as the file has ranges.
    over = Window.partitionBy("path").orderBy("at", F.col("kind") != HEAD)
    before = F.sum((F.col("kind") == HEAD).cast("long")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    numbered = edges.select("path", "at", "kind", F.coalesce(before, F.lit(0)).alias("number"), F.max("at").over(Window.partitionBy("path")).alias("last_at"), F.max_by("kind", F.struct("at", F.col("kind") != HEAD)).over(Window.partitionBy("path")).alias("last_kind"))
    met = edges.join(numbered, ["path", "at", "kind"])
    g = met.groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("kind") != HEAD).alias("later"), "nth", "text"))).alias("f"), F.max(F.col("kind") == HEAD).alias("ended"))
    joined = g.select("path", F.get("f", F.lit(0))["at"].alias("at"), F.get("f", F.lit(0))["nth"].alias("nth"), F.array_join(F.transform("f", lambda x: x["text"]), mark).alias("text"), (F.col("number") == 0).alias("first"), (~F.col("ended")).alias("last"))
    whole = rows.where(f"kind = {WHOLE}").select("path", "at", "nth", "text", F.lit(False).alias("first"), F.lit(False).alias("last"))
    return whole.unionByName(joined)


def _stop(say: str, path: Column) -> Column:
    return F.raise_error(F.concat(F.lit(say), path)).cast("boolean")


def wiki_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, at, nth, title, lines`` of all ``<doc ...>`` blocks in files of any size.

    The same documents as ``wiki_lines`` makes of whole files: ``lines`` are those between
    the opening and the closing line, broken at any of Unicode's line ends.  A document
    inside another, one that is not closed, or an end without a beginning stops the job.
    """
    mark = "<doc "
    breaks = LINE_BREAK
    # A mark opens a document if there is nothing but blanks between it and the line's beginning.
    parts = pieces(spark, path, mark).withColumn("ends", F.element_at(F.split("value", breaks), -1).rlike("^ *$"))
    found = _assembled(parts, mark, lambda part, opens: np.asarray(part.column("ends")))
    lines = F.split("text", breaks)
    closing = lambda l: F.trim(l) == "</doc>"
    cut = found.select("path", "at", "nth", "first", lines.alias("l")).withColumn("closed", F.size(F.filter("l", closing)))
    stray = F.when(F.col("closed") > 0, _stop("broken document in ", F.col("path"))).otherwise(False)
    whole = F.when(F.col("closed") == 1, True).when(F.col("closed") > 1, _stop("broken document in ", F.col("path"))).otherwise(_stop("document not closed in ", F.col("path")))
    docs = cut.where(F.when(F.col("first"), stray).otherwise(whole))
    end = F.array_position(F.transform("l", closing), True).cast("int")
    return docs.select("path", "at", "nth", doc_title(F.concat(F.lit(mark), F.trim(F.get("l", F.lit(0))))).alias("title"), F.slice("l", F.lit(2), F.greatest(end - 2, F.lit(0))).alias("lines"))


# Elements of a JSON array.  Whether a piece begins inside a string depends on all before it in the file: each
# piece is a function of that one bit, and so is a range; the ranges of a file, one row each, are composed in order.


def _lexed(rows: DataFrame) -> DataFrame:
    """Add ``odd`` (an odd number of quotes) and the change of depth if the piece begins ``outside`` or ``inside`` a string."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    change = lambda s: F.length(F.translate(s, "]}", "")) - F.length(F.translate(s, "[{", ""))
    # Strings go, closed or not; what is left are brackets.
    bare = lambda s: F.regexp_replace(s, r'"[^"]*+("|$)', "")
    rest = F.regexp_replace("plain", r'^[^"]*+("|$)', "")
    return rows.withColumn("plain", plain).select("path", "at", "value", (F.pmod(F.length("plain") - F.length(F.translate("plain", '"', "")), F.lit(2)) == 1).alias("odd"), change(bare(F.col("plain"))).alias("outside"), change(bare(rest)).alias("inside"))


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(part.column(name))


def _walk(part: pa.RecordBatch, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece: whether a string is open behind it, and the depth there; a closing mark counts with its piece."""
    odd = _column(part, "odd")
    after = (np.cumsum(odd) + inside) % 2 == 1
    before = np.concatenate([[inside], after[:-1]])
    step = np.where(before, _column(part, "inside"), _column(part, "outside")) - ~after
    return after, depth + np.cumsum(step)


def _summed(batches):
    """One row for each range: what it makes of either state."""
    now: list = []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("path", "at", "n", "flips", "outside", "inside"), now, strict=True))], pa.schema([("path", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("flips", pa.bool_()), ("outside", pa.int64()), ("inside", pa.int64())]))

    for opens, part in _runs(batches):
        if opens:
            if now:
                yield row()
            now = [part.column("path")[0].as_py(), part.column("at")[0].as_py(), 0, False, 0, 0]
        for k, inside in enumerate((False, True)):
            now[4 + k] = int(_walk(part, inside != now[3], now[4 + k])[1][-1])
        now[2] += part.num_rows
        now[3] ^= bool(_column(part, "odd").sum() % 2)
    if now:
        yield row()


def json_elements(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """``path, at, nth, element`` of files that are each one JSON array of objects, whatever their size.

    Brackets are counted outside strings, escapes respected.  A file that does not begin
    with ``[``, ends inside a string or an object, has other than objects in its array or
    anything behind it, or an object that does not parse stops the job.
    """
    mark = "}"
    lexed = _lexed(pieces(spark, path, mark))
    ranges = lexed.select("path", "at", "odd", "outside", "inside").mapInArrow(_summed, "path string, at long, n long, flips boolean, outside long, inside long")
    # One row for each byte range, as many as the driver plans tasks for.
    entries, state = [], {}
    for r in sorted(ranges.collect(), key=lambda r: (r.path, r["at"])):
        inside, depth = state.get(r.path, (False, 0))
        entries.append((r.path, r["at"], inside, depth))
        state[r.path] = inside != r.flips, depth + (r.inside if inside else r.outside)
    if not entries:
        return spark.createDataFrame([], StructType()).select(F.lit("").alias("path"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("nth"), F.from_json(F.lit("{}"), schema).alias("element")).where("false")
    # The last piece of a file has no mark behind it: one closing too many was counted.
    for where, (inside, depth) in sorted(state.items()):
        if inside or depth != -1:
            raise ValueError(f"{where} ends inside a string or has unbalanced brackets")
    begin = spark.createDataFrame(entries, "path string, at long, entry boolean, depth long")
    def bounds():
        kept: list = [False, 0]

        def ends(part: pa.RecordBatch, opens: bool) -> np.ndarray:
            if opens:
                kept[:] = [bool(_column(part, "entry")[0]), int(_column(part, "depth")[0])]
            after, depth = _walk(part, *kept)
            kept[:] = [bool(after[-1]), int(depth[-1])]
            return ~after & (depth == 1)

        return ends

    # Rows of a range stay in order: ranges meet their entry by broadcast, one row each.
    parts = lexed.join(F.broadcast(begin), ["path", "at"]).select("path", "at", "value", "odd", "outside", "inside", "entry", "depth")
    found = _assembled(parts, mark, _fresh(bounds))
    lead = F.regexp_replace("text", F.when(F.col("first"), F.lit(r"^\s*\[\s*")).otherwise(F.lit(r"^\s*,\s*")), "")
    body = F.when(F.startswith(lead, F.lit("{")), F.concat(lead, F.lit(mark))).otherwise(_stop("no object in the array of ", F.col("path")).cast("string"))
    # What follows the last object is the closing bracket, or, of an empty array, both.
    tail = F.when(F.col("first"), F.col("text").rlike(r"^\s*\[\s*\]\s*$")).otherwise(F.col("text").rlike(r"^\s*\]\s*$"))
    ok = F.when(~F.col("last"), True).when(tail, False).otherwise(_stop("no closing bracket at the end of ", F.col("path")))
    opened = F.when(F.col("first") & ~F.col("text").rlike(r"^\s*\["), _stop("no array in ", F.col("path"))).otherwise(True)
    return found.where(opened).where(ok).select("path", "at", "nth", F.from_json(body, schema, {"mode": "FAILFAST"}).alias("element"))


def _fresh(make):
    """A state of its own for each task."""
    held: dict = {}

    def ends(part: pa.RecordBatch, opens: bool) -> np.ndarray:
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        if task not in held:
            held.clear()
            held[task] = make()
        return held[task](part, opens)

    return ends
