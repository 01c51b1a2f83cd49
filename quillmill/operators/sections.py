"""Raw lines to paragraphs, and wiki text to titled sections, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import pick
from ..functions.text import ALNUM, ALPHA, collapse, tokens
from .scan import scanned

SHORT_LINE = 7


def paragraphs(lines: DataFrame, key: str = "doc_id", n: str = "line", raw: str = "raw") -> DataFrame:
    """``key, text_no, par, paragraph``: lines joined into paragraphs, paragraphs numbered by text.

    A line begins a paragraph if the one before is blank or has no word, or ends with a
    full stop, question or exclamation mark or ellipsis, or if the line begins with a dash
    or digit, or its first alphabetic token is title-case, or all of them are upper-case.
    A line without a word is a paragraph of its own and ends the text before it; blank
    lines only end paragraphs.
    """
    w = Window.partitionBy(key).orderBy(n)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = lines.select(key, n, collapse(F.replace(raw, F.lit("--"), F.lit("—"))).alias("s"))
    x = x.withColumn("_t", tokens(F.col("s")))
    x = x.withColumn("_a", F.filter("_t", lambda t: t.rlike(ALPHA))).withColumn("_wordy", F.exists("_t", lambda t: t.rlike(ALNUM)))
    x = x.select(key, n, "s", "_wordy", F.get("_a", F.lit(0)).rlike(r"^\p{Lu}\p{Ll}*$").alias("_title"), ((F.size("_a") > 0) & F.forall("_a", lambda t: (t == F.upper(t)) & (t != F.lower(t)))).alias("_upper"))
    x = x.withColumns({"_ps": F.lag("s").over(w), "_pw": F.lag("_wordy").over(w)})
    begins = (
        F.col("_ps").isNull() | (F.col("_ps") == "") | ~F.col("_pw") | F.col("_ps").rlike("[.?!…]$") | F.col("s").rlike(r"^[—\-0-9]") | F.coalesce("_title", F.lit(False)) | F.col("_upper") | ~F.col("_wordy")
    )
    x = x.withColumn("par", F.sum(F.when((F.col("s") != "") & begins, 1).otherwise(0)).over(up_to)).where("s <> ''")
    p = x.groupBy(key, "par").agg(F.array_sort(F.collect_list(F.struct(n, "s"))).alias("_l"), F.max("_wordy").alias("_wordy"))
    p = p.select(key, "par", "_wordy", F.array_join(F.transform("_l", lambda l: l["s"]), " ").alias("paragraph"))
    pw = Window.partitionBy(key).orderBy("par").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.withColumn("text_no", F.sum(F.when(F.col("_wordy"), 0).otherwise(1)).over(pw)).where("_wordy").select(key, "text_no", "par", "paragraph")


#: Noncharacters of Unicode that mark the bounds of paragraphs, and those without a word, inside a joined text.
_BOUND, _WORDLESS = "\ufdd0", "\ufdd1"


def _line_facts(s: Column) -> Column:
    """What a collapsed line tells about paragraphs: searches of the line, without a list of its tokens."""
    # An alphabetic token is a run of letters alone.
    word = r"(?<![\p{L}\p{N}_])[\p{L}]++(?![\p{N}_])"
    first = F.regexp_extract(s, word, 0)
    letters = F.array_join(F.regexp_extract_all(s, F.lit(word), 0), "")
    upper = (letters != "") & ~F.exists(F.regexp_extract_all(s, F.lit(word), 0), lambda t: (t != F.upper(t)) | (t == F.lower(t)))
    wordy = s.rlike(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]++(?!_)")
    return F.struct(s.alias("s"), wordy.alias("wordy"), first.rlike(r"^\p{Lu}\p{Ll}*$").alias("title"), upper.alias("upper"), s.rlike("[.?!…]$").alias("ended"), s.rlike(r"^[—\-0-9]").alias("mark"))


def document_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`paragraphs` of whole documents, one row each: no line is shuffled.

    Lines stay an array; joined with marks where paragraphs begin and split at these, they
    are the paragraphs.  The two noncharacters used as marks are taken out of texts.
    """
    from .spans import running_ends

    clean = F.translate(F.replace(F.col(text), F.lit("--"), F.lit("—")), _BOUND + _WORDLESS, "")
    x = docs.select(key, F.transform(F.split(clean, "\n"), collapse).alias("_s"))

    x = x.select(key, F.transform("_s", _line_facts).alias("_f"))

    def piece(f: Column, i: Column) -> Column:
        before = F.get("_f", i - 1)
        begins = (i == 0) | (before["s"] == "") | ~before["wordy"] | before["ended"] | f["mark"] | f["title"] | f["upper"] | ~f["wordy"]
        lead = F.when(begins, F.when(f["wordy"], _BOUND).otherwise(_BOUND + _WORDLESS)).otherwise(" ")
        return F.when(f["s"] == "", "").otherwise(F.concat(lead, f["s"]))

    joined = F.array_join(F.transform("_f", piece), "")
    p = x.select(key, F.split(joined, _BOUND).alias("_p"))
    # The first piece is what stands before the first mark: nothing.
    p = p.withColumn("_p", F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))))
    p = p.withColumn("_n", running_ends(F.transform("_p", lambda t: F.startswith(t, F.lit(_WORDLESS)).cast("int"))))
    rows = p.select(key, F.posexplode(F.arrays_zip("_p", "_n")).alias("_i", "_x")).where(~F.startswith(F.col("_x._p"), F.lit(_WORDLESS)))
    return rows.select(key, F.col("_x._n").cast("long").alias("text_no"), (F.col("_i") + 1).cast("long").alias("par"), F.col("_x._p").alias("paragraph"))


def scanned_paragraphs(lines: DataFrame, key: str, order: list[str], raw: str = "raw") -> DataFrame:
    """:func:`paragraphs` of documents of any number of lines, ordered by the columns ``order``.

    The lines of one document may fill any number of partitions: whether a line stands
    behind the end of a paragraph is a machine of two states, scanned across partitions, and
    paragraphs and texts are numbered in the same pass.  A paragraph is one row.
    Null lines are blank.
    """
    def facts(x: DataFrame) -> DataFrame:
        line = collapse(F.replace(F.coalesce(F.col(raw), F.lit("")), F.lit("--"), F.lit("—")))
        x = x.select(key, *order, _line_facts(line).alias("_f")).select(key, *order, "_f.*")
        said, wordless = F.col("s") != "", ~F.col("wordy")
        # State 0: what comes next begins a paragraph.
        behind = F.when(~said | wordless | F.col("ended"), 0).otherwise(1)
        opens = said & (F.col("mark") | F.col("title") | F.col("upper") | wordless)
        counted = F.array(said.cast("long"), opens.cast("long")).alias("_begins"), F.array_repeat((said & wordless).cast("long"), 2).alias("_wordless")
        return x.select(key, *order, F.when(said & ~wordless, F.col("s")).alias("s"), F.array(behind, behind).alias("_m"), *counted)

    x = scanned(lines.select(key, *order, raw), [key], order, "_m", 2, "_state", facts, {"par": "_begins", "_text": "_wordless"}).where("s IS NOT NULL")
    g = x.groupBy(key, "par").agg(F.max("_text").alias("text_no"), F.array_sort(F.collect_list(F.struct(*order, "s"))).alias("_l"))
    return g.select(key, "text_no", "par", F.array_join(F.transform("_l", lambda l: l["s"]), " ").alias("paragraph"))


def scanned_sections(lines: DataFrame, key: str, order: list[str], text: str = "line") -> DataFrame:
    """:func:`wiki_sections` of documents of any number of lines, ordered by the columns ``order``.

    A machine of three states (at the start, behind a title, behind anything else) tells
    titles from bodies; it is scanned across partitions, sections are numbered in the same
    pass, and a title meets its bodies by a join.  Null lines are blank and left out.
    """
    words = F.size(F.filter(tokens(F.col("_s")), lambda t: t.rlike(ALNUM)))

    def facts(x: DataFrame) -> DataFrame:
        moves = F.when(F.col("_short"), F.array(F.lit(1), F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(2)))
        told = x.select(key, *order, collapse(F.coalesce(F.col(text), F.lit(""))).alias("_s")).where("_s <> ''")
        told = told.withColumn("_short", words <= SHORT_LINE)
        # A title is the first line, or a short one behind a body.
        return told.withColumns({"_m": moves, "_titles": F.array(F.lit(1), F.lit(0), F.col("_short").cast("int")).cast("array<long>")})

    x = scanned(lines.select(key, *order, text), [key], order, "_m", 3, "_state", facts, {"section": "_titles"})
    x = x.withColumn("_title", ((F.col("_state") == 0) | (F.col("_short") & (F.col("_state") == 2))).cast("long"))
    titles = x.where("_title = 1").select(F.col(key).alias("_k"), F.col("section").alias("_n"), F.col("_s").alias("title"))
    body = x.where("_title = 0").join(titles, F.col(key).eqNullSafe(F.col("_k")) & (F.col("section") == F.col("_n")))
    said = F.when(F.col("_short"), F.col("title")).otherwise(F.col("_s"))
    g = body.withColumn("_b", said).groupBy(key, "section", "title").agg(F.array_sort(F.collect_list(F.struct(*order, "_b"))).alias("_p"))
    return g.select(key, "section", "title", F.array_join(F.transform("_p", lambda p: p["_b"]), "\n").alias("body"))


def segmentation_pairs(pars: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, text_no, n, input, target``: paragraphs of a text joined by blanks, and by newlines."""
    g = pars.groupBy(key, "text_no").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("par", "paragraph"))).alias("_p"))
    ps = F.transform("_p", lambda p: p["paragraph"])
    return g.select(key, "text_no", "n", F.array_join(ps, " ").alias("input"), F.array_join(ps, "\n").alias("target"))


def wiki_sections(lines: DataFrame, key: str = "doc", n: str = "n", text: str = "line") -> DataFrame:
    """``key, section, title, body`` from the lines of wiki documents (blank lines left out).

    A line of at most seven alphanumeric tokens is short; the first line of a document
    counts as short.  In a run of short lines the odd ones are titles and the even ones
    bodies; a short body repeats its title.  Titles without a body are dropped.
    """
    w = Window.partitionBy(key).orderBy(n)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.size(F.filter(tokens(F.col(text)), lambda t: t.rlike(ALNUM)))
    x = lines.select(key, n, collapse(F.col(text)).alias("s")).where("s <> ''").withColumnRenamed("s", text)
    x = x.withColumn("_short", (words <= SHORT_LINE) | (F.row_number().over(w) == 1))
    x = x.withColumn("_run", F.sum(F.when(F.col("_short"), 0).otherwise(1)).over(up_to))
    in_run = Window.partitionBy(key, "_run").orderBy(n).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_i", F.sum(F.col("_short").cast("int")).over(in_run))
    x = x.withColumn("_is_title", F.col("_short") & (F.col("_i") % 2 == 1))
    x = x.withColumn("section", F.sum(F.col("_is_title").cast("int")).over(up_to))
    x = x.withColumn("title", F.max(F.when(F.col("_is_title"), F.col(text))).over(Window.partitionBy(key, "section")))
    body = x.where("NOT _is_title").withColumn("_b", F.when(F.col("_short"), F.col("title")).otherwise(F.col(text)))
    g = body.groupBy(key, "section", "title").agg(F.array_sort(F.collect_list(F.struct(n, "_b"))).alias("_p"))
    return g.select(key, "section", "title", F.array_join(F.transform("_p", lambda p: p["_b"]), "\n").alias("body"))


def article_text(title: str = "title", document: str = "document", squeezed: bool = True) -> Column:
    """A structured article as plain text: its title, then title and body of each section between blank lines.

    ``squeezed`` leaves no blanks around line ends and no more than one blank line.
    """
    parts = F.transform(document, lambda s: F.concat(F.lit("\n\n"), s["section_title"], F.lit("\n\n"), F.array_join(s["section_body"], "\n")))
    whole = F.concat(F.col(title), F.array_join(parts, ""))
    return F.regexp_replace(F.regexp_replace(whole, " *\n *", "\n"), "\n{3,}", "\n\n") if squeezed else whole


def section_context(article_key: Column, document: Column, seed: str = "section") -> Column:
    """Title and body of one section of an article, drawn by the article's key."""
    one = F.get(document, pick(seed, F.greatest(F.size(document), F.lit(1)), article_key))
    return F.concat(one["section_title"], F.lit("\n\n"), F.array_join(one["section_body"], "\n"))
