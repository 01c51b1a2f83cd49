"""Row generators: arithmetic, comparison and choice questions, and typo augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import key_hash, pick

# Templates of our own; {x} and {y} are numbers, {s} none or one blank.
ARITHMETIC = (
    "What is {x}{s}{op}{s}{y}?", "Calculate {x}{s}{op}{s}{y}.", "{x}{s}{op}{s}{y} =", "Work out {x}{s}{op}{s}{y}.", "How much is {x}{s}{op}{s}{y}?", "{x}{s}{op}{s}{y} = ?",
    "Solve: {x}{s}{op}{s}{y}", "Please compute {x}{s}{op}{s}{y}", "Give the value of {x}{s}{op}{s}{y}.", "Evaluate {x}{s}{op}{s}{y}", "Tell me {x}{s}{op}{s}{y}", "The result of {x}{s}{op}{s}{y} is", "Find {x}{s}{op}{s}{y}.",
)
COMPARISON = ("Which is {word}: {x} or {y}?", "Of {x} and {y}, which one is {word}?", "Name the {word} number: {x}, {y}.", "{word}({x}, {y}) =", "Pick the {word} of {x} and {y}.", "Given {x} and {y}, the {word} one is")
#: (word, whether the larger one is meant)
COMPARISON_WORDS = (("max", True), ("min", False), ("larger", True), ("smaller", False))
CHOICE = (
    "Which element of the array {list} is the {word}?\n{options}", "Find the {word} number: {list}\n{options}", "Array: {list}. Choose the {word} element.\n{options}", "What is the {word} value in {list}?\n{options}",
    "{list}\nThe {word} of these is\n{options}", "Look at {list} and name the {word} number.\n{options}", "From {list} pick the {word} one.\n{options}", "Among {list} the {word} element is\n{options}",
    "Test question. Numbers: {list}. Which is the {word}?\n{options}", "Say which of {list} is the {word}.\n{options}", "Select the {word} number of {list}.\n{options}", "The {word} in {list}?\n{options}",
)
CHOICE_WORDS = ("largest", "smallest")
NONE_RIGHT = "none of these"


def _fill(template: Column, **values: Column) -> Column:
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def _of(options: tuple, i: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), i)


def operand(seed: str, key: Column) -> Column:
    """A number from -100 to 100 in millionths: whole in half of all draws, with six decimals in the others."""
    whole = (pick(seed + "-whole", 201, key) - 100).cast("long") * 1_000_000
    return F.when(pick(seed + "-kind", 2, key) == 0, whole).otherwise(pick(seed + "-micro", 200_000_001, key).cast("long") - 100_000_000)


def _divided(x: Column, y: Column) -> Column:
    """x / y in whole numbers, halves away from zero; null for a zero divisor."""
    size = F.call_function("div", 2 * F.abs(x) + F.abs(y), F.nullif(2 * F.abs(y), F.lit(0)))
    return F.when((x < 0) == (y < 0), size).otherwise(-size)


def micro_text(x: Column) -> Column:
    """Millionths as a decimal number without trailing zeros."""
    size = F.abs(x)
    part = F.lpad((size % 1_000_000).cast("string"), 6, "0")
    digits = F.concat(F.call_function("div", size, F.lit(1_000_000).cast("long")).cast("string"), F.regexp_replace(F.concat(F.lit("."), part), r"\.?0+$", ""))
    return F.concat(F.when(x < 0, "-").otherwise(""), digits)


def arithmetic_rows(spark: SparkSession, n: int, seed: str = "arithmetic") -> DataFrame:
    """``id, input, target``: sums, differences, products and quotients of numbers from -100 to 100.

    Half of the numbers are whole, half have six decimals; results are rounded to six
    (exactly: all is counted in millionths).  A division by less than a millionth becomes a
    product.
    """
    k = F.col("id")
    d = spark.range(n).select("id", operand(seed + "-a", k).alias("a"), operand(seed + "-b", k).alias("b"), pick(seed + "-o", 4, k).alias("o"), pick(seed + "-s", 2, k).alias("s"), pick(seed + "-t", len(ARITHMETIC), k).alias("t"))
    d = d.withColumn("o", F.when((F.col("o") == 3) & (F.col("b") == 0), 2).otherwise(F.col("o")))
    x, y, million = F.col("a"), F.col("b"), F.lit(1_000_000).cast("long")
    value = F.when(F.col("o") == 0, x + y).when(F.col("o") == 1, x - y).when(F.col("o") == 2, _divided(x * y, million)).otherwise(_divided(x * million, y))
    text = _fill(_of(ARITHMETIC, F.col("t")), x=micro_text(x), op=_of(("+", "-", "*", "/"), F.col("o")), y=micro_text(y), s=F.when(F.col("s") == 1, " ").otherwise(""))
    return d.select("id", text.alias("input"), micro_text(value).alias("target"))


def comparison_rows(spark: SparkSession, n: int, seed: str = "comparison") -> DataFrame:
    """``id, input, target``: the larger or the smaller of two numbers as in :func:`arithmetic_rows`."""
    k = F.col("id")
    d = spark.range(n).select("id", operand(seed + "-a", k).alias("a"), operand(seed + "-b", k).alias("b"), pick(seed + "-w", len(COMPARISON_WORDS), k).alias("w"), pick(seed + "-t", len(COMPARISON), k).alias("t"))
    best = F.when(_of(tuple(large for _, large in COMPARISON_WORDS), F.col("w")), F.greatest("a", "b")).otherwise(F.least("a", "b"))
    text = _fill(_of(COMPARISON, F.col("t")), word=_of(tuple(w for w, _ in COMPARISON_WORDS), F.col("w")), x=micro_text(F.col("a")), y=micro_text(F.col("b")))
    return d.select("id", text.alias("input"), micro_text(best).alias("target"))


def choice_rows(spark: SparkSession, n: int, least: int = 5, most: int = 20, seed: str = "choice") -> DataFrame:
    """``id, input, target``: the label of the largest or smallest of five to twenty numbers.

    Two to six different numbers of the array are offered (fewer if it has fewer), in hash
    order, under letters or numbers.  In half of the questions the last option says that
    none is right, and in half of these that is so.
    """
    k = F.col("id")
    d = spark.range(n).select(
        "id", (pick(seed + "-n", most - least + 1, k) + least).alias("m"), (pick(seed + "-k", 5, k) + 2).alias("k"), pick(seed + "-w", 2, k).alias("w"), pick(seed + "-c", 4, k).alias("c"), pick(seed + "-l", 2, k).alias("l"), pick(seed + "-t", len(CHOICE), k).alias("t")
    )
    d = d.withColumn("v", F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: pick(seed + "-v", 1000, k, i)))
    d = d.withColumn("best", F.when(F.col("w") == 0, F.array_max("v")).otherwise(F.array_min("v")))
    in_order = lambda name, values: F.transform(F.array_sort(F.transform(values, lambda x: F.struct(key_hash(seed + name, k, x).alias("h"), x.alias("x")))), lambda p: p["x"])
    others = in_order("-other", F.filter(F.array_distinct("v"), lambda x: x != F.col("best")))
    offered = F.when(F.col("c") == 3, F.slice(others, 1, F.col("k"))).otherwise(F.concat(F.slice(others, 1, F.col("k") - 1), F.array(F.col("best"))))
    d = d.withColumn("shown", in_order("-shown", offered))
    texts = F.transform("shown", lambda x: x.cast("string"))
    texts = F.when(F.col("c") >= 2, F.concat(texts, F.array(F.lit(NONE_RIGHT)))).otherwise(texts)
    label = lambda i: F.when(F.col("l") == 0, F.char(F.lit(65) + i)).otherwise((i + 1).cast("string"))
    options = F.array_join(F.transform(texts, lambda x, i: F.concat(label(i), F.lit(") "), x)), "\n")
    right = F.when(F.col("c") == 3, F.size("shown")).otherwise(F.array_position("shown", F.col("best")).cast("int") - 1)
    listed = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x.cast("string")), ", "), F.lit("]"))
    return d.select("id", _fill(_of(CHOICE, F.col("t")), word=_of(CHOICE_WORDS, F.col("w")), list=listed, options=options).alias("input"), label(right).alias("target"))


_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {c: row[max(0, i - 1) : i] + row[i + 1 : i + 2] for row in _KEYS for i, c in enumerate(row)}


#: Most edits of a text.
MOST_TYPOS = 5


def typos(text: Column, key: Column, share: float = 0.1, most: int = MOST_TYPOS) -> Column:
    """One to ``most`` edits drawn by the key: neighbouring key, swap, deletion or doubling of a character.

    Each edit draws a place in the text as it is by then and a kind; where the kind can't
    be, the character is doubled.  An empty text stays empty.
    """
    draw = lambda i, n: (F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")
    near = F.create_map(*(F.lit(x) for kv in _NEAR.items() for x in kv))

    def edit(s: Column, e: Column) -> Column:
        # Struct fields under a lambda's name are evaluated once.
        def at(p: Column) -> Column:
            i, kind, n = p["i"], p["kind"], p["n"]
            before, c, after = F.substr(s, F.lit(1), i), F.substr(s, i + 1, F.lit(1)), F.substr(s, i + 2, n)
            other = F.element_at(near, F.lower(c))
            typed = F.substr(other, draw(2 * e + 100, F.length(other)) + 1, F.lit(1))
            swapped = F.concat(before, F.substr(after, F.lit(1), F.lit(1)), c, F.substr(after, F.lit(2), n))
            return (
                F.when((kind == 0) & other.isNotNull(), F.concat(before, typed, after))
                .when((kind == 1) & (i + 1 < n), swapped)
                .when((kind == 2) & (n > 1), F.concat(before, after))
                .otherwise(F.concat(before, c, c, after))
            )

        places = F.array(F.struct(draw(2 * e, F.length(s)).alias("i"), draw(2 * e + 1, F.lit(4)).alias("kind"), F.length(s).alias("n")))
        return F.when(s == "", s).otherwise(F.get(F.transform(places, at), F.lit(0)))

    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.length(text) * share).cast("int")))
    return F.aggregate(F.sequence(F.lit(0), n - 1), text, edit)


def typo_augmented(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, text``: texts with typos that are neither an existing text nor made twice.

    Texts are told apart by 128-bit digests, so none is shuffled but those that come back.
    """
    typed = typos(F.coalesce(F.col(text), F.lit("")), F.col(key))
    made = without(rows.select(key, F.md5(typed).alias("_d")), rows.select(F.md5(text).alias("_d")), "_d").groupBy("_d").agg(F.min(key).alias("_key"))
    kept = rows.join(made.select("_key", F.col("_d").alias("_made")), F.col(key) == F.col("_key")).withColumn("_text", typed)
    # A key may repeat: of its rows those count that gave this digest, and of these one.
    return kept.where(F.md5("_text") == F.col("_made")).groupBy("_made").agg(F.min(key).alias(key), F.first("_text").alias(text)).select(key, text)


def without(rows: DataFrame, others: DataFrame, digest: str) -> DataFrame:
    """The rows whose digest no other row has; a null one is like none."""
    return rows.join(others.select(digest).where(F.col(digest).isNotNull()).distinct(), digest, "left_anti")
