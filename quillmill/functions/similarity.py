"""Edit distances and similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Distinct tokens that a pair may hold: the code points beyond the basic plane.
MOST_TOKENS = 0x10FFFF - 0x10000


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over lists of tokens.

    Each distinct token of the pair becomes one character, so the built-in function for
    strings does the work inside the JVM.  A pair with over a million distinct tokens
    stops the job.
    """
    every = F.array_distinct(F.concat(a, b))
    known = F.when(F.size(every) > MOST_TOKENS, F.raise_error(F.lit("too many distinct tokens in a pair")).cast("array<string>")).otherwise(every)

    def distance(names: Column) -> Column:
        as_char = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) - 1 + F.array_position(names, t)), 8, "0")), "UTF-32")
        return F.levenshtein(F.array_join(F.transform(a, as_char), ""), F.array_join(F.transform(b, as_char), ""))

    # Under a lambda's name the list of distinct tokens is made once, not once a token.
    return F.get(F.transform(F.array(known), distance), F.lit(0))


def lexical_similarity(reference: Column, candidate: Column) -> Column:
    """1 - character distance / length of the reference, at least 0; null for an empty reference."""
    return F.greatest(F.lit(0.0), 1 - F.try_divide(F.levenshtein(reference, candidate), F.length(reference)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def homogeneity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2."""
    return (cosine(a, b) + 1) / 2


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts; 0 where nothing was there to find or found."""
    return F.coalesce(F.try_divide(tp.cast("double"), tp + 0.5 * (fp + fn)), F.lit(0.0))


def sorted_tokens(text: Column) -> Column:
    """White-space tokens in order, joined again: equal for texts that differ in word order alone."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda t: t != "")), " ")


def environment(source: Column, target: Column, threshold: int) -> Column:
    """Two bits: is the source longer than the threshold, is the target."""
    return (source > threshold).cast("int") * 2 + (target > threshold).cast("int")
