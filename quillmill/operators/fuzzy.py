"""Fuzzy text scores that need whole strings: word-order-free ratio and character n-gram F-score.

Both run over Arrow batches; the ratio's common subsequence is bit-parallel.  Sentence
splitting and normal forms are injected functions with plain defaults.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.similarity import sorted_tokens


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step for each character of ``b``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
    return (full & ~row).bit_count()


def token_edits(a: list, b: list) -> int:
    """Levenshtein distance of two token lists: one step on big integers, a bit a token of ``a``, for each token of ``b``."""
    lo, ea, eb = 0, len(a), len(b)
    while lo < min(ea, eb) and a[lo] == b[lo]:
        lo += 1
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[lo:ea], b[lo:eb]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, t in enumerate(a):
        places.setdefault(t, []).append(i)
    at = {}
    for t, where in places.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in where:
            bits[i >> 3] |= 1 << (i & 7)
        at[t] = int.from_bytes(bits, "little")
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = full, 0, len(a)
    for t in b:
        eq = at.get(t, 0)
        x = eq | down
        across = ((((eq & up) + up) ^ up) | eq) & full
        more, less = down | (full & ~(across | up)), up & across
        edits += 1 if more & top else -1 if less & top else 0
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(x | more)), more & x
    return edits


def token_edit_counts(a: Column, b: Column) -> Column:
    """:func:`token_edits` of two array columns, lists of any length."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else token_edits(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="Int64")

    return run(a, b)


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths; two empty texts are equal."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


def token_sort_ratio(a: Column, b: Column) -> Column:
    """:func:`ratio` of the lower-case words of both texts, each in order, joined by blanks."""
    words = lambda t: sorted_tokens(F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]+", " ")))

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(words(a), words(b))


def chrf(reference: str, candidate: str, orders: range = range(1, 7), beta: float = 3.0) -> float:
    """Mean over n of the F-score of character n-grams without white space; orders that neither text has are left out."""
    r, c = "".join(reference.split()), "".join(candidate.split())
    scores = []
    for n in orders:
        a, b = Counter(r[i : i + n] for i in range(len(r) - n + 1)), Counter(c[i : i + n] for i in range(len(c) - n + 1))
        if not a and not b:
            continue
        hit = sum((a & b).values())
        p, q = hit / max(1, sum(b.values())), hit / max(1, sum(a.values()))
        scores.append((1 + beta**2) * p * q / (beta**2 * p + q) if hit else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def chrf_score(reference: Column, candidate: Column, normal: Callable[[str], str] | None = None) -> Column:
    """:func:`chrf` of texts in a normal form (by default :func:`normal_words`)."""
    form = normal or normal_words

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([chrf(form(p or ""), form(q or "")) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(reference, candidate)


def normal_words(text: str) -> str:
    """The default normal form: lower-case tokens that hold a letter or digit (no lemmas)."""
    return " ".join(t.lower() for t in re.findall(r"\w+|[^\w\s]+", text) if any(c.isalnum() for c in t))


def sentence_ends(text: str) -> list[int]:
    """The default sentence splitter: token numbers behind which a sentence ends."""
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    ends = [i + 1 for i, t in enumerate(tokens) if t[-1] in ".!?…"]
    return ends if ends and ends[-1] == len(tokens) or not tokens else [*ends, len(tokens)]
