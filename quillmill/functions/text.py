"""Text functions as column expressions: tokens, white space, end marks, links, scripts, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose meaning must match established tokenisation (fixed values).
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
ALNUM = r"^[\p{L}\p{N}]+$"
ALPHA = r"^\p{L}+$"
WS = r"[\t-\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WIKILINK = r"\[\[(?:[^|\]]*\|)?(.*?)\]\]"
EOS = r"(\s*</s>)*\s*$"
#: Where a line ends for a reader that knows all of Unicode's line breaks.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def tokens(text: Column) -> Column:
    """Runs of word characters, and runs of anything else that is not white space."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def tokenize(text: Column) -> Column:
    """Tokens; one that is not all letters and digits falls into its characters."""
    return F.flatten(F.transform(tokens(text), lambda t: F.when(t.rlike(ALNUM), F.array(t)).otherwise(F.split(t, ""))))


def word_count(text: Column) -> Column:
    """The size of :func:`tokens`, by one count of matches."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def token_count(text: Column) -> Column:
    """The size of :func:`tokenize`, without building the pieces.

    One for each run of letters and digits that no underscore touches, and one for each
    character of all other tokens.
    """
    runs = F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]++(?!_)"))
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}_\s]"))
    joined = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]*+_[\p{L}\p{N}_]*+"), 0)
    return (runs + marks + F.length(F.array_join(joined, ""))).cast("long")


def collapse(text: Column) -> Column:
    """White space of any kind to one blank, none at the ends.

    Single blanks, by far the most, are no match: only what would change is replaced.
    """
    return F.trim(F.regexp_replace(text, rf" {WS}|{WS.replace(' ', '', 1)[:-1]}{WS[:-1]}*", " "))


def multiline(text: Column) -> Column:
    """Collapsed lines that are not blank."""
    lines = F.transform(F.split(text, LINE_BREAK), collapse)
    return F.filter(lines, lambda x: x != "")


def strip_eos(text: Column) -> Column:
    """The text without white space at its ends and without end marks, however many."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), EOS, "")


def ensure_tags(text: Column, prefix: str = "<LM>", suffix: str = "") -> Column:
    tagged = F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text)) if prefix else text
    return F.when(F.endswith(tagged, F.lit(suffix)), tagged).otherwise(F.concat(tagged, F.lit(suffix))) if suffix else tagged


def script_share(text: Column, alphabet: str) -> tuple[Column, Column]:
    """(tokens, tokens wholly in the alphabet); punctuation counts in the first.  Two counts of matches, no list."""
    own = rf"(?<![\p{{L}}\p{{N}}_]){alphabet}++(?![\p{{L}}\p{{N}}_])"
    return word_count(text), F.regexp_count(text, F.lit(own)).cast("long")


def has_lower_letters(text: Column, lower: str) -> Column:
    """True if no token is alphabetic, or some alphabetic token has a lower-case letter of the script."""
    words = F.filter(tokens(text), lambda t: t.rlike(ALPHA))
    return (F.size(words) == 0) | F.exists(words, lambda t: t.rlike(lower))


def padded_tokens(text: Column, fold: dict[str, str] | None = None) -> Column:
    """Tokens joined by blanks, one blank at either end, some letters folded."""
    out = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    for a, b in (fold or {}).items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def remove_links(text: Column) -> Column:
    """Wiki links replaced by their shown text, again until none is left.

    A round removes at least one opening bracket pair where there is a link, so there are
    no more rounds than such pairs; later rounds cost a search only.
    """
    once = lambda t: collapse(F.regexp_replace(t, WIKILINK, "$1"))
    rounds = F.sequence(F.lit(0), F.regexp_count(text, F.lit(r"\[\[")))
    return F.aggregate(rounds, collapse(text), lambda t, _: F.when(t.rlike(WIKILINK), once(t)).otherwise(t))


def doc_title(line: Column) -> Column:
    return collapse(F.regexp_extract(line, r'title="(.+)">$', 1))


def find_subphrase(words: Column, phrase: Column) -> Column:
    """First place (from 0) where the phrase's tokens stand in the text's, whatever the case; -1 if nowhere.

    An empty phrase is found at 0.
    """
    a, b = F.transform(words, F.lower), F.transform(phrase, F.lower)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - F.size(b), F.lit(0))), lambda i: F.slice(a, i + 1, F.size(b)) == b)
    return F.when(F.size(b) == 0, F.lit(0)).when(F.size(b) > F.size(a), F.lit(-1)).otherwise(F.coalesce(F.get(at, F.lit(0)), F.lit(-1)))


def answer_word(text: Column, yes: str, no: str) -> Column:
    """The one of two words that comes first among the lower-cased alphanumeric tokens, else null."""
    words = F.filter(F.transform(tokens(text), F.lower), lambda t: t.rlike(ALNUM))
    y, n = F.array_position(words, yes), F.array_position(words, no)
    return F.when((y > 0) & ((n == 0) | (y < n)), F.lit(yes)).when(n > 0, F.lit(no))


def judged_bad(verdict: Column) -> Column:
    """A judge's answer counts as bad if it says no or does not say yes."""
    words = F.array_distinct(F.transform(tokens(verdict), F.lower))
    return F.array_contains(words, "no") | ~F.array_contains(words, "yes")


def decimal_points(text: Column) -> Column:
    """Decimal commas between blanks to points.

    Two rounds reach the end: the first meets every other of numbers that share a blank,
    the second the rest, and a point never makes a new match.
    """
    out = text
    for _ in range(2):
        out = F.regexp_replace(out, r"([\s^]+\d+),(\d+)([\s$]+)", "$1.$2$3")
    return out


def choice_letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\(([\p{L}\p{N}_])\)"), 1)


def strip_zeros(number: Column) -> Column:
    """Trailing zeros after a decimal point dropped, and a point that is left alone; whole numbers stay."""
    return F.when(number.rlike(r"[.,]"), F.regexp_replace(number, r"[.,]?0*$", "")).otherwise(number)


def entity_list(text: Column, negative: str) -> Column:
    """Entities, one a line; a text that is the negative sentence has none."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    return F.when(F.instr(text, negative) > 0, F.array().cast("array<string>")).otherwise(lines)


def entity_text(entities: Column, negative: str) -> Column:
    """The inverse of :func:`entity_list`: one a line, or the negative sentence."""
    return F.when(F.size(entities) == 0, F.lit(negative)).otherwise(F.array_join(entities, "\n"))


def says_only(text: Column, sentence: str) -> Column:
    """Whether a text has the same set of alphanumeric tokens as a fixed sentence, whatever their order and case."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(tokens(c), F.lower), lambda t: t.rlike(ALNUM))))
    return words(text) == words(F.lit(sentence))


def closed_sentence(text: Column) -> Column:
    """A full stop added where the last character is a letter or digit."""
    return F.when(text.rlike(r"[\p{L}\p{N}]$"), F.concat(text, F.lit("."))).otherwise(text)
