"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's \s sees it, word characters, and the function words of the English signal.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORDCHAR = r"[\p{L}\p{N}_]"
STOPWORDS = ("a", "an", "and", "are", "for", "from", "how", "in", "is", "of", "please", "the", "to", "what", "why", "with")
# Length bins, half open, and their labels.
BINS = ((0, 256, "0-255"), (256, 512, "256-511"), (512, 1024, "512-1023"), (1024, 1536, "1024-1535"), (1536, 2049, "1536-2048"))


def normalise(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), SPACE + "+", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct runs of n characters; the whole text where it is no longer than n."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z]+"), F.lit(0))


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def solid_count(c: Column) -> Column:
    """Characters that are no white space."""
    return F.regexp_count(c, F.lit(r"[^\t-\r\x1c-\x20\x85\p{Z}]"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORDCHAR + "+"))


def token_count(c: Column) -> Column:
    """Words and single marks: the stand-in for a tokenizer."""
    return F.regexp_count(c, F.lit(WORDCHAR + r"+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]"))


def has_run(c: Column, n: int) -> Column:
    """Whether some character other than a newline stands n times in a row."""
    return c.rlike(r"(?d)(.)\1{" + str(n - 1) + ",}")


def length_bin(n: Column) -> Column:
    """The label of a token count; an error outside of all bins."""
    out = F.raise_error(F.concat(F.lit("token count outside of all bins: "), n.cast("string"))).cast("string")
    for lo, hi, label in reversed(BINS):
        out = F.when((n >= lo) & (n < hi), F.lit(label)).otherwise(out)
    return out


def repetition_excess(words: Column) -> Column:
    """Sum over distinct words that occur more than three times of their occurrences beyond the first.

    Words are counted by their sorted runs in one pass, not by comparing each with all.
    """
    step = lambda s, w: F.when(
        s["last"] == w, F.struct(w.alias("last"), (s["n"] + 1).alias("n"), (s["sum"] + F.when(s["n"] == 3, F.lit(3)).when(s["n"] > 3, F.lit(1)).otherwise(F.lit(0))).alias("sum"))
    ).otherwise(F.struct(w.alias("last"), F.lit(1).alias("n"), s["sum"].alias("sum")))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("sum"))
    return F.aggregate(F.array_sort(words), start, step, lambda s: s["sum"])


def text_quality(text: Column, assistant: Column, tokens: Column) -> Column:
    """Quality in 0..1 of a text joined by spaces: English signal, answer length, length, repetition and artefacts; 6 decimals."""
    words = ascii_words(text)
    n = F.size(words)
    hits = F.size(F.filter(words, lambda w: w.isin(*STOPWORDS)))
    english = 0.5 * F.least(F.lit(1.0), hits / 4.0) + 0.5 * F.least(F.lit(1.0), letter_count(text) / F.greatest(F.lit(1), solid_count(text)))
    response = F.least(F.lit(1.0), word_count(assistant) / 80.0)
    length = F.when((tokens >= 32) & (tokens <= 1536), 1.0).otherwise(0.7)
    repetition = F.greatest(F.lit(0.0), 1.0 - repetition_excess(words) / F.greatest(F.lit(1), n))
    artefact = F.when(F.contains(text, F.char(F.lit(0))) | has_run(text, 10), 0.0).otherwise(1.0)
    return F.when(n == 0, 0.0).otherwise(F.round(0.25 * english + 0.25 * response + 0.2 * length + 0.2 * repetition + 0.1 * artefact, 6))


def hard_valid(text: Column, tokens: Column, most: int = 2048) -> Column:
    """Whether a text may enter the pool at all."""
    letters = letter_count(text)
    return (
        (tokens > 0) & (tokens <= most) & (F.size(ascii_words(text)) >= 4) & (letters >= 20) & (letters / F.greatest(F.lit(1), solid_count(text)) >= 0.25)
        & ~F.contains(text, F.char(F.lit(0))) & ~has_run(text, 13)
    )


def priority(seed: int | str, ident: Column) -> Column:
    """16 hexadecimal digits that order rows as an unsigned 64-bit hash does."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256), 1, 16)


def is_blank(c: Column) -> Column:
    """Whether a text holds nothing but white space; null for null."""
    return ~c.rlike(r"[^\t-\r\x1c-\x20\x85\p{Z}]")


# Scripts and marker letters of the language guess, in the order in which they are tried.
_SCRIPT_RULES = (
    (r"[\x{AC00}-\x{D7A3}]", "ko"), (r"[\x{0E01}-\x{0E5B}]", "th"), (r"[\x{0400}-\x{044F}]", "cyrillic"), (r"[\x{0905}-\x{097F}]", "hi"), (r"[\x{0C95}-\x{0CDE}]", "kn"),
    (r"[\x{0A05}-\x{0A33}]", "pa"), (r"[\x{0A85}-\x{0AF9}]", "gu"), (r"[\x{0B85}-\x{0BFA}]", "ta"), (r"[\x{0985}-\x{09FE}]", "bn"), (r"[\x{0621}-\x{06FF}]", "arabic"),
)


def script_guess(c: Column) -> Column:
    """Language by the first script found, in a fixed order; null for texts in Latin letters, `none` without letters."""
    out = F.when(~c.rlike(r"\p{L}"), F.lit("none"))
    for pattern, lang in _SCRIPT_RULES:
        out = out.when(c.rlike(pattern), F.lit(lang))
    return out
