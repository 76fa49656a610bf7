"""Statistics that tell natural prose from lists, tables and junk."""

from __future__ import annotations

import re
import statistics
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.llm import tongues
from lodecast.runtime import ship_by_value

ship_by_value(__name__)

_SENTENCE_END = re.compile(r"[.!?…。！？।؟][\"'”’»)\]]*(?:\s|$)|[。！？।]")
_CLOSED = re.compile(r"[.!?…。！？।؟:;][\"'”’»)\]*_]*\s*$")
_ITEM = re.compile(r"\s*(?:[-*•–—·+▪◦]|\d{1,4}[.)]|[A-Za-z][.)]|\[[ xX✓]?\]|\([a-z0-9]{1,3}\))\s+\S")
#: Indentation of a line, and the mark of an entry with the space behind it.
_EDGE = re.compile(r"[ \t]*(?:(?:[-*•–—·+▪◦]|\d{1,4}[.)]|[A-Za-z][.)]|\[[ xX✓]?\]|\([a-z0-9]{1,3}\))[ \t]+(?=\S))?")
_GAP = re.compile(r"(?<=\S)(?:\t| {3,})(?=\S)|(?<=\S)\t|\t(?=\S)")
_SPACED = re.compile(r"(?<=[^\s.!?:;,])  +(?=\S)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_DIGIT = re.compile(r"\d")
_WIDE = re.compile(r"[\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef]")
_BROKEN = re.compile(r"�|ï¿½|Ã[\x80-\xbf¼©�]?|â€|Å“|Â[\x80-\xbf·]")

FIELDS = (
    "n_words int, mean_word_length double, symbol_ratio double, digit_ratio double, closed_line_share double, common_word_share double, n_lines int, item_line_share double, "
    "delimiter_alignment double, indent_periodicity double, line_length_autocorrelation double, sentence_word_share double, broken_share double, kind string"
)


def edges(line: str, mark: str) -> list[int]:
    """Columns at which the cells of a line end: the places of a delimiter, or of runs of spaces (`gap`)."""
    if mark == "gap":
        return [m.end() for m in _GAP.finditer(line)] if "\t" in line or "   " in line else []
    out, k = [], line.find(mark)
    while k >= 0:
        out.append(k)
        k = line.find(mark, k + 1)
    return out


def delimiter_alignment(lines: list[str], body: str) -> tuple[float, str]:
    """How well the lines' delimiters stand below each other, and the delimiter for which they do best.

    Each line is put beside the one before it. Its delimiters are aligned where they stand in the same columns, by a
    column more or less, or where both lines have equally many, so that the k-th cell of one is below the k-th of the
    other whatever their widths. The score is the mean over all lines. Commas and semicolons, which prose has too, only
    count in lines of short cells without a sentence's end.
    """
    best, which = 0.0, ""
    if len(lines) < 3:
        return 0.0, ""
    for mark in ("|", "│", "\t", ";", ",", "gap"):
        if mark != "gap" and mark not in body:
            continue
        at = [edges(x, mark) for x in lines]
        if mark in ",;":
            at = [e if len(x.split()) <= 2 * (len(e) + 1) and not _SENTENCE_END.search(x) else [] for x, e in zip(lines, at, strict=True)]
        score = 0.0
        for above, below in zip([at[1], *at[:-1]], at, strict=True):
            if above and below:
                if len(above) == len(below):
                    score += 1.0
                else:
                    have = {c + d for c in above for d in (-1, 0, 1)}
                    score += sum(c in have for c in below) / max(len(above), len(below))
        share = score / len(lines)
        if share > best:
            best, which = share, mark
    return best, which


def indent_periodicity(lines: list[str]) -> float:
    """Share of the lines whose text begins in a column that comes back within four lines, as it does in lists of up to four levels.

    Text begins behind the indentation and behind the mark of an entry, which is a hanging indentation; indentation that
    all lines have in common is taken off. Lines without any don't count; fewer than three lines give 0.
    """
    if len(lines) < 3:
        return 0.0
    wide = [x.expandtabs(4) for x in lines]
    common = min(len(x) - len(x.lstrip(" ")) for x in wide)
    depth = [_EDGE.match(x, common).end() - common for x in wide]
    back = sum(d > 0 and any(abs(d - e) <= 1 for e in depth[max(0, k - 4) : k]) for k, d in enumerate(depth))
    return back / (len(depth) - 1)


def length_autocorrelation(lines: list[str]) -> float:
    """Evenness of line lengths with the lengths of the lines before: 1 for equal lines, about 0 for prose."""
    if len(lines) < 4:
        return 0.0
    n = [len(x) for x in lines]
    mean = sum(n) / len(n)
    off = [x - mean for x in n]
    var = sum(x * x for x in off) / len(n)
    spread = var**0.5 / max(1.0, mean)
    if spread < 1e-9:
        return 1.0
    along = sum(x * y for x, y in zip(off, off[1:], strict=False)) / max(1e-9, var * (len(n) - 1))
    return max(-1.0, min(1.0, along)) * 0.5 + max(0.0, 1 - 2 * spread) * 0.5


def even_lines(lines: list[str], even: float) -> bool:
    """Whether line lengths are regular by their autocorrelation, or nearly equal, where the autocorrelation is that of small differences."""
    if even >= 0.3 or even <= 0 or len(lines) < 4:
        return even >= 0.3
    n = [len(x) for x in lines]
    return statistics.pstdev(n) <= 0.1 * statistics.fmean(n)


def strung(lines: list[str], body: str) -> tuple[list[str], str]:
    """The entries of a list that is strung in few lines, and the mark between them; none for a text in many lines."""
    best, which = [], ""
    if len(lines) <= 4:
        for mark in (";", " | ", " / ", " • ", " · ", ","):
            if body.count(mark) > len(best):
                best, which = [x for x in body.split(mark) if x.strip()], mark
    return best, which


def spaced_rows(lines: list[str], even: float) -> bool:
    """Whether the lines are rows of short cells set off by two spaces or more: as many cells in most of them, and lines of even length."""
    if len(lines) < 4 or not even_lines(lines, even):
        return False
    counts = [len(_SPACED.findall(x.strip())) for x in lines]
    common = Counter(c for c in counts if c).most_common(1)
    return bool(common) and sum(c == common[0][0] and len(x.split()) <= 4 * (c + 1) for x, c in zip(lines, counts, strict=True)) >= 0.6 * len(lines)


def stepped(lines: list[str], indent: float) -> bool:
    """Whether at least half of the lines are indented in steps, in two depths or more."""
    return indent >= 0.5 and len({len(x) - len(x.lstrip(" \t")) for x in lines} - {0}) >= 2


def continued(lines: list[str]) -> float:
    """Share of the lines after the first that begin in lower case, as wrapped prose does."""
    return sum(x.lstrip()[0].islower() for x in lines[1:]) / max(1, len(lines) - 1)


def ordinary(word: str) -> bool:
    """Whether a word of Latin letters is built as words are: vowels among its consonants, letter case as in words."""
    w = word.lower()
    if len(w) < 3 or not w.isascii():
        return True
    vowels = sum(c in "aeiouy" for c in w)
    run = longest = 0
    for c in w:
        run = 0 if c in "aeiouy" else run + 1
        longest = max(longest, run)
    return 0.18 <= vowels / len(w) <= 0.85 and longest <= 4 and (word[1:].islower() or word.isupper() or len(word) < 4)


def profile(text: str) -> tuple:
    """The statistics of FIELDS of one text. An empty or blank text has zeros and kind `empty`."""
    body = text.replace("\r\n", "\n").replace("\r", "\n").strip("\n")
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "empty")
    spaced = body.split()
    solid = sum(map(len, spaced))
    words = tongues.letters_only(body)
    letters = sum(map(len, words))
    digits = len(_DIGIT.findall(body))
    symbols = max(0, solid - letters - digits)
    broken = 0.0 if body.isascii() else sum(map(len, _BROKEN.findall(body))) / max(1, solid)
    items = [x for x in lines if _ITEM.match(x)]
    align, mark = delimiter_alignment(lines, body)
    indent, even = indent_periodicity(lines), length_autocorrelation(lines)
    closed = sum(bool(_CLOSED.search(x)) for x in lines)
    common = tongues.function_share(body, words)
    # Words in lines that read as sentences: closed ones, or long ones without delimiters and with function words.
    inside = total = 0
    for x in lines:
        n = len(x.split()) + x.count("。") * 4
        total += n
        if n < 12 and _ITEM.match(x):
            continue
        if n >= 3 and _SENTENCE_END.search(x) or n >= 8 and tongues.function_share(x) >= 0.22 and x.count(";") * 8 < n and x.count("|") * 8 < n:
            inside += n
    prose = inside / max(1, total)
    odd = sum(not ordinary(w) for w in _WORD.findall(body)) / max(1, len(words)) if common < 0.2 else 0.0
    entries, between = strung(lines, body)
    spread = length_autocorrelation(entries)
    kind = "prose"
    tokens = len(spaced)
    cjk = 0 if body.isascii() else len(_WIDE.findall(body))
    mean_len = solid / max(1, tokens)
    flat = closed < 0.2 * len(lines) and repeated_lines(lines) < 0.5
    if broken > 0.12 or solid >= 24 and letters / max(1, solid) < 0.45 and not (align >= 0.6 and digits + letters > 0.25 * solid):
        kind = "junk"
    elif solid >= 40 and cjk < 0.2 * solid and (mean_len > 45 or odd > 0.45 and len(words) >= 8):
        kind = "junk"
    elif len(lines) >= 5 and closed < 0.1 * len(lines) and stepped(lines, indent) and repeated_lines(lines) < 0.5:
        kind = "list"
    elif prose >= 0.5:
        kind = "prose"
    elif len(lines) >= 4 and (align >= 0.6 or spaced_rows(lines, even)):
        kind = "table"
    elif len(lines) <= 2 and between not in (";", ",") and len(entries) > 6 and Counter(words).most_common(1)[0][1] >= 3 and repeated_words(body) > 0.35:
        kind = "junk"
    elif indent >= 0.5:
        kind = "list"
    elif len(entries) > 4 and tokens <= (5 if between != "," else 3.5) * (1 + spread) * len(entries) and not _SENTENCE_END.search(body[:-1]):
        kind = "list"
    elif len(lines) >= 5 and (tokens <= (5 + 4 * even) * len(lines) or even_lines(lines, even) and cjk < 0.2 * solid and continued(lines) < 0.5) and flat:
        kind = "list"
    elif len(words) >= 25 and cjk < 0.2 * solid and (common < 0.12 or not _SENTENCE_END.search(body) and common < 0.2):
        kind = "junk"
    elif len(words) >= 12 and repeated_lines(lines) >= 0.5 and len(lines) >= 5:
        kind = "junk"
    return (
        len(words), letters / max(1, len(words)), symbols / max(1, solid), digits / max(1, solid), closed / len(lines), common, len(lines), len(items) / len(lines),
        align, indent, even, prose, broken, kind,
    )


def repeated_words(text: str) -> float:
    words = [w.lower() for w in _WORD.findall(text)]
    return 1 - len(set(words)) / len(words) if words else 0.0


def repeated_lines(lines: list[str]) -> float:
    return 1 - len({x.strip() for x in lines}) / len(lines) if lines else 0.0


def profiles(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns of keep and the statistics of FIELDS for each row; null texts give null statistics, no row is dropped.

    One pass over the texts without a shuffle. Equal rows stay; columns of other names, also of FIELDS' names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            rows = [profile(t) if t is not None else (None,) * 14 for t in b.column(0).to_pylist()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), *[pa.float64()] * 5, pa.int32(), *[pa.float64()] * 6, pa.string()])]
            schema = [f"_k{k}" for k in range(len(keep))] + [x.split()[0] for x in FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=schema)

    kinds = ", ".join(f"_k{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    got = df.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)]).mapInArrow(run, f"{kinds}, {FIELDS}")
    return got.withColumnsRenamed({f"_k{k}": c for k, c in enumerate(keep)})


def answer_text() -> F.Column:
    """Contents of the assistant's messages joined by blank lines, of text where messages is null."""
    role = lambda m: F.lower(F.trim(m["role"]))
    answers = F.array_join(F.transform(F.filter("messages", lambda m: role(m) == "assistant"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")
    return F.when(F.col("messages").isNotNull(), answers).otherwise(F.col("text"))


def text_profiles(records: DataFrame) -> DataFrame:
    """One row per row of records: example_id, quality_score and the statistics of text; null texts have null statistics."""
    return profiles(records, "text", ["example_id", "quality_score"])


def no_prose(records: DataFrame) -> DataFrame:
    """Distinct (example_id, kind) of records with non-null text whose answers are mostly a list, a table or junk.

    Empty and missing answers are no cases; of a record in several forms each kind found is reported once.
    """
    texts = records.where("text IS NOT NULL AND example_id IS NOT NULL").select("example_id", answer_text().alias("answer"))
    return profiles(texts, "answer", ["example_id"]).where(F.col("kind").isin("list", "table", "junk")).select("example_id", "kind").distinct()
