"""Reading level of running text: the median of several grade estimates, brought to school years by graded documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecast.llm import textstats, tongues
from lodecast.runtime import cut_lineage, ship_by_value

ship_by_value(__name__)

LANGUAGES = ("en", "de", "fr", "es")
#: Documents with grades that the calibration reads at most; a random sample by hash of the id where there are more.
GRADED_DOCS = 50_000
LEAST_WORDS = 50
#: Numbers of documents for which a rater's deviation, a language's own curves, and calibration at all count half.
SHRINK_RATER, SHRINK_LANGUAGE, SHRINK_ALL = 5, 15, 6

# Two vowels that are spoken as two syllables (hiatus), by language; all other neighbours are one.
HIATUS = {
    "en": re.compile(r"ia(?!l\b|n\b)|io(?!n)|iu|eo(?!u)|ua(?!r)|uo|[aeiouy]ing\b|ier\b|iest\b"),
    "de": re.compile(r"io|ia|ea|eo|iu|ii|[aou][äöü]"),
    "fr": re.compile(r"éa|éo|ia|io(?!n)|aï|oï|uë|éu"),
    "es": re.compile(r"[aeo][aeo]|[íú][aeo]|[aeo][íú]"),
}
GROUPS = {"en": re.compile(r"[aeiouy]+"), "de": re.compile(r"[aeiouyäöü]+"), "fr": re.compile(r"[aeiouyàâéèêëîïôûùüœæ]+"), "es": re.compile(r"[aeiouáéíóúü]+|y\b")}
SILENT = {"en": re.compile(r"(?:[^aeiouyl]|[aeiouy]l|[^aeiouy][^aeiouytdl])es?$|[^aeiouytd]ed$|[^aeiouy]e(?:ly|ment|ness|less|ful)$"), "fr": re.compile(r"[^aeiouyéèêà]e(?:s|nt)?$"), "de": None, "es": None}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A sentence ends at a mark before a capital or the end, but not behind a word of one or two letters, as in abbreviations.
_SENTENCE = re.compile(r"(?<!\b[^\W\d_])(?<!\b[^\W\d_]{2})[.!?…]+[\"'”’»)\]]*(?=\s+[\"'“«¿¡(]*[A-ZÀ-ÖØ-Þ]|\s*$)|[!?]+(?=\s)|\n\s*\n")
# Marks of speakers, of chat templates and of log lines.
_SPEAKER = re.compile(r"(?m)^\s*(?:\[?(?:human|user|assistant|model|system|speaker|host|guest|interviewer|q|a)(?: \d+)?\]?\s*:|\[(?:human|model|user|assistant|system)\]|<\|?\w+\|?>|#{2,}\s*(?:instruction|response|input)\b|>>>? |[A-Z]\w{1,20}: )|\"role\"\s*:", re.I)
_LOG = re.compile(r"(?m)^\s*(?:\d{4}-\d\d-\d\d|\d\d:\d\d(?::\d\d)?\b|\[?\d{1,2}:\d\d(?::\d\d)?\]?|0x[0-9a-f]{4,}|(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b)|\b\w+=\d[\w.+-]*(?: \w+=[\w.+-]+){2,}")


# Groups of consonants that begin a syllable together.
ONSETS = {
    "en": "bl br ch cl cr dr dw fl fr gl gr ph pl pr qu sc sch scr sh shr sk sl sm sn sp spl spr st str sw th thr tr tw wh wr", "de": "bl br ch cl cr dr fl fr gl gr kl kn kr ph pf pfl pfr pl pr qu sch schl schm schn schr schw sp spl spr st str th tr tz zw",
    "fr": "bl br ch cl cr dr fl fr gl gn gr ph pl pr qu th tr vr", "es": "bl br ch cl cr dr fl fr gl gr ll pl pr qu rr tr",
}
_ONSETS = {k: frozenset(v.split()) for k, v in ONSETS.items()}


def nuclei(word: str, lang: str) -> list[tuple[int, int]]:
    """Stretches of vowels of a lower-case word, one for each syllable: groups without a silent ending, cut where two vowels are spoken apart."""
    groups = [m.span() for m in GROUPS[lang].finditer(word)]
    silent = SILENT[lang]
    if len(groups) > 1 and silent is not None and (m := silent.search(word)):
        last = [g for g in groups if g[0] >= m.start()]
        if last and len(groups) > len(last[:1]):
            groups.remove(last[0] if last[0][0] > m.start() or len(last) == 1 else last[1])
    cuts = {m.start() + 1 for m in HIATUS[lang].finditer(word)}
    out = []
    for a, b in groups:
        inside = sorted(c for c in cuts if a < c < b)
        out += list(zip([a, *inside], [*inside, b], strict=True))
    return out


def hyphenated(word: str, lang: str) -> list[str]:
    """A lower-case word in syllables: between two nuclei as many consonants go to the second as begin a syllable together, at least one of them."""
    cores = nuclei(word, lang)
    if len(cores) < 2:
        return [word]
    breaks = []
    for (_, end), (begin, _) in zip(cores, cores[1:], strict=False):
        between = word[end:begin]
        keep = next((k for k in range(min(4, len(between)), 1, -1) if between[-k:] in _ONSETS[lang]), min(1, len(between)))
        breaks.append(begin - keep)
    return [word[a:b] for a, b in zip([0, *breaks], [*breaks, len(word)], strict=True)]


def syllables(word: str, lang: str) -> int:
    return len(hyphenated(word, lang))


def is_running(text: str) -> bool:
    """Whether a text is running prose: no list, table, junk, transcript, chat template or log."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return False
    if len(_SPEAKER.findall(text)) >= max(2, 0.15 * len(lines)) or len(_LOG.findall(text)) >= max(2, 0.2 * len(lines)):
        return False
    stats = textstats.profile(text)
    if stats[-1] == "prose":
        return True
    # Short plain lines that hold sentences without marks are read as a list by their shape alone.
    return stats[-1] == "list" and stats[7] < 0.1 and stats[5] >= 0.15 and len(text.split()) >= 3.2 * len(lines) and not re.search(r"[;|\t]", text)


def measures(text: str, lang: str, cache: dict[tuple[str, str], int]) -> tuple[float, ...] | None:
    """Words, words a sentence, syllables a word, letters a word, and shares of words of 3 and more syllables and of over 6 letters.

    Where a text has hardly any sentence marks, its lines are its sentences, and where these are too long as well, the
    length of a sentence is not known: missing punctuation makes no text harder. Names (capitalised words
    inside a sentence, but for German) don't count for the length of words.
    """
    parts = [w for p in _SENTENCE.split(text) if (w := _WORD.findall(p))]
    total = sum(map(len, parts))
    if total < LEAST_WORDS:
        return None
    per = total / max(1, len(parts))
    if per > 45:
        lines = [x for x in text.splitlines() if _WORD.search(x)]
        per = total / max(1, len(lines))
        if per > 45:
            per = float("nan")
    counts: Counter[str] = Counter()
    for p in parts:
        counts.update(p if lang == "de" else [p[0], *[w for w in p[1:] if not (w[0].isupper() and w[1:].islower())]])
    n = s = letters = many = long = 0
    for w, k in counts.items():
        low = w.lower()
        if (lang, low) not in cache:
            if len(cache) > 300_000:
                cache.clear()
            cache[lang, low] = syllables(low, lang)
        c = cache[lang, low]
        n += k
        s += k * c
        letters += k * len(low)
        many += k * (c >= 3)
        long += k * (len(low) > 6)
    if n < LEAST_WORDS // 2:
        return None
    return (float(total), per, s / n, letters / n, many / n, long / n)


#: The estimates, in their order: those combined where the length of sentences is known, and those of words alone.
ESTIMATES = ("flesch_kincaid", "coleman_liau", "readability_index", "fog", "lix", "syllables", "letters", "long_words")
WITH_SENTENCES, WORDS_ALONE = slice(0, 6), slice(5, 8)


def estimates(m: tuple[float, ...]) -> tuple[float, ...]:
    """Grade estimates of measures(), before calibration: five classic formulas, and three of words alone; those that need an unknown length of sentences are NaN."""
    _, per, syl, letters, many, long = m
    return (
        0.39 * per + 11.8 * syl - 15.59,
        5.88 * letters - 29.6 / max(per, 1.0) - 15.8 if per == per else per,
        4.71 * letters + 0.5 * per - 21.43,
        0.4 * (per + 100 * many),
        (per + 100 * long) / 4,
        11.8 * syl - 10.5,
        5.88 * letters - 18.0,
        25 * long,
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, language, n_words and raw, the raw estimates, of documents of running text in one of LANGUAGES; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[str, str], int] = {}
        for b in batches:
            keep, langs, sizes, raw = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t or len(t) < 100:
                    continue
                words = tongues.letters_only(t)
                if len(words) < LEAST_WORDS:
                    continue
                lang = tongues.main_language(t, words=words)
                if lang not in LANGUAGES or not is_running(t):
                    continue
                m = measures(t, lang, cache)
                if m:
                    keep.append(k)
                    langs.append(lang)
                    sizes.append(int(m[0]))
                    raw.append(estimates(m))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(raw, pa.list_(pa.float64()))], names=["doc_id", "language", "n_words", "raw"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, language string, n_words int, raw array<double>")


def school_years(grades: DataFrame) -> DataFrame:
    """(doc_id, years): one grade of each graded document: the median of its raters, each without its steady deviation.

    Only grades 1 to 18 count, repeated rows once. The deviation of a rater is the median of its differences from the
    mean of the other raters of the same documents, drawn towards none the fewer documents there are.
    """
    g = grades.where("doc_id IS NOT NULL AND rater IS NOT NULL AND grade BETWEEN 1 AND 18").groupBy("doc_id", "rater").agg(F.avg("grade").alias("grade"))
    doc = Window.partitionBy("doc_id")
    both = g.withColumn("n", F.count(F.lit(1)).over(doc)).withColumn("s", F.sum("grade").over(doc)).where("n > 1")
    bias = both.groupBy("rater").agg(F.median(F.col("grade") - (F.col("s") - F.col("grade")) / (F.col("n") - 1)).alias("bias"), F.count(F.lit(1)).alias("k"))
    # Half of a deviation from the others is the others' own, where there are two of them; it is taken off as measured.
    fixed = g.join(F.broadcast(bias), "rater", "left").withColumn("grade", F.col("grade") - F.coalesce(F.col("bias") * F.col("k") / (F.col("k") + SHRINK_RATER), F.lit(0.0)) / 2)
    return fixed.groupBy("doc_id").agg(F.median("grade").alias("years"))


def fit(rows: np.ndarray, years: np.ndarray) -> list[list[tuple[float, float]]]:
    """Of each estimate the points of a rising curve from raw value to years: isotonic regression, both ends of each level."""
    curves = []
    for k in range(rows.shape[1]):
        there = np.flatnonzero(~np.isnan(rows[:, k]))
        order = there[np.argsort(rows[there, k], kind="stable")]
        blocks: list[list[float]] = []
        for x, y in zip(rows[order, k], years[order], strict=True):
            blocks.append([y, 1, x, x])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
        curves.append([p for v, _, x0, x1 in blocks for p in ([(x0, v)] if x0 == x1 else [(x0, v), (x1, v)])])
    return curves


def curve_years(raw: np.ndarray, curves: list) -> np.ndarray:
    """Each estimate of a table brought to school years by its curve; NaN stays."""
    return np.column_stack([np.interp(raw[:, k], c[0], c[1]) if len(c[0]) else np.full(len(raw), np.nan) for k, c in enumerate(curves)])


def years_of(raw: np.ndarray, languages: list[str], held: dict) -> np.ndarray:
    """School years of each row of estimates: the median over its estimates, of those of words alone where the length of sentences is not known.

    An estimate is drawn from its language's curve towards the curve of all languages, and from there towards its raw value,
    the fewer graded documents stand behind the curves.
    """
    years = raw.copy()
    if "" in held:
        n, curves = held[""]
        years += n / (n + SHRINK_ALL) * (curve_years(raw, curves) - years)
        own = np.array(languages, dtype=object)
        for lang in set(languages) & held.keys():
            rows = own == lang
            n, curves = held[lang]
            years[rows] += n / (n + SHRINK_LANGUAGE) * (curve_years(raw[rows], curves) - years[rows])
    known = ~np.isnan(raw[:, 0])
    out = np.median(years[:, WORDS_ALONE], axis=1)
    out[known] = np.median(years[known, WITH_SENTENCES], axis=1)
    return out


def calibration(found: DataFrame, grades: DataFrame, sample: int = GRADED_DOCS) -> dict[str, tuple]:
    """(documents, curves) of each language, and under "" of all together, from at most `sample` graded documents; none without grades."""
    rows = found.join(school_years(grades), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("language", "raw", "years").toPandas()
    out = {}
    for lang in ("", *LANGUAGES):
        part = rows if not lang else rows[rows.language == lang]
        if len(part):
            raw, years = np.array(part.raw.tolist(), dtype=float), part.years.to_numpy(dtype=float)
            out[lang] = (len(part), [tuple(map(np.array, zip(*c, strict=True))) if c else ((), ()) for c in fit(raw, years)])
    return out


def reading_levels(docs: DataFrame, grades: DataFrame, low: float = 5.0, high: float = 13.0, sample: int = GRADED_DOCS) -> DataFrame:
    """doc_id, language, n_words, years and reading_level of documents of at least 50 words of running text in en, de, fr or es.

    years is the median of the calibrated estimates; reading_level is `elementary` up to `low` years, `advanced` from
    `high` on, else null. Both lie in the middle between the ends asked for and what is between. Texts are measured once. Without grades the raw
    estimates are used. Documents in other languages, lists, tables, logs, transcripts, junk and null texts are left out.
    """
    found = cut_lineage(measured(docs))
    curves = docs.sparkSession.sparkContext.broadcast(calibration(found, grades, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = curves.value
        for b in batches:
            raw = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(ESTIMATES)).astype(float)
            years = years_of(raw, b.column(1).to_pylist(), held) if len(raw) else raw[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(years, pa.float64())], names=["doc_id", "language", "n_words", "years"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rated = found.mapInArrow(run, f"doc_id {kind}, language string, n_words int, years double")
    return rated.withColumn("reading_level", F.when(F.col("years") <= low, "elementary").when(F.col("years") >= high, "advanced"))


def clear_levels(docs: DataFrame, grades: DataFrame) -> DataFrame:
    """Distinct (doc_id, reading_level) of the documents that lie at one end."""
    return reading_levels(docs, grades).where("reading_level IS NOT NULL").select("doc_id", "reading_level").distinct()
