"""Language of a text by its scripts and marker words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of letters in the order in which they are tried, with their language; two of them are told apart by marker letters.
SCRIPTS = (
    ("\\x{AC00}-\\x{D7A3}", "ko"), ("\\x{0E01}-\\x{0E5B}", "th"), ("\\x{0400}-\\x{044F}", ("[ъьщю]", "bg", "ru")), ("\\x{0905}-\\x{097F}", "hi"), ("\\x{0C95}-\\x{0CDE}", "kn"),
    ("\\x{0A05}-\\x{0A33}", "pa"), ("\\x{0A85}-\\x{0AF9}", "gu"), ("\\x{0B85}-\\x{0BFA}", "ta"), ("\\x{0985}-\\x{09FE}", "bn"), ("\\x{0621}-\\x{06FF}", ("[پچژگ]", "fa", "ur")),
)
# Marker words of languages in Latin letters, in the order in which equal scores are decided; `en` without any.
MARKERS = {
    "de": "der die das und ist nicht ein", "it": "il lo la gli che una non", "pt": "que não uma para com dos das", "fi": "että ja on sekä tämä ovat",
    "vi": "và của là một những trong", "sw": "na ya kwa wa ni hii",
}
TOKEN = "[a-z\\x{C0}-\\x{FF}]+"


def language_guess(c: Column) -> Column:
    """The language of the first script found; for Latin letters the one of most marker words, `en` without any; null for a text without letters or a null one.

    Letters of a range count only where they are letters. Marker words are counted once each, in lower case.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))

    def best(w: Column) -> Column:
        scores = {k: F.size(F.array_intersect(w, F.array(*map(F.lit, v.split())))) for k, v in MARKERS.items()}
        ranked = F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, n) in enumerate(scores.items())])
        top = F.array_max(ranked)
        return F.when(top["n"] > 0, top["lang"]).otherwise("en")

    out = F.when(~c.rlike(r"\p{L}"), F.lit(None).cast("string"))
    for letters, lang in SCRIPTS:
        there = c.rlike(rf"[{letters}&&\p{{L}}]")
        out = out.when(there, lang if isinstance(lang, str) else F.when(c.rlike(lang[0]), lang[1]).otherwise(lang[2]))
    # One evaluation of the words: the list is bound to a variable of a lambda.
    return F.when(c.isNotNull(), out.otherwise(F.get(F.transform(F.array(words), best), F.lit(0))))
