"""Responses that stop before their text is finished, found by counts of word trigrams inside texts and at their ends; in SQL.

A text that ends in a sentence mark, a closed structure or a bare answer is complete. Of all others the final trigram is
joined with the counts of the whole table. It accuses the text where it often goes on and almost never ends a text or
line. Where it occurs nowhere else, what stands before the final word is asked the same way, then the trigram's shape
(short words, numbers and capitals, by kind of line). A final word that stands nowhere inside a text is a piece of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.runtime import cut_lineage

# What may stand after a cut; sentence marks with what may close behind them; the letters of words.
MARK = r"(\s*([—–-]?\s*[(\[]\s*(more|continued|cont\.?)\b[^\n]{0,8}|\[\s*(…|\.\.\.|truncated|cut)\s*\]|<\s*(cut|truncated|…|\.\.\.)\s*>|\\u?[0-9a-fA-F]{0,4}|&[a-z]{0,6}|�|…|\.\.\.|[(\[{<]))+\s*$"
CLOSED = r"[.!?。！？।؟][\"'”’»)\]*_`]*$"
BARE = r"^[*_(]*[A-Za-z0-9.,+%$-]{1,16}[)*_.]*$"
LETTERS = r"\p{L}\p{M}\p{N}_'’#"

#: Keys of final trigrams that are broadcast, as 8 bytes each, to drop all other trigrams where they are read; more are joined by a shuffle.
BROADCAST_KEYS = 4_000_000

# A length is a field limit where at least so many texts of sentences have it and this share of them is not closed.
LIMIT_TEXTS, LIMIT_SHARE = 8, 0.75

TEXTS = r"""
SELECT output_id, length(response) AS len, response RLIKE r'\s$' AS trailing, bare, bare <> body AS marked, bare RLIKE r'@CLOSED@' AS closed, bare RLIKE r'[.!?。！？।؟][\"”’)]*(\s|$)|[。।]' AS sentences, instr(bare, '\n') > 0 AS lines
FROM (
  SELECT output_id, response, body, regexp_replace(body, r'@MARK@', '') AS bare
  FROM (SELECT DISTINCT output_id, response, regexp_replace(response, r'[\s ​]+$', '') AS body FROM @outputs@ WHERE response IS NOT NULL AND output_id IS NOT NULL)
  WHERE body <> ''
)
"""

# Tokens of a text, made by replacing and splitting whole texts: ␝ is the start of a list entry, ␞ the end of a line or an
# ellipsis, ␟ a sentence mark, 0 a number, all else a word; c in lower case, h as shapes (⊔ a long word with a capital, ⊓ a long one).
TOKENS = r"""
SELECT output_id, verse, element_at(split(trim(s), ' '), -1) AS written, split(lower(trim(s)), ' ') AS c,
  split(lower(trim(regexp_replace(regexp_replace(s, r'(?<![^ ])\p{Lu}[^ ]{3,}', '⊔'), r'(?<![^ ])[^ ]{4,}', '⊓'))), ' ') AS h
FROM (
  SELECT output_id, NOT sentences AND lines AS verse,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(concat('\n', bare), '␝␞␟⊔⊓', ''),
      r'\n[ \t]*(?:[-*•+]|\d+[.)])[ \t]+', ' ␝ '), r'\n|(?:…|\.\.\.)[.!?。！？।؟…]*', ' ␞ '), r'[0-9]+(?:[.,][0-9]+)+|(?<![@LETTERS@])[0-9][@LETTERS@]*', ' 0 '), r'[.!?。！？।؟]+', ' ␟ '), r'[^@LETTERS@␝␞␟]+', ' ') AS s
  FROM @texts@
)
"""

# Each word beside the five tokens before it, the next one, and the shapes of the last three; arrays are shifted against each other, so that no function is called for each element.
WORDS = r"""
SELECT output_id, last, word, written, follows, first_of_line,
  translate(concat(if(p1 IN ('␝', '␞', '␟'), '', p2), ' ', p1, ' '), '␟', '␞') AS ahead, translate(concat(p3, ' ', p2, ' ', p1), '␟', '␞') AS before,
  translate(concat(CASE WHEN '␝' IN (p1, p2, p3, p4, p5) THEN 'L' WHEN verse THEN 'V' ELSE 'P' END, ' ', if(p1 IN ('␝', '␞', '␟'), '', g2), ' ', g1, ' ', g0), '␟', '␞') AS mould
FROM (
  SELECT *, p0 AS word, next IS NULL AS last, CASE WHEN next IS NULL OR next IN ('␝', '␞') THEN 2 WHEN next = '␟' THEN 1 ELSE 0 END AS follows, p1 = '␞' AND p2 NOT IN ('␞', '␟') AS first_of_line
  FROM (
    SELECT output_id, verse, written, inline(arrays_zip(slice(c, 1, n), slice(c, 2, n), slice(c, 3, n), slice(c, 4, n), slice(c, 5, n), slice(c, 6, n), slice(c, 7, n), slice(h, 2, n), slice(h, 3, n), slice(h, 4, n))) AS (p5, p4, p3, p2, p1, p0, next, g2, g1, g0)
    FROM (SELECT output_id, verse, written, size(c) AS n, concat(array('', '', '', '', ''), c) AS c, concat(array('', '', ''), h) AS h FROM @tokens@)
  )
  WHERE p0 NOT IN ('␝', '␞', '␟')
)
"""

# Texts that are not closed, with their last words.
ENDS = r"""
SELECT t.*, w.word, w.ahead, w.before, w.mould, w.first_of_line, w.written, coalesce(l.n >= @LIMIT_TEXTS@ AND l.open >= @LIMIT_SHARE@ * l.n, false) AS limited
FROM (
  SELECT *, bare RLIKE r'^\s*[\[{]' AS json,
    length(bare) - length(replace(bare, '{', '')) <> length(bare) - length(replace(bare, '}', '')) OR length(bare) - length(replace(bare, '[', '')) <> length(bare) - length(replace(bare, ']', ''))
      OR (length(bare) - length(replace(replace(bare, '\\\\"', '\\\\'), '"', ''))) % 2 = 1 AS unbalanced,
    ((length(bare) - length(replace(bare, '```', ''))) / 3) AS fences,
    bare RLIKE r'[)*_`]$' AND length(bare) - length(replace(bare, '(', '')) = length(bare) - length(replace(bare, ')', '')) AND ((length(bare) - length(replace(bare, '**', ''))) / 2) % 2 = 0 AS shut,
    element_at(split(bare, '\n'), -1) RLIKE r'@BARE@' AS single, bare RLIKE r'(^|\n)#+[ \t]*[-+]?[0-9][0-9,.]*$' AS counted,
    element_at(split(bare, '\n'), -1) RLIKE r'^\s*([-*•+]|[0-9]+[.)])(\s|$)' AS listed
  FROM @texts@ WHERE NOT closed
) t
LEFT JOIN (SELECT * FROM @words@ WHERE last) w USING (output_id)
LEFT JOIN (SELECT len, count(*) AS n, count_if(NOT closed) AS open FROM @texts@ WHERE sentences GROUP BY len) l USING (len)
WHERE NOT (shut AND fences % 2 = 0) AND NOT counted
"""

# Of each trigram, of what stands before a word, of each shape and of each word that the ends ask for: how often it occurs and how it goes on.
ASKED = "SELECT DISTINCT xxhash64(kind, key) AS k FROM (SELECT stack(4, 't', ahead, 'b', before, 'm', mould, 'w', word) AS (kind, key) FROM @ends@ WHERE word IS NOT NULL)"
COUNTS = """
SELECT kind, key, word, count(*) AS n, count_if(ends = 2) AS open_ends, count_if(ends > 0) AS any_ends, count_if(inside) AS inside
FROM (
  SELECT kind, key, if(kind = 't', said, '') AS word, ends, inside, xxhash64(kind, key) AS k
  FROM (SELECT stack(4, 't', ahead, follows, 'b', before, follows, 'm', mould, follows, 'w', word, follows) AS (kind, key, ends), word AS said, NOT (last AND follows = 2) AS inside FROM @words@)
) LEFT SEMI JOIN @asked@ USING (k)
GROUP BY kind, key, word
"""

FOUND = r"""
WITH asked AS (SELECT DISTINCT ahead, word FROM @ends@ WHERE word IS NOT NULL),
longest AS (SELECT coalesce(max(length(word)), 0) AS most FROM asked),
begun AS (
  -- the beginnings of all words that follow two words, each with the count of its most frequent longer word
  SELECT key AS ahead, left(word, k) AS word, max(n) AS n
  FROM (SELECT c.key, c.word, c.n, explode(sequence(1, least(length(c.word) - 1, most))) AS k FROM @held@ c CROSS JOIN longest WHERE c.kind = 't' AND length(c.word) > 1 AND most > 0)
  GROUP BY ALL
), pieces AS (
  -- final words that are the beginning of a longer word which follows the same two words more often
  SELECT a.ahead, a.word FROM asked a JOIN begun USING (ahead, word) JOIN @held@ o ON o.kind = 't' AND o.key = a.ahead AND o.word = a.word AND begun.n > o.n
)
SELECT DISTINCT output_id FROM (
  SELECT e.*, coalesce(t.n, 1) - 1 AS tn, (coalesce(t.open_ends, 1) - 1) / nullif(coalesce(t.n, 1) - 1, 0) AS t_open, (coalesce(t.any_ends, 1) - 1) / nullif(coalesce(t.n, 1) - 1, 0) AS t_any,
    coalesce(b.n, 1) - 1 AS bn, (coalesce(b.open_ends, 1) - 1) / nullif(coalesce(b.n, 1) - 1, 0) AS b_open, (coalesce(b.any_ends, 1) - 1) / nullif(coalesce(b.n, 1) - 1, 0) AS b_any,
    coalesce(m.n, 1) - 1 AS mn, (coalesce(m.any_ends, 1) - 1) / nullif(coalesce(m.n, 1) - 1, 0) AS m_any,
    (coalesce(w.inside, 0) > 0 OR e.word = '0') AND p.word IS NULL AS known, coalesce(w.open_ends, 0) AS w_open
  FROM @ends@ e
  LEFT JOIN @held@ t ON t.kind = 't' AND t.key = e.ahead AND t.word = e.word LEFT JOIN @held@ b ON b.kind = 'b' AND b.key = e.before
  LEFT JOIN @held@ m ON m.kind = 'm' AND m.key = e.mould LEFT JOIN @held@ w ON w.kind = 'w' AND w.key = e.word
  LEFT JOIN pieces p ON p.ahead = e.ahead AND p.word = e.word
)
WHERE CASE
  WHEN json THEN unbalanced
  WHEN fences > 0 THEN fences % 2 = 1
  WHEN word IS NULL THEN false
  WHEN single THEN NOT known AND NOT shut AND word RLIKE r'^[A-Za-z]{2,}$' AND NOT first_of_line
  WHEN word LIKE '#%' THEN w_open < 3
  -- lines without sentences: the shape's own kind of line counts first, as words of lists stand in sentences too
  WHEN listed OR NOT sentences AND lines THEN NOT known OR CASE WHEN mn >= 3 THEN m_any < 0.2 WHEN tn >= 5 THEN t_any < 0.2 ELSE false END
  WHEN NOT sentences AND NOT marked AND known AND length(bare) - length(replace(bare, ' ', '')) <= 2 AND written RLIKE r'^\p{Lu}' THEN false
  -- a piece of a word: what stands before it goes on, but for endings that are always followed by one word and the end
  WHEN NOT known THEN NOT (bn >= 2 AND (b_open >= 0.5 OR b_open >= 0.02 AND b_any >= 0.9) AND (tn >= 5 OR written RLIKE r'^\p{Lu}' AND first_of_line))
  WHEN bn >= 2 AND (b_open >= 0.5 OR b_open >= 0.02 AND b_any >= 0.9) THEN false
  -- the final trigram goes on elsewhere and doesn't end texts; one that often ends sentences only accuses at a field limit or before what stands after a cut
  WHEN tn >= 1 THEN t_open < 0.5 AND (coalesce(t_any, 0) < 0.3 OR bn < 2 OR b_any < 0.4 OR marked OR trailing OR limited)
  WHEN bn >= 1 THEN b_open < 0.5
  ELSE mn < 50 OR m_any < 0.6
END
"""


def cut_responses(outputs: DataFrame) -> DataFrame:
    """Distinct output_id of responses that were cut off: that end within a word, sentence, list entry or structure.

    What stands after the cut is taken off first. Null and blank responses are no cases; repeated rows count once;
    columns of other names are not read. The counts cover all responses, each without its own end; n-grams that no end
    asks for are dropped where they are read.
    """
    spark, tag = outputs.sparkSession, uuid.uuid4().hex

    def view(name: str, df: DataFrame) -> str:
        df.createOrReplaceTempView(f"lodecast_{name}_{tag}")
        return f"lodecast_{name}_{tag}"

    def put(sql: str, **parts: str) -> str:
        for k, v in parts.items():
            sql = sql.replace(f"@{k}@", str(v))
        return sql

    names = {"outputs": view("outputs", outputs.select("output_id", "response"))}
    quoted = {"CLOSED": CLOSED.replace("'", r"\x27"), "BARE": BARE, "MARK": MARK, "LETTERS": LETTERS.replace("'", r"\x27"), "LIMIT_TEXTS": LIMIT_TEXTS, "LIMIT_SHARE": LIMIT_SHARE}
    names["texts"] = view("texts", cut_lineage(spark.sql(put(TEXTS, **quoted, **names))))
    names["tokens"] = view("open_tokens", spark.sql(put(TOKENS, **quoted, texts=f"(SELECT * FROM {names['texts']} WHERE NOT closed)")))
    names["words"] = view("open_words", spark.sql(put(WORDS, **names)))
    names["ends"] = view("ends", cut_lineage(spark.sql(put(ENDS, **quoted, **names))))
    names["tokens"] = view("tokens", spark.sql(put(TOKENS, **quoted, **names)))
    names["words"] = view("words", spark.sql(put(WORDS, **names)))
    asked = cut_lineage(spark.sql(put(ASKED, **names)))
    names["asked"] = view("asked", F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked)
    names["held"] = view("held", cut_lineage(spark.sql(put(COUNTS, **names))))
    found = spark.sql(put(FOUND, **names))
    for name in (*names.values(), f"lodecast_open_tokens_{tag}", f"lodecast_open_words_{tag}"):
        spark.catalog.dropTempView(name)
    return found


def cut_shares(outputs: DataFrame) -> DataFrame:
    """adapter, benchmark, responses, cut, share: how many distinct non-blank responses of each were cut off."""
    rows = outputs.where("output_id IS NOT NULL AND response IS NOT NULL AND trim(response) <> ''").select("output_id", "adapter", "benchmark").distinct()
    found = cut_responses(outputs).withColumn("_cut", F.lit(1))
    both = rows.join(found, "output_id", "left").groupBy("adapter", "benchmark").agg(F.count(F.lit(1)).alias("responses"), F.count("_cut").alias("cut"))
    return both.withColumn("share", F.col("cut") / F.col("responses"))
