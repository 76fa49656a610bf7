"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecast.llm import bpe, leakage, mixture, pairs, reading, textstats, tokens, truncation, variety
from lodecast.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: Share of the records that the varied subset of p6_subset holds.
SUBSET_SHARE = 0.1


def varied(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records")
    size = round(SUBSET_SHARE * records.select("example_id").distinct().count())
    return variety.varied_subset(records, size, seed=13).select("example_id")


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: pairs.broken_pairs(table(s, d, "records")),
    "p2_found": lambda s, d: tokens.unusable_counts(table(s, d, "records")),
    "p2_budget": lambda s, d: tokens.token_budget(table(s, d, "records"), table(s, d, "documents"), table(s, d, "source_info")),
    "p3_found": lambda s, d: truncation.cut_responses(table(s, d, "eval_outputs")),
    "p3_shares": lambda s, d: truncation.cut_shares(table(s, d, "eval_outputs")).withColumn("share", F.round("share", 9)),
    "p4_found": lambda s, d: mixture.unfilled(table(s, d, "records"), table(s, d, "target_mix"), seed=13),
    "p4_sample": lambda s, d: mixture.mixture_sample(table(s, d, "records"), table(s, d, "target_mix"), seed=13)[0],
    "p4_report": lambda s, d: mixture.mixture_sample(table(s, d, "records"), table(s, d, "target_mix"), seed=13)[1].withColumns({c: F.round(c, 9) for c in ("wanted", "short")}),
    "p5_found": lambda s, d: textstats.no_prose(table(s, d, "records")),
    "p5_stats": lambda s, d: textstats.text_profiles(table(s, d, "records")),
    "p6_found": lambda s, d: variety.similar_groups(table(s, d, "records")).withColumnsRenamed({"a": "example_id_a", "b": "example_id_b"}),
    "p6_subset": varied,
    "p7_ids": lambda s, d: tokens.encode_documents(table(s, d, "documents")),
    "p8_found": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "benchmark", "example_id").distinct(),
    "p9_found": lambda s, d: reading.clear_levels(table(s, d, "documents"), table(s, d, "doc_grades")),
    "p9_levels": lambda s, d: reading.reading_levels(table(s, d, "documents"), table(s, d, "doc_grades")),
}

_USABLE = """
  usable AS (
    SELECT DISTINCT example_id, translate(lower(trim(source)), '_ ', '--') AS source, length_bin FROM records
    WHERE example_id IS NOT NULL AND source IS NOT NULL AND length_bin IS NOT NULL
  ), have AS (SELECT source, length_bin, count(*) AS available FROM usable GROUP BY source, length_bin)
"""

# The drawn sample in steps: wanted numbers, the factor that the categories not exhausted share, prefix sums, crossings, and the repair of floors by rounds.
_MIX = f"""
WITH {_USABLE}, everything AS (SELECT count(DISTINCT example_id) AS n FROM usable),
plan AS (
  SELECT mix_name, source, length_bin, any_value(available) AS available, sum(wanted) AS wanted, max(min_rows) AS min_rows FROM (
    SELECT DISTINCT m.mix_name, translate(lower(trim(m.source)), '_ ', '--') AS source, m.length_bin, coalesce(h.available, 0)::BIGINT AS available,
      coalesce(m.target_share, 0)::DOUBLE * coalesce(m.sample_share, 0)::DOUBLE * everything.n AS wanted, coalesce(m.min_rows, 0)::BIGINT AS min_rows
    FROM everything, target_mix m LEFT JOIN have h ON h.source = translate(lower(trim(m.source)), '_ ', '--') AND h.length_bin = m.length_bin
  ) GROUP BY ALL
), ratios AS (SELECT *, wanted > 0 AND available > 0 AS inside, CASE WHEN wanted > 0 AND available > 0 THEN available / wanted END AS ratio, sum(wanted) OVER (PARTITION BY mix_name) AS size FROM plan),
factors AS (
  SELECT *, (size - coalesce(sum(available) OVER w, 0)) / (sum(wanted) OVER (PARTITION BY mix_name, inside) - coalesce(sum(wanted) OVER w, 0)) AS f
  FROM ratios WINDOW w AS (PARTITION BY mix_name, inside ORDER BY ratio, source, length_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (SELECT mix_name, arg_min(f, (ratio, source, length_bin)) AS factor FROM factors WHERE inside AND f <= ratio GROUP BY mix_name),
likely AS (SELECT f.*, CASE WHEN NOT inside THEN 0.0::DOUBLE WHEN factor IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, factor / ratio) END AS p FROM factors f LEFT JOIN chosen USING (mix_name)),
based AS (
  SELECT *, coalesce(sum(p * available) OVER (PARTITION BY mix_name ORDER BY source, length_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + ('0x' || substr(md5('13:' || mix_name), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS base FROM likely
), drawn AS (SELECT *, (floor(base + p * available + 1e-9) - floor(base + 1e-9))::BIGINT AS drawn, least(min_rows, available) AS lowest FROM based),
lacks AS (
  SELECT *, greatest(0, lowest - drawn) AS lack, greatest(0, drawn - greatest(lowest, floor(wanted)::BIGINT)) AS spare, greatest(0, drawn - lowest) AS surplus, sum(greatest(0, lowest - drawn)) OVER (PARTITION BY mix_name) AS need FROM drawn
), slots AS (
  SELECT mix_name, source, length_bin, need, row_number() OVER (PARTITION BY mix_name ORDER BY k > spare, k - CASE WHEN k > spare THEN spare ELSE 0 END, source, length_bin) AS turn
  FROM (SELECT *, unnest(generate_series(1, surplus)) AS k FROM lacks WHERE need > 0)
), given AS (SELECT mix_name, source, length_bin, count(*) AS given FROM slots WHERE turn <= need GROUP BY ALL),
final AS (SELECT l.*, l.drawn - coalesce(given, 0) AS keep FROM lacks l LEFT JOIN given USING (mix_name, source, length_bin)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY source, length_bin ORDER BY md5('13:' || example_id), example_id) AS r FROM usable),
placed AS (
  SELECT mix_name, example_id, source, length_bin, floor(base + p * r + 1e-9) > floor(base + p * (r - 1) + 1e-9) AS hit, floor(base + p * r + 1e-9) - floor(base + 1e-9) AS nth, r, keep, lack
  FROM ranks JOIN final USING (source, length_bin)
), sample AS (SELECT mix_name, example_id, source, length_bin FROM placed WHERE hit AND nth <= keep OR NOT hit AND r - nth <= lack)
"""

def encoded_sql(texts: str, path: str = bpe.DEFAULT) -> str:
    """CTEs for WITH RECURSIVE: parts (id, pieces) of a table of (id, text), and coded (piece, ids), by the ranks in the tokenizer's file.

    DuckDB's patterns look ahead of nothing: runs of white space are cut before their last character where something else
    follows, by a letter of private use.
    """
    split = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{bpe.SPACE}\p{{L}}\p{{N}}]+|[{bpe.SPACE}]+".replace("'", "''")
    return rf"""vocab AS MATERIALIZED (SELECT from_base64(t) AS b, r FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'INTEGER'}})),
merges AS MATERIALIZED (
  SELECT a.r AS l, c.r AS r, v.r AS m FROM (SELECT b, r, unnest(generate_series(1, octet_length(b) - 1)) AS k FROM vocab WHERE octet_length(b) > 1) v
  JOIN vocab a ON a.b = v.b[1:k] JOIN vocab c ON c.b = v.b[k + 1:]
), parts AS MATERIALIZED (
  SELECT id, flatten(list_transform(string_split(regexp_replace(text, '([{bpe.SPACE}]+)([{bpe.SPACE}][^{bpe.SPACE}])', '\1' || chr(63743) || '\2', 'g'), chr(63743)), lambda p: regexp_extract_all(p, '{split}'))) AS pieces FROM {texts}
), words AS MATERIALIZED (SELECT p AS piece, row_number() OVER () AS word FROM (SELECT DISTINCT unnest(pieces) AS p FROM parts)),
symbols AS (
  SELECT word, k AS pos, v.r AS tok FROM (SELECT word, encode(piece) AS b, unnest(generate_series(0, octet_length(encode(piece)) - 1)) AS k FROM words) s JOIN vocab v ON v.b = s.b[k + 1:k + 1]
), state(word, pos, tok, depth) AS (
    SELECT word, pos, tok, 0 FROM symbols
  UNION ALL
    SELECT word, pos, CASE WHEN pos = best & 1048575 THEN (best >> 20)::INTEGER ELSE tok END, depth + 1
    FROM (
      SELECT p.word, p.pos, p.tok, p.before, p.depth, min((m.m::BIGINT << 20) | p.pos) OVER (PARTITION BY p.word) AS best
      FROM (SELECT word, pos, tok, depth, lead(tok) OVER w AS behind, lag(pos) OVER w AS before FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)) p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.behind
    ) WHERE best IS NOT NULL AND before IS DISTINCT FROM best & 1048575
), ended AS (SELECT word, max(depth) AS depth FROM state GROUP BY word),
coded AS MATERIALIZED (SELECT piece, list(tok ORDER BY pos) AS ids FROM state JOIN ended USING (word, depth) JOIN words USING (word) GROUP BY piece)"""


def cut_sql() -> str:
    """CTEs up to found (output_id): the rules of truncation in a plain form, by windows over one row a token, without hashes, prefilters or shifted arrays."""
    t = truncation
    q = lambda x: x.replace("'", "''")
    L = q(t.LETTERS)
    closed, mark, bare = q(t.CLOSED), q(t.MARK), q(t.BARE)
    return rf"""
WITH texts AS MATERIALIZED (
  SELECT output_id, length(response) AS len, regexp_matches(response, '[\s\x0b]$') AS trails, bare, bare <> body AS marked, regexp_matches(bare, '{closed}') AS closed,
    regexp_matches(bare, '[.!?。！？।؟][\"”’'')]*([\s\x0b]|$)|[。।]') AS sentences, contains(bare, chr(10)) AS lines
  FROM (SELECT output_id, response, body, regexp_replace(body, '{mark}', '') AS bare FROM (
    SELECT DISTINCT output_id, response, regexp_replace(response, '[\s\x0b​ ]+$', '') AS body FROM eval_outputs WHERE response IS NOT NULL AND output_id IS NOT NULL) WHERE body <> '')
), toks AS (
  SELECT output_id, NOT sentences AND lines AS verse, list_transform(list_filter(string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(chr(10) || bare, '␝␞␟⊔⊓', ''),
      '\n[ \t]*(?:[-*•+]|\d+[.)])[ \t]+', ' ␝ ', 'g'), '\n|(?:…|\.\.\.)[.!?。！？।؟…]*', ' ␞ ', 'g'), '[0-9]+(?:[.,][0-9]+)+', ' 0 ', 'g'), '[.!?。！？।؟]+', ' ␟ ', 'g'), '[^{L}␝␞␟]+', ' ', 'g'), ' '), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE x END) AS t FROM texts
), rows AS (
  SELECT output_id, verse, k, lower(x) AS c, x AS written, CASE WHEN length(x) >= 4 AND regexp_matches(x, '^\p{{Lu}}') THEN '⊔' WHEN length(x) >= 4 THEN '⊓' ELSE lower(x) END AS h
  FROM (SELECT output_id, verse, unnest(t) AS x, unnest(generate_series(1, len(t))) AS k FROM toks)
), beside AS (
  SELECT *, coalesce(lag(c, 1) OVER w, '') AS p1, coalesce(lag(c, 2) OVER w, '') AS p2, coalesce(lag(c, 3) OVER w, '') AS p3, coalesce(lag(c, 4) OVER w, '') AS p4, coalesce(lag(c, 5) OVER w, '') AS p5, lead(c) OVER w AS nx,
    coalesce(lag(h, 1) OVER w, '') AS g1, coalesce(lag(h, 2) OVER w, '') AS g2 FROM rows WINDOW w AS (PARTITION BY output_id ORDER BY k)
), words AS MATERIALIZED (
  SELECT output_id, nx IS NULL AS last, c AS word, written, CASE WHEN nx IS NULL OR nx IN ('␝', '␞') THEN 2 WHEN nx = '␟' THEN 1 ELSE 0 END AS follows, p1 = '␞' AND p2 NOT IN ('␞', '␟') AS first_of_line,
    translate(CASE WHEN p1 IN ('␝', '␞', '␟') THEN '' ELSE p2 END || ' ' || p1 || ' ', '␟', '␞') AS ahead, translate(p3 || ' ' || p2 || ' ' || p1, '␟', '␞') AS before,
    translate(CASE WHEN '␝' IN (p1, p2, p3, p4, p5) THEN 'L' WHEN verse THEN 'V' ELSE 'P' END || ' ' || CASE WHEN p1 IN ('␝', '␞', '␟') THEN '' ELSE g2 END || ' ' || g1 || ' ' || h, '␟', '␞') AS mould
  FROM beside WHERE c NOT IN ('␝', '␞', '␟')
), t3 AS (SELECT ahead, word, count(*) AS n, count(*) FILTER (follows = 2) AS o, count(*) FILTER (follows > 0) AS e FROM words GROUP BY ALL),
b3 AS (SELECT before, count(*) AS n, count(*) FILTER (follows = 2) AS o, count(*) FILTER (follows > 0) AS e FROM words GROUP BY ALL),
m3 AS (SELECT mould, count(*) AS n, count(*) FILTER (follows > 0) AS e FROM words GROUP BY ALL),
w1 AS (SELECT word, count(*) FILTER (follows = 2) AS o, count(*) FILTER (NOT (last AND follows = 2)) AS inside FROM words GROUP BY ALL),
limits AS (SELECT len, count(*) >= {t.LIMIT_TEXTS} AND count(*) FILTER (NOT closed) >= {t.LIMIT_SHARE} * count(*) AS limited FROM texts WHERE sentences GROUP BY len),
ends AS (
  SELECT x.*, w.word, w.ahead, w.before, w.mould, w.first_of_line, w.written, coalesce(l.limited, false) AS limited FROM (
    SELECT *, regexp_matches(bare, '^\s*[\[{{]') AS json, string_split(bare, chr(10))[-1] AS last_line,
      length(replace(bare, '{{', '')) <> length(replace(bare, '}}', '')) OR length(replace(bare, '[', '')) <> length(replace(bare, ']', '')) OR (length(bare) - length(replace(replace(bare, '\\"', '\\'), '"', ''))) % 2 = 1 AS unbalanced,
      (length(bare) - length(replace(bare, '```', ''))) // 3 AS fences,
      regexp_matches(bare, '[)*_`]$') AND length(replace(bare, '(', '')) = length(replace(bare, ')', '')) AND ((length(bare) - length(replace(bare, '**', ''))) // 2) % 2 = 0 AS shut,
      regexp_matches(bare, '(^|\n)#+[ \t]*[-+]?[0-9][0-9,.]*$') AS counted FROM texts WHERE NOT closed
  ) x LEFT JOIN (SELECT * FROM words WHERE last) w USING (output_id) LEFT JOIN limits l USING (len) WHERE NOT (shut AND fences % 2 = 0) AND NOT counted
), longer AS (
  SELECT DISTINCT e.ahead, e.word FROM ends e JOIN t3 own ON own.ahead = e.ahead AND own.word = e.word JOIN t3 c ON c.ahead = e.ahead AND length(c.word) > length(e.word) AND starts_with(c.word, e.word) AND c.n > own.n
), facts AS (
  SELECT e.*, coalesce(t.n, 1) - 1 AS tn, (coalesce(t.o, 1) - 1) / nullif(coalesce(t.n, 1) - 1, 0) AS t_open, (coalesce(t.e, 1) - 1) / nullif(coalesce(t.n, 1) - 1, 0) AS t_any,
    coalesce(b.n, 1) - 1 AS bn, (coalesce(b.o, 1) - 1) / nullif(coalesce(b.n, 1) - 1, 0) AS b_open, (coalesce(b.e, 1) - 1) / nullif(coalesce(b.n, 1) - 1, 0) AS b_any,
    coalesce(m.n, 1) - 1 AS mn, (coalesce(m.e, 1) - 1) / nullif(coalesce(m.n, 1) - 1, 0) AS m_any, (coalesce(w.inside, 0) > 0 OR e.word = '0') AND p.word IS NULL AS known, coalesce(w.o, 0) AS w_open,
    regexp_matches(last_line, '{bare}') AS single, regexp_matches(last_line, '^\s*([-*•+]|[0-9]+[.)])(\s|$)') AS listed
  FROM ends e LEFT JOIN t3 t ON t.ahead = e.ahead AND t.word = e.word LEFT JOIN b3 b ON b.before = e.before LEFT JOIN m3 m ON m.mould = e.mould LEFT JOIN w1 w ON w.word = e.word LEFT JOIN longer p ON p.ahead = e.ahead AND p.word = e.word
), found AS (SELECT DISTINCT output_id FROM facts WHERE CASE
  WHEN json THEN unbalanced WHEN fences > 0 THEN fences % 2 = 1 WHEN word IS NULL THEN false
  WHEN single THEN NOT known AND NOT shut AND regexp_matches(word, '^[A-Za-z]{{2,}}$') AND NOT first_of_line
  WHEN starts_with(word, '#') THEN w_open < 3
  WHEN listed OR NOT sentences AND lines THEN NOT known OR CASE WHEN mn >= 3 THEN m_any < 0.2 WHEN tn >= 5 THEN t_any < 0.2 ELSE false END
  WHEN NOT sentences AND NOT marked AND known AND length(bare) - length(replace(bare, ' ', '')) <= 2 AND regexp_matches(written, '^\p{{Lu}}') THEN false
  WHEN NOT known THEN NOT coalesce(bn >= 2 AND (b_open >= 0.5 OR b_open >= 0.02 AND b_any >= 0.9) AND (tn >= 5 OR regexp_matches(written, '^\p{{Lu}}') AND first_of_line), false)
  WHEN bn >= 2 AND (b_open >= 0.5 OR b_open >= 0.02 AND b_any >= 0.9) THEN false
  WHEN tn >= 1 THEN t_open < 0.5 AND (coalesce(t_any, 0) < 0.3 OR bn < 2 OR b_any < 0.4 OR marked OR trails OR limited)
  WHEN bn >= 1 THEN b_open < 0.5 ELSE mn < 50 OR m_any < 0.6 END)"""


_NAME = "translate(lower(trim({0})), '_ ', '--')"
_RECORD_TEXTS = """(
  SELECT row_number() OVER () AS n, example_id, token_count, source, lang, CASE WHEN messages IS NOT NULL THEN list_transform(messages, lambda m: coalesce(m.content, '')) ELSE [coalesce(text, '')] END AS texts FROM records
)"""
_COUNTED = """placed AS (SELECT id, unnest(pieces) AS piece FROM parts), counted AS (SELECT id, sum(len(ids))::BIGINT AS n_tokens FROM placed JOIN coded USING (piece) GROUP BY id)"""

# All pairs of bags of words, those that differ in at most a fifth, and what is reached from each record over any number of steps.
_SIMILAR = r"""
WITH RECURSIVE texts AS (
  SELECT DISTINCT example_id, lower(coalesce(text, array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), chr(10)))) AS text FROM records WHERE example_id IS NOT NULL
), bags AS MATERIALIZED (
  SELECT row_number() OVER () AS n, example_id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN regexp_extract_all(text, '[\p{L}\p{N}]+') ELSE list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') END AS words FROM texts WHERE text IS NOT NULL
), rows AS MATERIALIZED (SELECT n, w, row_number() OVER (PARTITION BY n, w) AS k FROM (SELECT n, unnest(words) AS w FROM bags)),
shared AS (SELECT a.n AS a, b.n AS b, count(*) AS c FROM rows a JOIN rows b ON a.w = b.w AND a.k = b.k AND a.n < b.n GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT x.example_id AS a, y.example_id AS b FROM shared s JOIN bags x ON x.n = s.a JOIN bags y ON y.n = s.b
  WHERE greatest(len(x.words), len(y.words)) - c <= 0.2::DOUBLE * greatest(len(x.words), len(y.words)) AND x.example_id <> y.example_id
), both_ways AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reached(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reached r JOIN both_ways w ON w.a = r.b),
least AS (SELECT b AS example_id, least(min(a), b) AS head FROM reached GROUP BY b)
SELECT head AS example_id_a, example_id AS example_id_b FROM least WHERE head <> example_id"""

ORACLES: dict[str, str] = {
    "p3_found": f"{cut_sql()} SELECT output_id FROM found",
    "p3_shares": f"""{cut_sql()} SELECT adapter, benchmark, count(*) AS responses, count(f.output_id) AS cut, round(count(f.output_id) / count(*), 9) AS share
FROM (SELECT DISTINCT output_id, adapter, benchmark FROM eval_outputs WHERE output_id IS NOT NULL AND response IS NOT NULL AND trim(response) <> '') r LEFT JOIN found f USING (output_id) GROUP BY adapter, benchmark""",
    "p6_found": _SIMILAR,
    "p7_ids": f"""WITH RECURSIVE {encoded_sql("(SELECT doc_id AS id, text FROM documents WHERE text <> '')")},
placed AS (SELECT id, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS k FROM parts)
SELECT d.doc_id, coalesce(ids, []::INTEGER[]) AS ids FROM documents d LEFT JOIN (SELECT id, flatten(list(ids ORDER BY k)) AS ids FROM placed JOIN coded USING (piece) GROUP BY id) e ON e.id = d.doc_id""",
    "p2_found": f"""WITH RECURSIVE r AS MATERIALIZED {_RECORD_TEXTS}, {encoded_sql("(SELECT n AS id, unnest(texts) AS text FROM r)")}, {_COUNTED}
SELECT DISTINCT example_id FROM r LEFT JOIN counted ON id = n
WHERE example_id IS NOT NULL AND (token_count IS NULL OR token_count <= 0 OR token_count < coalesce(n_tokens, 0) / 2.0::DOUBLE OR token_count > coalesce(n_tokens, 0) * 2.0::DOUBLE)""",
    "p2_budget": f"""WITH RECURSIVE r AS MATERIALIZED (
  SELECT n, 'records' AS corpus, {_NAME.format('source')} AS name, lower(trim(lang)) AS lang, texts FROM {_RECORD_TEXTS}
  UNION ALL SELECT -row_number() OVER (), 'documents', {_NAME.format('source')}, lower(trim(lang)), [coalesce(text, '')] FROM documents
), {encoded_sql("(SELECT n AS id, unnest(texts) AS text FROM r)")}, {_COUNTED},
totals AS (SELECT corpus, name, lang, count(*) AS texts, sum(coalesce(n_tokens, 0))::BIGINT AS tokens FROM r LEFT JOIN counted ON id = n GROUP BY ALL),
known AS (SELECT DISTINCT {_NAME.format('source')} AS known FROM source_info WHERE source IS NOT NULL),
near AS (
  SELECT name, arg_min(known, (levenshtein(name, known), known)) AS known FROM (SELECT DISTINCT name FROM totals WHERE name IS NOT NULL AND name NOT IN (SELECT known FROM known)), known
  WHERE (left(name, 4) = left(known, 4) OR right(name, 4) = right(known, 4)) AND abs(length(name) - length(known)) <= 1 AND levenshtein(name, known) <= 2 GROUP BY name
), info AS (SELECT {_NAME.format('source')} AS source, any_value(domain_name) AS domain, any_value(lower(default_lang)) AS default_lang FROM source_info WHERE source IS NOT NULL GROUP BY 1),
fixed AS (SELECT t.*, coalesce(near.known, t.name) AS source FROM totals t LEFT JOIN near USING (name))
SELECT corpus, coalesce(f.source, 'unknown') AS source, coalesce(lang, default_lang, 'unknown') AS lang, coalesce(domain, 'unknown') AS domain, sum(texts)::BIGINT AS texts, sum(tokens)::BIGINT AS tokens
FROM fixed f LEFT JOIN info i ON i.source = f.source GROUP BY 1, 2, 3, 4""",
    "p4_sample": f"{_MIX} SELECT * FROM sample",
    "p4_report": f"""{_MIX}, counted AS (SELECT mix_name, source, length_bin, count(*) AS selected FROM sample GROUP BY ALL)
SELECT mix_name, source, length_bin, available, round(wanted, 9) AS wanted, min_rows, drawn, coalesce(selected, 0) AS selected,
  CASE WHEN coalesce(selected, 0) < min_rows OR available < wanted THEN round(greatest(wanted, min_rows) - coalesce(selected, 0), 9) ELSE 0.0::DOUBLE END AS short
FROM final LEFT JOIN counted USING (mix_name, source, length_bin)""",
    "p4_found": f"""
WITH {_USABLE}
SELECT DISTINCT m.mix_name, translate(lower(trim(m.source)), '_ ', '--') AS source, m.length_bin
FROM target_mix m LEFT JOIN have h ON h.source = translate(lower(trim(m.source)), '_ ', '--') AND h.length_bin = m.length_bin
WHERE coalesce(h.available, 0) < coalesce(m.min_rows, 0)
   OR coalesce(h.available, 0) < coalesce(m.target_share, 0) * coalesce(m.sample_share, 0) * (SELECT count(DISTINCT example_id) FROM usable)
""",
}
