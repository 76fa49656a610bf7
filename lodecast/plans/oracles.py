"""The SQL, for DuckDB, of the queries that SQL expresses."""

from __future__ import annotations

# White space and word characters as in lodecast.functions.text, in RE2's spelling.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}]"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _run(text: str, n: int) -> str:
    return f"coalesce(list_bool_or(list_transform(generate_series(1, length({text}) - {n - 1}), lambda i: substr({text}, i, 1) <> chr(10) AND substr({text}, i, {n}) = repeat(substr({text}, i, 1), {n}))), false)"


STOP = "('a','an','and','are','for','from','how','in','is','of','please','the','to','what','why','with')"
DOCS = f"docs AS (SELECT doc_id, coalesce(source, 'unknown') AS source, lang, text, {_count('text', TOKEN)}::BIGINT AS token_count FROM documents WHERE text IS NOT NULL)"
CAPPED = f"{DOCS}, capped AS (SELECT source, doc_id, token_count FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY substr(sha256('0:' || doc_id), 1, 16), doc_id) AS n FROM docs WHERE token_count > 0) WHERE n <= 100)"
QUOTAS = """totals AS (SELECT source, sum(token_count)::HUGEINT AS t FROM docs GROUP BY source), shares AS (SELECT source, (100000 * t) // (SELECT sum(t) FROM totals)::HUGEINT AS f, (100000 * t) % (SELECT sum(t) FROM totals)::HUGEINT AS r FROM totals),
quotas AS (SELECT source, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, source) <= 100000 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM shares)"""
OUT = "first AS (SELECT DISTINCT ON (output_id) adapter, strategy, seed, benchmark, subset, example_id, score FROM eval_outputs WHERE example_id IS NOT NULL ORDER BY output_id)"
ROWS = f"""{OUT}, long AS (
  SELECT adapter, strategy, seed, benchmark, subset, example_id, unnest([
    {{'metric': 'prompt_strict', 'value': score.prompt_level_strict::INT::DOUBLE}}, {{'metric': 'instruction_strict', 'value': list_avg(list_transform(score.instruction_level_strict, lambda x: coalesce(x::INT::DOUBLE, 0.0::DOUBLE)))}},
    {{'metric': 'prompt_loose', 'value': score.prompt_level_loose::INT::DOUBLE}}, {{'metric': 'instruction_loose', 'value': list_avg(list_transform(score.instruction_level_loose, lambda x: coalesce(x::INT::DOUBLE, 0.0::DOUBLE)))}},
    {{'metric': 'gsm8k', 'value': score.exact_match::INT::DOUBLE}}, {{'metric': 'bbh', 'value': score.normalized_accuracy::INT::DOUBLE}}]) AS p
  FROM first WHERE score IS NOT NULL
), metric_rows AS (SELECT adapter, strategy, seed, benchmark, subset, example_id, p.metric AS metric, p.value AS value FROM long WHERE p.value IS NOT NULL)"""
SEEDS = f"""{ROWS}, seeds AS (
  SELECT adapter, strategy, seed, metric, avg(value) AS value FROM metric_rows WHERE metric NOT LIKE 'instruction%' GROUP BY ALL
  UNION ALL SELECT adapter, strategy, seed, 'instruction_strict', sum(len(list_filter(score.instruction_level_strict, lambda x: x))) / sum(len(score.instruction_level_strict)) FROM first WHERE len(score.instruction_level_strict) > 0 GROUP BY ALL
  UNION ALL SELECT adapter, strategy, seed, 'instruction_loose', sum(len(list_filter(score.instruction_level_loose, lambda x: x))) / sum(len(score.instruction_level_loose)) FROM first WHERE len(score.instruction_level_loose) > 0 GROUP BY ALL)"""
PAIRED = f"""{ROWS}, means AS (SELECT metric, example_id, seed, avg(value) FILTER (strategy = 'random') AS b, avg(value) FILTER (strategy = 'diversity') AS t FROM metric_rows WHERE strategy IN ('random', 'diversity') GROUP BY ALL),
both_arms AS (SELECT * FROM means WHERE b IS NOT NULL AND t IS NOT NULL), k AS (SELECT metric, count(DISTINCT seed) AS k FROM both_arms GROUP BY metric),
paired AS (SELECT metric, example_id, avg(t - b) AS difference FROM both_arms JOIN k USING (metric) GROUP BY metric, example_id, k HAVING count(*) = k)"""
JUDGED = """rows AS (SELECT DISTINCT ON (audit_id) * FROM judge_results), judged AS (
  SELECT example_id, e.key AS dimension, e.value AS a, pass_b.scores[e.key] AS b FROM (SELECT *, unnest(map_entries(pass_a.scores)) AS e FROM rows WHERE pass_a.parse_ok AND pass_b.parse_ok)
), ok AS (SELECT * FROM judged WHERE a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5)"""
CANON = f"""canon AS (
  SELECT coalesce(source, 'unknown') AS source, source_row, list_transform(messages, lambda m: {{'role': lower(trim(m.role)), 'content': trim(regexp_replace(m.content, '{SPACE}+', ' ', 'g'))}}) AS ms FROM records WHERE messages IS NOT NULL
), kept AS (
  SELECT *, list_aggregate(list_transform(ms, lambda m: m.content), 'string_agg', ' ') AS spaced, list_sum(list_transform(ms, lambda m: {_count('m.content', TOKEN)}))::BIGINT AS tokens FROM canon
  WHERE len(ms) > 0 AND list_bool_and(list_transform(ms, lambda m: coalesce(m.role IN ('system', 'user', 'assistant') AND m.content <> '', false))) AND list_bool_or(list_transform(ms, lambda m: m.role = 'user')) AND list_bool_or(list_transform(ms, lambda m: m.role = 'assistant'))
), valid AS (
  SELECT source, source_row, tokens, ms FROM kept WHERE tokens > 0 AND tokens <= 2048 AND {_count('spaced', '[A-Za-z]+')} >= 4 AND {_count('spaced', '[A-Za-z]')} >= 20
    AND {_count('spaced', '[A-Za-z]')} / greatest(1, {_count('spaced', '[^' + SPACE[1:])}) >= 0.25 AND NOT contains(spaced, chr(0)) AND NOT {_run('spaced', 13)}
)"""

ORACLES: dict[str, str] = {
    "pool_strata": f"""WITH {CANON}, named AS (SELECT *, source || '|' || CASE WHEN tokens < 256 THEN '0-255' WHEN tokens < 512 THEN '256-511' WHEN tokens < 1024 THEN '512-1023' WHEN tokens < 1536 THEN '1024-1535' ELSE '1536-2048' END AS stratum FROM valid),
first AS (SELECT arg_min({{'stratum': stratum, 'tokens': tokens}}, (source, source_row)) AS b FROM named GROUP BY to_json(ms)::VARCHAR)
SELECT b.stratum AS stratum, count(*) AS n_rows, sum(b.tokens)::BIGINT AS n_tokens FROM first GROUP BY 1""",
    "doc_quality": f"""WITH {DOCS}, parts AS (SELECT doc_id, text, token_count, regexp_extract_all(lower(text), '[A-Za-z]+') AS w FROM docs)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE round(
  0.25::DOUBLE * (0.5::DOUBLE * least(1.0::DOUBLE, len(list_filter(w, lambda x: x IN {STOP})) / 4.0::DOUBLE) + 0.5::DOUBLE * least(1.0::DOUBLE, {_count('text', '[A-Za-z]')}::DOUBLE / greatest(1, {_count('text', '[^' + SPACE[1:])})))
  + 0.25::DOUBLE * least(1.0::DOUBLE, {_count('text', r'[\p{L}\p{N}_]+')} / 80.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN token_count BETWEEN 32 AND 1536 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
  + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - coalesce(list_sum(list_transform(list_filter(map_values(histogram_of), lambda c: c > 3), lambda c: c - 1)), 0)::DOUBLE / greatest(1, len(w)))
  + 0.1::DOUBLE * CASE WHEN contains(text, chr(0)) OR {_run('text', 10)} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 6) END AS quality_score
FROM (SELECT *, list_histogram(w) AS histogram_of FROM parts)""",
    "dedup_first": f"WITH {DOCS} SELECT sha256(text) AS h, (arg_min({{'s': source, 'd': doc_id}}, (source, doc_id))).s AS source, (arg_min({{'s': source, 'd': doc_id}}, (source, doc_id))).d AS doc_id FROM docs GROUP BY 1",
    "capped_pool": f"WITH {CAPPED} SELECT source, doc_id, token_count FROM capped",
    "token_quotas": f"WITH {DOCS}, {QUOTAS} SELECT source, quota FROM quotas",
    "order_random": "WITH r AS (SELECT example_id, min(source) AS source FROM records WHERE example_id IS NOT NULL AND source IS NOT NULL GROUP BY 1) SELECT example_id, source, row_number() OVER (PARTITION BY source ORDER BY substr(sha256('13:' || example_id), 1, 16), example_id)::INT AS position FROM r",
    "order_quality": "WITH r AS (SELECT example_id, min(source) AS source, max(quality_score) AS q FROM records WHERE example_id IS NOT NULL AND source IS NOT NULL GROUP BY 1) SELECT example_id, source, row_number() OVER (PARTITION BY source ORDER BY q DESC, substr(sha256(example_id), 1, 16), example_id)::INT AS position FROM r WHERE q >= 0.55",
    "order_diversity": """WITH r AS (SELECT vec_id, label, ((vec_id % 7 + 7) % 7) / 7.0::DOUBLE AS score FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, substr(sha256('13:' || vec_id), 1, 16), vec_id) AS cluster_rank FROM r)
SELECT vec_id, label, cluster_rank::INT AS cluster_rank, row_number() OVER (ORDER BY cluster_rank, label)::INT AS position FROM k""",
    "greedy_take": f"""WITH RECURSIVE {CAPPED}, {QUOTAS}, ordered AS (SELECT c.source, doc_id, token_count, quota, row_number() OVER (PARTITION BY c.source ORDER BY substr(sha256('13:' || doc_id), 1, 16), doc_id) AS p FROM capped c JOIN quotas USING (source)),
pass1 AS (
  SELECT source, 0::BIGINT AS p, 0::BIGINT AS total, NULL::BIGINT AS doc_id, false AS took FROM quotas
  UNION ALL SELECT o.source, o.p, CASE WHEN s.total + o.token_count <= o.quota THEN s.total + o.token_count ELSE s.total END, o.doc_id, s.total + o.token_count <= o.quota FROM pass1 s JOIN ordered o ON o.source = s.source AND o.p = s.p + 1
), ended AS (SELECT source, max(total) AS total FROM pass1 GROUP BY source),
rest AS (SELECT o.source, o.doc_id, o.quota, e.total + sum(o.token_count) OVER (PARTITION BY o.source ORDER BY o.token_count, substr(sha256(o.doc_id::VARCHAR), 1, 16), o.doc_id) AS reached FROM ordered o JOIN ended e USING (source) JOIN pass1 s ON s.source = o.source AND s.p = o.p WHERE NOT s.took)
SELECT source, doc_id FROM pass1 WHERE took UNION ALL SELECT source, doc_id FROM rest WHERE reached <= quota""",
    "exact_overlap": f"""WITH t AS (SELECT example_id AS train_id, trim(regexp_replace(lower(any_value(array_to_string(list_transform(list_filter(messages, lambda m: lower(trim(m.role)) = 'user'), lambda m: coalesce(m.content, '')), chr(10)))), '{SPACE}+', ' ', 'g')) AS norm FROM records WHERE messages IS NOT NULL GROUP BY 1),
e AS (SELECT trim(regexp_replace(lower(prompt), '{SPACE}+', ' ', 'g')) AS norm, max(benchmark || '/' || example_id) AS eval_id FROM eval_items GROUP BY 1) SELECT train_id, eval_id FROM t JOIN e USING (norm) WHERE norm <> ''""",
    "candidate_votes": f"""WITH n AS (SELECT benchmark || '/' || example_id AS i, trim(regexp_replace(lower(prompt), '{SPACE}+', ' ', 'g')) AS norm FROM eval_items), s AS (SELECT i, length(norm) AS l, list_distinct(list_transform(generate_series(1, greatest(length(norm) - 4, 1)), lambda k: substr(norm, k, 5))) AS s FROM n WHERE norm <> ''),
x AS (SELECT i, l, len(s) AS c, unnest(s) AS g FROM s), v AS (SELECT a.i AS train_id, b.i AS eval_id, a.c AS ca, b.c AS cb, count(*) AS votes FROM x a JOIN x b ON a.g = b.g AND a.i <> b.i AND greatest(a.l, b.l) <= 1.5 * greatest(1, least(a.l, b.l)) GROUP BY ALL)
SELECT train_id, eval_id, votes, round(votes::DOUBLE / (ca + cb - votes), 9) AS jaccard FROM v WHERE votes::DOUBLE / (ca + cb - votes) >= 0.35""",
    "length_buckets": "SELECT benchmark, example_id, length(prompt)::INT AS n, least(3, (row_number() OVER (PARTITION BY benchmark ORDER BY length(prompt), example_id) - 1) * 4 // count(*) OVER (PARTITION BY benchmark))::INT AS bucket FROM eval_items",
    "waterfill_counts": f"""WITH {DOCS}, c AS (SELECT lang, count(*) AS n FROM docs WHERE lang IS NOT NULL GROUP BY lang), slots AS (SELECT lang, unnest(generate_series(1, n)) AS k FROM c), dealt AS (SELECT lang, row_number() OVER (ORDER BY k, lang) AS r FROM slots)
SELECT lang, count(r)::BIGINT AS taken FROM c LEFT JOIN (SELECT * FROM dealt WHERE r <= 200) USING (lang) GROUP BY lang""",
    "sample_groups": f"""WITH {DOCS}, c AS (SELECT lang, count(*) AS n FROM docs WHERE lang IS NOT NULL GROUP BY lang), slots AS (SELECT lang, unnest(generate_series(1, n)) AS k FROM c), dealt AS (SELECT lang, row_number() OVER (ORDER BY k, lang) AS r FROM slots),
taken AS (SELECT lang, count(*) AS t FROM dealt WHERE r <= 200 GROUP BY lang), o AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('2026:' || doc_id), 1, 16), doc_id) AS p FROM docs WHERE lang IS NOT NULL) SELECT lang, doc_id FROM o JOIN taken USING (lang) WHERE p <= t""",
    "equal_per_group": f"WITH {DOCS} SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY substr(sha256('2126:' || doc_id), 1, 16), doc_id) AS n FROM docs) WHERE n <= 8",
    "quality_tertiles": """WITH q AS (SELECT quality_score AS v, row_number() OVER (ORDER BY quality_score) - 1 AS i, count(*) OVER () AS n FROM records WHERE quality_score IS NOT NULL), c AS (SELECT min(v) FILTER (i = n // 3) AS c1, min(v) FILTER (i = 2 * n // 3) AS c2 FROM q)
SELECT CASE WHEN v <= c1 THEN 'low' WHEN v <= c2 THEN 'mid' ELSE 'high' END AS tertile, count(*) AS n, min(v) AS lo, max(v) AS hi FROM q, c GROUP BY 1""",
    "score_unpivot": f"WITH {ROWS} SELECT adapter, example_id, benchmark, metric, round(value, 9) AS value FROM metric_rows",
    "metrics_seed": f"WITH {SEEDS} SELECT adapter, strategy, seed, metric, round(value, 9) AS value FROM seeds",
    "metrics_strategy": f"WITH {SEEDS} SELECT strategy, metric, count(*) AS n_runs, round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 9) AS sd FROM seeds GROUP BY strategy, metric",
    "group_macro_worst": f"WITH {ROWS}, t AS (SELECT adapter, subset, avg(value) AS m FROM metric_rows WHERE metric = 'bbh' GROUP BY ALL) SELECT adapter, round(avg(m), 9) AS macro, round(min(m), 9) AS worst, count(*) AS tasks FROM t GROUP BY adapter",
    "paired_diff": f"WITH {PAIRED} SELECT metric, example_id, round(difference, 9) AS difference FROM paired",
    "paired_bootstrap": f"""WITH {PAIRED}, items AS (SELECT metric, difference, row_number() OVER (PARTITION BY metric ORDER BY example_id) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM paired), sizes AS (SELECT metric, any_value(n) AS n, avg(difference) AS mean FROM items GROUP BY metric),
draws AS (SELECT metric, n, rep, unnest(generate_series(0, n - 1)) AS k FROM sizes, range(1000) r(rep)), m AS (SELECT d.metric, d.rep, avg(difference) AS m FROM draws d JOIN items i ON i.metric = d.metric AND i.i = ('0x' || substr(md5(d.rep || ':' || d.k), 1, 8))::BIGINT % d.n GROUP BY ALL)
SELECT metric, any_value(n) AS n, round(any_value(mean), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m JOIN sizes USING (metric) GROUP BY metric""",
    "bootstrap_contrasts": "",
    "sign_counts": f"""WITH {ROWS}, a AS (SELECT metric, subset, seed, avg(value) FILTER (strategy = 'random') AS b, avg(value) FILTER (strategy = 'diversity') AS t FROM metric_rows WHERE strategy IN ('random', 'diversity') GROUP BY ALL)
SELECT metric, count(*) FILTER (t - b >= 1e-12) AS higher, count(*) FILTER (abs(t - b) < 1e-12) AS equal, count(*) FILTER (b - t >= 1e-12) AS lower FROM a WHERE b IS NOT NULL AND t IS NOT NULL GROUP BY metric""",
    "overlap_matrix": """WITH m AS (SELECT DISTINCT adapter, example_id FROM eval_outputs WHERE adapter IS NOT NULL AND example_id IS NOT NULL), n AS (SELECT DISTINCT adapter FROM eval_outputs WHERE adapter IS NOT NULL), p AS (SELECT x.adapter AS a, y.adapter AS b, count(*) AS c FROM m x JOIN m y USING (example_id) GROUP BY ALL)
SELECT n.adapter AS a, o.adapter AS b, coalesce(c, 0)::BIGINT AS shared FROM n CROSS JOIN n o LEFT JOIN p ON p.a = n.adapter AND p.b = o.adapter""",
    "agreement": f"WITH {JUDGED} SELECT dimension, count(*) AS n, round(avg((a = b)::INT), 9) AS exact, round(avg(abs(a - b)), 9) AS mean_difference, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg((a = 5)::INT), 9) AS share_at_most, round(avg(((a = 5)::INT + (b = 5)::INT) / 2), 9) AS share_at_most_both, array_to_string(list_sort(list_distinct(list_concat(list(a), list(b)))), ',') AS distinct_scores FROM ok GROUP BY dimension",
    "parse_states": "WITH rows AS (SELECT DISTINCT ON (audit_id) * FROM judge_results) SELECT CASE WHEN pass_a IS NULL THEN 'missing' WHEN coalesce(pass_a.parse_ok, false) THEN 'ok' ELSE 'failed' END AS state_a, CASE WHEN pass_b IS NULL THEN 'missing' WHEN coalesce(pass_b.parse_ok, false) THEN 'ok' ELSE 'failed' END AS state_b, count(*) AS n FROM rows GROUP BY 1, 2",
    "spearman": f"""WITH {JUDGED}, r AS (SELECT dimension, rank() OVER (PARTITION BY dimension ORDER BY a) + (count(*) OVER (PARTITION BY dimension, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY dimension ORDER BY b) + (count(*) OVER (PARTITION BY dimension, b) - 1) / 2.0::DOUBLE AS rb FROM ok)
SELECT dimension, count(*) AS n, CASE WHEN count(*) >= 2 AND count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1 THEN round(corr(ra, rb), 9) END AS rho FROM r GROUP BY dimension""",
    "stream_dedup": "SELECT DISTINCT user_id FROM events",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "selection_summary": "",
}
_CONTRAST = ORACLES["paired_bootstrap"].replace("range(1000)", "range(10000)")
ORACLES["bootstrap_contrasts"] = "\nUNION ALL\n".join(f"SELECT *, '{t}' AS treatment FROM ({_CONTRAST.replace(chr(39) + 'diversity' + chr(39), chr(39) + t + chr(39))})" for t in ("quality", "diversity"))
ORACLES["selection_summary"] = ORACLES["greedy_take"].replace("SELECT source, doc_id FROM pass1 WHERE took UNION ALL SELECT source, doc_id FROM rest WHERE reached <= quota", "SELECT source, count(*) AS n_rows, sum(token_count)::BIGINT AS n_tokens FROM (SELECT source, doc_id FROM pass1 WHERE took UNION ALL SELECT source, doc_id FROM rest WHERE reached <= quota) JOIN docs USING (source, doc_id) GROUP BY source")

# White space at either end is taken off, as Python does.
def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{SPACE}+', ' ', 'g'))"


_SOLID = "[^" + SPACE[1:]
_WORDS = r"[\p{L}\p{N}_]+"
NUMBER = r"[-+]?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"


def _last(text: str, pattern: str, group: int = 0) -> str:
    return f"list_last(regexp_extract_all({text}, '{pattern}', {group}))"


def _number(text: str) -> str:
    return f"replace(coalesce({_last(text, '####' + SPACE + '*(' + NUMBER + ')', 1)}, {_last(text, NUMBER)}), ',', '')"


SCORED = "scored AS (SELECT DISTINCT output_id, benchmark, response, target FROM eval_outputs WHERE response IS NOT NULL AND target IS NOT NULL)"
ORACLES["extract_number"] = f"WITH {SCORED} SELECT output_id, {_number('response')} AS answer, coalesce({_number('response')} = {_number('target')}, false) AS correct FROM scored WHERE benchmark = 'gsm8k'"
_MARKS = "' .,:;!?' || chr(10)"
_LINES = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ORACLES["extract_option"] = f"""WITH {SCORED}, t AS (SELECT output_id, response, target AS given, {_strip('target')} AS target FROM scored WHERE benchmark = 'bbh'),
parts AS (
  SELECT *, trim({_norm('target')}, {_MARKS}) AS wording, {_norm('response')} AS said, {_last('response', '[(][A-Z][)]')} AS option,
    '(' || upper({_last('response', '(?i)(?:answer|choice|option|final)' + SPACE + '*(?:is|:)?' + SPACE + '*[(]?([A-Z])[)]?', 1)}) || ')' AS worded,
    {_last('response', '(?i)' + chr(92) + 'b(?:true|false)' + chr(92) + 'b')} AS truth,
    list_last(list_filter(list_transform(regexp_split_to_array(response, '{_LINES}'), lambda x: {_strip('x')}), lambda x: x <> '')) AS tail
  FROM t
), answers AS (
  SELECT output_id, given, CASE WHEN regexp_full_match(target, '[(][A-Z][)]') THEN coalesce(option, worded) WHEN target IN ('True', 'False') THEN upper(truth[1]) || lower(truth[2:])
    WHEN wording <> '' AND contains(said, wording) THEN target ELSE trim(tail, ' .') END AS answer FROM parts
) SELECT output_id, answer, coalesce(trim({_norm('answer')}, {_MARKS}) = trim({_norm('given')}, {_MARKS}), false) AS correct FROM answers"""
ORACLES["evaluation_prompts"] = """SELECT benchmark, example_id, prompt || CASE benchmark WHEN 'gsm8k' THEN chr(10) || chr(10) || 'Solve the problem. End your final numeric answer with #### followed by the number.'
WHEN 'bbh' THEN chr(10) || chr(10) || 'Return only the final answer. Do not add an explanation.' ELSE '' END AS asked FROM eval_items"""
ORACLES["benchmark_snapshot"] = """SELECT printf('%s-%s-test-%04d', benchmark, config, row_number() OVER (PARTITION BY benchmark, config ORDER BY example_id) - 1) AS example_id, example_id AS was
FROM (SELECT benchmark, example_id, CASE benchmark WHEN 'gsm8k' THEN 'main' ELSE subset END AS config FROM eval_items WHERE benchmark IN ('gsm8k', 'bbh'))"""
ORACLES["instruction_families"] = "SELECT family, count(*) AS n FROM (SELECT unnest(list_distinct(instruction_id_list)) AS family FROM eval_items) WHERE family IS NOT NULL GROUP BY family"

ATTEMPTS = f"""latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY adapter, benchmark, example_id ORDER BY attempt DESC NULLS LAST, output_id DESC NULLS LAST) AS _r FROM eval_outputs WHERE adapter IS NOT NULL) WHERE _r = 1
), items AS (SELECT benchmark, example_id, min(instruction_id_list) AS ins FROM eval_items WHERE benchmark IS NOT NULL AND example_id IS NOT NULL GROUP BY ALL),
names AS (SELECT DISTINCT adapter FROM latest), sizes AS (SELECT benchmark, count(*) AS expected FROM items GROUP BY 1),
checked AS (
  SELECT a.adapter, a.benchmark, a.example_id, i.example_id IS NOT NULL AS known, a.response IS NULL OR NOT regexp_matches(a.response, '{_SOLID}') AS blank, {_count('a.response', TOKEN)} AS tokens, coalesce(CASE a.benchmark
    WHEN 'ifeval' THEN score.prompt_level_strict IS NOT NULL AND score.prompt_level_loose IS NOT NULL AND score.instruction_level_strict IS NOT NULL AND score.instruction_level_loose IS NOT NULL
      AND len(list_filter(score.instruction_level_strict, lambda x: x IS NULL)) = 0 AND len(list_filter(score.instruction_level_loose, lambda x: x IS NULL)) = 0
      AND len(score.instruction_level_strict) = len(score.instruction_level_loose) AND (i.ins IS NULL OR len(score.instruction_level_strict) = len(i.ins))
    WHEN 'gsm8k' THEN score.exact_match IS NOT NULL WHEN 'bbh' THEN score.normalized_accuracy IS NOT NULL END, false) AND score IS NOT NULL AS usable
  FROM latest a LEFT JOIN items i ON i.benchmark = a.benchmark AND i.example_id = a.example_id
), base AS (
  SELECT adapter, benchmark, count(*) AS n_rows, count(*) FILTER (blank OR NOT usable) AS malformed, count(*) FILTER (blank) AS empty_responses,
    count(*) FILTER (NOT blank AND usable AND tokens >= CASE benchmark WHEN 'ifeval' THEN 512 ELSE 128 END) AS possibly_cut,
    min(tokens) FILTER (NOT blank AND usable)::INT AS min_tokens, avg(tokens) FILTER (NOT blank AND usable) AS mean_tokens, max(tokens) FILTER (NOT blank AND usable)::INT AS max_tokens, count(*) FILTER (NOT blank AND usable) AS scored
  FROM checked GROUP BY ALL
), ids AS (SELECT adapter, benchmark, example_id, count(*) AS n, bool_and(known) AS known FROM checked WHERE example_id IS NOT NULL GROUP BY ALL),
of_ids AS (SELECT adapter, benchmark, count(*) AS ids, count(*) FILTER (n > 1) AS duplicate_ids, count(*) FILTER (NOT known) AS extra_ids, count(*) FILTER (known) AS found FROM ids GROUP BY ALL),
files AS (
  SELECT adapter, benchmark, coalesce(n_rows, 0) AS n_rows, expected, coalesce(ids, 0) AS ids, coalesce(duplicate_ids, 0) AS duplicate_ids, expected - coalesce(found, 0) AS missing_ids, coalesce(extra_ids, 0) AS extra_ids,
    coalesce(malformed, 0) AS malformed, coalesce(empty_responses, 0) AS empty_responses, coalesce(possibly_cut, 0) AS possibly_cut, min_tokens, round(mean_tokens, 6) AS mean_tokens, max_tokens, coalesce(scored, 0) AS scored
  FROM names CROSS JOIN sizes LEFT JOIN base USING (adapter, benchmark) LEFT JOIN of_ids USING (adapter, benchmark)
), judged_files AS (SELECT *, n_rows = expected AND duplicate_ids = 0 AND missing_ids = 0 AND extra_ids = 0 AND malformed = 0 AS complete FROM files)"""
ORACLES["validate_outputs"] = f"WITH {ATTEMPTS} SELECT * FROM judged_files"
ORACLES["outputs_complete"] = f"WITH {ATTEMPTS} SELECT count(*) AS files, bool_and(complete) AS all_complete, sum(possibly_cut)::BIGINT AS possibly_cut, sum(scored)::BIGINT AS responses FROM judged_files"
ORACLES["possible_cuts"] = f"WITH {ATTEMPTS} SELECT benchmark, sum(possibly_cut)::BIGINT AS possibly_cut, sum(scored)::BIGINT AS scored FROM files GROUP BY benchmark"
ORACLES["faulty_ids"] = f"""WITH {ATTEMPTS} SELECT adapter, benchmark, example_id, 'duplicate' AS fault FROM ids WHERE n > 1 UNION ALL SELECT adapter, benchmark, example_id, 'extra' FROM ids WHERE NOT known
UNION ALL SELECT adapter, benchmark, example_id, 'missing' FROM names CROSS JOIN items ANTI JOIN ids USING (adapter, benchmark, example_id)"""
ORACLES["metrics_wide"] = f"""WITH {SEEDS} SELECT strategy, metric, round(avg(value) FILTER (seed = 13), 9) AS seed_13, round(avg(value) FILTER (seed = 42), 9) AS seed_42, round(avg(value) FILTER (seed = 2026), 9) AS seed_2026,
round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 9) AS sd, count(*) AS n_runs FROM seeds GROUP BY strategy, metric"""
ORACLES["seed_lists"] = f"WITH {SEEDS} SELECT strategy, metric, string_agg(seed::VARCHAR, ',' ORDER BY adapter, seed) AS seeds FROM (SELECT DISTINCT strategy, metric, adapter, seed FROM seeds) GROUP BY strategy, metric"
ORACLES["accuracy_summary"] = f"""WITH {OUT}, v AS (SELECT adapter, benchmark, CASE benchmark WHEN 'ifeval' THEN score.prompt_level_strict WHEN 'gsm8k' THEN score.exact_match WHEN 'bbh' THEN score.normalized_accuracy END AS v FROM first)
SELECT adapter, benchmark, count(*) AS n, round(avg(v::INT), 9) AS accuracy FROM v WHERE v IS NOT NULL GROUP BY ALL"""

FIRST_JUDGED = "firsts AS (SELECT DISTINCT ON (audit_id) * FROM judge_results WHERE audit_id IS NOT NULL ORDER BY audit_id, example_id)"
OVERALL = f"""{FIRST_JUDGED}, known AS (SELECT example_id, min((source, quality_score)) AS s FROM records GROUP BY 1),
overalls AS (SELECT audit_id, coalesce(s[1], 'unknown') AS source, (pass_a.scores['overall_quality'] + pass_b.scores['overall_quality']) / 2 AS overall FROM firsts LEFT JOIN known USING (example_id) WHERE pass_a.parse_ok AND pass_b.parse_ok)"""
ORACLES["judge_normal"] = f"""WITH {FIRST_JUDGED}, long AS (SELECT audit_id, 'a' AS pass, pass_a AS p FROM firsts WHERE pass_a IS NOT NULL UNION ALL SELECT audit_id, 'b', pass_b FROM firsts WHERE pass_b IS NOT NULL),
kept AS (SELECT audit_id, pass, p, list_filter(map_entries(p.scores), lambda e: e.key IN ('correctness', 'instruction_following', 'clarity', 'self_containedness', 'overall_quality') AND e.value BETWEEN 1 AND 5) AS k,
  CASE WHEN p.confidence BETWEEN 0 AND 1 THEN p.confidence END AS c FROM long)
SELECT audit_id, pass, coalesce(len(k), 0) = 5 AND c IS NOT NULL AS parse_ok, coalesce(len(k), 0)::INT AS n_scores, coalesce(list_sum(list_transform(k, lambda e: e.value)), 0)::INT AS sum_scores, c AS confidence, coalesce(p.uncertain, false) AS uncertain FROM kept"""
ORACLES["judge_sources"] = f"WITH {OVERALL} SELECT source, count(*) AS n, round(avg(overall), 9) AS mean_overall, coalesce(bool_and(overall = 5), false) AS at_maximum FROM overalls GROUP BY source"
ORACLES["judge_distribution"] = f"WITH {OVERALL} SELECT overall, count(*) AS n, coalesce((SELECT min(overall) = 5 FROM overalls), false) AS degenerate FROM overalls GROUP BY overall"
ORACLES["judge_structure"] = f"""WITH {FIRST_JUDGED}, known AS (SELECT example_id, bool_or(coalesce(list_contains(list_transform(messages, lambda m: m.role), 'user') AND list_contains(list_transform(messages, lambda m: m.role), 'assistant'), false)) AS roles,
  bool_or(coalesce(len(list_filter(messages, lambda m: m.role = 'assistant' AND regexp_matches(m.content, '[^ {chr(92)}t-{chr(92)}r]'))) > 0, false)) AS said FROM records GROUP BY 1)
SELECT count(*) AS items, count(DISTINCT f.example_id) AS unique_example_ids, count(k.example_id) AS records_found, count(*) FILTER (roles) AS with_both_roles, count(*) FILTER (said) AS with_answer FROM firsts f LEFT JOIN known k USING (example_id)"""
ORACLES["audit_found"] = f"WITH {FIRST_JUDGED} SELECT count(*) AS items, count(*) FILTER (example_id IN (SELECT example_id FROM records WHERE example_id IS NOT NULL)) AS found FROM firsts"
ORACLES["quality_statistics"] = """SELECT coalesce(source, 'unknown') AS source, count(*) AS n_rows, count(quality_score) AS n, round(avg(quality_score), 9) AS mean, round(median(quality_score), 9) AS median, round(min(quality_score), 9) AS least, round(max(quality_score), 9) AS most
FROM records GROUP BY 1"""
ORACLES["manifest_members"] = "SELECT count(DISTINCT adapter) AS manifests, count(*) AS n_rows, count(DISTINCT example_id) AS unique_ids, (SELECT count(*) FROM (SELECT example_id FROM eval_outputs WHERE example_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids FROM eval_outputs"
ORACLES["manifest_repeats"] = "SELECT example_id, string_agg(strategy, ',' ORDER BY strategy) AS manifests, count(*) AS n FROM (SELECT DISTINCT strategy, example_id FROM eval_outputs WHERE example_id IS NOT NULL) GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 20"
ORACLES["first_wins"] = "SELECT example_id, min(benchmark) AS benchmark FROM eval_items WHERE example_id IS NOT NULL AND benchmark IN ('bbh', 'gsm8k', 'ifeval') GROUP BY 1"

RECOMPUTED = f"""r AS (SELECT example_id, source_row, quality_score AS stored, token_count, list_transform(messages, lambda m: {{'role': lower(trim(m.role)), 'content': coalesce(m.content, '')}}) AS ms FROM records WHERE messages IS NOT NULL AND token_count IS NOT NULL),
texts AS (SELECT *, array_to_string(list_transform(ms, lambda m: m.content), ' ') AS text, array_to_string(list_transform(list_filter(ms, lambda m: m.role = 'assistant'), lambda m: m.content), ' ') AS said FROM r),
parts AS (SELECT *, regexp_extract_all(lower(text), '[A-Za-z]+') AS w, list_histogram(regexp_extract_all(lower(text), '[A-Za-z]+')) AS h FROM texts),
computed AS (SELECT example_id, source_row, stored, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE round(
  0.25::DOUBLE * (0.5::DOUBLE * least(1.0::DOUBLE, len(list_filter(w, lambda x: x IN {STOP})) / 4.0::DOUBLE) + 0.5::DOUBLE * least(1.0::DOUBLE, {_count('text', '[A-Za-z]')}::DOUBLE / greatest(1, {_count('text', _SOLID)})))
  + 0.25::DOUBLE * least(1.0::DOUBLE, {_count('said', _WORDS)} / 80.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN token_count BETWEEN 32 AND 1536 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
  + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - coalesce(list_sum(list_transform(list_filter(map_values(h), lambda c: c > 3), lambda c: c - 1)), 0)::DOUBLE / greatest(1, len(w)))
  + 0.1::DOUBLE * CASE WHEN contains(text, chr(0)) OR {_run('text', 10)} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 6) END AS computed FROM parts)"""
ORACLES["quality_mismatches"] = f"WITH {RECOMPUTED} SELECT count(*) AS mismatches FROM computed WHERE abs(coalesce(stored, 0) - computed) > 1e-9"
ORACLES["quality_mismatch_rows"] = f"WITH {RECOMPUTED} SELECT DISTINCT example_id, source_row, stored, computed FROM computed WHERE abs(coalesce(stored, 0) - computed) > 1e-9 ORDER BY example_id NULLS FIRST, source_row NULLS FIRST, stored NULLS FIRST LIMIT 20"

_RANGES = [("AC00", "D7A3"), ("0E01", "0E5B"), ("0400", "044F"), ("0905", "097F"), ("0C95", "0CDE"), ("0A05", "0A33"), ("0A85", "0AF9"), ("0B85", "0BFA"), ("0985", "09FE"), ("0621", "06FF")]
_LANGS = ["'ko'", "'th'", "CASE WHEN regexp_matches(text, '[ъьщю]') THEN 'bg' ELSE 'ru' END", "'hi'", "'kn'", "'pa'", "'gu'", "'ta'", "'bn'", "CASE WHEN regexp_matches(text, '[پچژگ]') THEN 'fa' ELSE 'ur' END"]
_MARKER_SQL = [("de", "der die das und ist nicht ein"), ("it", "il lo la gli che una non"), ("pt", "que não uma para com dos das"), ("fi", "että ja on sekä tämä ovat"), ("vi", "và của là một những trong"), ("sw", "na ya kwa wa ni hii")]
_CASES = " ".join(f"WHEN len(list_filter(letters, lambda c: c BETWEEN chr({int(a, 16)}) AND chr({int(b, 16)}))) > 0 THEN {lang}" for (a, b), lang in zip(_RANGES, _LANGS, strict=True))
_SCORES = ", ".join(f"len(list_intersect(words, {v.split()!r})) AS n_{k}" for k, v in _MARKER_SQL)
_MOST = "greatest(" + ", ".join(f"n_{k}" for k, _ in _MARKER_SQL) + ")"
_TOP = " ".join(f"WHEN n_{k} = {_MOST} THEN '{k}'" for k, _ in _MARKER_SQL)
ORACLES["language_guess"] = rf"""WITH l AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '\p{{L}}')) AS letters, list_distinct(regexp_extract_all(lower(text), '[a-z\x{{C0}}-\x{{FF}}]+')) AS words FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, {_SCORES} FROM l)
SELECT doc_id, CASE WHEN len(letters) = 0 THEN NULL {_CASES} WHEN {_MOST} = 0 THEN 'en' {_TOP} END AS language FROM m"""

FLAGGED = f"""r AS (SELECT messages, array_to_string(list_transform(messages, lambda m: coalesce(m.content, 'None')), ' ') AS every, array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: coalesce(m.content, 'None')), ' ') AS said FROM records)"""
ORACLES["structural_flags"] = f"""WITH {FLAGGED}, f AS (SELECT
  messages IS NOT NULL AS messages_is_list, coalesce(list_bool_and(list_transform(messages, lambda m: coalesce(lower(m.role) IN ('system', 'user', 'assistant') AND regexp_matches(m.content, '{_SOLID}'), false))), messages IS NOT NULL) AS valid_message_items,
  list_contains(list_transform(messages, lambda m: lower(m.role)), 'user') AS has_user, list_contains(list_transform(messages, lambda m: lower(m.role)), 'assistant') AS has_assistant, lower(messages[-1].role) = 'assistant' AS assistant_last,
  regexp_matches(said, '{_SOLID}') AS nonempty_assistant, contains(every, chr(0)) AS null_byte, {_run('every', 10)} AND messages IS NOT NULL AS long_repeated_character_run, {_count('said', _WORDS)} < 8 AND messages IS NOT NULL AS short_assistant_word_count FROM r)
SELECT flag, n FROM (UNPIVOT (SELECT count(*) FILTER (messages_is_list) AS messages_is_list, count(*) FILTER (valid_message_items) AS valid_message_items, count(*) FILTER (has_user) AS has_user, count(*) FILTER (has_assistant) AS has_assistant,
  count(*) FILTER (assistant_last) AS assistant_last, count(*) FILTER (nonempty_assistant) AS nonempty_assistant, count(*) FILTER (null_byte) AS null_byte, count(*) FILTER (long_repeated_character_run) AS long_repeated_character_run,
  count(*) FILTER (short_assistant_word_count) AS short_assistant_word_count FROM f) ON COLUMNS(*) INTO NAME flag VALUE n) WHERE n > 0"""
_SCRIPTS = ["ko", "th", "cyrillic", "hi", "kn", "pa", "gu", "ta", "bn", "arabic"]
_SCRIPT_CASES = " ".join(rf"WHEN regexp_matches(text, '[\x{{{a}}}-\x{{{b}}}]') THEN '{k}'" for (a, b), k in zip(_RANGES, _SCRIPTS, strict=True))
ORACLES["script_guess"] = rf"SELECT script, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(text, '\p{{L}}') THEN 'none' {_SCRIPT_CASES} END AS script FROM documents WHERE text IS NOT NULL) GROUP BY 1"
ORACLES["audit_sample"] = """WITH r AS (SELECT example_id, min(source) AS source, max(quality_score) AS q FROM records WHERE source IS NOT NULL AND quality_score IS NOT NULL GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY q) - 1 AS i, count(*) OVER () AS n FROM r),
c AS (SELECT min(q) FILTER (i = n // 3) AS c1, min(q) FILTER (i = 2 * n // 3) AS c2 FROM o), l AS (SELECT example_id, source, CASE WHEN q <= c1 THEN 'low' WHEN q <= c2 THEN 'mid' ELSE 'high' END AS tertile FROM r, c),
h AS (SELECT source || '|' || tertile AS st, count(*) AS size FROM l GROUP BY 1), b AS (SELECT st, size, least(size, 120 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY st) <= 120 % count(*) OVER () THEN 1 ELSE 0 END) AS base FROM h),
s AS (SELECT st, unnest(generate_series(1, size - base)) AS k FROM b), d AS (SELECT st, row_number() OVER (ORDER BY k, substr(sha256('2026:' || st), 1, 16), st) AS turn FROM s),
t AS (SELECT b.st, base + coalesce(m, 0) AS taken FROM b LEFT JOIN (SELECT st, count(*) AS m FROM d WHERE turn <= 120 - (SELECT sum(base) FROM b) GROUP BY 1) USING (st)),
p AS (SELECT l.*, row_number() OVER (PARTITION BY source || '|' || tertile ORDER BY substr(sha256('2026:' || example_id), 1, 16), example_id) AS k FROM l)
SELECT example_id, source, tertile, printf('audit-%03d', row_number() OVER (ORDER BY substr(sha256('2027:' || example_id), 1, 16), example_id)) AS audit_id FROM p JOIN t ON t.st = p.source || '|' || p.tertile WHERE k <= taken"""

LATE = f"""texts AS (SELECT doc_id, coalesce(crawled_at >= TIMESTAMPTZ '2025-05-01 00:00:00+00', false) AS late, {_norm('text')} AS norm FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""
ORACLES["exact_overlap_late"] = f"WITH {LATE}, e AS (SELECT norm, max(doc_id) AS eval_id FROM texts WHERE late AND norm <> '' GROUP BY 1) SELECT doc_id AS train_id, eval_id FROM texts JOIN e USING (norm) WHERE NOT late"
_VOTES = """x AS (SELECT i, side, l, len(s) AS c, unnest(s) AS g FROM (SELECT i, side, length(norm) AS l, list_distinct(list_transform(generate_series(1, greatest(length(norm) - 4, 1)), lambda k: substr(norm, k, 5))) AS s FROM sides WHERE norm <> '')),
v AS (SELECT a.i AS train_id, b.i AS eval_id, a.c AS ca, b.c AS cb, count(*) AS votes FROM x a JOIN x b ON a.g = b.g AND NOT a.side AND b.side AND greatest(a.l, b.l) <= 1.5 * greatest(1, least(a.l, b.l)) GROUP BY ALL)
SELECT train_id, eval_id, votes, round(votes::DOUBLE / (ca + cb - votes), 9) AS jaccard FROM v WHERE votes::DOUBLE / (ca + cb - votes) >= 0.35"""
ORACLES["candidate_votes_late"] = f"WITH {LATE}, sides AS (SELECT doc_id AS i, late AS side, norm FROM texts), {_VOTES}"
ORACLES["candidate_votes_train"] = f"""WITH sides AS (SELECT DISTINCT example_id AS i, false AS side, {_norm("array_to_string(list_transform(list_filter(messages, lambda m: lower(trim(m.role)) = 'user'), lambda m: coalesce(m.content, '')), chr(10))")} AS norm FROM records WHERE messages IS NOT NULL
UNION ALL SELECT benchmark || '/' || example_id, true, {_norm('prompt')} FROM eval_items), {_VOTES}"""
_POOL = f"""{CANON}, named AS (SELECT *, sha256(to_json(list_transform(ms, lambda m: {{'content': m.content, 'role': m.role}}))::VARCHAR) AS example_id FROM valid),
pool AS (SELECT example_id, arg_min({{'source': source, 'source_row': source_row, 'tokens': tokens, 'ms': ms}}, (source, source_row)) AS b FROM named GROUP BY 1)"""
_SCORED = f"""{_POOL}, flat AS (
  SELECT example_id, b.source AS source, b.source_row AS source_row, b.tokens AS token_count, array_to_string(list_transform(b.ms, lambda m: m.content), ' ') AS spaced, array_to_string(list_transform(b.ms, lambda m: m.content), chr(10)) AS text,
    array_to_string(list_transform(list_filter(b.ms, lambda m: m.role = 'assistant'), lambda m: m.content), ' ') AS said,
    CASE WHEN b.tokens < 256 THEN '0-255' WHEN b.tokens < 512 THEN '256-511' WHEN b.tokens < 1024 THEN '512-1023' WHEN b.tokens < 1536 THEN '1024-1535' ELSE '1536-2048' END AS length_bin FROM pool
), worded AS (SELECT *, source || '|' || length_bin AS stratum, regexp_extract_all(lower(spaced), '[A-Za-z]+') AS w, list_histogram(regexp_extract_all(lower(spaced), '[A-Za-z]+')) AS h FROM flat),
rated AS MATERIALIZED (SELECT example_id, source, source_row, stratum, length_bin, token_count, text, round(
  0.25::DOUBLE * (0.5::DOUBLE * least(1.0::DOUBLE, len(list_filter(w, lambda x: x IN {STOP})) / 4.0::DOUBLE) + 0.5::DOUBLE * least(1.0::DOUBLE, {_count('spaced', '[A-Za-z]')}::DOUBLE / greatest(1, {_count('spaced', _SOLID)})))
  + 0.25::DOUBLE * least(1.0::DOUBLE, {_count('said', _WORDS)} / 80.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN token_count BETWEEN 32 AND 1536 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
  + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - coalesce(list_sum(list_transform(list_filter(map_values(h), lambda c: c > 3), lambda c: c - 1)), 0)::DOUBLE / greatest(1, len(w)))
  + 0.1::DOUBLE * CASE WHEN contains(spaced, chr(0)) OR {_run('spaced', 10)} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS quality_score FROM worded),
kept_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY substr(sha256('0:' || example_id), 1, 16), example_id) AS _n FROM rated) WHERE _n <= 1000)"""
ORACLES["canonical_pool"] = f"WITH {_SCORED} SELECT example_id, source, length_bin, token_count::INT AS token_count, quality_score, text FROM kept_rows"
ORACLES["select_before_top_up"] = f"""WITH RECURSIVE {_SCORED}, totals AS (SELECT stratum, sum(token_count)::HUGEINT AS t FROM rated GROUP BY 1),
shares AS (SELECT stratum, (40000 * t) // (SELECT sum(t) FROM totals)::HUGEINT AS f, (40000 * t) % (SELECT sum(t) FROM totals)::HUGEINT AS r FROM totals),
quotas AS (SELECT stratum, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, stratum) <= 40000 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM shares),
ordered AS MATERIALIZED (SELECT stratum, example_id, token_count, quota, row_number() OVER (PARTITION BY stratum ORDER BY quality_score DESC, substr(sha256(example_id), 1, 16), example_id) AS p FROM kept_rows JOIN quotas USING (stratum) WHERE quality_score >= 0.55),
pass1 AS (
  SELECT stratum, 0::BIGINT AS p, 0::BIGINT AS total, NULL::BIGINT AS token_count, false AS took FROM quotas
  UNION ALL SELECT o.stratum, o.p, CASE WHEN s.total + o.token_count <= o.quota THEN s.total + o.token_count ELSE s.total END, o.token_count, s.total + o.token_count <= o.quota FROM pass1 s JOIN ordered o ON o.stratum = s.stratum AND o.p = s.p + 1
), ended AS (SELECT stratum, max(total) AS total FROM pass1 GROUP BY stratum),
rest AS (SELECT o.stratum, o.token_count, o.quota, e.total + sum(o.token_count) OVER (PARTITION BY o.stratum ORDER BY o.token_count, substr(sha256(o.example_id), 1, 16), o.example_id) AS reached FROM ordered o JOIN ended e USING (stratum) JOIN pass1 s ON s.stratum = o.stratum AND s.p = o.p WHERE NOT s.took)
SELECT stratum, count(*) AS n_rows, sum(token_count)::BIGINT AS n_tokens FROM (SELECT stratum, token_count FROM pass1 WHERE took UNION ALL SELECT stratum, token_count FROM rest WHERE reached <= quota) GROUP BY 1"""
ORACLES["select_totals"] = f"WITH {_POOL} SELECT k.strategy, least(40000, sum(b.tokens))::BIGINT AS actual_tokens, 40000::BIGINT AS target_tokens, sum(b.tokens) >= 40000 AS exact FROM pool, (VALUES ('random'), ('quality'), ('diversity')) k(strategy) GROUP BY k.strategy"
ORACLES["doc_quality_all"] = ORACLES["doc_quality"]
