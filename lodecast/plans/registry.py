"""All queries of the engine over the test tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecast.functions import language, scoring
from lodecast.functions import text as T
from lodecast.operators import audit, budget, contamination, judge, messages, metrics, pool, sampling, selection, validation
from lodecast.runtime import table
from lodecast.plans.oracles import ORACLES  # noqa: F401
from lodecast.sources import files
from lodecast.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries.
TARGET, CAP, POOL_SEED, FLOOR = 100_000, 100, 0, 0.55
#: Tokens of a selected manifest, and the time from which crawled documents count as held out.
SELECT_TARGET, HELD_OUT = 40_000, "2025-05-01"
REPLICATES, BASE, TREATMENT = 1_000, "random", "diversity"
# Those of the reference: all treatments against BASE.
ALL_REPLICATES, TREATMENTS = 10_000, ("quality", "diversity")


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Documents with text and stand-in tokens, with or without source; the sources as stored."""
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "source", "lang", "text", T.token_count(F.col("text")).cast("bigint").alias("token_count"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    """All documents of _texts; those without a source have the source `unknown`."""
    return _texts(s, d).withColumn("source", F.coalesce("source", F.lit("unknown")))


def _capped(s: SparkSession, d: str) -> DataFrame:
    return pool.capped(_docs(s, d).where("token_count > 0"), "source", "doc_id", CAP, POOL_SEED)


def _quotas(s: SparkSession, d: str) -> DataFrame:
    totals = _docs(s, d).groupBy("source").agg(F.sum("token_count").alias("t"))
    return budget.largest_remainder(totals, "source", "t", TARGET)


def _ordered(s: SparkSession, d: str) -> DataFrame:
    return pool.numbered(_capped(s, d).select("source", "doc_id", "token_count"), "source", pool.random_order(13, "doc_id"))


def _taken(s: SparkSession, d: str) -> DataFrame:
    return budget.greedy_take(_ordered(s, d), "source", "doc_id", "token_count", "position", _quotas(s, d))


def _topped(s: SparkSession, d: str) -> DataFrame:
    return budget.top_up(_ordered(s, d), _taken(s, d), "source", "doc_id", "token_count", "position", TARGET)


def _train(s: SparkSession, d: str) -> DataFrame:
    users = F.array_join(F.transform(F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    rows = table(s, d, "records").where("messages IS NOT NULL").select("example_id", users.alias("p")).distinct()
    return contamination.prompts(rows, "example_id", "p", "train_id")


def _evaluation(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "eval_items").select(F.concat_ws("/", "benchmark", "example_id").alias("i"), "prompt")
    return contamination.prompts(rows, "i", "prompt", "eval_id")


def _late(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents crawled before HELD_OUT, and those crawled later, which stand for held-out texts."""
    docs = table(s, d, "documents").where("doc_id IS NOT NULL")
    split = lambda late: docs.where(F.coalesce(F.col("crawled_at") >= F.lit(HELD_OUT).cast("timestamp"), F.lit(False)) == late)
    return contamination.prompts(split(False), "doc_id", "text", "train_id"), contamination.prompts(split(True), "doc_id", "text", "eval_id")


def _selected(strategy: str) -> Query:
    return lambda s, d: selection.select(table(s, d, "records"), strategy, SELECT_TARGET)[0].select("example_id", "source", "source_row", "length_bin", "token_count", "quality_score", "place")


def _select_totals(s: SparkSession, d: str) -> DataFrame:
    parts = [selection.summary(selection.select(table(s, d, "records"), k, SELECT_TARGET)[0], SELECT_TARGET).withColumn("strategy", F.lit(k)) for k in selection.STRATEGIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("strategy", "actual_tokens", "target_tokens", "exact")


def _attempts(s: SparkSession, d: str) -> DataFrame:
    """The last attempt of each run at each item; repeated rows once."""
    rows = table(s, d, "eval_outputs").where("adapter IS NOT NULL")
    rest = [c for c in rows.columns if c not in ("adapter", "benchmark", "example_id")]
    last = rows.groupBy("adapter", "benchmark", "example_id").agg(F.max_by(F.struct(*rest), F.struct("attempt", "output_id")).alias("_b"))
    return last.select("adapter", "benchmark", "example_id", "_b.*")


def _completeness(s: SparkSession, d: str) -> DataFrame:
    return validation.completeness(_attempts(s, d), table(s, d, "eval_items"))


def _judged(s: SparkSession, d: str) -> DataFrame:
    return judge.judged_records(table(s, d, "judge_results"), table(s, d, "records"))


def _recomputed(s: SparkSession, d: str) -> DataFrame:
    """Records with messages, and the quality score of their texts and stored token counts."""
    rows = table(s, d, "records").where("messages IS NOT NULL AND token_count IS NOT NULL").select("example_id", "source_row", "quality_score", "messages", "token_count")
    some = F.transform("messages", lambda m: F.struct(F.lower(F.trim(m["role"])).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    rows = messages.bound(rows, messages.joined(some, " ").alias("_text"), messages.joined(some, " ", "assistant").alias("_said"))
    return rows.select("example_id", "source_row", F.col("quality_score").alias("stored"), T.text_quality(F.col("_text"), F.col("_said"), F.col("token_count")).alias("computed"))


def _judge_text(s: SparkSession, d: str) -> DataFrame:
    """Stored passes as a model's answer: prose around their JSON."""
    long = judge.first_judgements(table(s, d, "judge_results")).select("audit_id", F.explode(F.array(F.struct(F.lit("a").alias("pass"), F.col("pass_a").alias("p")), F.struct(F.lit("b").alias("pass"), F.col("pass_b").alias("p")))).alias("x"))
    said = F.concat(F.lit("Scores {as asked}: "), F.to_json(F.struct("x.p.scores", "x.p.confidence", "x.p.uncertain")), F.lit(" {end"))
    return long.where("x.p IS NOT NULL").select("audit_id", "x.pass", said.alias("answer"))


def _normal_judgements(s: SparkSession, d: str) -> DataFrame:
    got = judge.with_object(_judge_text(s, d), "answer").select("audit_id", "pass", judge.normal_judgement(F.col("object")).alias("j"))
    return got.select("audit_id", "pass", "j.parse_ok", F.size("j.scores").alias("n_scores"), F.coalesce(F.aggregate(F.map_values("j.scores"), F.lit(0), lambda a, x: a + x), F.lit(0)).alias("sum_scores"), "j.confidence", "j.uncertain")


def _outputs(s: SparkSession, d: str) -> DataFrame:
    return metrics.distinct_outputs(table(s, d, "eval_outputs"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_outputs").where("response IS NOT NULL AND target IS NOT NULL").select("output_id", "benchmark", "response", "target").distinct()


def _stream(s: SparkSession, d: str) -> DataFrame:
    return streams.table_stream(s, d, "events")


def _order(kind: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        if kind == "diversity":
            rows = table(s, d, "embeddings").select("vec_id", "label", F.lit("all").alias("stratum"), (F.pmod("vec_id", F.lit(7)) / 7.0).alias("score"))
            return pool.cluster_round_robin(rows, "stratum", "label", "score", "vec_id", 13).select("vec_id", "label", "cluster_rank", "position")
        rows = table(s, d, "records").where("example_id IS NOT NULL AND source IS NOT NULL").groupBy("example_id").agg(F.min("source").alias("source"), F.max("quality_score").alias("quality_score"))
        if kind == "random":
            return pool.numbered(rows, "source", pool.random_order(13, "example_id")).select("example_id", "source", "position")
        return pool.numbered(rows.where(F.col("quality_score") >= FLOOR), "source", pool.quality_order("quality_score", "example_id")).select("example_id", "source", "position")

    return query


def _paired(s: SparkSession, d: str) -> DataFrame:
    return metrics.paired_items(metrics.metric_rows(_outputs(s, d)), BASE, TREATMENT)


def _contrasts(s: SparkSession, d: str) -> DataFrame:
    rows = metrics.metric_rows(_outputs(s, d))
    each = [metrics.bootstrap(metrics.paired_items(rows, BASE, t), ALL_REPLICATES).withColumn("treatment", F.lit(t)) for t in TREATMENTS]
    return each[0].unionByName(each[1]).select("metric", "treatment", "n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


def _quality(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.text_quality(F.col("text"), F.col("text"), F.col("token_count")).alias("quality_score"))


def _agreement(s: SparkSession, d: str) -> DataFrame:
    got = audit.agreement(audit.parsed_judgements(table(s, d, "judge_results")))
    return got.select("dimension", "n", *[F.round(c, 9).alias(c) for c in ("exact", "mean_difference", "mean_a", "mean_b", "share_at_most", "share_at_most_both")], "distinct_scores")


QUERIES: dict[str, Query] = {
    "pool_strata": lambda s, d: pool.stratum_totals(pool.first_of_equal(messages.candidate_rows(table(s, d, "records")).select("example_id", "source", "source_row", "stratum", "token_count"), "example_id", ["source", "source_row"])),
    "doc_quality": lambda s, d: _quality(_texts(s, d)),
    "doc_quality_all": lambda s, d: _quality(_texts(s, d)),
    "dedup_first": lambda s, d: pool.first_of_equal(_docs(s, d).select(F.sha2("text", 256).alias("h"), "source", "doc_id"), "h", ["source", "doc_id"]),
    "capped_pool": lambda s, d: _capped(s, d).select("source", "doc_id", "token_count"),
    "token_quotas": _quotas,
    "order_random": _order("random"),
    "order_quality": _order("quality"),
    "order_diversity": _order("diversity"),
    "greedy_take": _taken,
    "selection_summary": lambda s, d: _taken(s, d).join(_docs(s, d).select("doc_id", "token_count"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("token_count").alias("n_tokens")),
    "exact_fit": lambda s, d: budget.exact_fit(_capped(s, d), _topped(s, d), "doc_id", "token_count", TARGET),
    "exact_overlap": lambda s, d: contamination.exact_overlap(_train(s, d), _evaluation(s, d)),
    "candidate_votes": lambda s, d: contamination.shingle_votes(_evaluation(s, d).toDF("train_id", "norm"), _evaluation(s, d)).where("train_id <> eval_id").withColumn("jaccard", F.round("jaccard", 9)),
    "candidate_votes_train": lambda s, d: contamination.shingle_votes(_train(s, d), _evaluation(s, d)).withColumn("jaccard", F.round("jaccard", 9)),
    "near_overlap": lambda s, d: contamination.near_overlap(_train(s, d), _evaluation(s, d)),
    "exact_overlap_late": lambda s, d: contamination.exact_overlap(*_late(s, d)),
    "candidate_votes_late": lambda s, d: contamination.shingle_votes(*_late(s, d)).withColumn("jaccard", F.round("jaccard", 9)),
    "near_overlap_late": lambda s, d: contamination.near_overlap(*_late(s, d)),
    "select_random": _selected("random"),
    "select_quality": _selected("quality"),
    "select_diversity": _selected("diversity"),
    "select_totals": _select_totals,
    "select_before_top_up": lambda s, d: selection.select(table(s, d, "records"), "quality", SELECT_TARGET)[1],
    "canonical_pool": lambda s, d: selection.candidate_pool(table(s, d, "records"))[0].select("example_id", "source", "length_bin", "token_count", "quality_score", "text"),
    "length_buckets": lambda s, d: sampling.rank_buckets(table(s, d, "eval_items").select("benchmark", "example_id", F.length("prompt").alias("n")), "benchmark", [F.col("n"), F.col("example_id")], 4),
    "waterfill_counts": lambda s, d: sampling.water_fill(_docs(s, d).where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n", 200),
    "sample_groups": lambda s, d: sampling.sample_groups(_docs(s, d).where("lang IS NOT NULL").select("lang", "doc_id"), "lang", "doc_id", QUERIES["waterfill_counts"](s, d), 2026),
    "equal_per_group": lambda s, d: sampling.equal_per_group(_docs(s, d).select("source", "doc_id"), "source", "doc_id", 8, 2126),
    "coverage_greedy": lambda s, d: sampling.coverage_greedy(table(s, d, "eval_items").where("instruction_id_list IS NOT NULL"), "example_id", "instruction_id_list", 60, 2026),
    "audit_sample": lambda s, d: sampling.audit_sample(table(s, d, "records").where("source IS NOT NULL AND quality_score IS NOT NULL").groupBy("example_id").agg(F.min("source").alias("source"), F.max("quality_score").alias("quality_score")), "source", "quality_score", "example_id", 120, 2026),
    "extract_number": lambda s, d: _scored(s, d).where("benchmark = 'gsm8k'").select("output_id", scoring.extract_number(F.col("response")).alias("answer"), scoring.number_match(F.col("response"), F.col("target")).alias("correct")),
    "extract_option": lambda s, d: _scored(s, d).where("benchmark = 'bbh'").select("output_id", scoring.extract_option(F.col("response"), F.col("target")).alias("answer"), scoring.option_match(F.col("response"), F.col("target")).alias("correct")),
    "validate_outputs": lambda s, d: _completeness(s, d).withColumn("mean_tokens", F.round("mean_tokens", 6)),
    "faulty_ids": lambda s, d: validation.faulty_ids(_attempts(s, d), table(s, d, "eval_items")),
    "outputs_complete": lambda s, d: validation.completeness_total(_completeness(s, d)),
    "possible_cuts": lambda s, d: _completeness(s, d).groupBy("benchmark").agg(F.sum("possibly_cut").alias("possibly_cut"), F.sum("scored").alias("scored")),
    "evaluation_prompts": lambda s, d: table(s, d, "eval_items").select("benchmark", "example_id", scoring.evaluation_prompt(F.col("benchmark"), F.col("prompt")).alias("asked")),
    "benchmark_snapshot": lambda s, d: files.snapshot(table(s, d, "eval_items").where("benchmark = 'gsm8k'").select("benchmark", F.lit("main").alias("subset"), F.col("example_id").alias("was"), "prompt"), "gsm8k", "subset", ["was"]).unionByName(files.snapshot(table(s, d, "eval_items").where("benchmark = 'bbh'").select("benchmark", "subset", F.col("example_id").alias("was"), "prompt"), "bbh", "subset", ["was"])).select("example_id", "was"),
    "instruction_families": lambda s, d: sampling.family_counts(table(s, d, "eval_items"), "instruction_id_list"),
    "score_unpivot": lambda s, d: metrics.metric_rows(_outputs(s, d)).select("adapter", "example_id", "benchmark", "metric", F.round("value", 9).alias("value")),
    "metrics_seed": lambda s, d: metrics.seed_metrics(_outputs(s, d)).withColumn("value", F.round("value", 9)),
    "metrics_strategy": lambda s, d: metrics.strategy_metrics(metrics.seed_metrics(_outputs(s, d))).select("strategy", "metric", "n_runs", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd")),
    "group_macro_worst": lambda s, d: metrics.task_summary(metrics.metric_rows(_outputs(s, d)).where("metric = 'bbh'")).select("adapter", F.round("macro", 9).alias("macro"), F.round("worst", 9).alias("worst"), "tasks"),
    "paired_diff": lambda s, d: _paired(s, d).withColumn("difference", F.round("difference", 9)),
    "paired_bootstrap": lambda s, d: metrics.bootstrap(_paired(s, d), REPLICATES).select("metric", "n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")]),
    "bootstrap_contrasts": _contrasts,
    "sign_counts": lambda s, d: metrics.sign_counts(metrics.metric_rows(_outputs(s, d)), BASE, TREATMENT),
    "metrics_wide": lambda s, d: metrics.seed_columns(metrics.seed_metrics(_outputs(s, d)), [13, 42, 2026]).select("strategy", "metric", *[F.round(c, 9).alias(c) for c in ("seed_13", "seed_42", "seed_2026", "mean", "sd")], "n_runs"),
    "seed_lists": lambda s, d: metrics.seed_lists(metrics.seed_metrics(_outputs(s, d))),
    "accuracy_summary": lambda s, d: metrics.accuracy_summary(_outputs(s, d)).withColumn("accuracy", F.round("accuracy", 9)),
    "overlap_matrix": lambda s, d: audit.overlap_matrix(table(s, d, "eval_outputs"), "adapter", "example_id"),
    "agreement": _agreement,
    "parse_states": lambda s, d: audit.parse_states(judge.first_judgements(table(s, d, "judge_results"))),
    "spearman": lambda s, d: audit.spearman(audit.parsed_judgements(table(s, d, "judge_results")), "dimension", "a", "b").withColumn("rho", F.round("rho", 9)),
    "judge_normal": _normal_judgements,
    "judge_sources": lambda s, d: judge.source_means(_judged(s, d)).withColumn("mean_overall", F.round("mean_overall", 9)),
    "judge_distribution": lambda s, d: judge.score_distribution(_judged(s, d)),
    "judge_structure": lambda s, d: judge.structural_checks(judge.first_judgements(table(s, d, "judge_results")), table(s, d, "records")),
    "audit_found": lambda s, d: audit.found_in(judge.first_judgements(table(s, d, "judge_results")), table(s, d, "records"), "example_id"),
    "quality_statistics": lambda s, d: audit.score_statistics(table(s, d, "records"), "source", "quality_score").select("source", "n_rows", "n", *[F.round(c, 9).alias(c) for c in ("mean", "median", "least", "most")]),
    "manifest_members": lambda s, d: audit.membership_counts(table(s, d, "eval_outputs"), "adapter", "example_id"),
    "manifest_repeats": lambda s, d: audit.first_rows(audit.membership(table(s, d, "eval_outputs").select("strategy", "example_id").distinct(), "strategy", "example_id"), ["example_id"]),
    "quality_mismatches": lambda s, d: audit.score_mismatches(_recomputed(s, d), "stored", "computed").agg(F.count(F.lit(1)).alias("mismatches")),
    "quality_mismatch_rows": lambda s, d: audit.first_rows(audit.score_mismatches(_recomputed(s, d), "stored", "computed").distinct(), ["example_id", "source_row", "stored"]),
    "first_wins": lambda s, d: audit.first_wins([table(s, d, "eval_items").where(f"benchmark = '{b}'").select("benchmark", "example_id", "subset") for b in ("bbh", "gsm8k", "ifeval")], "example_id", ["benchmark", "subset"]).select("example_id", "benchmark"),
    "language_guess": lambda s, d: _texts(s, d).select("doc_id", language.language_guess(F.col("text")).alias("language")),
    "structural_flags": lambda s, d: messages.flag_counts(messages.structural_flags(table(s, d, "records"))),
    "script_guess": lambda s, d: _texts(s, d).select(T.script_guess(F.col("text")).alias("script")).groupBy("script").agg(F.count(F.lit(1)).alias("n")),
    "quality_tertiles": lambda s, d: sampling.tertile_labels(table(s, d, "records").where("quality_score IS NOT NULL").select("example_id", "quality_score"), "quality_score", "example_id").groupBy("tertile").agg(F.count(F.lit(1)).alias("n"), F.min("quality_score").alias("lo"), F.max("quality_score").alias("hi")),
    "stream_dedup": lambda s, d: streams.drained(streams.dedup(_stream(s, d).select("user_id"), "user_id"), streams.fresh_folder(s)),
    "stream_counts": lambda s, d: streams.drained(_stream(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), streams.fresh_folder(s), "complete"),
}
