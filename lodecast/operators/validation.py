"""Completeness of evaluation outputs: ids, malformed rows, score shapes, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecast.functions.text import token_count

#: A character that is no white space.
SOLID = r"[^\t-\r\x1c-\x20\x85\p{Z}]"


def valid_score(benchmark: Column, score: Column, instructions: Column | None = None) -> Column:
    """Whether a score has what its benchmark needs; instruction lists must be as long as the item's, where that is given."""
    whole = lambda c: c.isNotNull() & ~F.exists(c, lambda x: x.isNull())
    strict, loose = score["instruction_level_strict"], score["instruction_level_loose"]
    lists = whole(strict) & whole(loose) & (F.size(strict) == F.size(loose))
    if instructions is not None:
        lists = lists & (instructions.isNull() | (F.size(strict) == F.size(instructions)))
    ifeval = score["prompt_level_strict"].isNotNull() & score["prompt_level_loose"].isNotNull() & lists
    ok = F.when(benchmark == "ifeval", ifeval).when(benchmark == "gsm8k", score["exact_match"].isNotNull()).when(benchmark == "bbh", score["normalized_accuracy"].isNotNull())
    return F.coalesce(score.isNotNull() & ok, F.lit(False))


# The most tokens that a response of each benchmark was allowed.
TOKEN_CAPS = {"ifeval": 512, "gsm8k": 128, "bbh": 128}


def expected_items(items: DataFrame) -> DataFrame:
    """benchmark, example_id, _list: the distinct items and their instructions, of repeated ones the least list."""
    return items.where("benchmark IS NOT NULL AND example_id IS NOT NULL").groupBy("benchmark", "example_id").agg(F.min("instruction_id_list").alias("_list"))


def possibly_cut(benchmark: Column, tokens: Column, caps: dict[str, int] = TOKEN_CAPS) -> Column:
    """Whether a response has as many tokens as its benchmark allows, so that it may have been cut; false for unknown benchmarks."""
    cap = F.lit(None).cast("int")
    for name, most in caps.items():
        cap = F.when(benchmark == name, most).otherwise(cap)
    return F.coalesce(tokens >= cap, F.lit(False))


def completeness(outputs: DataFrame, items: DataFrame, caps: dict[str, int] = TOKEN_CAPS) -> DataFrame:
    """One row per adapter and benchmark of the items, with or without rows: n_rows, expected, ids, duplicate_ids, missing_ids,
    extra_ids, malformed (blank response or unusable score), empty_responses, possibly_cut, min_tokens, mean_tokens and
    max_tokens (of well-formed rows), scored and complete.

    complete: as many rows as items, each well-formed, and no id repeated, missing or unknown. Ids are counted by distinct
    pairs; no list of ids is gathered anywhere. The items are joined as Spark sees fit: their size is not assumed.
    """
    expected = expected_items(items)
    names = outputs.where("adapter IS NOT NULL").select("adapter").distinct()
    sizes = expected.groupBy("benchmark").agg(F.count(F.lit(1)).alias("expected"))
    rows = outputs.where("adapter IS NOT NULL").select("adapter", "benchmark", "example_id", "response", "score").join(expected, ["benchmark", "example_id"], "left")
    blank = F.coalesce(~F.col("response").rlike(SOLID), F.lit(True))
    good = ~blank & valid_score(F.col("benchmark"), F.col("score"), F.col("_list"))
    rows = rows.select("adapter", "benchmark", blank.alias("_blank"), F.when(good, token_count(F.col("response"))).alias("_tokens"))
    rows = rows.withColumn("_cut", possibly_cut(F.col("benchmark"), F.col("_tokens"), caps))
    base = rows.groupBy("adapter", "benchmark").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_tokens").isNull()).alias("malformed"), F.count_if("_blank").alias("empty_responses"), F.count_if("_cut").alias("possibly_cut"),
        F.min("_tokens").alias("min_tokens"), F.avg("_tokens").alias("mean_tokens"), F.max("_tokens").alias("max_tokens"), F.count("_tokens").alias("scored"),
    )
    known = counted_ids(outputs, expected).groupBy("adapter", "benchmark").agg(
        F.count(F.lit(1)).alias("ids"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.count_if(~F.col("known")).alias("extra_ids"), F.count_if("known").alias("_found")
    )
    out = names.crossJoin(sizes).join(base, ["adapter", "benchmark"], "left").join(known, ["adapter", "benchmark"], "left")
    out = out.na.fill(0, ["n_rows", "malformed", "empty_responses", "possibly_cut", "scored", "ids", "duplicate_ids", "extra_ids", "_found"]).withColumn("missing_ids", F.col("expected") - F.col("_found")).drop("_found")
    bad = sum((F.col(c) for c in ("duplicate_ids", "missing_ids", "extra_ids", "malformed")), F.lit(0))
    return out.withColumn("complete", (bad == 0) & (F.col("n_rows") == F.col("expected")))


def counted_ids(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """adapter, benchmark, example_id, n, known: each id of a run, how many rows it has, and whether an item has it."""
    ids = outputs.where("adapter IS NOT NULL AND example_id IS NOT NULL").groupBy("adapter", "benchmark", "example_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(expected.select("benchmark", "example_id", F.lit(True).alias("_there")), ["benchmark", "example_id"], "left").select("adapter", "benchmark", "example_id", "n", F.coalesce("_there", F.lit(False)).alias("known"))


def faulty_ids(outputs: DataFrame, items: DataFrame) -> DataFrame:
    """adapter, benchmark, example_id, fault: ids that are `duplicate` or `extra` in a run, and items that are `missing` in it."""
    expected = expected_items(items)
    ids = counted_ids(outputs, expected)
    names = outputs.where("adapter IS NOT NULL").select("adapter").distinct()
    missing = names.crossJoin(expected.select("benchmark", "example_id")).join(ids.select("adapter", "benchmark", "example_id"), ["adapter", "benchmark", "example_id"], "left_anti")
    wrong = ids.select("adapter", "benchmark", "example_id", F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate"), F.when(~F.col("known"), "extra")))).alias("fault"))
    return wrong.unionByName(missing.withColumn("fault", F.lit("missing")))


def completeness_total(rows: DataFrame) -> DataFrame:
    """files, all_complete, possibly_cut, responses: one row over all rows of completeness()."""
    return rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.bool_and("complete"), F.lit(True)).alias("all_complete"), F.coalesce(F.sum("possibly_cut"), F.lit(0)).alias("possibly_cut"), F.coalesce(F.sum("scored"), F.lit(0)).alias("responses"))


def asserted(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, or an error at run time where a row breaks the condition."""
    return df.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(message)).isNull())


def fixed_budget_gate(summaries: DataFrame, target: int = 1_000_000) -> DataFrame:
    """summaries with passed: actual and target tokens equal the budget, and the exact flag is set."""
    return summaries.withColumn("passed", F.coalesce((F.col("actual_tokens") == target) & (F.col("target_tokens") == target) & F.col("exact"), F.lit(False)))


def audit_gate(summary: DataFrame, manifests: int, rows: int, sampled: int) -> DataFrame:
    """summary with passed: the seven conditions on an audit summary.

    It is an automatic structural audit, nobody rated, and the numbers of manifests, rows, mismatches (0), sampled items and
    sampled items found are as expected. A null fails.
    """
    ok = (
        F.col("audit_type").startswith("automatic structural") & ~F.col("human_ratings_performed") & (F.col("manifest_count") == manifests) & (F.col("total_manifest_rows") == rows)
        & (F.col("mismatches") == 0) & (F.col("sampled") == sampled) & (F.col("found_in_manifests") == sampled)
    )
    return summary.withColumn("passed", F.coalesce(ok, F.lit(False)))


def alignment(left: DataFrame, right: DataFrame, ordinal: str, ident: str) -> DataFrame:
    """ordinal, left_id, right_id of the positions at which two tables differ: another id, or none."""
    a, b = left.select(ordinal, F.col(ident).alias("left_id"), F.lit(1).alias("_l")), right.select(ordinal, F.col(ident).alias("right_id"), F.lit(1).alias("_r"))
    both = a.join(b, ordinal, "full")
    return both.where("_l IS NULL OR _r IS NULL OR NOT left_id <=> right_id").select(ordinal, "left_id", "right_id")


def zipped(inputs: DataFrame, outputs: DataFrame, ordinal: str, ident: str) -> DataFrame:
    """inputs with the other columns of outputs at the same ordinal; an error where ids differ, or outputs go beyond the inputs."""
    rest = [c for c in outputs.columns if c not in (ordinal, ident)]
    got = outputs.select(F.col(ordinal).alias("_o"), F.col(ident).alias("_i"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(rest)], F.lit(1).alias("_has"))
    both = inputs.withColumn("_in", F.lit(1)).join(got, F.col(ordinal) == F.col("_o"), "full")
    ok = F.col("_has").isNull() | (F.col("_in").isNotNull() & F.col(ident).eqNullSafe(F.col("_i")))
    both = asserted(both, ok, "stored rows are not those of the inputs")
    return both.select(*[F.col(c) for c in inputs.columns], *[F.col(f"_c{k}").alias(c) for k, c in enumerate(rest) if c not in inputs.columns])


def named_run(c: Column) -> Column:
    """Struct of name, strategy and seed of `name=strategy=seed`; an error where it has not three parts or the seed is no number."""
    parts = F.split(c, "=")
    ok = (F.size(parts) == 3) & F.get(parts, F.lit(2)).rlike(r"^\s*[-+]?[0-9]+\s*$")
    made = F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("strategy"), F.trim(F.get(parts, F.lit(2))).cast("int").alias("seed"))
    return F.when(F.coalesce(ok, F.lit(False)), made).otherwise(F.raise_error(F.concat(F.lit("not name=strategy=seed: "), F.coalesce(c, F.lit("null")))).cast("struct<name:string,strategy:string,seed:int>"))
