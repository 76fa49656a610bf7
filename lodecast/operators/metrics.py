"""Metric rows, per-seed and per-strategy metrics, paired differences, bootstrap intervals and sign counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["adapter", "strategy", "seed"]


def distinct_outputs(outputs: DataFrame) -> DataFrame:
    """One row per output_id, of outputs with an item: every attempt counts, only repeated rows are dropped."""
    return outputs.where("example_id IS NOT NULL").dropDuplicates(["output_id"])


def _mean(c: Column) -> Column:
    """Mean of a list of booleans, null where it is null or empty."""
    return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))) / F.size(c))


def metric_rows(outputs: DataFrame) -> DataFrame:
    """adapter, strategy, seed, benchmark, subset, example_id, metric, value: one row per output and metric; absent scores have no rows."""
    s = F.col("score")
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), v.alias("value"))
            for n, v in (
                ("prompt_strict", s["prompt_level_strict"].cast("double")), ("instruction_strict", _mean(s["instruction_level_strict"])), ("prompt_loose", s["prompt_level_loose"].cast("double")),
                ("instruction_loose", _mean(s["instruction_level_loose"])), ("gsm8k", s["exact_match"].cast("double")), ("bbh", s["normalized_accuracy"].cast("double")),
            )
        ]
    )
    return outputs.where("score IS NOT NULL").select(*KEYS, "benchmark", "subset", "example_id", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def seed_metrics(outputs: DataFrame) -> DataFrame:
    """adapter, strategy, seed, metric, value: means over items; of the instruction metrics, means over all instructions."""
    macro = metric_rows(outputs).where("metric NOT LIKE 'instruction%'").groupBy(*KEYS, "metric").agg(F.avg("value").alias("value"))
    parts = []
    for name, field in (("instruction_strict", "instruction_level_strict"), ("instruction_loose", "instruction_level_loose")):
        c = F.col("score")[field]
        true = F.sum(F.size(F.filter(c, lambda x: x)))
        every = F.sum(F.size(c))
        got = outputs.where(F.size(F.col("score")[field]) > 0).groupBy(*KEYS).agg((true / every).alias("value")).withColumn("metric", F.lit(name))
        parts.append(got.select(*KEYS, "metric", "value"))
    return macro.unionByName(parts[0]).unionByName(parts[1])


def strategy_metrics(seeds: DataFrame) -> DataFrame:
    """strategy, metric, n_seeds, mean, sd: sample standard deviation over runs, 0.0 for a single one."""
    return seeds.groupBy("strategy", "metric").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def task_summary(rows: DataFrame) -> DataFrame:
    """adapter, macro, worst, tasks: mean and least of the tasks' means of metric rows."""
    tasks = rows.groupBy("adapter", "subset").agg(F.avg("value").alias("m"))
    return tasks.groupBy("adapter").agg(F.avg("m").alias("macro"), F.min("m").alias("worst"), F.count(F.lit(1)).alias("tasks"))


def paired_items(rows: DataFrame, base: str, treatment: str) -> DataFrame:
    """metric, example_id, difference: mean over the common seeds of treatment minus base, of the items that all common seeds of both have."""
    both = rows.where(F.col("strategy").isin(base, treatment)).groupBy("metric", "example_id", "seed", "strategy").agg(F.avg("value").alias("v"))
    wide = both.groupBy("metric", "example_id", "seed").agg(F.max(F.when(F.col("strategy") == base, F.col("v"))).alias("b"), F.max(F.when(F.col("strategy") == treatment, F.col("v"))).alias("t"))
    paired = wide.where("b IS NOT NULL AND t IS NOT NULL")
    seeds = paired.groupBy("metric").agg(F.count_distinct("seed").alias("k"))
    items = paired.groupBy("metric", "example_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("t") - F.col("b")).alias("difference"))
    return items.join(F.broadcast(seeds), "metric").where("n = k").select("metric", "example_id", "difference")


def bootstrap(paired: DataFrame, replicates: int) -> DataFrame:
    """metric, n, mean, low, high: mean difference and the 2.5 and 97.5 percentiles of resampled means.

    The k-th draw of a replicate is the item at index hash(replicate, k) mod n, items in order of their ids, so that results
    are the same everywhere. The differences of a metric, one for each evaluation item, are one array; each replicate sums
    its draws out of it, so that no draw becomes a row and nothing is joined.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct("example_id", "difference"))), lambda x: x["difference"])
    sizes = paired.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("difference").alias("mean"), items.alias("items"))
    each = sizes.select("metric", "n", "mean", "items", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    each = each.repartition(each.sparkSession.sparkContext.defaultParallelism, "metric", "rep")
    total = F.expr("aggregate(sequence(0, cast(n as int) - 1), 0D, (a, k) -> a + get(items, cast(pmod(cast(conv(substring(md5(concat(rep, ':', k)), 1, 8), 16, 10) as bigint), n) as int)))")
    means = each.select("metric", "n", "mean", (total / F.col("n")).alias("m"))
    return means.groupBy("metric", "n", "mean").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def sign_counts(rows: DataFrame, base: str, treatment: str) -> DataFrame:
    """metric, higher, equal, lower: over (task, seed), how the treatment's mean compares with the base's."""
    means = rows.where(F.col("strategy").isin(base, treatment)).groupBy("metric", "subset", "seed", "strategy").agg(F.avg("value").alias("v"))
    wide = means.groupBy("metric", "subset", "seed").agg(F.max(F.when(F.col("strategy") == base, F.col("v"))).alias("b"), F.max(F.when(F.col("strategy") == treatment, F.col("v"))).alias("t")).where("b IS NOT NULL AND t IS NOT NULL")
    same = F.abs(F.col("t") - F.col("b")) < 1e-12
    return wide.groupBy("metric").agg(F.count_if(~same & (F.col("t") > F.col("b"))).alias("higher"), F.count_if(same).alias("equal"), F.count_if(~same & (F.col("t") < F.col("b"))).alias("lower"))


def seed_columns(seeds: DataFrame, values: list[int]) -> DataFrame:
    """strategy, metric, one column seed_<n> for each of the given seeds (null without a run), n_runs, mean and sd.

    Runs of one strategy and seed under several adapters are averaged. The seeds are given, so that columns don't depend on the data.
    """
    wide = seeds.where(F.col("seed").isin(*values)).groupBy("strategy", "metric").pivot("seed", values).agg(F.avg("value"))
    wide = wide.withColumnsRenamed({str(v): f"seed_{v}" for v in values})
    return strategy_metrics(seeds).join(wide, ["strategy", "metric"], "left").select("strategy", "metric", *[f"seed_{v}" for v in values], "n_runs", "mean", "sd")


def seed_lists(seeds: DataFrame) -> DataFrame:
    """strategy, metric, seeds: the seeds in order of the adapters, joined by commas."""
    runs = F.array_sort(F.collect_set(F.struct("adapter", "seed")))
    return seeds.groupBy("strategy", "metric").agg(F.array_join(F.transform(runs, lambda r: r["seed"].cast("string")), ",").alias("seeds"))


def accuracy_summary(outputs: DataFrame) -> DataFrame:
    """adapter, benchmark, n, accuracy: the mean of the one score that stands for each benchmark, over its scored outputs."""
    s = F.col("score")
    value = F.when(F.col("benchmark") == "ifeval", s["prompt_level_strict"]).when(F.col("benchmark") == "gsm8k", s["exact_match"]).when(F.col("benchmark") == "bbh", s["normalized_accuracy"])
    return outputs.select("adapter", "benchmark", value.cast("double").alias("v")).where("v IS NOT NULL").groupBy("adapter", "benchmark").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("accuracy"))
