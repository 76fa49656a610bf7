"""Overlap of manifests, agreement of two judge passes and rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators.judge import first_judgements


def overlap_matrix(members: DataFrame, manifest: str, ident: str) -> DataFrame:
    """a, b, shared: distinct ids that two manifests share, for every pair and the diagonal, zeros included.

    Each id carries the list of its manifests, which are few; pairs of lists are counted before any shuffle of pairs.
    """
    ids = members.where(F.col(manifest).isNotNull() & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_i")).agg(F.array_sort(F.collect_set(manifest)).alias("m"))
    counted = ids.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    pairs = counted.select("n", F.explode("m").alias("a"), "m").select("n", "a", F.explode("m").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    names = members.where(F.col(manifest).isNotNull()).select(F.col(manifest).alias("a")).distinct()
    every = names.crossJoin(names.withColumnRenamed("a", "b"))
    return every.join(pairs, ["a", "b"], "left").na.fill(0, ["shared"])


def parsed_judgements(results: DataFrame) -> DataFrame:
    """example_id, dimension, a, b of distinct rows whose passes both parsed and scored the dimension 1 to 5."""
    rows = first_judgements(results).where("pass_a.parse_ok AND pass_b.parse_ok")
    long = rows.select("example_id", F.col("pass_b.scores").alias("other"), F.explode("pass_a.scores").alias("dimension", "a"))
    return long.withColumn("b", F.try_element_at("other", F.col("dimension"))).where("a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5").select("example_id", "dimension", "a", "b")


def agreement(judged: DataFrame) -> DataFrame:
    """dimension, n, exact, mean_difference, mean_a, mean_b, share_at_most (of pass a), share_at_most_both, distinct_scores (of both passes, ascending)."""
    top = lambda c: (F.col(c) == 5).cast("double")
    return judged.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_difference"),
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(top("a")).alias("share_at_most"), F.avg((top("a") + top("b")) / 2).alias("share_at_most_both"),
        F.concat_ws(",", F.array_sort(F.array_union(F.collect_set("a"), F.collect_set("b")))).alias("distinct_scores"),
    )


def parse_states(results: DataFrame) -> DataFrame:
    state = lambda c: F.when(F.col(c).isNull(), "missing").when(F.coalesce(F.col(c)["parse_ok"], F.lit(False)), "ok").otherwise("failed")
    return results.groupBy(state("pass_a").alias("state_a"), state("pass_b").alias("state_b")).agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, n, rho: Spearman correlation with average ranks; null below two rows or for a constant column."""
    for c in (x, y):
        counts = df.groupBy(group, c).agg(F.count(F.lit(1)).alias("_c"))
        low = F.sum("_c").over(Window.partitionBy(group).orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        ranks = counts.withColumn(f"_r{c}", F.coalesce(low, F.lit(0)) + (F.col("_c") + 1) / 2.0).drop("_c")
        df = df.join(ranks, [group, c])
    got = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop(f"_r{x}", f"_r{y}"), F.stddev_pop(f"_r{x}") * F.stddev_pop(f"_r{y}")).alias("rho"), F.count_distinct(x).alias("_dx"), F.count_distinct(y).alias("_dy"))
    return got.select(group, "n", F.when((F.col("n") >= 2) & (F.col("_dx") > 1) & (F.col("_dy") > 1), F.col("rho")).alias("rho"))


def score_statistics(df: DataFrame, group: str, score: str) -> DataFrame:
    """group, n_rows, n, mean, median, least, most of a score; null where a group has no score. Null groups are `unknown`."""
    g = F.coalesce(F.col(group), F.lit("unknown")).alias(group)
    return df.groupBy(g).agg(F.count(F.lit(1)).alias("n_rows"), F.count(score).alias("n"), F.avg(score).alias("mean"), F.median(score).alias("median"), F.min(score).alias("least"), F.max(score).alias("most"))


def membership(members: DataFrame, manifest: str, ident: str) -> DataFrame:
    """ident, manifests (ascending, joined by commas), n: of the ids that several rows of the manifests have."""
    rows = members.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.concat_ws(",", F.array_sort(F.collect_set(manifest))).alias("manifests"), F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1")


def membership_counts(members: DataFrame, manifest: str, ident: str) -> DataFrame:
    """manifests, n_rows, unique_ids, repeated_ids: one row over all manifests; repeated are ids of more than one row."""
    ids = members.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count(F.lit(1)).alias("_n"))
    of_ids = ids.agg(F.count(F.lit(1)).alias("unique_ids"), F.count_if(F.col("_n") > 1).alias("repeated_ids"))
    return members.agg(F.count_distinct(manifest).alias("manifests"), F.count(F.lit(1)).alias("n_rows")).crossJoin(of_ids)


def first_rows(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows by order, as reports show them: a top-k, so that partitions pass on n rows each."""
    return df.orderBy(*order).limit(n)


def score_mismatches(df: DataFrame, stored: str, computed: str, tolerance: float = 1e-9) -> DataFrame:
    """The rows whose stored score is not the computed one; a null stored score counts as 0."""
    return df.where(F.abs(F.coalesce(F.col(stored), F.lit(0.0)) - F.col(computed)) > tolerance)


def found_in(items: DataFrame, records: DataFrame, ident: str) -> DataFrame:
    """items, found: how many rows of items have an id that some record has."""
    ids = records.select(ident).where(F.col(ident).isNotNull()).distinct().withColumn("_there", F.lit(1))
    return items.select(ident).join(ids, ident, "left").agg(F.count(F.lit(1)).alias("items"), F.count("_there").alias("found"))


def first_wins(manifests: list[DataFrame], ident: str, order: list[str]) -> DataFrame:
    """Rows of several manifests, one for each id: that of the first manifest in the list, in it the first by order."""
    from functools import reduce

    from lodecast.operators.pool import first_of_equal

    every = reduce(DataFrame.unionByName, [m.withColumn("_manifest", F.lit(k)) for k, m in enumerate(manifests)])
    return first_of_equal(every, ident, ["_manifest", *order]).drop("_manifest")
