"""Balanced evaluation subsets and audit samples."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.functions.text import priority
from lodecast.operators.ranks import filled
from lodecast.runtime import broadcast_small, ship_by_value

ship_by_value(__name__)


def rank_buckets(df: DataFrame, group: str | None, order: list[Column], parts: int) -> DataFrame:
    """df with bucket = floor((rank - 1) * parts / n) within its group; this differs from ntile where n % parts > 0."""
    by = [group] if group else []
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("bucket", F.least(F.lit(parts - 1), F.floor(rank * parts / size)).cast("int"))


def water_fill(capacity: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """key, taken: total units dealt in rounds by key, one each while capacity lasts; in closed form, so that the work depends on the number of keys alone."""
    return filled(capacity.select(key, size).withColumn("_total", F.lit(total)), [], [key], size, "_total").select(key, "taken")


def sample_groups(df: DataFrame, group: str, ident: str, counts: DataFrame, seed: int) -> DataFrame:
    """The first `taken` rows of each group by seeded hash.

    The greatest of the counts is a constant of the plan, so that each partition passes on at most as many rows of a group, however large it is.
    """
    most = counts.agg(F.max("taken")).first()[0] or 0
    w = Window.partitionBy(group).orderBy(priority(seed, F.col(ident)), ident)
    first = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return first.join(broadcast_small(counts), group).where(F.col("_n") <= F.col("taken")).drop("_n", "taken")


def equal_per_group(df: DataFrame, group: str, ident: str, k: int, seed: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(priority(seed, F.col(ident)), ident)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def coverage_greedy(df: DataFrame, ident: str, families: str, total: int, seed: int) -> DataFrame:
    """ident of `total` rows that cover all families: one pick for each family in order, then by the sum of 1 / (1 + covered).

    Each pick depends on all before, so this is one function; it is meant for item lists, which are small by nature.
    Ties go to the least seeded hash. Errors where total is less than the number of families.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {i: sorted(set(f)) for i, f in zip(pdf["_id"], pdf["_f"], strict=True)}
        names = sorted({x for f in rows.values() for x in f})
        if total < len(names):
            raise ValueError(f"{total} rows cannot cover {len(names)} families")
        tie = {i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:16] for i in rows}
        covered, left, chosen = dict.fromkeys(names, 0), dict(rows), []

        def pick(pool: list, gain) -> None:
            i = min(pool, key=lambda i: (-gain(i), tie[i]))
            chosen.append(i)
            for f in left.pop(i):
                covered[f] += 1

        for name in names:
            pool = [i for i, f in left.items() if name in f]
            if pool:
                pick(pool, lambda i: sum(covered[f] == 0 for f in rows[i]))
        while left and len(chosen) < total:
            pick(list(left), lambda i: sum(1 / (1 + covered[f]) for f in rows[i]))
        return pd.DataFrame({"_id": sorted(chosen)}, dtype=object)

    kind = df.schema[ident].dataType.simpleString()
    picked = df.select(F.col(ident).alias("_id"), F.col(families).alias("_f")).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, f"_id {kind}")
    return picked.withColumnRenamed("_id", ident)


def tertile_labels(df: DataFrame, score: str, ident: str) -> DataFrame:
    """df with tertile: low up to the value at position n div 3 of the sorted scores, mid up to the one at 2n div 3, else high.

    The cuts are the values at two positions; they are found from the counts of distinct values, not by ranking all rows in one window.
    """
    counts = df.groupBy(F.col(score).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = counts.withColumn("_to", F.sum("_c").over(Window.orderBy("_v"))).withColumn("_all", F.sum("_c").over(Window.partitionBy()))
    cut = lambda k: F.min(F.when(F.col("_to") > F.floor(F.col("_all") * k / 3), F.col("_v")))
    cuts = run.agg(cut(1).alias("_c1"), cut(2).alias("_c2"))
    label = F.when(F.col(score) <= F.col("_c1"), "low").when(F.col(score) <= F.col("_c2"), "mid").otherwise("high")
    return df.crossJoin(F.broadcast(cuts)).withColumn("tertile", label).drop("_c1", "_c2")


def audit_counts(sizes: DataFrame, key: str, size: str, total: int, seed: int) -> DataFrame:
    """key, taken: the same number for each stratum, one more for the first ones by key while the rest of the division lasts, no more than
    it has; what is then missing is dealt in rounds to those with rows left, in seeded order of the strata."""
    every = Window.partitionBy()
    df = sizes.withColumn("_k", F.count(F.lit(1)).over(every)).withColumn("_at", F.row_number().over(Window.orderBy(key)))
    base = F.floor(F.lit(total) / F.col("_k")) + (F.col("_at") <= F.lit(total) % F.col("_k")).cast("bigint")
    df = df.withColumn("_base", F.least(F.col(size), base)).withColumn("_rest", F.col(size) - F.col("_base")).withColumn("_total", F.lit(total) - F.sum("_base").over(every)).withColumn("_turn", priority(seed, F.col(key)))
    return filled(df, [], ["_turn", key], "_rest", "_total", "_more").select(key, (F.col("_base") + F.col("_more")).alias("taken"))


def audit_sample(df: DataFrame, source: str, score: str, ident: str, size: int, seed: int) -> DataFrame:
    """ident, source, tertile, audit_id of a sample spread evenly over (source, tertile), in random order; all rows where there are fewer.

    See audit_counts for the numbers of the strata.
    """
    labelled = tertile_labels(df.select(ident, source, score), score, ident).withColumn("_stratum", F.concat_ws("|", source, "tertile"))
    have = labelled.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_size"))
    picked = sample_groups(labelled, "_stratum", ident, audit_counts(have, "_stratum", "_size", size, seed), seed)
    w = Window.orderBy(priority(seed + 1, F.col(ident)), ident)
    return picked.withColumn("audit_id", F.format_string("audit-%03d", F.row_number().over(w))).select(ident, source, "tertile", "audit_id")


def family_counts(df: DataFrame, families: str) -> DataFrame:
    """family, n: how many rows have each family; their number is the least size of a coverage sample."""
    return df.select(F.explode(F.array_distinct(families)).alias("family")).where("family IS NOT NULL").groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def rejoined(chosen: DataFrame, rows: DataFrame, ordinal: str) -> DataFrame:
    """The rows at the chosen ordinals, in their order of columns; an ordinal that no row has is an error."""
    got = chosen.select(F.col(ordinal).alias("_o")).distinct().join(rows.withColumn("_there", F.lit(True)), F.col("_o") == F.col(ordinal), "left")
    found = F.assert_true(F.coalesce("_there", F.lit(False)), F.concat(F.lit("no row at "), F.coalesce(F.col("_o").cast("string"), F.lit("null"))))
    return got.where(found.isNull()).select(*rows.columns)
