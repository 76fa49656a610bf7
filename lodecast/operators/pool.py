"""The candidate pool: first of equal rows, capped strata, counters, and seeded or ranked orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.functions.text import priority
from lodecast.operators.ranks import numbered


def first_of_equal(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows with one key the first by order; pre-aggregated before the shuffle, so that a hot key costs one row a partition."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = df.groupBy(key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_b"))
    return best.select(key, "_b.*").select(*df.columns)


def stratum_totals(pool: DataFrame) -> DataFrame:
    """stratum, rows, tokens."""
    return pool.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("token_count").cast("bigint").alias("n_tokens"))


def capped(df: DataFrame, group: str, ident: str, cap: int, seed: int = 0) -> DataFrame:
    """At most cap rows of each group: those of least priority. The limit is applied in each partition before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy("_p", ident)
    return df.withColumn("_p", priority(seed, F.col(ident))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_p", "_n")


def random_order(seed: int, ident: str) -> list[Column]:
    return [priority(seed, F.col(ident)).asc(), F.col(ident).asc()]


def quality_order(score: str, ident: str) -> list[Column]:
    """Best first; equal scores by hash, then id; no seed."""
    return [F.col(score).desc(), F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 16).asc(), F.col(ident).asc()]


def cluster_round_robin(df: DataFrame, group: str, cluster: str, score: str, ident: str, seed: int) -> DataFrame:
    """The diversity order: rank in cluster by score and seeded hash, then all first ranks by cluster, all second ranks, and so on."""
    best = [F.col(score).desc(), priority(seed, F.col(ident)).asc(), F.col(ident).asc()]
    return numbered(numbered(df, [group, cluster], best, "cluster_rank"), group, [F.col("cluster_rank").asc(), F.col(cluster).asc()])
