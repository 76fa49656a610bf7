"""The whole selection of a manifest: pool, quotas, an order for each stratum, greedy taking, top-up, exact fit and final order."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.functions import plugins
from lodecast.functions.text import priority
from lodecast.operators import budget, messages, pool
from lodecast.runtime import cut_lineage, ship_by_value

ship_by_value(__name__)

STRATEGIES = ("random", "quality", "diversity")
KEEP = ["example_id", "source", "source_row", "length_bin", "stratum", "token_count", "quality_score", "text", "messages"]


def hashed_words(texts: list[str], width: int = 256) -> np.ndarray:
    """One unit vector a text: counts of its lower-case words, hashed into width places with a sign."""
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts, strict=True):
        for w in text.lower().split():
            h = zlib.crc32(w.encode("utf-8", "replace"))
            row[h % width] += 1 if h & 0x8000_0000 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


plugins.register(plugins.EMBEDDERS, "hashed_words", hashed_words)


def cluster_count(n: int) -> int:
    """max(2, the square root of n, rounded half to even), no more than n."""
    return min(n, max(2, round(n**0.5)))


def k_means(vectors: np.ndarray, k: int, seed: int, rounds: int = 30) -> np.ndarray:
    """The cluster of each vector: first centres far from each other by seeded draws, then alternating until nothing changes."""
    draw = np.random.default_rng(seed)
    centres = [vectors[draw.integers(len(vectors))]]
    far = ((vectors - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = far.sum()
        at = int(np.searchsorted(np.cumsum(far), draw.random() * total)) if total > 0 else 0
        centres.append(vectors[min(at, len(vectors) - 1)])
        far = np.minimum(far, ((vectors - centres[-1]) ** 2).sum(axis=1))
    middle = np.array(centres)
    label = np.full(len(vectors), -1)
    for _ in range(rounds):
        now = ((vectors**2).sum(axis=1)[:, None] - 2 * vectors @ middle.T + (middle**2).sum(axis=1)[None, :]).argmin(axis=1)
        if (now == label).all():
            break
        label = now
        for c in np.unique(label):
            middle[c] = vectors[label == c].mean(axis=0)
    return label


def clustered(rows: DataFrame, group: str, ident: str, text: str, seed: int, embedder: str = "hashed_words") -> DataFrame:
    """rows with cluster: the texts of each group are embedded and clustered, cluster_count(n) clusters for n rows; groups of one or two rows have none of their own.

    One function call a group: groups are capped strata of the pool. Equal texts get equal vectors; the rows are put in
    order of their ids first, so that the result doesn't depend on how they lie.
    """
    embed = plugins.named(plugins.EMBEDDERS, embedder)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        label = np.zeros(len(pdf), dtype=int) if len(pdf) <= 2 else k_means(embed(pdf["_text"].tolist()), cluster_count(len(pdf)), seed)
        return pd.DataFrame({"_id": pdf["_id"], "cluster": label})

    kind = rows.schema[ident].dataType.simpleString()
    got = rows.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(group).alias("_group")).groupBy("_group").applyInPandas(run, f"_id {kind}, cluster int")
    return rows.join(got.withColumnRenamed("_id", ident), ident)


def ordered(candidates: DataFrame, strategy: str, seed: int, floor: float = 0.55, embedder: str = "hashed_words") -> DataFrame:
    """candidates with position: their order in their stratum by a strategy; quality and diversity leave out what is below the floor."""
    if strategy == "random":
        return pool.numbered(candidates, "stratum", pool.random_order(seed, "example_id"))
    kept = candidates.where(F.col("quality_score") >= floor)
    if strategy == "quality":
        return pool.numbered(kept, "stratum", pool.quality_order("quality_score", "example_id"))
    if strategy != "diversity":
        raise ValueError(f"unknown strategy {strategy!r}")
    # Strata of one or two rows keep the order of the pool: by source_row and id.
    few = kept.groupBy("stratum").agg((F.count(F.lit(1)) <= 2).alias("_few"))
    rows = clustered(kept.join(few, "stratum"), "stratum", "example_id", "text", seed, embedder)
    rows = rows.withColumn("_first", F.when(F.col("_few"), F.col("source_row"))).withColumn("_score", F.when(~F.col("_few"), F.col("quality_score")))
    best = [F.col("_first").asc(), F.col("_score").desc(), F.when(~F.col("_few"), priority(seed, F.col("example_id"))).asc(), F.col("example_id").asc()]
    ranked = pool.numbered(rows, ["stratum", "cluster"], best, "cluster_rank")
    return pool.numbered(ranked, "stratum", [F.col("cluster_rank").asc(), F.col("cluster").asc()]).select(*candidates.columns, "position")


def candidate_pool(records: DataFrame, cap: int = 1000, seed: int = 0, tokens: str = "words_and_marks", most: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The capped pool (columns of KEEP) and the totals of all strata before the cap: valid rows, first of equal ones by (source, source_row)."""
    first = cut_lineage(pool.first_of_equal(messages.candidate_rows(records, most, tokens).select(*KEEP), "example_id", ["source", "source_row"]))
    return cut_lineage(pool.capped(first, "stratum", "example_id", cap, seed)), pool.stratum_totals(first)


def select(records: DataFrame, strategy: str, target: int, seed: int = 13, cap: int = 1000, floor: float = 0.55, pool_seed: int = 0, embedder: str = "hashed_words", tokens: str = "words_and_marks") -> tuple[DataFrame, DataFrame]:
    """The manifest of a strategy (KEEP without stratum, and place) and, by stratum, the rows and tokens taken before the top-up.

    Quotas come from the totals of all valid rows. Each stratum is taken greedily within its quota; if tokens are missing, one
    pass over the leftovers of all strata tops up, and the exact fit corrects the rest with any row of the pool. place is
    the position by (source, source_row, example_id).
    """
    candidates, totals = candidate_pool(records, cap, pool_seed, tokens)
    quotas = budget.largest_remainder(totals, "stratum", "n_tokens", target)
    lined = cut_lineage(ordered(candidates, strategy, seed, floor, embedder).select("stratum", "example_id", "token_count", "position"))
    taken = cut_lineage(budget.greedy_take(lined, "stratum", "example_id", "token_count", "position", quotas))
    topped = budget.top_up(lined, taken, "stratum", "example_id", "token_count", "position", target)
    final = budget.exact_fit(candidates.select("example_id", "token_count"), topped, "example_id", "token_count", target)
    chosen = candidates.join(final, "example_id", "left_semi").drop("stratum")
    manifest = pool.numbered(chosen, None, [F.col("source").asc(), F.col("source_row").asc(), F.col("example_id").asc()], "place")
    before = taken.join(lined.select("example_id", "token_count"), "example_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("token_count").cast("bigint").alias("n_tokens"))
    return manifest, before


def summary(manifest: DataFrame, target: int) -> DataFrame:
    """n_rows, actual_tokens, target_tokens, exact of a manifest; one row."""
    total = F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint")
    return manifest.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("actual_tokens"), F.lit(target).cast("bigint").alias("target_tokens"), (total == target).alias("exact"))


def replaced(chosen: DataFrame, removed: DataFrame, added: DataFrame, ident: str) -> DataFrame:
    """The chosen rows without those whose id is removed, and the added rows; a row that is added again counts once."""
    kept = chosen.join(removed.select(ident), ident, "left_anti").select(*chosen.columns)
    return kept.unionByName(added.join(kept.select(ident), ident, "left_anti").select(*chosen.columns))
