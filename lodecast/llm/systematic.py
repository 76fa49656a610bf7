"""Systematic sampling with unequal probabilities over a table of any size.

Rows are ordered within sorted groups by a seeded hash; the prefix sums of their inclusion probabilities run across all
partitions: each group is cut into ranges of the hash, sums of the ranges are carried over as offsets, and only within a
range does a window run. A row is drawn where its prefix sum crosses an integer, counted from one random start.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range of the hash holds on average at most.
RANGE_ROWS = 200_000


def random_start(seed: int, name: str = "") -> float:
    """A start in [0, 1) that depends on the seed alone."""
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:12], 16) / 16**12


def order_key(seed: int, ident: Column) -> Column:
    """Hexadecimal digits that order rows randomly; ties of equal identifiers only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def ranked(df: DataFrame, groups: list[str], seed: int, ident: str, rows: int) -> DataFrame:
    """df with _key, _range and _rank, the position of a row in its group by _key, from 1; no window holds a whole large group."""
    digits = 0
    while rows / 16**digits > RANGE_ROWS and digits < 6:
        digits += 1
    keyed = df.withColumn("_key", order_key(seed, F.col(ident)))
    if not digits:
        return keyed.withColumn("_range", F.lit("")).withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy("_key", ident)).cast("bigint"))
    keyed = keyed.withColumn("_range", F.substring("_key", 1, digits))
    inside = keyed.withColumn("_at", F.row_number().over(Window.partitionBy(*groups, "_range").orderBy("_key", ident)))
    sizes = keyed.groupBy(*groups, "_range").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return inside.join(before, [*groups, "_range"]).withColumn("_rank", F.col("_at") + F.col("_before")).drop("_at", "_before")


def weighted_sample(df: DataFrame, weight: str, size: int, seed: int, ident: str, rows: int) -> DataFrame:
    """The rows of a sample of exactly min(size, rows with positive weight) rows, drawn with probability in proportion to weight.

    Rows whose share would exceed 1 are taken for sure and the rest is shared again, until none exceeds it. Rows of null
    or non-positive weight are never drawn. Weights are taken to 2**-20 of the mean, so that sums are exact.
    """
    base = df.where(F.col(weight) > 0)
    certain = None
    for _ in range(20):
        pool = base if certain is None else base.where(F.col(weight) < certain)
        sure = 0 if certain is None else base.where(F.col(weight) >= certain).count()
        total, n = pool.agg(F.sum(weight), F.count(F.lit(1))).first()
        left = min(size, sure + n) - sure
        if not total or left <= 0 or not pool.where(F.col(weight) * left > total).limit(1).count():
            break
        certain = total / left
    if not total or left <= 0:
        return base if certain is None and size > 0 else base.where(F.col(weight) >= certain) if certain is not None and size > 0 else base.limit(0)
    unit = 2.0**20 * n / total
    scaled = pool.withColumn("_w", F.greatest(F.lit(1), F.round(F.col(weight) * unit)).cast("bigint")).withColumn("_key", order_key(seed, F.col(ident)))
    digits = 0
    while rows / 16**digits > RANGE_ROWS and digits < 6:
        digits += 1
    digits = max(digits, 1)
    scaled = scaled.withColumn("_range", F.substring("_key", 1, digits))
    sums = scaled.groupBy("_range").agg(F.sum("_w").alias("_s"))
    whole = sums.agg(F.sum("_s")).first()[0]
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    run = F.sum("_w").over(Window.partitionBy("_range").orderBy("_key", ident).rowsBetween(Window.unboundedPreceding, 0))
    placed = scaled.withColumn("_run", run).join(F.broadcast(before), "_range").withColumn("_end", F.col("_run") + F.col("_before"))
    # The crossing of the k-th integer: floor(end * left / whole + start) grows there. Whole numbers keep it exact.
    start = int(random_start(seed) * whole)
    step = lambda c: F.expr(f"cast(floor((cast({c} as decimal(38,0)) * {left} + {start}) / {whole}) as bigint)")
    drawn = placed.where(step("_end") > step("(_end - _w)")).drop("_w", "_key", "_range", "_run", "_before", "_end")
    return drawn if certain is None else drawn.unionByName(base.where(F.col(weight) >= certain))
