"""Positions of rows in an order, for groups of any size: no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.runtime import cut_lineage


def numbered(df: DataFrame, group: str | list[str] | None, order: list[Column], name: str = "position") -> DataFrame:
    """df with the position, from 1, of each row in its group.

    Rows are spread by ranges of (group, order), so that a group of a third of all rows is cut into many ranges. Rows are
    ranked in their range, and the sizes of the ranges before it, a table of one row a range and group, are added. Null
    groups are one group; ties get positions in no defined order, as with row_number. The ranges are written before they are counted, because both uses must see the same ones.
    """
    groups = [group] if isinstance(group, str) else list(group or [])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut_lineage(df.repartitionByRange(parts, *[F.col(g) for g in groups], *order).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0))).drop("_size")
    before = before.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], "_before")
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    inside = spread.withColumn(name, F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order)))
    return inside.join(before, same).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*df.columns, name)


def filled(df: DataFrame, by: list[str], key: list[str], size: str, total: str, name: str = "taken") -> DataFrame:
    """df with name: `total` units of each group `by` dealt to its rows in rounds, one each in order of key, while `size` lasts.

    Closed form over the rows in order of size: a row is used up where dealing as much to each row from it on keeps within
    the total; all others share what is left alike, the first by key one more. One row a category is expected.
    """
    every, rest = Window.partitionBy(*by), Window.partitionBy(*by, "_full")
    w = Window.partitionBy(*by).orderBy("_cap", *key)
    df = df.withColumn("_cap", F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("decimal(38,0)")).withColumn("_sum", F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_after", F.count(F.lit(1)).over(every) - F.row_number().over(w))
    df = df.withColumn("_full", F.col("_sum") + F.col("_cap") * F.col("_after") <= F.col(total))
    df = df.withColumn("_left", F.greatest(F.lit(0), F.col(total) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0))).cast("bigint"))
    df = df.withColumn("_many", F.count(F.lit(1)).over(rest)).withColumn("_turn", F.row_number().over(rest.orderBy(*key)))
    share = F.floor(F.col("_left") / F.col("_many")) + (F.col("_turn") <= F.col("_left") % F.col("_many")).cast("bigint")
    out = F.when(F.col("_full"), F.col("_cap").cast("bigint")).otherwise(share).cast("bigint")
    return df.withColumn(name, out).drop("_cap", "_sum", "_after", "_full", "_left", "_many", "_turn")
