"""A sample of records whose categories have given shares, with least numbers and a report of what cannot be filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecast.llm.systematic import random_start, ranked
from lodecast.llm.tokens import source_name
from lodecast.operators.ranks import filled
from lodecast.runtime import broadcast_small, cut_lineage

CATEGORY = ["source", "length_bin"]


def usable_records(records: DataFrame) -> DataFrame:
    """(example_id, source, length_bin): distinct records with non-null source and stored length_bin, sources in one spelling."""
    return (
        records.where("example_id IS NOT NULL AND source IS NOT NULL AND length_bin IS NOT NULL")
        .select("example_id", source_name(F.col("source")).alias("source"), F.col("length_bin"))
        .distinct()
    )


def category_plan(usable: DataFrame, mix: DataFrame) -> DataFrame:
    """One row per row of the mix: mix_name, source, length_bin, available, wanted, min_rows.

    wanted is target_share * sample_share * (distinct usable example_id). Null shares count as 0, null min_rows as 0,
    repeated rows once. The counts of categories are broadcast: one row for each (source, length_bin), not for records.
    """
    have = usable.groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("available"))
    everything = usable.agg(F.countDistinct("example_id").alias("_all"))
    rows = mix.select("mix_name", source_name(F.col("source")).alias("source"), "length_bin", "target_share", "min_rows", "sample_share").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        rows.join(broadcast_small(have), CATEGORY, "left")
        .crossJoin(F.broadcast(everything))
        .select(
            "mix_name", *CATEGORY, zero("available").cast("bigint").alias("available"),
            (zero("target_share").cast("double") * zero("sample_share").cast("double") * F.col("_all")).alias("wanted"), zero("min_rows").cast("bigint").alias("min_rows"),
        )
    )


def with_probability(plan: DataFrame) -> DataFrame:
    """plan with p, the probability of a record of each category: all p together give the stated size.

    Categories that have too few records give all of them; what they lack is shared among the others in proportion to
    wanted. With the categories sorted by available / wanted, the first m are exhausted, where the factor that is then
    left for the others, (size - their available) / wanted of the others, does not exhaust the next one too.
    """
    usable = (F.col("wanted") > 0) & (F.col("available") > 0)
    ratio = F.when(usable, F.col("available") / F.col("wanted"))
    w = Window.partitionBy("mix_name", "_in").orderBy("_ratio", *CATEGORY).rowsBetween(Window.unboundedPreceding, -1)
    every, inside = Window.partitionBy("mix_name"), Window.partitionBy("mix_name", "_in")
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    plan = plan.withColumn("_ratio", ratio).withColumn("_in", usable).withColumn("_size", F.sum("wanted").over(every))
    plan = plan.withColumn("_factor", F.try_divide(F.col("_size") - before("available"), F.sum("wanted").over(inside) - before("wanted")))
    # The factor of the first category that it does not exhaust; none where all are exhausted.
    plan = plan.withColumn("_factor", F.min_by(F.when(F.col("_factor") <= F.col("_ratio"), F.col("_factor")), F.when(F.col("_in") & (F.col("_factor") <= F.col("_ratio")), F.struct("_ratio", *CATEGORY))).over(every))
    p = F.when(~F.col("_in"), 0.0).when(F.col("_factor").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("_factor") / F.col("_ratio")))
    return plan.withColumn("p", p).drop("_ratio", "_in", "_size", "_factor")


def mixture_sample(records: DataFrame, mix: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The samples of all mixes (mix_name, example_id, source, length_bin) and the report of their categories.

    Systematic sampling with unequal probabilities: categories are sorted, records in them are in random order, the
    probability of a record is wanted / available of its category, and what exhausted categories lack is shared among
    the others, so that the stated size comes out; records where the prefix sum crosses an integer, from one random
    start for each mix, are drawn. Then floors are repaired: a category below its min_rows
    takes the next records of its order, and the categories furthest above both their floor and their wanted number give
    up as many, their last drawn first; so that the size stays, as far as floors allow. The report has available,
    wanted, min_rows, drawn and selected of each category, selected being counted in the sample itself, and short, by how many records it
    misses the greater of wanted and min_rows: 0 where only whole numbers keep it from wanted.
    """
    usable = cut_lineage(usable_records(records))
    plan = category_plan(usable, mix).groupBy("mix_name", *CATEGORY).agg(F.first("available").alias("available"), F.sum("wanted").alias("wanted"), F.max("min_rows").alias("min_rows"))
    names = [r[0] for r in mix.select("mix_name").distinct().collect()]
    starts = records.sparkSession.createDataFrame([(n, random_start(seed, str(n))) for n in names], "mix_name string, start double")
    plan = plan.join(F.broadcast(starts), "mix_name")
    order = Window.partitionBy("mix_name").orderBy(*CATEGORY)
    plan = with_probability(plan)
    plan = plan.withColumn("base", F.coalesce(F.sum(F.col("p") * F.col("available")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("start"))
    # Drawn records of a category: the integers that its stretch of the prefix sum crosses.
    edge = lambda k: F.floor(F.col("base") + F.col("p") * k + 1e-9)
    plan = plan.withColumn("drawn", (edge(F.col("available")) - edge(F.lit(0))).cast("bigint"))
    plan = plan.withColumn("floor", F.least("min_rows", "available")).withColumn("lack", F.greatest(F.lit(0), F.col("floor") - F.col("drawn")))
    # What all lacking categories take is given up by those with most to spare above their wanted number, then above their floor.
    spare = F.greatest(F.lit(0), F.col("drawn") - F.greatest(F.col("floor"), F.floor("wanted").cast("bigint")))
    surplus = F.greatest(F.lit(0), F.col("drawn") - F.col("floor"))
    of_mix = Window.partitionBy("mix_name")
    plan = plan.withColumn("spare", spare).withColumn("more", surplus - F.col("spare")).withColumn("need", F.sum("lack").over(of_mix))
    plan = filled(plan, ["mix_name"], CATEGORY, "spare", "need", "given")
    plan = plan.withColumn("need", F.col("need") - F.sum("given").over(of_mix))
    plan = filled(plan, ["mix_name"], CATEGORY, "more", "need", "further")
    plan = cut_lineage(plan.withColumn("keep", F.col("drawn") - F.col("given") - F.col("further")))
    order_rows = ranked(usable, CATEGORY, seed, "example_id", usable.count())
    placed = order_rows.join(broadcast_small(plan.where("p > 0 OR lack > 0")), CATEGORY)
    hit = edge(F.col("_rank")) > edge(F.col("_rank") - 1)
    # The n-th drawn record of a category is the one that crosses its n-th integer; undrawn ones are numbered by what is left.
    nth = edge(F.col("_rank")) - edge(F.lit(0))
    spared = F.col("_rank") - nth
    sample = placed.where((hit & (nth <= F.col("keep"))) | (~hit & (spared <= F.col("lack")))).select("mix_name", "example_id", *CATEGORY)
    counted = sample.groupBy("mix_name", *CATEGORY).agg(F.count(F.lit(1)).alias("selected"))
    short = F.greatest(F.col("wanted"), F.col("min_rows").cast("double")) - F.col("selected")
    missed = (F.col("selected") < F.col("min_rows")) | (F.col("available") < F.col("wanted"))
    report = (
        plan.select("mix_name", *CATEGORY, "available", "wanted", "min_rows", "drawn")
        .join(counted, ["mix_name", *CATEGORY], "left")
        .na.fill(0, ["selected"])
        .withColumn("short", F.when(missed, short).otherwise(0.0))
    )
    return sample, report


def unfilled(records: DataFrame, mix: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_name, source, length_bin) of the rows of the mix, as given, whose category misses its target in the drawn sample.

    The sample is drawn and its records are counted: a category is short where floor repair could not bring it to min_rows,
    or where all of its records are fewer than the wanted number.
    """
    missed = mixture_sample(records, mix, seed)[1].where("short > 0").select(F.col("mix_name").alias("_m"), F.col("source").alias("_s"), F.col("length_bin").alias("_b"))
    given = mix.select("mix_name", "source", "length_bin").distinct()
    same = F.col("mix_name").eqNullSafe(F.col("_m")) & source_name(F.col("source")).eqNullSafe(F.col("_s")) & F.col("length_bin").eqNullSafe(F.col("_b"))
    return given.join(missed, same, "left_semi")
