"""Streaming forms: deduplication by content hash, running counters, a capped sample per stratum, and resumable output."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecast.functions.text import priority
from lodecast.runtime import checkpoint_folder, ship_by_value

ship_by_value(__name__)


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table of a data folder as a stream of its files; a table of one file is picked out of its folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def dedup(stream: DataFrame, key: str, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows with a key not seen before. With an event time, state older than delay is dropped; without, it holds every key."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def running_counts(stream: DataFrame, group: str, tokens: str) -> DataFrame:
    return stream.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(tokens).alias("n_tokens"))


def capped_sample(stream: DataFrame, group: str, ident: str, cap: int, folder: str, checkpoint: str, seed: int = 0):
    """A query that keeps the cap rows of least priority of each group in a Parquet folder, one version for each batch.

    Each batch is merged with what is kept: at most cap rows a group. Versions are written side by side and named by
    batch, so that a batch that is run again after a failure writes the same version again.
    """
    from pyspark.sql import Window

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_p", priority(seed, F.col(ident)))
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/v{number - 1}"))
        w = Window.partitionBy(group).orderBy("_p", ident)
        kept = rows.dropDuplicates([ident]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
        kept.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All rows that a stream gives until its input is used up, as a table of files below folder; state and progress lie there too.

    In append mode each batch is a folder of its own, named by its number; in complete mode the last batch holds
    everything. A batch that runs again after a failure writes the same folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    rows = spark.createDataFrame([], stream.schema) if not exists(spark, f"{folder}/rows") else spark.read.parquet(f"{folder}/rows")
    if mode == "complete" and "batch" in rows.columns:
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.select(*stream.columns)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def resumable_output(stream: DataFrame, path: str, checkpoint: str):
    """Append-only JSON output that goes on where it stopped."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_done(inputs: DataFrame, done: DataFrame, ident: str) -> DataFrame:
    """Inputs without stored output."""
    return inputs.join(done.select(ident), ident, "left_anti")


def in_batches(df: DataFrame, size: int, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What function gives for the rows of df, a stream or a table, in batches of at most `size` rows, as tokenizers and models take them.

    Batches are cut out of the Arrow batches in which rows reach Python; no more than one of those is held. Empty tables call nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), size):
                yield function(b.iloc[k : k + size])

    return df.mapInPandas(run, schema)
