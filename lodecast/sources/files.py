"""JSON Lines, JSON documents, CSV and file indexes: scans with error capture, and sinks."""

from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lodecast.functions import plugins
from lodecast.operators.messages import message_tokens


def read_jsonl(spark: SparkSession, path: str, schema: t.StructType | str) -> DataFrame:
    """Rows of a JSON Lines file; blank lines are skipped, a bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _placed(rows: DataFrame, name: str, first: int) -> DataFrame:
    """rows with name, their place over all files in order of path: numbered in each block of a file, blocks added up. Nothing leaves the JVM and no window holds a whole file of several blocks."""
    keyed = rows.withColumn("_at", F.monotonically_increasing_id())
    blocks = keyed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")))
    placed = inside.join(F.broadcast(before), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return placed.withColumn(name, F.col("_before") + F.col("_in") + (first - 1)).drop("_file", "_block", "_at", "_in", "_f", "_b", "_before")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, from 1, and line of a text file, or of all files of a folder in order of their paths."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return _placed(rows, "line_no", 1).select("line_no", "line")


def enumerated(spark: SparkSession, path: str, source: str, name: str = "source_row") -> DataFrame:
    """The rows of a Parquet source with `source` and their ordinal, from 0, in the order in which they are stored; files in order of their paths."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(before), F.col("_file") == F.col("_f")).withColumn(name, F.col("_row") + F.col("_before"))
    return out.withColumn("source", F.lit(source)).drop("_file", "_row", "_f", "_before")


def streams_of(spark: SparkSession, paths: dict[str, str], limit: int = 0) -> DataFrame:
    """Rows of several sources, each with its name and ordinal, at most `limit` raw ordinals of each; 0 keeps all."""
    every = [first_ordinals(enumerated(spark, path, name), "source", "source_row", limit) for name, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)


def read_arrow(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """The table of one Arrow IPC file or stream. It is read by the driver, so that a file above most_bytes is refused: convert it to Parquet."""
    size = os.path.getsize(path)
    if size > most_bytes:
        raise ValueError(f"{path} has {size} bytes, more than the {most_bytes} that the driver may hold")
    with pa.memory_map(path) as f:
        try:
            table = pa.ipc.open_file(f).read_all()
        except pa.ArrowInvalid:
            f.seek(0)
            table = pa.ipc.open_stream(f).read_all()
        return spark.createDataFrame(table)


def snapshot(rows: DataFrame, benchmark: str, config: str, order: list[str], split: str = "test") -> DataFrame:
    """rows with example_id `benchmark-config-split-0000`: the ordinal, from 0 and in four digits at least, of each row in its config by order."""
    ordinal = F.row_number().over(Window.partitionBy(config).orderBy(*order)) - 1
    return rows.withColumn("example_id", F.concat_ws("-", F.lit(benchmark), F.col(config), F.lit(split), F.format_string("%04d", ordinal)))


def checked_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line_no, row, error of every line: error is `blank`, `bad json`, `not an object` or null."""
    kind = F.schema_of_variant(F.try_parse_json("line"))
    error = F.when(F.trim("line") == "", "blank").when(F.try_parse_json("line").isNull(), "bad json").when(~kind.startswith("OBJECT"), "not an object")
    return numbered_lines(spark, path).select("line_no", F.when(error.isNull(), F.from_json("line", schema)).alias("row"), error.alias("error"))


def valid_rows(lines: DataFrame) -> DataFrame:
    return lines.where("error IS NULL").select("line_no", "row.*")


def strict_rows(lines: DataFrame) -> DataFrame:
    """The rows, or an error that names the first kind of bad line found."""
    ok = F.assert_true(F.col("error").isNull(), F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error")))
    return lines.where(ok.isNull()).select("line_no", "row.*")


def valid_prefix(lines: DataFrame) -> DataFrame:
    """The rows before the first bad line, as a run that was cut off leaves them; blank lines are bad ones too."""
    first = lines.where("error IS NOT NULL").agg(F.min("line_no").alias("_first"))
    return lines.crossJoin(F.broadcast(first)).where("_first IS NULL OR line_no < _first").select("line_no", "row.*")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; all columns are strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def first_ordinals(df: DataFrame, source: str, ordinal: str, limit: int) -> DataFrame:
    """Rows whose stored ordinal in their source is below limit; 0 keeps all. Counted before validation, so a plain filter that is pushed to the scan."""
    return df if limit == 0 else df.where(F.col(ordinal) < limit)


def file_index(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of the files below a folder, paths relative with slashes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/") + "/"
    path = F.replace(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit(root), F.lit("")), F.lit("\\"), F.lit("/"))
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(df: DataFrame, most_tokens: int = 2048, tokens: str | None = None, most_rows: int | None = None, order: str = "example_id") -> DataFrame:
    """Manifest rows, or an error where a row has no messages, or no token count from 1 to the cap; most_rows keeps the first by order.

    With the name of a token count (see plugins), the stored number must be that of the messages counted again.
    """
    ok = (F.col("token_count") > 0) & (F.col("token_count") <= most_tokens) & (F.size("messages") > 0)
    if tokens is not None:
        ok = ok & (message_tokens(F.col("messages"), 0, plugins.named(plugins.TOKENS, tokens)) == F.col("token_count"))
    rows = df.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit("bad manifest row "), F.coalesce("example_id", F.lit("null")))).isNull())
    return rows if most_rows is None else rows.orderBy(order).limit(most_rows)


def padded(ids: Column, length: int, pad: int, left: bool = False) -> Column:
    """Struct of ids padded to length, mask (1 for ids, 0 for padding) and labels (ids, -100 for padding); longer lists are an error."""
    fill = F.lit(length) - F.size(ids)
    fill = F.when(fill >= 0, fill).otherwise(F.raise_error(F.lit("more ids than the length")).cast("int"))
    put = lambda have, value: F.concat(F.array_repeat(F.lit(value), fill), have) if left else F.concat(have, F.array_repeat(F.lit(value), fill))
    return F.struct(put(ids, pad).alias("ids"), put(F.transform(ids, lambda _: F.lit(1)), 0).alias("mask"), put(ids, -100).alias("labels"))


def utc_stamp() -> Column:
    """The time of the query in UTC, as ISO 8601 text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A summary table as markdown: a heading and one line a row, bars escaped. Tables above `most` rows are no summaries and are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a report")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]) + "\n"


def markdown_report(title: str, parts: dict[str, DataFrame]) -> str:
    """A report of headed summary tables."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in parts.items())


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], one_file: bool = False) -> None:
    chosen = df.select(*columns)
    (chosen.coalesce(1) if one_file else chosen).write.mode("overwrite").option("header", True).csv(path)


def summary_json(df: DataFrame) -> str:
    """One row as a JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("j")).first()["j"]
