"""Encoding of a corpus by a public byte-level BPE, exact token counts and token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecast.llm import bpe
from lodecast.runtime import cut_lineage, ship_by_value

ship_by_value(__name__)

#: Pieces whose lengths are broadcast: all where they are no more than HOT_PIECES and HOT_BYTES, else the most frequent ones of HOT_LETTERS letters at most; all others are joined by a shuffle.
HOT_PIECES, HOT_LETTERS, HOT_BYTES = 400_000, 40, 32_000_000


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = bpe.DEFAULT) -> DataFrame:
    """One row per input row: id_col and ids, the token ids of its whole text without special tokens.

    Null and empty texts give an empty list, repeated rows are repeated, strings that look like special tokens are
    ordinary text, other columns are left out. Each partition encodes its distinct pieces once; no shuffle.
    """
    tok = docs.sparkSession.sparkContext.broadcast(bpe.packed(bpe.load(bpe.readable(tokenizer))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder, pattern = bpe.encoder_for(tok.value)
        for b in batches:
            for k in range(0, b.num_rows, 2_000):
                part = b.slice(k, 2_000)
                rows = encoder.encode(part.column(1).to_pylist(), pattern)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", tokenizer: str = bpe.DEFAULT) -> DataFrame:
    """The texts of encode_documents again; invalid UTF-8 becomes U+FFFD, an empty or null list an empty text."""
    tok = encoded.sparkSession.sparkContext.broadcast({v: k for k, v in bpe.load(bpe.readable(tokenizer)).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b2 = tok.value
        for b in batches:
            texts = [b"".join(b2[i] for i in x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def pieces(text: Column) -> Column:
    """The pieces into which the tokenizer's pattern splits a text; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(bpe.SPLIT), F.lit(0))


def message_pieces(messages: Column, text: Column) -> Column:
    """The pieces of all message contents, each content split by itself; of the text where messages is null."""
    return F.when(messages.isNotNull(), F.flatten(F.transform(messages, lambda m: pieces(m["content"])))).otherwise(pieces(text))


def piece_lengths(parts: DataFrame, tokenizer: str = bpe.DEFAULT) -> DataFrame:
    """(piece, rows, n): each distinct piece of column piece, how often it occurs, and its number of tokens, encoded once."""
    tok = parts.sparkSession.sparkContext.broadcast(bpe.packed(bpe.load(bpe.readable(tokenizer))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = bpe.encoder_for(tok.value)
        for b in batches:
            words = b.column(0).to_pylist()
            encoder.learn(set(words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(encoder.known[w]) for w in words], pa.int32())], names=["piece", "rows", "n"])

    return parts.where("piece IS NOT NULL").groupBy("piece").agg(F.count(F.lit(1)).alias("rows")).mapInArrow(run, "piece string, rows bigint, n int")


def token_counts(df: DataFrame, split: Column, keep: list[str], tokenizer: str = bpe.DEFAULT, hot: int = HOT_PIECES) -> DataFrame:
    """One row per input row: the columns of keep and n_tokens, the exact number of tokens of its pieces.

    split is an array of pieces, see pieces() and message_pieces(); a row without pieces has 0 tokens. The lengths of
    the `hot` most frequent pieces are broadcast, so that their occurrences are summed where they are read; all other
    pieces are counted per row first and joined by a shuffle, in which no piece is frequent.
    """
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), *keep, split.alias("_split"))
    rows = numbered.select("_row", *keep, F.explode_outer("_split").alias("piece"))
    lengths = cut_lineage(piece_lengths(rows.select("piece"), tokenizer))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_tokens")
    distinct, size = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()
    if distinct <= hot and size <= HOT_BYTES:
        return rows.join(F.broadcast(lengths.select("piece", "n")), "piece", "left").groupBy("_row", *keep).agg(total).drop("_row")
    often = cut_lineage(lengths.where(F.length("piece") <= HOT_LETTERS).orderBy(F.desc("rows"), "piece").limit(hot).select("piece", "n"))
    first = rows.join(F.broadcast(often), "piece", "left")
    rest = first.where("n IS NULL AND piece IS NOT NULL").groupBy("_row", *keep, "piece").agg(F.count(F.lit(1)).alias("times"))
    rest = rest.join(lengths.join(F.broadcast(often.select("piece")), "piece", "left_anti").select("piece", "n"), "piece").select("_row", *keep, (F.col("times") * F.col("n")).alias("n"))
    return first.select("_row", *keep, F.col("n").cast("bigint").alias("n")).unionByName(rest.withColumn("n", F.col("n").cast("bigint"))).groupBy("_row", *keep).agg(total).drop("_row")


def record_tokens(records: DataFrame, keep: list[str], tokenizer: str = bpe.DEFAULT, hot: int = HOT_PIECES) -> DataFrame:
    """keep and n_tokens per row of records: the tokens of all message contents, of text where messages is null."""
    return token_counts(records, message_pieces(F.col("messages"), F.col("text")), keep, tokenizer, hot)


def unusable_counts(records: DataFrame, tokenizer: str = bpe.DEFAULT) -> DataFrame:
    """Distinct example_id whose stored token_count is null, not positive, or off by more than a factor of two.

    A stored count fits when n/2 <= token_count <= 2n for the exact count n. Null contents count as empty; an empty
    table gives an empty result; columns of other names are not read.
    """
    counted = record_tokens(records, ["example_id", "token_count"], tokenizer)
    stored, exact = F.col("token_count").cast("double"), F.col("n_tokens").cast("double")
    bad = F.col("token_count").isNull() | (stored <= 0) | (stored < exact / 2) | (stored > exact * 2)
    return counted.where(bad & F.col("example_id").isNotNull()).select("example_id").distinct()


def source_name(c: Column) -> Column:
    """A source as it is compared: trimmed, lower case, `_` and space as `-`."""
    return F.translate(F.lower(F.trim(c)), "_ ", "--")


def known_sources(names: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, known): for each distinct name that is in no row of sources, the nearest known source up to two edits away (a swap is two).

    Compares distinct names only, and only those that share their first or last four letters and differ in length by one at most.
    """
    known = sources.select(source_name(F.col("source")).alias("known")).where("known IS NOT NULL").distinct()
    new = names.where("name IS NOT NULL").distinct().join(known, F.col("name") == F.col("known"), "left_anti")
    keyed = lambda d, c: d.select(c, F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, 4)), F.concat(F.lit(">"), F.expr(f"right({c}, 4)")))).alias("_k"))
    near = keyed(new, "name").join(keyed(known, "known"), "_k").where((F.abs(F.length("name") - F.length("known")) <= 1) & (F.levenshtein("name", "known") <= 2)).select("name", "known").distinct()
    best = near.withColumn("d", F.levenshtein("name", "known")).groupBy("name").agg(F.min(F.struct("d", "known")).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.select("name", F.col("b.known").alias("known"))


def token_budget(records: DataFrame, documents: DataFrame, sources: DataFrame, tokenizer: str = bpe.DEFAULT) -> DataFrame:
    """corpus, source, lang, domain, texts, tokens: exact totals of both tables.

    Sources are compared trimmed, in lower case, with `_` and space as `-`; a misspelled one counts for the known source
    next to it. A null language is the source's default one. What stays unknown is `unknown`. Repeated rows count each
    time they occur.
    """
    lang = F.lower(F.trim("lang"))
    a = record_tokens(records.select("messages", "text", source_name(F.col("source")).alias("name"), lang.alias("lang")), ["name", "lang"], tokenizer).withColumn("corpus", F.lit("records"))
    docs = documents.select("text", source_name(F.col("source")).alias("name"), lang.alias("lang"))
    b = token_counts(docs, pieces(F.col("text")), ["name", "lang"], tokenizer).withColumn("corpus", F.lit("documents"))
    small = cut_lineage(a.unionByName(b).groupBy("corpus", "name", "lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens")))
    info = sources.select(source_name(F.col("source")).alias("source"), F.col("domain_name").alias("domain"), F.lower("default_lang").alias("default_lang")).where("source IS NOT NULL").dropDuplicates(["source"])
    fixed = small.join(known_sources(small.select("name"), sources), "name", "left").withColumn("source", F.coalesce("known", "name"))
    return (
        fixed.join(info, "source", "left")
        .groupBy("corpus", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", "default_lang", F.lit("unknown")).alias("lang"), F.coalesce("domain", F.lit("unknown")).alias("domain"))
        .agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    )
