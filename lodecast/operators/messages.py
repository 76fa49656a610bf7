"""Conversations: canonical form, prompts, ids and structural flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecast.functions import plugins
from lodecast.functions import text as T

plugins.register(plugins.TOKENS, "words_and_marks", T.token_count)

ROLES = ("system", "user", "assistant")


def canonical_messages(c: Column) -> Column:
    """Roles trimmed and lower-cased, white space of contents collapsed; null where any item is invalid or a user or assistant is missing."""
    clean = F.transform(c, lambda m: F.struct(F.lower(F.trim(m["role"])).alias("role"), T.collapse(m["content"]).alias("content")))
    valid = F.forall(clean, lambda m: F.coalesce(m["role"].isin(*ROLES) & (m["content"] != ""), F.lit(False)))
    return F.when(valid & F.exists(clean, lambda m: m["role"] == "user") & F.exists(clean, lambda m: m["role"] == "assistant"), clean)


def joined(c: Column, sep: str, role: str | None = None) -> Column:
    """Contents joined, of one role or of all."""
    kept = F.filter(c, lambda m: m["role"] == role) if role else c
    return F.array_join(F.transform(kept, lambda m: m["content"]), sep)


def example_id(c: Column) -> Column:
    """SHA-256 of the canonical JSON: keys sorted, compact, letters unescaped."""
    return F.sha2(F.to_json(F.transform(c, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))), 256)


def message_tokens(c: Column, overhead: int = 0, count=T.token_count) -> Column:
    """Tokens of all contents by a token count, and a fixed number for each message."""
    return F.aggregate(c, F.lit(0), lambda n, m: n + count(m["content"]) + overhead)


def bound(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns (aliased), each evaluated once: a generator, through which neither filters nor projections are moved."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def candidate_rows(records: DataFrame, most: int = 2048, tokens: str = "words_and_marks", overhead: int = 0) -> DataFrame:
    """example_id, source, source_row, messages, text, token_count, length_bin, quality_score, stratum of the rows that may enter the pool.

    Each text is put into its canonical form once and its words are counted once; no shuffle. Rows of null source count as
    source `unknown`. tokens names the token count, see plugins.
    """
    count = plugins.named(plugins.TOKENS, tokens)
    df = records.select(F.coalesce("source", F.lit("unknown")).alias("source"), "source_row", F.col("messages").alias("_raw")).where("_raw IS NOT NULL")
    df = bound(df, canonical_messages(F.col("_raw")).alias("messages")).drop("_raw").where("messages IS NOT NULL")
    df = bound(df, message_tokens(F.col("messages"), overhead, count).alias("token_count"), joined(F.col("messages"), " ").alias("_spaced")).where(F.col("token_count").between(1, most))
    df = bound(df, T.hard_valid(F.col("_spaced"), F.col("token_count"), most).alias("_valid")).where("_valid").drop("_valid")
    df = df.withColumn("length_bin", T.length_bin(F.col("token_count"))).withColumn("example_id", example_id(F.col("messages")))
    df = df.withColumn("quality_score", T.text_quality(F.col("_spaced"), joined(F.col("messages"), " ", "assistant"), F.col("token_count")))
    return df.withColumn("stratum", F.concat_ws("|", "source", "length_bin")).withColumn("text", joined(F.col("messages"), "\n")).drop("_spaced")


FLAGS = (
    "messages_is_list", "valid_message_items", "has_user", "has_assistant", "assistant_last", "nonempty_assistant", "null_byte", "long_repeated_character_run", "short_assistant_word_count",
    "recomputed_quality_matches",
)


def structural_flags(records: DataFrame) -> DataFrame:
    """One row per record: its flags, all false for a null list but none of an empty one.

    Roles are lower-cased for all but the assistant's text, which is that of the role as stored. A null content reads as
    `None`. The last flag is raised only after flags are counted, so that it is false here.
    """
    role = lambda m: F.lower(m["role"])
    content = lambda m: F.coalesce(m["content"], F.lit("None"))
    msgs, no = F.col("messages"), F.lit(False)
    all_text = F.array_join(F.transform(msgs, content), " ")
    said = F.array_join(F.transform(F.filter(msgs, lambda m: F.coalesce(m["role"] == "assistant", no)), content), " ")
    df = bound(records.select("example_id", "messages"), all_text.alias("_all"), said.alias("_said"))
    some = lambda name: F.exists(msgs, lambda m: F.coalesce(role(m) == name, no))
    flags = (
        msgs.isNotNull(), F.forall(msgs, lambda m: F.coalesce(role(m).isin(*ROLES) & ~T.is_blank(m["content"]), no)), some("user"), some("assistant"),
        role(F.try_element_at(msgs, F.lit(-1))) == "assistant", ~T.is_blank(F.col("_said")), F.contains(F.col("_all"), F.char(F.lit(0))), T.has_run(F.col("_all"), 10), T.word_count(F.col("_said")) < 8, no,
    )
    return df.select("example_id", *[F.coalesce(F.when(msgs.isNotNull(), v), no).alias(k) for k, v in zip(FLAGS, flags, strict=True)])


def flag_counts(flags: DataFrame) -> DataFrame:
    """(flag, n) of the flags that occur."""
    names = [c for c in flags.columns if c != "example_id"]
    sums = flags.agg(*[F.count_if(c).alias(c) for c in names])
    return sums.unpivot([], names, "flag", "n").where("n > 0")
