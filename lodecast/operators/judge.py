"""The judge stage around a model: prompts, the JSON object in an answer, its normal form, and summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecast.runtime import ship_by_value

ship_by_value(__name__)

# The criteria that a judgement must score, 1 to 5 each, and the one that stands for all.
CRITERIA = ("correctness", "instruction_following", "clarity", "self_containedness", "overall_quality")
OVERALL = "overall_quality"
NOTES = {"a": "Apply the rubric word by word; every score needs something visible in the answer.", "b": "Judge once more from scratch; a long answer is not a good one for its length."}
TEMPLATE = "Rate the answer to the request.\n\n%s\n\nScore each of " + ", ".join(CRITERIA) + " from 1 (worst) to 5 (best). Reply with one JSON object: scores, evidence, confidence (0 to 1), uncertain.\n\n<USER>\n%s\n</USER>\n<ASSISTANT>\n%s\n</ASSISTANT>\n"


def split_messages(messages: Column) -> Column:
    """Struct of user and assistant: their contents joined by blank lines; an error where either has no message or the list is null. Roles as stored."""
    said = lambda role: F.filter(messages, lambda m: m["role"] == role)
    text = lambda role: F.array_join(F.transform(said(role), lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")
    whole = F.coalesce((F.size(said("user")) > 0) & (F.size(said("assistant")) > 0), F.lit(False))
    return F.when(whole, F.struct(text("user").alias("user"), text("assistant").alias("assistant"))).otherwise(F.raise_error(F.lit("missing user or assistant message")).cast("struct<user:string,assistant:string>"))


def judge_prompt(user: Column, assistant: Column, variant: str = "a", template: str = TEMPLATE, notes: dict[str, str] = NOTES) -> Column:
    """The prompt of one variant: template with the variant's note, the request and the answer put in, in this order."""
    head, one, two, tail = template.split("%s")
    return F.concat(F.lit(head), F.lit(notes[variant]), F.lit(one), user, F.lit(two), assistant, F.lit(tail))


def first_object(text: str | None) -> str | None:
    """The first JSON object that begins at some brace of a text, as JSON; None without one."""
    decoder, at = json.JSONDecoder(), -1
    while text and (at := text.find("{", at + 1)) >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
        except (json.JSONDecodeError, RecursionError):
            continue
        return json.dumps(value, ensure_ascii=False)
    return None


def with_object(df: DataFrame, text: str, name: str = "object") -> DataFrame:
    """df with name: the first JSON object embedded in column text, as a string; null where there is none.

    Texts without a brace stay in the JVM; the others are scanned in Arrow batches.
    """

    @F.pandas_udf("string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(first_object, na_action="ignore")

    return df.withColumn(name, F.when(F.contains(F.col(text), F.lit("{")), scan(F.col(text))))


def normal_judgement(c: Column) -> Column:
    """parse_ok, scores, confidence and uncertain of a judgement given as JSON.

    A score is a number, or text of a whole number, cut to a whole number; booleans and those outside 1 to 5 are left out.
    confidence is a number in 0 to 1, else null. parse_ok: all criteria are scored and confidence is known. Null or
    invalid JSON has no scores and is uncertain.
    """
    raw = lambda path: F.get_json_object(c, path)

    def score(name: str) -> Column:
        # Read as a variant, a string keeps its type: text must be a whole number, numbers are cut.
        v = F.try_variant_get(F.try_parse_json(c), f"$.scores.{name}", "variant")
        kind = F.schema_of_variant(v)
        text = F.trim(raw(f"$.scores.{name}"))
        whole = F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("double"))).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), text.try_cast("double"))
        n = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("int")
        return F.when(n.between(1, 5), n)

    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), score(k).alias("value")) for k in CRITERIA]), lambda p: p["value"].isNotNull())
    sure = F.trim(raw("$.confidence")).try_cast("double")
    sure = F.when(sure.between(0, 1), sure)
    doubt = F.coalesce(raw("$.uncertain"), F.lit("false"))
    valid = F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return F.struct(
        (valid & (F.size(pairs) == len(CRITERIA)) & sure.isNotNull()).alias("parse_ok"), F.map_from_entries(pairs).alias("scores"), F.when(valid, sure).alias("confidence"),
        F.when(valid, ~doubt.isin("false", "0", "", "0.0", "[]", "{}", "null")).otherwise(True).alias("uncertain"),
    )


def first_judgements(results: DataFrame) -> DataFrame:
    """audit_id, example_id, pass_a, pass_b: one row per audit_id; of different ones that of least example_id, then the one whose passes come first in order of their fields."""
    order = F.struct("example_id", "pass_a.parse_ok", "pass_b.parse_ok", "pass_a.confidence", "pass_b.confidence", F.map_entries("pass_a.scores"), F.map_entries("pass_b.scores"))
    return results.where("audit_id IS NOT NULL").groupBy("audit_id").agg(F.min_by(F.struct("example_id", "pass_a", "pass_b"), order).alias("r")).select("audit_id", "r.*")


def judged_records(results: DataFrame, records: DataFrame) -> DataFrame:
    """audit_id, example_id, source, quality_score and overall, the mean overall score of both passes, of judgements of which both passes parsed.

    Repeated audit_id count once, see first_judgements; so do repeated records, that of least (source, quality_score). An
    audit item whose example is in no record is an error.
    """
    known = records.groupBy("example_id").agg(F.min(F.struct("source", "quality_score")).alias("_s")).select("example_id", F.lit(True).alias("_there"), "_s.*")
    rows = first_judgements(results).join(known, "example_id", "left")
    rows = rows.where(F.assert_true(F.coalesce("_there", F.lit(False)), F.concat(F.lit("audit example is in no record: "), F.coalesce("example_id", F.lit("null")))).isNull())
    both = rows.where("pass_a.parse_ok AND pass_b.parse_ok")
    mean = (F.col("pass_a.scores")[OVERALL] + F.col("pass_b.scores")[OVERALL]) / 2.0
    return both.select("audit_id", "example_id", F.coalesce("source", F.lit("unknown")).alias("source"), "quality_score", mean.alias("overall"))


def source_means(judged: DataFrame) -> DataFrame:
    """source, n, mean_overall, at_maximum: by source; at_maximum tells that every score is 5."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("overall").alias("mean_overall"), F.coalesce(F.bool_and(F.col("overall") == 5), F.lit(False)).alias("at_maximum"))


def score_distribution(judged: DataFrame) -> DataFrame:
    """overall, n, degenerate: how often each mean overall score occurs, and whether the maximum is the only one."""
    counts = judged.groupBy("overall").agg(F.count(F.lit(1)).alias("n"))
    worst = counts.agg(F.coalesce(F.min("overall") == 5, F.lit(False)).alias("degenerate"))
    return counts.crossJoin(F.broadcast(worst))


def structural_checks(items: DataFrame, records: DataFrame) -> DataFrame:
    """items, unique_example_ids, records_found, with_both_roles, with_answer of audit items against the records; one row.

    Roles as stored; of a repeated record any row may have the roles.
    """
    role = lambda r: F.coalesce(F.exists("messages", lambda m: m["role"] == r), F.lit(False))
    answered = F.coalesce(F.exists("messages", lambda m: (m["role"] == "assistant") & m["content"].rlike(r"\S")), F.lit(False))
    known = records.groupBy("example_id").agg(F.bool_or(role("user") & role("assistant")).alias("_roles"), F.bool_or(answered).alias("_said"), F.lit(True).alias("_there"))
    ids = items.select("example_id")
    return ids.join(known, "example_id", "left").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("example_id").alias("unique_example_ids"), F.count("_there").alias("records_found"), F.count_if("_roles").alias("with_both_roles"), F.count_if("_said").alias("with_answer")
    )
