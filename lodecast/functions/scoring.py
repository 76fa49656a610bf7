"""Answers extracted from free text, and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodecast.functions import plugins
from lodecast.functions.text import normalise

# A number, what marks a final answer, an option letter, a worded option, what is stripped from answers.
NUMBER = r"[-+]?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
MARKED = r"####[\t-\r\x1c-\x20\x85\p{Z}]*(" + NUMBER + ")"
OPTION = r"\([A-Z]\)"
WORDED = r"(?i)(?:answer|choice|option|final)[\t-\r\x1c-\x20\x85\p{Z}]*(?:is|:)?[\t-\r\x1c-\x20\x85\p{Z}]*\(?([A-Z])\)?"
STRIP = " .,:;!?\n"
# White space at either end, and ends of lines.
SIDES = r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}]"
# What a prompt of a benchmark ends with.
SUFFIXES = {
    "gsm8k": "\n\nSolve the problem. End your final numeric answer with #### followed by the number.",
    "bbh": "\n\nReturn only the final answer. Do not add an explanation.",
}


def last_of(c: Column, pattern: str, group: int = 0) -> Column:
    """The last match of a pattern, null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def extract_number(c: Column) -> Column:
    """The last number behind ####, else the last number; commas dropped; as text, so that -5.50 stays."""
    return F.replace(F.coalesce(last_of(c, MARKED, 1), last_of(c, NUMBER)), F.lit(","), F.lit(""))


def number_match(response: Column, target: Column) -> Column:
    a, b = extract_number(response), extract_number(target)
    return F.coalesce(a == b, F.lit(False))


def strip_marks(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIP))


def extract_option(response: Column, target: Column) -> Column:
    """The answer in a response, read in the form of its target: option, truth value, contained text, or last line."""
    target = F.regexp_replace(target, SIDES, "")
    wording = strip_marks(normalise(target))
    option = F.coalesce(last_of(response, OPTION), F.concat(F.lit("("), F.upper(last_of(response, WORDED, 1)), F.lit(")")))
    truth = F.initcap(last_of(response, r"(?i)\b(?:true|false)\b"))
    lines = F.filter(F.split(response, LINE_END), lambda x: F.regexp_replace(x, SIDES, "") != "")
    tail = F.btrim(F.regexp_replace(F.try_element_at(lines, F.lit(-1)), SIDES, ""), F.lit(" ."))
    return (
        F.when(target.rlike(r"^\([A-Z]\)$"), option)
        .when(target.isin("True", "False"), truth)
        .when((wording != "") & F.contains(normalise(response), wording), target)
        .otherwise(tail)
    )


def option_match(response: Column, target: Column) -> Column:
    got = extract_option(response, target)
    return F.coalesce(strip_marks(normalise(got)) == strip_marks(normalise(target)), F.lit(False))


def evaluation_prompt(benchmark: Column, prompt: Column) -> Column:
    """The prompt as a model gets it: with the closing instruction of its benchmark, if it has one."""
    end = F.lit("")
    for name, text in SUFFIXES.items():
        end = F.when(benchmark == name, text).otherwise(end)
    return F.concat(prompt, end)


plugins.register(plugins.SCORERS, "number", number_match)
plugins.register(plugins.SCORERS, "option", option_match)
