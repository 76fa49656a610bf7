"""Broken question and answer pairs: missing, refused, copied, foreign and cut-off answers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.llm import refusals, textstats, tongues
from lodecast.runtime import ship_by_value

ship_by_value(__name__)

# What stands for a missing text, without its brackets and marks.
STAND_INS = frozenset(
    "n/a|na|n.a|none|null|nil|nan|missing|empty|tbd|tba|todo|undefined|blank|void|unknown|unanswered|pending|placeholder|no answer|no response|no reply|no text|no content|no output|no data|"
    "answer missing|response missing|text missing|missing answer|missing response|missing text|answer pending|to be done|to be determined|to be announced|not available|not provided|not applicable|not answered|"
    "empty answer|empty response|answer here|response here|insert answer|insert answer here|answer goes here|your answer here|left blank|intentionally left blank|no answer given|no answer provided|keine antwort|sans réponse|sin respuesta|fehlt|vide|vacío|xxx|###".split("|")
)
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_INVISIBLE = re.compile(r"[\s​-‏⁠﻿­ᅠㅤ]+")
#: One mark that stands after a cut, once the text has stopped; none is longer than END characters.
CUT_MARK = re.compile(r"(?:\[\s{0,4}(?:…|\.{2,9}|truncated|cut(?: off)?|continued|snip)\s{0,4}\]|<\s{0,4}(?:cut|truncated|snip|…|\.{3})\s{0,4}>|\(\s{0,4}(?:…|\.{3}|truncated|cut(?: off)?|continued)\s{0,4}\)|\\u?[0-9a-fA-F]{0,4}|�|…|\.{3}|[(\[{<«“„])$", re.I)
END = 24
_ENDED = re.compile(r"[.!?。！？।؟…][\"'”’»)\]*_`“]*$")
_ANY_END = re.compile(r"[.!?。！？।؟](?:[\"'”’»)\]*_`]*\s|$)|[。！？।]")
_ITEM_LINE = re.compile(r"\s*(?:[-*•–·+]|\d{1,3}[.)]|[A-Za-z][.)]|\[[ xX]?\])\s+\S")
_OPEN_WORDS = frozenset("the a an of and or to with for in on at by from that which der die das und oder von mit zu le la les de du des et ou el los las y o con para il lo di e".split())


def tokens(text: str) -> list[str]:
    """Lower-case words; each letter of scripts written without spaces is a word."""
    low = text.lower().replace("’", "'")
    if _CJK.search(low):
        low = _CJK.sub(lambda m: f" {m.group()} ", low)
    return _WORDS.findall(low)


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by one integer per row: bits are positions in a."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = at.get(y, 0)
        u = v & m
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def is_empty(answer: str | None) -> bool:
    """Null, blank, or only a stand-in for missing text."""
    if answer is None:
        return True
    s = _INVISIBLE.sub(" ", answer).strip()
    if not s:
        return True
    inner = s.strip(" .…-—–_*<>[](){}|/\\\"'`:!?#=~").lower()
    if not inner:
        return len(s) <= 6
    return re.sub(r"[\s_]+", " ", inner) in STAND_INS


def is_echo(question: list[str], answer: list[str], least: float = 0.8) -> bool:
    """Whether an answer holds nothing but the question's words, in their order but for moved sentences.

    Shingle containment finds answers that could be copies. One is a copy when the longest common subsequence, or the
    bag of its words together with half of its pairs of words, covers `least` of the answer; an opening of up to six
    words before the copy is let pass.
    """
    if len(answer) < 4 or not question:
        return False
    have = set(question)
    if sum(w in have for w in answer) < (least - 0.25) * len(answer):
        return False
    pairs = shingles(question, 2)
    mine = [tuple(answer[i : i + 2]) for i in range(len(answer) - 1)]
    inside = sum(x in pairs for x in mine) / max(1, len(mine))
    if inside < 0.4:
        return False
    bag = Counter(question)
    times = max(1, round(len(answer) / max(1, len(question))))
    common = sum(min(n, bag[w] * times) for w, n in Counter(answer).items())
    size = max(1, len(answer) - min(6, max(0, len(answer) // 5)) if common < least * len(answer) else len(answer))
    if longest_common(answer, question * times) >= least * size:
        return True
    return common >= least * size and inside >= 0.5


def is_foreign(question: str | None, answer: str, asked: list[str], words: list[str], context: str = "") -> bool:
    """Whether an answer is mainly in a language that is neither the question's nor named in it."""
    mine = tongues.main_language(answer, words=words)
    if mine is None:
        return False
    theirs = tongues.main_language(question, words=asked)
    return theirs is not None and mine != theirs and mine not in tongues.named_languages((question or "") + " " + context)


def without_mark(body: str) -> str:
    """The text without what stands after its cut: marks are taken off its end one by one, however many there are."""
    while body and (m := CUT_MARK.search(body, max(0, len(body) - END))):
        body = body[: m.start()].rstrip()
        if body.endswith(".") and m.group() == "...":
            body = body.rstrip(".")
    return body


def is_cut(answer: str) -> bool:
    """Whether an answer of prose ends within a sentence or word.

    Marks after the cut are taken off first. Lists, tables, code, closings of letters and texts without any sentence
    marks are complete without one.
    """
    body = answer.rstrip()
    bare = without_mark(body)
    marked = bare != body
    if not bare:
        return False
    if _ENDED.search(bare):
        return False
    lines = [x for x in bare.split("\n") if x.strip()]
    last = lines[-1]
    words = last.split()
    if bare.endswith(("```", "}", "]", "|", "─", "┘", "</html>", ">")) and not marked:
        return False
    if _ITEM_LINE.match(last):
        return words[-1].lower() in _OPEN_WORDS or len(words) <= 1
    quiet = not _ANY_END.search(bare)
    if "\t" in last or last.count("|") > 1 or last.count(";") > 2:
        return False
    if len(words) <= 3 and len(lines) > 1 and (lines[-2].rstrip().endswith(",") or not re.search(r"[a-z]", last[:1])) and not marked:
        return False
    if bare.endswith((",", ";", ":", "-", "–", "—")):
        return not quiet or marked
    if quiet:
        if len(lines) > 1:
            return False
        return marked and len(words) > 3 or 4 <= len(words) <= 40 and (words[-1].lower() in _OPEN_WORDS or tongues.function_share(bare) >= 0.25 and words[0][:1].isupper() and "," not in words[0])
    # The last line of prose stands unclosed behind closed sentences; a table or list of short lines is no prose.
    if len(lines) > 3 and sum(bool(_ANY_END.search(x)) for x in lines) < 0.3 * len(lines):
        return False
    return marked or len(words) > 3 or bool(_ANY_END.search(last)) or words[-1][:1].islower()


def defect(question: str | None, answer: str | None, context: str = "") -> str | None:
    """The defect of a pair, or None: empty, refusal, echo, wrong_language, truncated, in this order."""
    if is_empty(answer):
        return "empty"
    words = tokens(answer)
    if refusals.is_refusal(answer, tokens, len(words)):
        return "refusal"
    asked = tokens(question or "")
    if is_echo(asked, words):
        return "echo"
    foreign, cut = is_foreign(question, answer, asked, words, context), is_cut(answer)
    if (foreign or cut) and textstats.profile(answer)[-1] in ("prose", "empty"):
        return "wrong_language" if foreign else "truncated"
    return None


def pairs_of(records: DataFrame) -> DataFrame:
    """(example_id, pair_no, question, answer, context): each user message and the assistant message right after it.

    Roles are trimmed and lower-cased; pair_no counts user messages from 1; answer is null where none follows; context
    is the system message. Records with null messages have no pairs.
    """
    role = lambda m: F.lower(F.trim(m["role"]))
    df = records.where("messages IS NOT NULL AND example_id IS NOT NULL").select("example_id", "messages")
    df = df.withColumn("_roles", F.transform("messages", role))
    users = F.expr("filter(sequence(1, greatest(1, size(messages))), i -> try_element_at(_roles, i) = 'user')")
    df = df.where("exists(_roles, r -> r = 'user')").withColumn("_users", users)
    system = F.array_join(F.transform(F.filter("messages", lambda m: role(m) == "system"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    df = df.select("example_id", "messages", "_roles", system.alias("context"), F.posexplode("_users").alias("_n", "_at"))
    return df.selectExpr(
        "example_id", "_n + 1 AS pair_no", "element_at(messages, _at).content AS question",
        "CASE WHEN try_element_at(_roles, _at + 1) = 'assistant' THEN try_element_at(messages, _at + 1).content END AS answer", "context",
    )


def broken_pairs(records: DataFrame) -> DataFrame:
    """Distinct (example_id, pair_no, defect) of defective pairs of records.messages.

    Works on whole texts in one pass; only the found cases are shuffled, to drop those of repeated records. Null roles
    are no user's or assistant's, null and empty contents are missing answers, columns of other names are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [defect(q, a, c) for q, a, c in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            keep = pa.array([x is not None for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([x for x in found if x], pa.string())], names=["example_id", "pair_no", "defect"])

    kind = records.schema["example_id"].dataType.simpleString()
    return pairs_of(records).mapInArrow(run, f"example_id {kind}, pair_no int, defect string").distinct()
