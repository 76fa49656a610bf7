"""Exact and near overlap of training prompts with evaluation prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.functions import text as T
from lodecast.runtime import ship_by_value

ship_by_value(__name__)

#: Characters of evaluation prompts that one pass over the training side looks for; more are looked for in several passes.
BLOCK_CHARS = 20_000_000


def prompts(df: DataFrame, ident: str, text: str, name: str) -> DataFrame:
    """(name, norm): ids with their normalised, non-empty prompts."""
    return df.select(F.col(ident).alias(name), T.normalise(F.col(text)).alias("norm")).where("norm <> ''")


def exact_overlap(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id) of equal normalised prompts; of equal evaluation prompts the greatest id counts. Joined by SHA-256."""
    last = evaluation.groupBy(F.sha2("norm", 256).alias("h")).agg(F.max("eval_id").alias("eval_id"))
    return train.select("train_id", F.sha2("norm", 256).alias("h")).join(last, "h").select("train_id", "eval_id")


class Prompts:
    """One block of evaluation prompts, indexed by their runs of n characters."""

    def __init__(self, ids: list, norms: list[str], n: int):
        self.ids, self.norms, self.n = ids, norms, n
        at: dict[str, list[int]] = {}
        sizes = []
        for k, text in enumerate(norms):
            runs = runs_of(text, n)
            sizes.append(len(runs))
            for r in runs:
                at.setdefault(r, []).append(k)
        self.sizes, self.lengths = np.array(sizes), np.array([len(x) for x in norms])
        self.at = {r: np.array(v, dtype=np.int32) for r, v in at.items()}

    def votes(self, text: str, least_jaccard: float, most_ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, votes and Jaccard similarities of the prompts that share enough runs with a text and are near in length."""
        runs = runs_of(text, self.n)
        lists = [x for x in map(self.at.get, runs) if x is not None]
        votes = np.bincount(np.concatenate(lists), minlength=len(self.ids)) if lists else np.zeros(len(self.ids), dtype=np.int64)
        jaccard = votes / (len(runs) + self.sizes - votes)
        near = np.maximum(self.lengths, len(text)) <= most_ratio * np.maximum(1, np.minimum(self.lengths, len(text)))
        found = np.flatnonzero((votes > 0) & near & (jaccard >= least_jaccard))
        return found, votes[found], jaccard[found]


def letter_places(text: str) -> dict[str, int]:
    """The places of each letter of a text, as bits."""
    at: dict[str, int] = {}
    for k, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << k
    return at


def longest_common(at: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of a text, given as its letters' places and its length, and another; all of a row at once in the bits of one number."""
    every = (1 << size) - 1
    left = every
    for c in other:
        hit = left & at.get(c, 0)
        if hit:
            left = ((left + hit) | (left - hit)) & every
    return size - left.bit_count()


def runs_of(text: str, n: int) -> set[str]:
    """Distinct runs of n characters; the whole text where it is no longer than n."""
    return {text[k : k + n] for k in range(max(1, len(text) - n + 1))}


def blocks(evaluation: DataFrame, n: int, most: int) -> Iterator[Prompts]:
    """The evaluation side, a stated set of queries, in indexed blocks of bounded size, in order of ids."""
    ids, norms, size = [], [], 0
    for row in evaluation.select("eval_id", "norm").orderBy("eval_id", "norm").toLocalIterator():
        if size and size + len(row.norm) > most:
            yield Prompts(ids, norms, n)
            ids, norms, size = [], [], 0
        ids.append(row.eval_id)
        norms.append(row.norm)
        size += len(row.norm)
    if ids:
        yield Prompts(ids, norms, n)


def searched(train: DataFrame, evaluation: DataFrame, look, columns: str, n: int, block_chars: int) -> DataFrame:
    """(train_id, eval_id, *columns): the rows that look(prompts, text) gives for each training text, block by block.

    Training rows are spread first, a table of few files would be searched in one task; they are not shuffled by shingle.
    """
    spark = train.sparkSession
    kinds = {"train_id": train.schema["train_id"].dataType.simpleString(), "eval_id": evaluation.schema["eval_id"].dataType.simpleString()}
    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", " + columns
    names = [c.split()[0] for c in columns.split(", ")]
    spread = train.select("train_id", "norm").repartition(2 * spark.sparkContext.defaultParallelism, F.xxhash64("train_id", "norm"))
    result = spark.createDataFrame([], schema)
    for block in blocks(evaluation, n, block_chars):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            held = shipped.value
            for pdf in batches:
                out = []
                for ident, text in zip(pdf["train_id"].tolist(), pdf["norm"].tolist(), strict=True):
                    out += [(ident, held.ids[k], *rest) for k, *rest in look(held, text)]
                yield pd.DataFrame(out, columns=["train_id", "eval_id", *names])

        result = result.unionByName(spread.mapInPandas(run, schema))
    return result


def shingle_votes(train: DataFrame, evaluation: DataFrame, least_jaccard: float = 0.35, most_ratio: float = 1.5, n: int = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(train_id, eval_id, votes, jaccard) of pairs that share shingles, near in length and in Jaccard similarity.

    Votes are the size of the intersection. Each training text is looked up in an index of the shingles of all
    evaluation prompts, a stated set of queries held in blocks; pairs below the thresholds never become rows, so that
    nothing is shuffled but the training texts themselves. Null ids are kept, equal rows are found each.
    """

    def look(held: Prompts, text: str) -> Iterator[tuple]:
        for k, v, j in zip(*(x.tolist() for x in held.votes(text, least_jaccard, most_ratio)), strict=True):
            yield k, v, j

    return searched(train, evaluation, look, "votes bigint, jaccard double", n, block_chars)


def near_overlap(
    train: DataFrame, evaluation: DataFrame, least_ratio: float = 0.92, most: int | None = 100, least_jaccard: float = 0.35, most_ratio: float = 1.5, n: int = 5, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(train_id, eval_id, ratio): the best aligned evaluation prompt of each training row without an exact match.

    The ratio is 2M/T of the matching blocks, to 6 decimals. Of the candidates of a row those whose lengths and letters
    allow the ratio at all are aligned, the `most` of most votes in a block (None: all of them); ties go to the least id.
    Matching blocks are a common subsequence, so that a pair whose longest one is too short for the ratio is not aligned.
    """
    rest = train.join(exact_overlap(train, evaluation).select("train_id"), "train_id", "left_anti")

    def look(held: Prompts, text: str) -> Iterator[tuple]:
        from difflib import SequenceMatcher

        found, votes, _ = held.votes(text, least_jaccard, most_ratio)
        best, where, left, at = least_ratio, None, most, None
        for k in found[np.lexsort((found, -votes))].tolist():
            match = SequenceMatcher(None, text, held.norms[k], autojunk=False)
            if match.real_quick_ratio() < least_ratio or match.quick_ratio() < least_ratio:
                continue
            if left is not None:
                if not left:
                    break
                left -= 1
            at = at or letter_places(text)
            if 2.0 * longest_common(at, len(text), held.norms[k]) / (len(text) + len(held.norms[k])) < best:
                continue
            ratio = match.ratio()
            if ratio > best or where is None and ratio >= best:
                best, where = ratio, k
        if where is not None:
            yield where, best

    found = searched(rest, evaluation, look, "ratio double", n, block_chars)
    best = found.groupBy("train_id").agg(F.max_by(F.struct("eval_id", "ratio"), F.struct("ratio", F.lit(1))).alias("b"))
    return best.select("train_id", "b.eval_id", F.round("b.ratio", 6).alias("ratio"))
