"""Byte-pair encoding of distinct pieces by recursive DuckDB queries.

A text is split into pieces by the tokenizer's own pattern. Each distinct piece becomes token-position rows, one per
byte; a recursive query joins neighbouring rows with the merge table and contracts the leftmost pair of least rank of
every piece, until no piece has a pair left. Ordered aggregation then gives the ids of each piece.
"""

from __future__ import annotations

import base64
import json
import os

import duckdb
import numpy as np
import pyarrow as pa
import regex

from lodecast.runtime import ship_by_value, worker_cache

ship_by_value(__name__)

# The white space of Unicode, and the pre-splitting pattern of byte-level BPE with 50,257 ids.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Folder of the tokenizer files, and the one that is used where no path is given.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT = f"{FOLDER}/byte_bpe_50k.tiktoken"
#: Pieces of more bytes are contracted by a heap over the same merge table: the rows of the recursion grow as the square of the length of a piece, about a second and 130 MB at this length.
LONG = 4_000
#: Pieces whose ids a Python worker keeps between batches.
KEEP = 400_000
#: Squares of the lengths of pieces that one recursive query takes, in sum.
BATCH = 8_000_000


def python_pattern() -> regex.Pattern:
    return regex.compile(regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: regex.escape(chr(int(m[1], 16))), SPLIT))


def load(path: str = DEFAULT) -> dict[bytes, int]:
    """Ranks by token bytes. A .tiktoken file holds them; of a .json file the vocabulary of a byte-level BPE is read."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model.get("added_tokens", [])}
    back = byte_letters()
    return {bytes(back[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible bytes for themselves, the rest from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, m): the pairs of tokens whose bytes joined are a token, and its rank, which is also its id."""
    rows = [(ranks[t[:k]], ranks[t[k:]], m) for t, m in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    cols = np.array(rows, dtype=np.int32).reshape(-1, 3)
    return pa.table({"l": cols[:, 0], "r": cols[:, 1], "m": cols[:, 2]})


RECURSION = """
WITH RECURSIVE state(word, pos, tok, depth) AS (
    SELECT word, pos, tok, 0 FROM symbols
  UNION ALL
    SELECT word, pos, CASE WHEN pos = best & 1048575 THEN (best >> 20)::INTEGER ELSE tok END, depth + 1
    FROM (
      SELECT p.word, p.pos, p.tok, p.before, p.depth, min((m.m::BIGINT << 20) | p.pos) OVER (PARTITION BY p.word) AS best
      FROM (
        SELECT word, pos, tok, depth, lead(tok) OVER w AS behind, lag(pos) OVER w AS before
        FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)
      ) p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.behind
    )
    WHERE best IS NOT NULL AND before IS DISTINCT FROM best & 1048575
), ended AS (SELECT word, max(depth) AS depth FROM state GROUP BY word)
SELECT word, list(tok ORDER BY pos) AS ids FROM state JOIN ended USING (word, depth) GROUP BY word
"""


class PieceEncoder:
    """Ids of pieces, each distinct piece encoded once for as long as it is kept."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table | None = None):
        self.ranks = ranks
        self.known: dict[str, np.ndarray] = {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False, "temp_directory": ""})
        t = merge_table(ranks) if merges is None else merges  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM t")

    def learn(self, pieces: set[str]) -> None:
        """Encodes those pieces that are not known yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEEP:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        open_, raw = [], []
        for p in new:
            b = p.encode("utf-8", "replace")
            if (whole := self.ranks.get(b)) is not None:
                self.known[p] = np.array([whole], dtype=np.int32)
            elif len(b) > LONG:
                self.known[p] = self.contract(b)
            else:
                open_.append(p)
                raw.append(b)
        # The recursion makes about half the square of a piece's length in rows; a batch makes a bounded number, in memory alone.
        at = weight = 0
        for k, b in enumerate(raw):
            if weight and weight + len(b) ** 2 > BATCH:
                self.recurse(open_[at:k], raw[at:k])
                at, weight = k, 0
            weight += len(b) ** 2
        if open_:
            self.recurse(open_[at:], raw[at:])

    def recurse(self, pieces: list[str], raw: list[bytes]) -> None:
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        symbols = pa.table({"word": word, "pos": pos, "tok": self.single[np.frombuffer(b"".join(raw), dtype=np.uint8)]})  # noqa: F841
        got = self.db.sql(RECURSION).to_arrow_table()
        ids = got.column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        ends = ends - ends[0]
        for k, w in enumerate(got.column("word").to_pylist()):
            self.known[pieces[w]] = flat[ends[k] : ends[k + 1]].astype(np.int32)

    def contract(self, b: bytes) -> np.ndarray:
        """The same contraction for one long piece: leftmost pair of least rank first, by a heap over linked positions."""
        import heapq

        part = [bytes([x]) for x in b]
        after, before = list(range(1, len(b) + 1)), list(range(-1, len(b) - 1))
        heap = [(m, i) for i in range(len(b) - 1) if (m := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if part[i] else len(b)
            if j >= len(b) or self.ranks.get(part[i] + part[j]) != m:
                continue
            part[i], part[j] = part[i] + part[j], b""
            after[i] = after[j]
            if after[j] < len(b):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(b) and (m := self.ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (m, k))
        return np.array([self.ranks[p] for p in part if p], dtype=np.int32)

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> list[np.ndarray]:
        """Ids of each text; none for a null or an empty one."""
        split = [pattern.findall(t) if t else [] for t in texts]
        self.learn({p for x in split for p in x})
        none = np.zeros(0, dtype=np.int32)
        return [np.concatenate([self.known[p] for p in x]) if x else none for x in split]


def packed(ranks: dict[bytes, int]) -> tuple:
    """The tokenizer as it is broadcast: its ranks and its merge table, both bounded by the vocabulary."""
    t = merge_table(ranks)
    return ranks, tuple(t.column(c).to_numpy() for c in ("l", "r", "m"))


def encoder_for(tokenizer: tuple) -> tuple[PieceEncoder, regex.Pattern]:
    """The encoder of this Python worker, built on first use and kept from task to task."""
    ranks, columns = tokenizer
    key = ("bpe", len(ranks), int(columns[2].sum()))
    cache = worker_cache()
    if key not in cache:
        cache[key] = (PieceEncoder(ranks, pa.table(dict(zip("lrm", columns, strict=True)))), python_pattern())
    return cache[key]


def readable(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer file at {path}; pass its path")
    return path
