"""Evaluation items that leak into a corpus: one Aho-Corasick automaton over the items' words, scanned once per text.

Texts and items are normalised to lower-case words without punctuation, markup, escapes and line-break hyphens; each
word keeps its offsets in the original text. The automaton holds every run of `seed` successive words of every item.
Where runs of one item are found, the words around are aligned with the item, so that changed, added and dropped words
are counted exactly.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.runtime import ship_by_value, worker_cache

ship_by_value(__name__)

#: A run of words that more items than this hold says little: one alone is not looked at, but an item of which enough of them are there for a passage is aligned like any other.
RARE = 4
#: Words of items in one automaton; more items are scanned in several passes. An automaton of this size takes about 250 MB.
BLOCK_WORDS = 400_000

# What is taken out of a text or put as what it stands for: markup, character references, escapes, percent codes, hyphens at line ends, quote marks of mail, invisible characters.
SPECIAL = regex.compile(
    r"(?P<tag></?[A-Za-z][^<>]*+>)|(?P<com><!--)|(?P<ref>&(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)"
    r"|(?P<esc>\\u[0-9a-fA-F]{4})|(?P<ctl>\\[nrt])|(?P<pct>(?:%[0-9A-Fa-f]{2})+)"
    r"|(?P<cut>(?<=\p{L})[-­‐‑]\r?\n[ \t]*(?:>[ \t]*)*(?=\p{Ll}))|(?P<quote>(?m:^[ \t]*(?:>[ \t]?)+))|(?P<gone>[­​-‏‪-‮⁠-⁤﻿]+)"
)
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
MAY = regex.compile(r"[<&\\%>­​-‏‪-‮⁠-⁤﻿]|[-‐‑]\r?\n")


def plain(text: str) -> tuple[str, list[int], list[int]]:
    """The text without special things, and for stretches of it (start in it, start in the original). A comment that is never closed stays."""
    out, at, origin, size, last = [], [0], [0], 0, 0
    if not MAY.search(text):
        return text, at, origin
    open_to_end = False
    for m in SPECIAL.finditer(text):
        begin, end = m.span()
        if begin < last:
            continue
        kind, s = m.lastgroup, m.group()
        put = ""
        if kind == "com":
            close = -1 if open_to_end else text.find("-->", end)
            if close < 0:
                open_to_end = True
                continue
            end = close + 3
        elif kind == "ref":
            put = html.unescape(s)
        elif kind == "esc":
            put = chr(int(s[2:], 16))
        elif kind == "ctl":
            put = " "
        elif kind == "pct":
            put = bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")
        out += [text[last:begin], put]
        size += begin - last
        at.append(size)
        origin.append(begin)
        size += len(put)
        at.append(size)
        origin.append(end)
        last = end
    out.append(text[last:])
    return "".join(out), at, origin


def fold(word: str) -> str:
    """A word as it is compared: compatibility form, lower case, without marks."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word).casefold()) if not unicodedata.combining(c))


def folded(clean: str) -> list[str]:
    """The normalised words of a text without special things; one entry for each word, an empty one where nothing is left of it."""
    if clean.isascii():
        return ASCII_WORD.findall(clean.lower())
    return [w.lower() if w.isascii() else fold(w) for w in WORD.findall(clean)]


def words_of(text: str) -> list[str]:
    return [w for w in folded(plain(text)[0]) if w]


def spans_of(clean: str, at: list[int], origin: list[int], held: list[str]) -> list[tuple[int, int]]:
    """(start, end) in the original text of each word of which something is left."""
    spans = []
    for m, w in zip(WORD.finditer(clean), held, strict=True):
        if w:
            if len(at) == 1:
                spans.append(m.span())
            else:
                a = bisect_right(at, m.start()) - 1
                b = bisect_right(at, m.end() - 1) - 1
                spans.append((origin[a] + m.start() - at[a], origin[b] + m.end() - at[b]))
    return spans


class Items:
    """Normalised items, the words of each that other items share, and the blocks in which they are looked for."""

    def __init__(self, keys: list[tuple], prompts: list[str], seed: int = 3, shared: int = 10, block: int = BLOCK_WORDS):
        self.keys, self.words, self.seed = keys, [words_of(p) for p in prompts], seed
        runs: dict[tuple, set[int]] = defaultdict(set)
        same = self.same = self.same_prompts()
        for i, w in enumerate(self.words):
            for k in range(len(w) - shared + 1):
                runs[tuple(w[k : k + shared])].add(same[i])
        self.masked = []
        for w in self.words:
            hidden = [False] * len(w)
            for k in range(len(w) - shared + 1):
                if len(runs[tuple(w[k : k + shared])]) > 1:
                    hidden[k : k + shared] = [True] * shared
            self.masked.append(hidden)
        self.loose = [[x or y for x, y in zip(a, b, strict=True)] for a, b in zip(self.masked, self.slotted(same, max(3, shared - 2)), strict=True)]
        self.blocks: list[list[int]] = [[]]
        size = 0
        for i, w in enumerate(self.words):
            if size and size + len(w) > block:
                self.blocks.append([])
                size = 0
            self.blocks[-1].append(i)
            size += len(w)

    def same_prompts(self) -> list[int]:
        """Items of (nearly) the same words get one number: they don't make each other's wording shared."""
        first: dict[frozenset, int] = {}
        by_word: dict[str, list[int]] = defaultdict(list)
        count: dict[str, int] = defaultdict(int)
        sets = [frozenset(w) for w in self.words]
        for s in sets:
            for x in s:
                count[x] += 1
        same = []
        for i, s in enumerate(sets):
            near = first.get(s)
            rare = sorted(s, key=lambda x: (count[x], x))[: max(1, len(s) // 10 + 1)]
            if near is None:
                near = next((j for x in rare for j in by_word[x] if 10 * len(s & sets[j]) >= 9 * max(len(s), len(sets[j]))), None)
            same.append(i if near is None else same[near])
            first.setdefault(s, i)
            for x in rare:
                by_word[x].append(i)
        return same

    def slotted(self, same: list[int], run: int) -> list[list[bool]]:
        """The words of each item in runs that other prompts have too but for one word: sentences of one mould."""
        holders: dict[tuple, int] = {}
        for i, w in enumerate(self.words):
            for k in range(len(w) - run + 1):
                for gap in range(1, run - 1):
                    key = (gap, *w[k : k + gap], *w[k + gap + 1 : k + run])
                    if holders.setdefault(key, same[i]) != same[i]:
                        holders[key] = -1
        out = []
        for w in self.words:
            hidden = [False] * len(w)
            for k in range(len(w) - run + 1):
                for gap in range(1, run - 1):
                    if holders[(gap, *w[k : k + gap], *w[k + gap + 1 : k + run])] == -1:
                        for z in range(k, k + run):
                            hidden[z] = hidden[z] or z != k + gap
            out.append(hidden)
        return out

    def part(self, block: int) -> Part:
        """What one pass over the documents needs of the items of a block."""
        return Part(self, self.blocks[block])


class Part:
    """The items of one block and the automaton over their runs of words."""

    def __init__(self, items: Items, at: list[int]):
        self.seed = items.seed
        self.keys, self.words, self.masked, self.loose, self.same = ([x[i] for i in at] for x in (items.keys, items.words, items.masked, items.loose, items.same))
        self.asked: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.firm: dict[int, list[int]] = {}

    def asks(self, i: int, least: int, per_edit: int) -> tuple[int, int]:
        """The words of an item that a passage needs, and how many of its runs at least stand there."""
        known = self.asked.get((i, least, per_edit))
        if known is None:
            n = len(self.words[i])
            # An item of fewer words that count must stand there with all of them.
            need = min(least, n - sum(self.masked[i]))
            # A passage of so many words with one edit in per_edit leaves this many of its runs untouched; a longer one may leave fewer, just where it may have one more edit.
            fewest = min(k - self.seed * (k // per_edit) - self.seed + 1 for k in range(need, need + per_edit + 1))
            known = self.asked[i, least, per_edit] = need, max(1, fewest)
        return known

    def near(self, i: int, where: list[tuple[int, int]], doc: list[str], least: int, per_edit: int) -> bool:
        """Whether hits (doc word, item word) of an item may belong to a passage of it in doc.

        Without edits the runs of a passage lie on one diagonal. With edits only words that are not loose count: the passage
        can be parted so that each part has fewer than twice as many of them as are needed; as one edit in per_edit holds
        for the whole, it holds for one of the parts, and its words stand near the diagonal of its first hit.
        """
        need, fewest = self.asks(i, least, per_edit)
        item, masked, loose = self.words[i], self.masked[i], self.loose[i]
        on: dict[int, list[int]] = defaultdict(list)
        for d, k in where:
            on[d - k].append(k)
        for at in on.values():
            if len(at) >= need - self.seed:
                at.sort()
                row = 1
                for k, m in zip(at, at[1:]):
                    row = row + 1 if m == k + 1 or all(masked[k + 1 : m + self.seed - 1]) else 1
                    if row >= need - self.seed:
                        return True
        if len(where) < fewest:
            return False
        if i not in self.firm:
            self.firm[i] = [k for k, x in enumerate(loose) if not x]
        firm = self.firm[i]
        where.sort()
        for x in range(len(where) - fewest + 1):
            d, k = where[x]
            u = bisect_left(firm, k)
            lo = firm[u - 2 * need] + 1 if u >= 2 * need else 0
            hi = firm[u + 2 * need] if u + 2 * need < len(firm) else len(item)
            # Words of the part, at most, and its edits.
            size = min(hi - lo, 2 * need - 1 + sum(loose[lo:hi]))
            drift = size // (per_edit - 1)
            held = {k}
            for e, m in where[x + 1 :]:
                if e - d > size + drift:
                    break
                if k <= m < hi and abs(e - m - d + k) <= drift:
                    held.add(m)
            if len(held) < fewest:
                continue
            if per_edit > self.seed and not any(masked[lo:hi]):
                # So few runs whole, a part is no longer than this; before its first whole run, edits stand close.
                most = (len(held) + self.seed - 1) * per_edit // (per_edit - self.seed)
                lo, hi = max(lo, k - self.seed * (most // per_edit) - self.seed + 1), min(hi, k + most)
            if hi - lo - sum(loose[lo:hi]) < need - 1:
                continue
            there = [(at := m + d - k) + drift >= 0 and item[m] in doc[max(0, at - drift) : at + drift + 1] for m in range(lo, hi)]
            if sum(there) < (need - 1) * (per_edit - 1) // per_edit:
                continue
            # Of the words of a part at most one in per_edit is not there: the longest stretches of which this holds start at a least sum so far.
            sums, counted, least_at = [0], [0], [0]
            for ok, light in zip(there, loose[lo:hi], strict=True):
                sums.append(sums[-1] + (1 if ok else 1 - per_edit))
                counted.append(counted[-1] + (not light))
                if sums[-1] < sums[least_at[-1]]:
                    least_at.append(len(sums) - 1)
            for end in range(hi - lo, 0, -1):
                while least_at and sums[end] >= sums[least_at[-1]]:
                    if counted[end] - counted[least_at.pop()] >= need - 1:
                        return True
        return False

    def automaton(self):
        import ahocorasick

        found: dict[str, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            n = min(self.seed, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                if not all(self.masked[i][k : k + n]):
                    found.setdefault(" " + " ".join(w[k : k + n]) + " ", {}).setdefault(i, []).append(k)
        few = {s: len({self.same[i] for i in by_item}) <= RARE for s, by_item in found.items()}
        # An item without any rare run is looked for by all of its runs.
        told = {i for s, by_item in found.items() if few[s] for i in by_item}
        auto = ahocorasick.Automaton()
        for s, by_item in found.items():
            auto.add_word(s, (len(s), by_item, frozenset(by_item) if few[s] else frozenset(by_item.keys() - told)))
        auto.make_automaton()
        return auto


def best_passage(item: list[str], masked: list[bool], loose: list[bool], doc: list[str], least: int, per_edit: int, near: tuple[int, int] | None = None) -> tuple[int, int, int, int] | None:
    """(unmasked words, edits, first and last doc word) of the best passage of the item in doc, or None.

    Local alignment of words, a match counts 1 and a changed, added or dropped word costs 1.5; within its path the
    longest stretch is taken in which at most one word in per_edit is not matched and that has `least` successive words
    of the item. One word changed at either end of the stretch counts as one of its words. Words in `masked` don't count,
    nor do those in `loose` where the stretch has edits. near holds the least and greatest distance of a doc word from its
    item word that the alignment may have: with few edits it stays near those of the runs found.
    """
    n, m = len(item), len(doc)
    low, high = near or (-n, m)
    back = []
    prev = [0.0] * (m + 1)
    top, where = 0.0, (0, 0)
    for i in range(1, n + 1):
        a, row, b = item[i - 1], [0.0] * (m + 1), bytearray(m + 1)
        for j in range(max(1, i + low), min(m, i + high) + 1):
            if a == doc[j - 1]:
                v, d = prev[j - 1] + 1, 1
            else:
                v, d = prev[j - 1] - 1.5, 2
                if prev[j] - 1.5 > v:
                    v, d = prev[j] - 1.5, 3
                if row[j - 1] - 1.5 > v:
                    v, d = row[j - 1] - 1.5, 4
                if v <= 0:
                    continue
            row[j], b[j] = v, d
            if v > top:
                top, where = v, (i, j)
        back.append(b)
        prev = row
    path = []
    i, j = where
    while i and j and back[i - 1][j]:
        d = back[i - 1][j]
        path.append((d == 1, None if d == 4 else i - 1, j - 1))
        i, j = i - (d != 4), j - (d != 3)
    path.reverse()
    # Sums up to each step: words of the item that count, matched or not, where the stretch has edits and where it has none, and edits.
    hits, firm, inner, edited = [0], [0], [0], [0]
    for ok, k, _ in path:
        hits.append(hits[-1] + (ok and not masked[k]))
        firm.append(firm[-1] + (ok and not loose[k]))
        inner.append(inner[-1] + (not ok and k is not None and not loose[k]))
        edited.append(edited[-1] + (not ok))
    best = None
    for s in range(len(path)):
        if not path[s][0]:
            continue
        for e in range(s, len(path)):
            if not path[e][0]:
                continue
            edits, size = edited[e + 1] - edited[s], e + 1 - s
            if edits * per_edit > size:
                continue
            counted = firm[e + 1] - firm[s] + inner[e + 1] - inner[s] if edits else hits[e + 1] - hits[s]
            spare = max(0, (size + 1) // per_edit - edits)
            if counted + min(1, spare) >= least:
                got = firm[e + 1] - firm[s] if edits else counted
                if best is None or got - edits > best[0] - best[1]:
                    best = (got, edits, path[s][2], path[e][2])
    return best


def scan(text: str, items: Part, auto, least: int, per_edit: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, words, edits, start, end) of each item of which text has a passage; start and end are offsets in text."""
    if not len(auto):
        return
    clean, at, origin = plain(text)
    held = folded(clean)
    words = [w for w in held if w]
    if not words:
        return
    hits = list(auto.iter(" " + " ".join(words) + " "))
    told = set().union(*[few for _, (_, _, few) in hits])
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    # Common runs alone tell of an item too, where as many of them stand together as a passage leaves untouched.
    common = Counter(chain.from_iterable([x for _, (_, x, few) in hits if len(few) < len(x)]))
    likely = {i for i, n in common.items() if i not in told and n >= items.asks(i, least, per_edit)[1]}
    if not told and not likely:
        return
    starts, p = {}, 0
    for k, w in enumerate(words):
        starts[p] = k
        p += len(w) + 1
    looked = told | likely
    for end, (size, by_item, _) in hits:
        d = starts[end - size + 1]
        for i in looked & by_item.keys() if len(by_item) > len(looked) else [i for i in by_item if i in looked]:
            found[i] += [(d, k) for k in by_item[i]]
    for i in likely:
        if not items.near(i, found[i], words, least, per_edit):
            del found[i]
    if not found:
        return
    passages = []
    for i, where in found.items():
        item, masked = items.words[i], items.masked[i]
        need, fewest = items.asks(i, least, per_edit)
        slack = len(item) // per_edit + 2
        where.sort(key=lambda x: (x[0] - x[1], x[0]))
        # Hits of one occurrence lie near one diagonal; each such group is aligned by itself.
        groups, group = [], [where[0]]
        for x in where[1:]:
            if x[0] - x[1] - (group[-1][0] - group[-1][1]) > slack:
                groups.append(group)
                group = []
            group.append(x)
        groups.append(group)
        best = None
        for g in groups:
            if len({k for _, k in g}) < fewest:
                continue
            low, high = min(d - k for d, k in g) - slack, max(d - k for d, k in g) + slack
            lo, hi = max(0, low), min(len(words), high + len(item))
            got = best_passage(item, masked, items.loose[i], words[lo:hi], need, per_edit, (low - lo, high - lo))
            if got and (best is None or got[0] - got[1] > best[0] - best[1]):
                best = (got[0], got[1], lo + got[2], lo + got[3])
        if best:
            passages.append((i, *best))
    spans = spans_of(clean, at, origin, held) if passages else []
    for i, hit, edits, first, last in passages:
        # Wording inside a longer passage of another prompt is shared wording, not a leak of this item.
        if any(
            items.same[j] != items.same[i] and h - 2 * e > hit - 2 * edits and 2 * (min(last, z) - max(first, a) + 1) > last - first + 1
            for j, h, e, a, z in passages
        ):
            continue
        yield i, hit, edits, spans[first][0], spans[last][1]


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keys: tuple[str, ...] = ("benchmark", "example_id"),
    prompt_cols: tuple[str, ...] = ("prompt",),
    least: int = 12,
    per_edit: int = 6,
    seed: int = 3,
    shared: int = 10,
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and item of which it holds a passage: id_col, keys, words, edits, start, end.

    A passage is `least` successive words of the item, all of them where it has fewer, of which one in per_edit may be
    changed, added or dropped. Items that have nine tenths of their different words in common are one prompt in several
    spellings: a document that holds one of them holds all. Otherwise, words in runs of `shared` words or more that another item has too do not count.
    words counts the matched words that count, start and end are offsets in the original text. Null texts and prompts
    match nothing, repeated documents and items are found each, columns of other names are not read. The items are the
    stated query set; they are held in automata of at most `block` words, one pass over the documents for each.
    """
    spark = docs.sparkSession
    rows = items.select(*keys, *prompt_cols).dropna(subset=list(keys)).distinct().toPandas()
    names, prompts = [], []
    for r in rows.itertuples(index=False):
        for p in r[len(keys) :]:
            if isinstance(p, str) and p.strip():
                names.append(tuple(r[: len(keys)]))
                prompts.append(p)
    held = Items(names, prompts, seed, shared, block)
    kinds = {f.name: f.dataType.simpleString() for f in (*docs.select(id_col).schema.fields, *items.select(*keys).schema.fields)}
    schema = f"id {kinds[id_col]}, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", words int, edits int, start int, end int"
    stamp = hash((tuple(names), tuple(prompts), seed, shared, block))

    def searched(b: int) -> DataFrame:
        # Bounded by the words of a block, not by the number of items.
        shipped = spark.sparkContext.broadcast(held.part(b))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data, cache = shipped.value, worker_cache()
            if cache.get("leak_key") != (stamp, b):
                cache["leak_key"], cache["leak"] = (stamp, b), data.automaton()
            auto = cache["leak"]
            for batch in batches:
                out = []
                for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text:
                        out += [(ident, *data.keys[i], n, e, s, t) for i, n, e, s, t in scan(text, data, auto, least, per_edit)]
                if out:
                    cols = list(zip(*out, strict=True))
                    types = [batch.schema.field(0).type, *[pa.string() if isinstance(x[0], str) else None for x in cols[1 : 1 + len(keys)]], *[pa.int32()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", *keys, "words", "edits", "start", "end"])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(run, schema)

    result = None
    for b in range(len(held.blocks)):
        one = searched(b)
        result = one if result is None else result.unionByName(one)
    return result.withColumnRenamed("id", id_col)
