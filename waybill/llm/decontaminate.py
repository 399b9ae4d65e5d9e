"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words with single spaces between them. A test item of m characters may be hit with up to
m * ``error`` edits, its budget. It is cut into budget + 1 pieces; whatever the edits do, one piece stays whole. So an
Aho-Corasick automaton over all pieces finds every place where an item can stand, and Myers' bit-parallel algorithm gives the
edit distance there.

The benchmark goes to the tasks in blocks of at most ``BLOCK`` characters, one pass over the documents for each block, so its size
is bounded whatever the benchmark's. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.base import unused

#: Characters of benchmark text that one pass works with.
BLOCK = 8_000_000
#: Edits per character of an item.
ERROR = 0.08
#: Items shorter than this match whole documents within their budget; inside longer texts, if at all, only word by word.
SHORT = 32

_WORDS = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """Start and end of budget + 1 pieces of near equal length."""
    cuts = [length * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to a part of ``text`` and the end of that part, by Myers' bit vectors.

    Column by column the vertical differences of the distance table are kept in two numbers of len(pattern) bits, and the distance
    in the last row is followed by the horizontal difference there. None if every distance is over the budget.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for k, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | (1 << k)
    plus, minus, distance = full, 0, m
    best = (m, 0) if m <= budget else None
    for end, c in enumerate(text, 1):
        same = equal.get(c, 0)
        diagonal = ((((same & plus) + plus) ^ plus) | same | minus) & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, end)
            if not distance:
                break
        up = (up << 1) & full  # a match may begin anywhere: the first row is all zero
        down = (down << 1) & full
        plus = down | (full & ~((same | minus) | up)) & full
        minus = up & (same | minus)
    return best


class Matcher:
    """The pieces of a block of items as an automaton; with ``inside`` another one of the short items, between spaces."""

    def __init__(self, items: list[tuple[int, str]], error: float, short: int, inside: bool = False):
        known = ((None if i is None else str(i), normal(t)) for i, t in items)
        self.items = [(i, t, int(len(t) * error)) for i, t in known if t]
        self.whole: dict[int, list[int]] = {}  # short items by length
        self.reach = 0  # the largest budget of a short item: lengths differ by no more
        spots: dict[str, list[tuple[int, int]]] = {}
        exact: dict[str, list[int]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            if len(text) < short:
                self.reach = max(self.reach, budget)
                self.whole.setdefault(len(text), []).append(k)
                exact.setdefault(f" {text} ", []).append(k)
                continue
            for start, end in pieces(len(text), budget):
                spots.setdefault(text[start:end], []).append((k, start))
        self.automaton = _automaton({piece: (len(piece), where) for piece, where in spots.items()})
        self.inside = _automaton(exact if inside else {})

    def hits(self, text: str | None, first: bool = False) -> list[tuple]:
        """(item_id, distance, budget, start, end) of the best match of each item; with ``first`` of one item at most."""
        words = normal(text)
        near = (k for n in range(len(words) - self.reach, len(words) + self.reach + 1) for k in self.whole.get(n, ()))
        seen = {k: hit for k in near if (hit := self._short(k, words))}
        found = list(seen.values())
        if self.inside and not (first and found):
            for last, known in self.inside.iter(f" {words} "):
                for k in known:
                    if k not in seen:
                        seen[k] = (self.items[k][0], 0, 0, last - 1 - len(self.items[k][1]), last - 1)
            found = list(seen.values())
        if not self.automaton or (first and found):
            return found
        spans: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(words):
            for k, offset in where:
                _, pattern, budget = self.items[k]
                begin = last + 1 - size - offset - budget
                end = begin + len(pattern) + 2 * budget
                ranges = spans.setdefault(k, [])
                if ranges and begin <= ranges[-1][0] + 2 * budget:  # the same place again
                    ranges[-1][0], ranges[-1][1] = min(begin, ranges[-1][0]), max(end, ranges[-1][1])
                else:
                    ranges.append([begin, end])
        for k, ranges in spans.items():
            item, pattern, budget = self.items[k]
            best = None
            for begin, end in ranges:
                begin = max(0, begin)
                match = best_match(pattern, words[begin:end], budget)
                if match and (best is None or match[0] < best[0]):
                    best = (match[0], begin + match[1])
                    if not match[0]:
                        break
            if best:
                found.append((item, best[0], budget, max(0, best[1] - len(pattern)), best[1]))
                if first:
                    break
        return found

    def _short(self, k: int, words: str) -> tuple | None:
        item, pattern, budget = self.items[k]
        match = best_match(pattern, words, budget + abs(len(words) - len(pattern)))
        if not match:
            return None
        whole = _distance(pattern, words)
        return (item, whole, budget, 0, len(words)) if whole <= budget else None


def _automaton(known: dict) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton() if known else None
    for text, value in known.items():
        out.add_word(text, value)
    if out:
        out.make_automaton()
    return out


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def blocks(benchmark: DataFrame, limit: int = BLOCK) -> Iterator[Broadcast]:
    """The items (item_id, text) as broadcast lists of about ``limit`` characters each, made one at a time."""
    items = benchmark.where(F.length("text") > 0).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // limit))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count if total else 0):
        rows = items.where(block == k).collect()  # one block
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: Broadcast, error: float, short: int, inside: bool) -> Matcher:
    """One automaton in a worker at a time."""
    key = (hash(tuple(items.value)), error, short, inside)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, error, short, inside)
    return _MATCHERS[key]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, error: float = ERROR, short: int = SHORT, limit: int = BLOCK, inside: bool = False
) -> DataFrame:
    """A row for every document and test item that stands in it within the item's budget.

    doc_id, item_id, distance, budget, match_start and match_end; positions are in the normalised text, and of equally good places the first
    counts. Items of under ``short`` characters match documents that are nothing else; with ``inside`` they also
    match where all their words stand in a longer document, without any edit (budget 0). Null and empty texts and items
    match nothing, repeated documents give repeated rows, repeated items one, and an empty table gives no rows. Other
    columns of both tables play no part.
    """
    schema = "doc_id long, item_id long, distance int, budget int, match_start int, match_end int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, limit):
        # ids as text: pandas would turn a column with nulls into floats
        found = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
            _hits(items, error, short, inside), schema.replace("_id long", "_id string")
        )
        out = out.unionByName(found.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")}))
    return out


def _hits(items: Broadcast, error: float, short: int, inside: bool):
    columns = ["doc_id", "item_id", "distance", "budget", "match_start", "match_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(items, error, short, inside)
        for batch in batches:
            pairs = zip(batch["doc_id"], batch["text"], strict=True)
            yield pd.DataFrame([(doc, *hit) for doc, text in pairs for hit in matcher.hits(text)], columns=columns)

    return run


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, error: float = ERROR, short: int = SHORT, limit: int = BLOCK, inside: bool = False
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test item stands; see ``contaminated``."""
    (clean,) = unused(docs, "clean")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    for items in blocks(benchmark, limit):
        is_clean = _clean(items, error, short, inside)
        docs = docs.withColumn(clean, is_clean("text")).where(F.col(clean)).select(*columns)
    return docs


def _clean(items: Broadcast, error: float, short: int, inside: bool):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(items, error, short, inside)
        for batch in batches:
            yield pd.Series([not matcher.hits(text, first=True) for text in batch], dtype=bool)

    return run
