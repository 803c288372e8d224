"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a document's passage by floor(rate * n) edits. It is cut into one
piece more than that (one more again if that makes pairs), so one piece at least is found exactly in every such passage,
and of one pair at least one piece is exact and the other has one edit at most. One Aho-Corasick automaton finds all
pieces of all items in a pass over each document; where a hit's partner is near too, Myers' bit-parallel distance decides
within the place that the hit allows. Both sides are compared in lower case with white space as single blanks.

The benchmark goes to the workers in parts of at most ``part_bytes`` of text, one pass over the documents for each, so
what is broadcast is bounded whatever its size. Null or blank items and texts match nothing. Repeated rows of the benchmark are one
item; repeated documents give repeated rows; empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.chunks import small_batches
from strandloom.llm.text import trimmed

MATCHES = "doc_id long, item_id long, distance int, allowed int, end_at long"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Item:
    def __init__(self, number: int | None, text: str, rate: float):
        self.number, self.text, self.n = number, text, len(text)
        self.allowed = int(rate * self.n)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def pieces(self) -> Iterator[tuple[int, str, str, bool]]:
        """Offset, text, the partner's text, and whether that follows."""
        number = self.allowed + 1 + (self.allowed + 1) % 2
        cuts = [k * self.n // number for k in range(number + 1)]
        cut = [self.text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return ((cuts[k], cut[k], cut[k ^ 1], k % 2 == 0) for k in range(number) if cut[k])

    def distance(self, passage: str) -> tuple[int, int]:
        """The least edit distance of the item to a substring of the passage, and that substring's end (Myers 1999)."""
        every, top, masks = (1 << self.n) - 1, 1 << (self.n - 1), self.masks
        plus, minus, score, best = every, 0, self.n, (self.n, 0)
        for k, c in enumerate(passage):
            equal = masks.get(c, 0)
            x = equal | minus
            h = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | (every & ~(h | plus)), plus & h
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best[0]:
                    best = (score, k + 1)
            up, down = (up << 1) & every, (down << 1) & every
            plus, minus = down | (every & ~(x | up)), up & x
        return best


def near(passage: str, at: int, partner: str, follows: bool) -> bool:
    """Whether the partner may begin (or end) there with one edit at most: then one of its halves is exact."""
    n = len(partner)
    half = n // 2
    if follows:
        return passage.startswith(partner[:half], at) or any(passage.startswith(partner[half:], max(0, at + half + d)) for d in (0, -1, 1))
    begin = at - n + half
    return passage.startswith(partner[half:], max(0, begin)) or any(passage.startswith(partner[:half], max(0, at - n + d)) for d in (0, -1, 1))


class Matcher:
    def __init__(self, rows: list[tuple[int | None, str | None]], rate: float):
        import ahocorasick

        self.items = [Item(number, text, rate) for number, raw in rows if (text := plain(raw))]
        found: dict[str, list[tuple[int, int, str, bool]]] = {}
        for k, item in enumerate(self.items):
            for offset, piece, partner, follows in item.pieces():
                found.setdefault(piece, []).append((k, offset, partner, follows))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, allowed, end) of each item that the text holds."""
        passage = plain(text)
        if not passage or not self.items:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(passage):
            for k, offset, partner, follows in places:
                if not near(passage, end + 1 if follows else end + 1 - size, partner, follows):
                    continue
                item = self.items[k]
                start = end + 1 - size - offset
                low, high = max(0, start - item.allowed), min(len(passage), start + item.n + item.allowed)
                own = spans.setdefault(k, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        out = []
        for k, own in spans.items():
            item = self.items[k]
            at = passage.find(item.text)
            if at >= 0:
                out.append((item.number, 0, item.allowed, at + item.n))
                continue
            best = (item.allowed + 1, 0)
            for low, high in own:
                if high - low >= item.n - item.allowed:
                    distance, end = item.distance(passage[low:high])
                    best = min(best, (distance, low + end))
            if best[0] <= item.allowed:
                out.append((item.number, best[0], item.allowed, best[1]))
        return out


_matchers: dict[tuple, Matcher] = {}


def _matcher(part: tuple, rate: float) -> Matcher:
    name, shared = part
    key = (name, rate)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shared.value, rate)
    return _matchers[key]


def _parts(benchmark: DataFrame, part_bytes: int, item_col: str, text_col: str) -> Iterator:
    """The benchmark as named broadcasts of about part_bytes of text (or one item), at least one. Repeated rows are one item."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + size // part_bytes
    for part in range(parts):
        rows = [tuple(x) for x in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()]
        if rows or part == 0:
            yield uuid.uuid4().hex, spark.sparkContext.broadcast(rows)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, part_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row (doc_id, item_id, distance, allowed, end_at in the plain text) for each item that a document holds."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _parts(benchmark, part_bytes, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = _matcher(shared, rate)
            for batch in batches:
                found = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in match(text)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "allowed", "end_at"])

        found = docs.mapInArrow(trimmed(run), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, part_bytes: int = 4 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, in all their columns; nothing is shuffled."""
    small_batches(docs.sparkSession)
    for shared in _parts(benchmark, part_bytes, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = _matcher(shared, rate)
            for batch in batches:
                yield batch.filter(pa.array([not match(text) for text in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
