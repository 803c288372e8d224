"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Best-fit decreasing looks only at lengths, and there are at most ``capacity`` of them. So the packing is
planned from the histogram of piece lengths, on equal pieces at once: a segment tree over remaining capacities
gives the tightest open bins in logarithmic time, and each placement is recorded as a run (pieces of this length
from rank a on go to the bins from b on, at this offset). The plan's size depends on ``capacity``, not on
the number of documents; every piece finds its place by a binary search in it.

Null text counts as empty and an empty text is the end token alone; rows with a null id are packed like others;
repeated rows are packed as often as they occur; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.chunks import small_batches
from strandloom.llm.text import blocks, flat, trimmed
from strandloom.operators.shared import materialise, partitions

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: How the byte-level vocabulary splits a text before merging (a fixed value of that tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, Encoder] = {}


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file.

    The merges are run by ``tiktoken``, about four times as fast, with the same vocabulary as ranks. Texts that
    hold one of the file's special strings go to ``tokenizers`` itself, and so do all texts if the two differ on a probe.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        code = _byte_of_char()
        ranks = {bytes(code[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = None
        try:
            fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            probe = ["It's 12 o'clock,  naïve\n\n\tcafé —  x=1;　日本語   end ", "aaaa" * 50, "\r\n a​b"]
            if [fast.encode_ordinary(x) for x in probe] == [x.ids for x in self.exact.encode_batch(probe, add_special_tokens=False)]:
                self.fast = fast
        except (ValueError, KeyError):
            pass

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids with the end token, cut from the end into pieces of ``capacity`` if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for low, high in blocks(offsets, 1 << 23):
                ids, parts, starts, lengths, sums = [], [], [], [], []
                for row in range(low, high):
                    got = np.array([*encode(data[offsets[row] : offsets[row + 1]].tobytes().decode()), end_id], "<u4")
                    start, length = 0, (len(got) - 1) % capacity + 1
                    doc = batch.column(0)[row].as_py()
                    part = 0
                    while start < len(got):
                        ids.append(doc)
                        parts.append(part)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(got[start : start + length].tobytes()))
                        start, length, part = start + length, capacity, part + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), PIECES)


class CapacityTree:
    """Which remaining capacities have open bins; the least one of at least x in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, at: int, value: bool) -> None:
        at += self.size
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def first(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1 and (at % 2 or not self.open[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing of histogram[length] pieces of each length: rows (length, rank, count, bin, offset)
    in order, and the number of bins. Piece rank + i of that length goes to bin + i at that offset."""
    tree, ranges, rows, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            room = tree.first(length)
            each = (capacity if room is None else room) // length
            if room is None:  # open as many as the rest fills, but one for what does not fill one
                room, begin, count = capacity, bins, max(1, (total - rank) // each)
                bins += count
            else:
                begin, count = ranges[room].pop()
                if not ranges[room]:
                    tree.set(room, False)
            fill = min(count, (total - rank) // each)  # bins that take all that fits, before any other is touched
            if fill:
                for k in range(each):
                    rows.append((length, rank, fill, begin, capacity - room + k * length))
                    rank += fill
                left = room - each * length
                if left:
                    ranges[left].append((begin, fill))
                    tree.set(left, True)
            if fill < count:
                last = total - rank
                for k in range(last):
                    rows.append((length, rank, 1, begin + fill, capacity - room + k * length))
                    rank += 1
                if room - last * length:
                    ranges[room - last * length].append((begin + fill, 1))
                    tree.set(room - last * length, True)
                if count - fill > 1:
                    ranges[room].append((begin + fill + 1, count - fill - 1))
                    tree.set(room, True)
    return np.array(rows, np.int64).reshape(-1, 5), bins


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its sequence_id and offset. Pieces are ranked within their length by a range sort and
    per-partition counts, so no length's pieces meet in one task."""
    spark = docs.sparkSession
    small_batches(spark)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            out = np.empty(len(lengths), np.int64)
            edges = np.flatnonzero(np.diff(lengths)) + 1  # rows come sorted by length
            for part in np.split(np.arange(len(lengths)), edges):
                if len(part):
                    base = seen.get(int(lengths[part[0]]), 0)
                    out[part] = base + np.arange(len(part))
                    seen[int(lengths[part[0]])] = base + len(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "local_rank"])

    cut, _ = materialise(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    ranked = cut.repartitionByRange(partitions(spark), "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece").mapInArrow(rank, PIECES + ", local_rank long")
    ranked, _ = materialise(ranked.withColumn("part", F.spark_partition_id()), "ranked")
    # ranges are contiguous in length: at most one row for each partition and each length
    counts = sorted(map(tuple, ranked.groupBy("part", "length").count().collect()))
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for part, length, n in counts:
        base[part, length] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    rows, _ = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast((base, rows))  # bounded by capacity and the number of partitions

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows = shared.value
        keys = rows[:, 0] * (1 << 48) + rows[:, 1]
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("local_rank").to_numpy() + np.array([base[p, n] for p, n in zip(batch.column("part").to_pylist(), lengths.tolist(), strict=True)], np.int64)
            at = np.searchsorted(keys, lengths * (1 << 48) + ranks, side="right") - 1
            found = rows[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found[:, 3] + ranks - found[:, 1]), pa.array(found[:, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
