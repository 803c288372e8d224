"""k-mers over ACGT as numbers, in Arrow functions over whole batches; sets of them as bitmaps of 4 ** k bits.

Two bits a symbol, A least, the first symbol highest: numbers are ordered as their strings are. Texts with other symbols go through plain Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.shared import partitions

#: Bitmaps that go to all tasks have 4 ** 13 bits (8 MB) at most, those that are merged by blocks 4 ** 14.
WIDEST = 13
BLOCK = 1 << 18
#: Labels of up to so many symbols are numbers, with a 1 before the first symbol.
SHORT = 31
#: Symbols that are worked on at once, and bytes that a task gathers before it drops repeated ones.
CHUNK, HELD = 1 << 18, 1 << 24
_CODE = np.full(256, 255, np.uint8)
_CODE[[65, 67, 71, 84]] = (0, 1, 2, 3)
_LETTER = np.frombuffer(b"ACGT", np.uint8)
_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[[65, 67, 71, 84]] = (84, 71, 67, 65)
_TO = str.maketrans("ACGT", "TGCA")
#: Odd, and its inverse modulo 2 ** 64: numbers are dealt out by the highest bits of their product.
_MIX = 0x9E3779B97F4A7C15
_BACK = pow(_MIX, -1, 1 << 64)


def reversed_text(s: str) -> str:
    return s[::-1].translate(_TO)


def number(s: str) -> int:
    """The number of a string over ACGT, -1 for any other."""
    found = 0
    for c in s:
        at = "ACGT".find(c)
        if at < 0:
            return -1
        found = found * 4 + at
    return found


def both_strands(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all windows of k symbols and of their reverse complements, by doubling."""
    kind = np.uint32 if k <= 16 else np.uint64
    a, b, width = code.astype(kind), (3 - code).astype(kind), 1
    f = r = a
    have = 0
    while True:
        if k & width:
            if have:
                m = max(0, len(code) - have - width + 1)
                f, r = (f[:m] << kind(2 * width)) | a[have : have + m], r[:m] | (b[have : have + m] << kind(2 * have))
            else:
                f, r = a, b
            have += width
        if have == k:
            return f, r
        m = max(0, len(a) - width)
        a, b = (a[:m] << kind(2 * width)) | a[width:], b[:m] | (b[width:] << kind(2 * width))
        width *= 2


class Longest:
    """Numbers of the 31 symbols from any asked place on, or of their reverse complements, put together from windows of 13."""

    def __init__(self, windows: np.ndarray, across: bool):
        self.windows, self.steps = windows, (18, 5, 0) if across else (0, 13, 18)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        a, b, c = (self.windows[at + i].astype(np.uint64) for i in self.steps)
        return a << np.uint64(36) | b << np.uint64(10) | (c & np.uint64(1023))


def padded(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, Longest, Longest]:
    """k-mers of both strands by place, k up to 13, and the 31 symbols by place, 31 more than in ``code``."""
    pad = np.zeros(SHORT, np.uint8)
    f, r = both_strands(np.concatenate([pad, code, pad]), WIDEST)
    n, rest = len(code) - k + 1, np.uint32(2 * (WIDEST - k))
    return f[SHORT : SHORT + n] >> rest, r[SHORT + k - WIDEST : SHORT + k - WIDEST + n] >> rest, Longest(f, False), Longest(r, True)


def taken(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which numbers are in a bitmap."""
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of strings; null is empty."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(batch: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, np.ndarray] | str]:
    """Texts of ``least`` symbols at least: codes and offsets of those over ACGT, in chunks; each other one as a string."""
    data, offsets = _flat(batch.column(0))
    code = _CODE[data]
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, np.flatnonzero(code == 255), "right") - 1] = True
    for i in np.flatnonzero(odd):
        s = data[offsets[i] : offsets[i + 1]].tobytes().decode()
        if len(s) >= least:
            yield s
    size = np.diff(offsets)
    use = np.flatnonzero(~odd & (size >= least))
    i = 0
    while i < len(use):
        sums = np.cumsum(size[use[i : i + CHUNK // least + 1]])
        n = max(1, int(np.searchsorted(sums, CHUNK, "right")))
        rows = use[i : i + n]
        if rows[-1] - rows[0] + 1 == n:
            part = code[offsets[rows[0]] : offsets[rows[-1] + 1]]
        else:
            part = np.concatenate([code[offsets[j] : offsets[j + 1]] for j in rows])
        yield part, np.concatenate([[0], sums[:n]])
        i += n


def _whole(offsets: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k symbols of a chunk lie within one text."""
    ok = np.ones(offsets[-1] - k + 1, bool)
    over = (offsets[1:-1, None] - np.arange(1, k)).ravel()
    ok[over[over < len(ok)]] = False
    return ok


# sets of k-mers


def _mark(bits: np.ndarray, numbers: np.ndarray) -> None:
    """Put numbers into a bitmap."""
    x = _once(numbers)
    at = x >> 3
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    if len(first):
        bits[at[first]] |= np.bitwise_or.reduceat(np.uint8(128) >> (x & 7).astype(np.uint8), first)


def _gathering(reads: DataFrame) -> DataFrame:
    """Fewer tasks than splits, as each may give a whole bitmap."""
    spark = reads.sparkSession
    return reads.coalesce(max(spark.sparkContext.defaultParallelism, partitions(spark) // 8))


def _blocks(reads: DataFrame, k: int, pick: Callable, plain: Callable, least: int) -> DataFrame:
    """(block, bits, odd): bitmaps of the k-mers that ``pick`` takes from chunks, merged; k-mers ``plain`` takes from other texts are rows."""
    size = max(4**k, 8)
    wide = k > WIDEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, odd, held, n = np.zeros(size // 8 if wide else size, np.uint8 if wide else bool), set(), [], 0
        for batch in batches:
            for part in texts(batch, least):
                if not isinstance(part, str):
                    for found in pick(*part):
                        if wide:
                            held.append(found)
                            n += len(found)
                        else:
                            seen[found] = True
                    if n > HELD // 4:
                        _mark(seen, np.concatenate(held))
                        held, n = [], 0
                    continue
                for s in plain(part):
                    at = number(s)
                    if at < 0:
                        odd.add(s)
                    elif wide:
                        held.append(np.array([at], np.uint32))
                    else:
                        seen[at] = True
                if len(odd) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array([-1] * len(odd), pa.int32()), pa.nulls(len(odd), pa.binary()), pa.array(sorted(odd))], names=["block", "bits", "odd"])
                    odd = set()
        if held:
            _mark(seen, np.concatenate(held))
        for i, at in enumerate(range(0, size, BLOCK)):
            own = seen[at // 8 : (at + BLOCK) // 8] if wide else seen[at : at + BLOCK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([(own if wide else np.packbits(own)).tobytes()]), pa.nulls(1, pa.string())], names=["block", "bits", "odd"])
        if odd:
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(odd), pa.int32()), pa.nulls(len(odd), pa.binary()), pa.array(sorted(odd))], names=["block", "bits", "odd"])

    def merge(rows: pa.Table) -> pa.Table:
        odd = pc.unique(rows["odd"].combine_chunks()).drop_null()
        bits = None
        for one in rows["bits"]:
            if one.is_valid:
                own = np.frombuffer(one.as_buffer(), np.uint8)
                bits = own.copy() if bits is None else np.bitwise_or(bits, own, out=bits)
        n = len(odd) + (bits is not None)
        head = [] if bits is None else [bits.tobytes()]
        return pa.table([pa.array([rows["block"][0].as_py()] * n, pa.int32()), pa.array(head + [None] * len(odd), pa.binary()), pa.array([None] * len(head) + odd.to_pylist(), pa.string())], names=["block", "bits", "odd"])

    form = "block int, bits binary, odd string"
    source = reads.select("seq")
    found = (_gathering(source) if wide else source).mapInArrow(run, form)
    key = F.when(F.col("block") >= 0, 0).otherwise(F.pmod(F.hash("odd"), F.lit(1024)))
    return found.withColumn("part", key).groupBy("block", "part").applyInArrow(lambda rows: merge(rows), form)


def _windows(k: int, strands: str) -> tuple[Callable, Callable]:
    def pick(code, offsets):
        f, r = both_strands(code, k)
        ok = _whole(offsets, k)
        f, r = f[ok], r[ok]
        return [f] if strands == "one" else [np.minimum(f, r)] if strands == "canonical" else [f, r]

    def plain(s):
        for i in range(len(s) - k + 1):
            x = s[i : i + k]
            y = reversed_text(x)
            yield from [x] if strands == "one" else [min(x, y)] if strands == "canonical" else [x, y]

    return pick, plain


def spelled(numbers: np.ndarray, k: int) -> pa.Array:
    """Strings of k symbols."""
    out = np.empty((len(numbers), k), np.uint8)
    for j in range(k):
        out[:, j] = _LETTER[(numbers >> (2 * (k - 1 - j))) & 3]
    return _strings(out.ravel(), np.arange(len(numbers) + 1, dtype=np.int64) * k)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def distinct_kmers(reads: DataFrame, k: int, strands: str = "one") -> DataFrame:
    """(kmer): distinct k-mers of up to 14 symbols, as they stand (one), the smaller of both strands (canonical), or on both strands (both)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, bits, odd in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if odd is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted({odd, reversed_text(odd)} if strands == "both" else {odd}))], names=["kmer"])
                    continue
                at = (np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))) + block * BLOCK).astype(np.uint32)
                if strands == "both":
                    other = other_strand(at, k)
                    at = np.concatenate([at, other[other != at]])
                for i in range(0, len(at), 1 << 16):
                    yield pa.RecordBatch.from_arrays([spelled(at[i : i + (1 << 16)], k)], names=["kmer"])

    if k > WIDEST + 1:
        raise ValueError("k is over 14")
    return _blocks(reads, k, *_windows(k, "one" if strands == "one" else "canonical"), k).mapInArrow(run, "kmer string")


def has_others(reads: DataFrame) -> bool:
    """Whether some text has other symbols than ACGT."""
    return not reads.filter(F.col("seq").rlike("[^ACGT]")).isEmpty()


def collected(blocks: DataFrame, k: int) -> np.ndarray | None:
    """The bitmap of merged blocks; None if there are k-mers with other symbols."""
    out = np.zeros(max(4**k // 8, 1), np.uint8)
    for row in blocks.toLocalIterator():
        if row["bits"] is None:
            return None
        own = np.frombuffer(row["bits"], np.uint8)
        at = row["block"] * (BLOCK // 8)
        out[at : at + len(own)] = own[: len(out) - at]
    return out


def bitmap(vertices: DataFrame, k: int) -> np.ndarray | None:
    """The bitmap of canonical k-mers (kmer); None if some have other symbols than ACGT."""
    pick, plain = _windows(k, "canonical")
    return collected(_blocks(vertices.select(F.col("kmer").alias("seq")), k, pick, plain, k), k)


# texts cut at vertices


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Strings as one value: how many, their lengths, their bytes."""
    sizes = np.concatenate([x[0] for x in parts]).astype(np.uint32)
    return np.uint32(len(sizes)).tobytes() + sizes.tobytes() + b"".join(x[1].tobytes() for x in parts)


def _once(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in order; sorting takes less here than the table of ``np.unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _gathered(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of slices, one after the other."""
    ends = np.cumsum(size)
    return buffer[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _plain_cut(s: str, bits: np.ndarray, k: int) -> Iterator[tuple[str, bool]]:
    """(label, open) of one text; the smaller strand of labels that end at vertices."""
    at = []
    for i in range(len(s) - k + 1):
        x = number(s[i : i + k])
        if x >= 0:
            x = min(x, number(reversed_text(s[i : i + k])))
            if bits[x >> 3] >> (7 - (x & 7)) & 1:
                at.append(i)
    v = [s[i : i + k] for i in at]
    for j in range(len(at) - 1):
        if j and v[j - 1] == v[j] == v[j + 1] and at[j] - at[j - 1] == at[j + 1] - at[j] < k:
            continue
        label = s[at[j] : at[j + 1] + k]
        yield min(label, reversed_text(label)), False
    if at and at[0]:
        yield reversed_text(s[: at[0] + k]), True
    if at and at[-1] + k < len(s):
        yield s[at[-1] :], True


def _cut_chunk(code: np.ndarray, offsets: np.ndarray, bits: np.ndarray, k: int):
    """Starts, ends, strands and openness of the labels of a chunk, with numbers of the 31 symbols from each place on and back to it."""
    own, other, f, r = padded(code, k)
    at = np.flatnonzero(taken(bits, np.minimum(own, other)) & _whole(offsets, k))
    row = np.searchsorted(offsets, at, "right") - 1
    same = row[1:] == row[:-1]
    step, v = np.diff(at), own[at]
    like = same & (v[1:] == v[:-1]) & (step < k)
    period = np.zeros(len(at), bool)
    if len(at) > 2:
        period[1:-1] = like[1:] & like[:-1] & (step[1:] == step[:-1])
    j = np.flatnonzero(same & ~period[:-1])
    a, b = at[j], at[j + 1] + k
    back, ahead = other[at[j + 1]], v[j]
    flip = back < ahead
    for i in np.flatnonzero(back == ahead):
        s = code[a[i] : b[i]]
        t = 3 - s[::-1]
        differ = np.flatnonzero(s != t)
        flip[i] = len(differ) > 0 and t[differ[0]] < s[differ[0]]
    last = np.flatnonzero(np.append(~same, True)[: len(at)]) if len(at) else at
    first = np.flatnonzero(np.append(True, ~same)[: len(at)]) if len(at) else at
    last = last[at[last] + k < offsets[row[last] + 1]]
    first = first[at[first] > offsets[row[first]]]
    a = np.concatenate([a, at[last], offsets[row[first]]])
    b = np.concatenate([b, offsets[row[last] + 1], at[first] + k])
    flip = np.concatenate([flip, np.zeros(len(last), bool), np.ones(len(first), bool)])
    return a, b, flip, np.arange(len(a)) >= len(j), f, r


def _used(only: str, a: np.ndarray, b: np.ndarray, is_open: np.ndarray, offsets: np.ndarray, f: np.ndarray, r: np.ndarray, marked: np.ndarray, k: int) -> np.ndarray:
    """Which labels of a chunk ``cut`` is asked for."""
    if only == "open":
        return is_open
    rest = np.uint64(2 * (SHORT - k))
    at_mark = lambda at: taken(marked, np.minimum(f[SHORT + at] >> rest, r[k + at] >> rest))
    touched = at_mark(a) | at_mark(b - k)
    if only == "held":  # vertices lie at ends of labels, so a text without a marked end has none
        row = np.searchsorted(offsets, a, "right") - 1
        has = np.zeros(len(offsets), bool)
        has[row[touched]] = True
        return has[row]
    return ~is_open & (touched if only == "loose" else ~touched)


def cut(reads: DataFrame, bits, k: int, only: str = "all", marks=None) -> DataFrame:
    """(bucket, kind, body): labels between vertices of the broadcast bitmap, without most repeated ones. Kinds: 0 numbers, 1 strings; 2 and 3 are open ones.

    Only: open ones; those of texts that hold a vertex of the bitmap ``marks`` (held); closed ones with a marked end (loose) or without (firm). But
    for open ones, texts have to be over ACGT then."""
    deal = max(6, int(np.ceil(np.log2(4 * partitions(reads.sparkSession)))))
    form = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        out = []
        for kind in (0, 2):
            if held[kind]:
                h = _once(np.concatenate(held[kind]) * np.uint64(_MIX))
                edges = np.searchsorted(h, np.arange(1, 1 << deal, dtype=np.uint64) << np.uint64(64 - deal))
                out += [(i, kind, _planes(np.diff(np.sort(x * np.uint64(_BACK)), prepend=np.uint64(0)))) for i, x in enumerate(np.split(h, edges)) if len(x)]
        for kind in (1, 3):
            if held[kind]:
                key, size, data = (np.concatenate([x[i] for x in held[kind]]) for i in range(3))
                ends = np.cumsum(size)
                coded = pc.dictionary_encode(_strings(data, np.concatenate([[0], ends])))
                once = np.zeros(len(coded.dictionary), np.int64)
                once[coded.indices.to_numpy()[::-1]] = np.arange(len(size))[::-1]
                own = (key[once] * np.uint64(_MIX)) >> np.uint64(64 - deal)
                once = once[np.argsort(own, kind="stable")]
                own = np.sort(own)
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                for x, i in zip(np.split(once, at[1:]), at, strict=True):
                    out.append((int(own[i]), kind, _joined([(size[x], _gathered(data, ends[x] - size[x], size[x]))])))
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out[i : i + 64], strict=True), form, strict=True)], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = bits.value, {i: [] for i in range(4)}, 0
        marked = marks.value if marks is not None else None
        for batch in batches:
            for part in texts(batch, k):
                if isinstance(part, str):
                    if only not in ("all", "open"):
                        raise ValueError("a text has other symbols than ACGT")
                    for label, is_open in _plain_cut(part, own, k):
                        if only == "open" and not is_open:
                            continue
                        x = number(label) if len(label) <= SHORT else -1
                        if x >= 0:
                            held[2 * is_open].append(np.array([x | 1 << (2 * len(label))], np.uint64))
                        else:
                            raw = label.encode()
                            held[2 * is_open + 1].append((np.array([hash_of(raw)], np.uint64), np.array([len(raw)]), np.frombuffer(raw, np.uint8)))
                        n += 8 + len(label)
                else:
                    code, offsets = part
                    a, b, flip, is_open, f, r = _cut_chunk(code, offsets, own, k)
                    if only != "all":
                        use = _used(only, a, b, is_open, offsets, f, r, marked, k)
                        a, b, flip, is_open = a[use], b[use], flip[use], is_open[use]
                    size = b - a
                    head = np.where(flip, r[b], f[a + SHORT])
                    short = size <= SHORT
                    shift = (2 * np.minimum(size, SHORT)).astype(np.uint64)
                    numbers = (head >> (np.uint64(2 * SHORT) - shift)) | (np.uint64(1) << shift)
                    buffer = _LETTER[np.concatenate([code, 3 - code[::-1]])]
                    for kind, which in ((0, ~is_open), (2, is_open)):
                        x = which & short
                        held[kind].append(_once(numbers[x]))
                        x = np.flatnonzero(which & ~short)
                        if len(x):
                            start = np.where(flip[x], 2 * len(code) - b[x], a[x])
                            data = _gathered(buffer, start, size[x])
                            held[kind + 1].append((label_keys(data, size[x]), size[x], data))
                            n += len(data) + 16 * len(x)
                        n += 8 * len(held[kind][-1])
                if n > HELD:
                    yield from flush(held)
                    held, n = {i: [] for i in range(4)}, 0
        yield from flush(held)

    return reads.select("seq").mapInArrow(run, "bucket int, kind int, body binary")


def label_keys(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key for each string, from its bytes: sums that depend on place."""
    ends = np.cumsum(size)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat((ends - size).astype(np.uint64), size)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), ends - size) if len(size) else np.zeros(0, np.uint64)


def hash_of(raw: bytes) -> int:
    return int(label_keys(np.frombuffer(raw, np.uint8), np.array([len(raw)]))[0])


def _decoded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of numbers with a 1 before the first symbol."""
    size = (np.frexp(numbers.astype(np.float64))[1].astype(np.int64) - 1) // 2
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    shift = 2 * (np.repeat(ends, size) - 1 - np.arange(total))
    return _LETTER[(np.repeat(numbers, size) >> shift.astype(np.uint64)) & np.uint64(3)], np.concatenate([[0], ends])


def _labels(rows: pa.Table, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a kind's distinct labels."""
    bodies = [x for x, y in zip(rows["body"].to_pylist(), rows["kind"].to_pylist(), strict=True) if y == kind]
    if not bodies:
        return
    if kind % 2 == 0:
        found = _once(np.concatenate([np.cumsum(_unplaned(x, np.uint64), dtype=np.uint64) for x in bodies]))
        for i in range(0, len(found), CHUNK // 4):
            yield _decoded(found[i : i + CHUNK // 4])
        return
    sizes, data = [], []
    for x in bodies:
        n = int(np.frombuffer(x, np.uint32, 1)[0])
        sizes.append(np.frombuffer(x, np.uint32, n, 4))
        data.append(np.frombuffer(x, np.uint8, offset=4 + 4 * n))
    data, offsets = _flat(pc.unique(_strings(np.concatenate(data), np.concatenate([[0], np.cumsum(np.concatenate(sizes).astype(np.int64))]))))
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 4 * CHUNK, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _ends(data: np.ndarray, offsets: np.ndarray, k: int, right: bool) -> pa.Array:
    n = len(offsets) - 1
    start = (offsets[1:] - k) if right else offsets[:-1]
    return _strings(data[(start[:, None] + np.arange(k)).ravel()], np.arange(n + 1, dtype=np.int64) * k)


def _edges(data: np.ndarray, offsets: np.ndarray, k: int, is_open: bool, both: bool) -> Iterator[pa.Table]:
    """(src, dst, label), on both strands unless open or not wanted."""
    names = ["src", "dst", "label"]
    if (data > 127).any():
        out = set()
        for s in _strings(data, offsets).to_pylist():
            t = reversed_text(s)
            out |= {(s[:k], None, s)} if is_open else {(x[:k], x[-k:], x) for x in ([s, t] if both else [s])}
        yield pa.table([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=names)
        return
    label = _strings(data, offsets)
    if is_open:
        yield pa.table([_ends(data, offsets, k, False), pa.nulls(len(label), pa.string()), label], names=names)
        return
    yield pa.table([_ends(data, offsets, k, False), _ends(data, offsets, k, True), label], names=names)
    if not both:
        return
    size = np.diff(offsets)
    back = _OTHER[data[np.repeat(offsets[:-1] + offsets[1:] - 1, size) - np.arange(len(data))]]
    other = np.flatnonzero(np.add.reduceat(back != data, offsets[:-1]) > 0) if len(size) else size
    if len(other) < len(size):
        back, offsets = _gathered(back, offsets[other], size[other]), np.concatenate([[0], np.cumsum(size[other])])
    yield pa.table([_ends(back, offsets, k, False), _ends(back, offsets, k, True), _strings(back, offsets)], names=names)


def edges(labels: DataFrame, k: int, both: bool = True) -> DataFrame:
    """(src, dst, label): the distinct edges of ``cut``, on both strands or, but for open ones, the smaller."""
    empty = pa.schema([(x, pa.string()) for x in ("src", "dst", "label")]).empty_table()

    def merge(rows: pa.Table) -> pa.Table:
        return pa.concat_tables([empty, *(t for kind in range(4) for part in _labels(rows, kind) for t in _edges(*part, k, kind > 1, both))])

    return labels.groupBy("bucket").applyInArrow(lambda rows: merge(rows), "src string, dst string, label string")


# unbranching paths: texts cut at all vertices but the inner ones


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A permutation of the numbers of k symbols."""
    mask, step = np.uint64((1 << 2 * k) - 1), np.uint64(k)
    x = x.astype(np.uint64) * np.uint64(_MIX | 1) & mask
    return ((x ^ (x >> step)) * np.uint64(0xD6E8FEB86659FD93) & mask).astype(np.uint32)


def unmixed(x: np.ndarray, k: int) -> np.ndarray:
    mask, step = np.uint64((1 << 2 * k) - 1), np.uint64(k)
    x = x.astype(np.uint64) * np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64)) & mask
    return ((x ^ (x >> step)) * np.uint64(_BACK) & mask).astype(np.uint32)


def other_strand(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the reverse complements."""
    x = ~x.astype(np.uint32)
    for mask, step in ((0x33333333, 2), (0x0F0F0F0F, 4), (0x00FF00FF, 8), (0x0000FFFF, 16)):
        m, n = np.uint32(mask), np.uint32(step)
        x = (x >> n & m) | ((x & m) << n)
    return x >> np.uint32(32 - 2 * k)


def projected(table: DataFrame) -> DataFrame:
    """(read_id, seq): texts of (read_id, text) over ACGT as ``sequences.project`` makes them; null stays null."""
    letter = np.zeros(256, np.uint8)
    for i in range(26):
        letter[[65 + i, 97 + i]] = _LETTER[i % 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            i, sums = 0, np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while i < len(sums):
                n = max(1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + 4 * CHUNK, "right")) - i)
                batch, i = whole.slice(i, n), i + n
                data, offsets = _flat(batch.column(1))
                seq = letter[data]
                kept = seq > 0
                ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(batch.column(1).is_valid(), _strings(seq[kept], ends), pa.scalar(None, pa.string()))], names=["read_id", "seq"])

    kind = table.schema["read_id"].dataType.simpleString()
    return table.select("read_id", "text").mapInArrow(run, f"read_id {kind}, seq string")


def minimizer_bits(reads: DataFrame, k: int, w: int) -> np.ndarray | None:
    """The bitmap of canonical k-mers of least hash among every w in a row; None if a text has other symbols than ACGT."""

    def pick(code, offsets):
        h = mixed(np.minimum(*both_strands(code, k)), k)
        best, width = h, 1
        while 2 * width <= w:
            best, width = np.minimum(best[:-width], best[width:]), 2 * width
        n = len(h) - w + 1
        best = np.minimum(best[:n], best[w - width :][:n])[_whole(offsets, k + w - 1)]
        return [unmixed(best[np.append(True, best[1:] != best[:-1])[: len(best)]], k)]

    def plain(s):
        yield next(s[i : i + k] for i in range(len(s) - k + 1) if number(s[i : i + k]) < 0)

    return collected(_blocks(reads, k, pick, plain, k + w - 1), k)


def end_bits(reads: DataFrame, k: int) -> np.ndarray | None:
    """The bitmap of the canonical k-mers at both ends of texts."""

    def pick(code, offsets):
        at = np.concatenate([offsets[:-1], offsets[1:] - k])
        f, r = both_strands(code[(at[:, None] + np.arange(k)).ravel()], k)
        return [np.minimum(f[::k], r[::k])]

    def plain(s):
        for x in (s[:k], s[-k:]):
            yield min(x, reversed_text(x))

    return collected(_blocks(reads, k, pick, plain, k), k)


def _only_way(key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the rest that all rows of a key have; 0 if they differ."""
    if not len(key):
        return key, rest
    order = np.argsort(key)
    key, rest = key[order], rest[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    low, high = np.minimum.reduceat(rest, first), np.maximum.reduceat(rest, first)
    return key[first], np.where(low == high, low, np.uint64(0))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: high bytes are mostly 0, and shuffles are compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def ways(reads: DataFrame, bits, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps over mixed numbers: vertices on either strand that one label leaves, and canonical ones that are first or last in a text.

    Texts are over ACGT, and neighbouring vertices at most 31 symbols apart."""
    deal = min(2 * k - 3, max(6, int(np.ceil(np.log2(4 * partitions(reads.sparkSession))))))
    form, names = "bucket int, src binary, rest binary, tips binary", ["bucket", "src", "rest", "tips"]
    shift = np.uint32(2 * k - deal)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        src, rest = _only_way(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
        tips = _once(np.concatenate([x[2] for x in held]))
        a, b = (np.searchsorted(x >> shift, np.arange((1 << deal) + 1)) for x in (src, tips))
        step = np.diff(src, prepend=src[:1])
        step[a[:-1][a[:-1] < len(src)]] = src[a[:-1][a[:-1] < len(src)]]
        rows = [(i, _planes(step[a[i] : a[i + 1]]), _planes(rest[a[i] : a[i + 1]]), tips[b[i] : b[i + 1]].tobytes()) for i in range(1 << deal) if a[i] < a[i + 1] or b[i] < b[i + 1]]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_bits, held, n = bits.value, [], 0
        for batch in batches:
            for part in texts(batch, k):
                if isinstance(part, str):
                    raise ValueError("a text has other symbols than ACGT")
                code, offsets = part
                own, other, f, r = padded(code, k)
                at = np.flatnonzero(taken(own_bits, np.minimum(own, other)) & _whole(offsets, k))
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, "right") - 1
                same = row[1:] == row[:-1]
                i, j = at[:-1][same], at[1:][same]
                if len(i) and (j - i).max() > SHORT:
                    raise ValueError("vertices are over 31 symbols apart")
                size = (2 * (j - i)).astype(np.uint64)
                cut_off, top = np.uint64(2 * SHORT) - size, np.uint64(1) << size
                tip = at[np.append(True, ~same) | np.append(~same, True)]
                src = mixed(np.concatenate([own[i], other[j]]), k)
                held.append((src, np.concatenate([(f[SHORT + i + k] >> cut_off) | top, (r[j] >> cut_off) | top]), mixed(np.minimum(own[tip], other[tip]), k)))
                n += len(src)
                if n > HELD // 8:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    def merge(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        src = np.concatenate([np.cumsum(_unplaned(x, np.uint32), dtype=np.uint32) for x in rows["src"].to_pylist()])
        src, rest = _only_way(src, np.concatenate([_unplaned(x, np.uint64) for x in rows["rest"].to_pylist()]))
        tips = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["tips"].to_pylist()])
        out = []
        for x in (src[rest > 0], tips):
            seen = np.zeros(1 << int(shift), bool)
            seen[x & np.uint32((1 << int(shift)) - 1)] = True
            out.append(np.packbits(seen).tobytes())
        return pa.table([pa.array([bucket], pa.int32()), pa.array(out[:1]), pa.array(out[1:])], names=["bucket", "one", "tips"])

    found = reads.select("seq").mapInArrow(run, form).groupBy("bucket").applyInArrow(lambda rows: merge(rows), "bucket int, one binary, tips binary")
    one, tips = (np.zeros(4**k // 8, np.uint8) for _ in range(2))
    size = (1 << int(shift)) // 8
    for x in found.toLocalIterator():
        for whole, own in ((one, x["one"]), (tips, x["tips"])):
            whole[x["bucket"] * size : (x["bucket"] + 1) * size] = np.frombuffer(own, np.uint8)
    return one, tips


def without_inner(bits: np.ndarray, one: np.ndarray, tips: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the vertices but for inner ones that are first or last in no text, and of the inner ones that are left."""
    kept, loose = np.zeros_like(bits), np.zeros_like(bits)
    for i in range(0, len(bits), BLOCK):
        v = (np.flatnonzero(np.unpackbits(bits[i : i + BLOCK])) + 8 * i).astype(np.uint32)
        h = mixed(v, k)
        inner, tip = taken(one, h) & taken(one, mixed(other_strand(v, k), k)), taken(tips, h)
        _mark(kept, v[~inner | tip])
        _mark(loose, v[inner & tip])
    return kept, loose


def branches(reads: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Bitmaps of the canonical k-mers whose extensions on either side are not exactly one, and of the others that reads begin or end with; None if a text
    has other symbols than ACGT. From the bitmap of (k + 1)-mers on both strands, in which the four extensions of a k-mer are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, bits, odd in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, 4).sum(axis=1) if odd is None else None
                out = [None, None] if n is None else [np.packbits(x).tobytes() for x in (n == 1, n > 0)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in out)], names=["block", "one", "some"])

    found = _blocks(reads, k + 1, *_windows(k + 1, "both"), k + 1).mapInArrow(run, "block int, one binary, some binary")
    one, some = (np.zeros(4**k // 8, np.uint8) for _ in range(2))
    for x in found.toLocalIterator():
        if x["one"] is None:
            return None
        for whole, own in ((one, x["one"]), (some, x["some"])):
            at = x["block"] * (BLOCK // 32)
            whole[at : at + len(own)] = np.frombuffer(own, np.uint8)
    ends = end_bits(reads, k)
    kept, loose = np.zeros(4**k, bool), np.zeros(4**k, bool)
    for i in range(0, len(some), BLOCK):
        v = (np.flatnonzero(np.unpackbits(some[i : i + BLOCK])) + 8 * i).astype(np.uint32)
        other = other_strand(v, k)
        key, inner = np.minimum(v, other), taken(one, v) & taken(one, other)
        tip = taken(ends, key)
        kept[key[~inner | tip]] = True
        loose[key[inner & tip]] = True
    return np.packbits(kept), np.packbits(loose)


def strings_of(spark, bits, k: int) -> DataFrame:
    """(v): the k-mers of a broadcast bitmap of canonical ones, on both strands."""
    blocks = max(1, 4**k // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                x = (np.flatnonzero(np.unpackbits(bits.value[i * (BLOCK // 8) : (i + 1) * (BLOCK // 8)])) + i * BLOCK).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([spelled(_once(np.concatenate([x, other_strand(x, k)])), k)], names=["v"])

    return spark.range(blocks).mapInArrow(run, "v string")


def labels_of(labels: DataFrame, k: int, both: bool = True) -> DataFrame:
    """(label): of ``edges`` the labels alone."""
    empty = pa.schema([("label", pa.string())]).empty_table()

    def merge(rows: pa.Table) -> pa.Table:
        return pa.concat_tables([empty, *(t.select(["label"]) for kind in range(4) for part in _labels(rows, kind) for t in _edges(*part, k, kind > 1, both))])

    return labels.groupBy("bucket").applyInArrow(lambda rows: merge(rows), "label string")
