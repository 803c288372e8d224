"""Whole texts as flat byte arrays, and words of them as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
BLOCK = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _byte_codes() -> np.ndarray:
    codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
    return codes


CODES = _byte_codes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes from which a word is hashed whole.
LONG = 256
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base & (2**64 - 1), U)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    texts = pc.fill_null(pc.cast(texts, pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()), b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have at most so many bytes, or a single row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def prefix_hash(data: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """P with (P[e] - P[s]) * base**-s a polynomial hash of data[s:e]."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(codes.take(data) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^\\x20\\x09-\\x0D]+, and the number of words in each text."""
    inside = ~_WHITE[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    full = offsets[:-1] < offsets[1:]
    if len(data):
        before[offsets[:-1][full]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        after[offsets[1:][full] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash for each word, A-Z as a-z, and the number of words in each text.

    A word is taken in 8-byte characters, each mixed into what came before; words of over LONG bytes are hashed by BLAKE2b. No
    two words are known to collide: among n distinct words n * n / 2**65 pairs do by chance."""
    starts, ends, counts = word_bounds(data, offsets)
    lower = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=lower[: len(data)])
    eights = np.ndarray(len(data) + 1, np.dtype("<u8"), lower, strides=(1,))  # the 8 bytes from each place on
    size = ends - starts
    out = size.astype(U) * U(0x9E3779B97F4A7C15)
    live, step = np.flatnonzero(size <= LONG), 0
    while len(live):
        rest = size[live] - step
        block = eights[starts[live] + step]
        cut = rest < 8
        block[cut] &= (U(1) << (rest[cut].astype(U) * U(8))) - U(1)
        out[live] = mix(out[live] ^ mix(block + U(step + 1)))
        live, step = live[rest > 8], step + 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(lower[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out, counts


def by_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over runs of the given lengths, 0 for empty runs."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def trimmed(run):
    """A function for mapInArrow that gives freed memory back after its last batch."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    """Give freed memory back to the system; workers wait between stages with what they hold."""
    import ctypes

    _powers[:] = [np.ones(1, U), np.ones(1, U)]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
