"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model is a bigram with a Dirichlet prior on the add-one unigram: p(w | h) = (c(hw) + m p(w)) / (c(h) + m). Its levels
are spread over shards, so neither a task nor the driver ever holds the whole model:

1. Documents become chunks; each reports its distinct words and their training counts to shards by hash. A shard
   merges them, stores its part of the word level (a monotone Elias-Fano sequence of word hashes with counts)
   and answers each chunk with the words' counts and numbers.
2. Each chunk reports its distinct pairs of words, grouped by context, to shards by context; contexts that hold more
   than a shard's share of the corpus are dealt over several shards by successor. A shard builds its part
   of the pair level: contexts, monotone pointers to their successors, the successors, and quantised smoothed
   probabilities, all in one memory-mapped file. A request is a search for the first successor not below the word, within
   the context's range.
3. Each chunk adds up its documents' scores.

Every document ends with one end token; null text is empty, so it is the end token alone. Documents with a null id take
part in training. Repeated rows count each time. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import chunks
from strandloom.llm.text import U, flat, mix, word_hashes
from strandloom.operators.shared import materialise, release, remove

CHUNK = 8 << 20
END = U(0x656E64)
UNKNOWN, BEGIN = -1, -2
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Monotone:
    """A nondecreasing sequence in Elias-Fano form: low bits in whole bytes, high parts as unary gaps.

    The bits stay packed in their mapped file. Beside them in memory is only a directory of the ones before each word of 64 bits,
    half as large as the bits."""

    def __init__(self, parts: list[np.ndarray]):
        head, high, low, ones = parts
        self.n, self.base, self.width, self.gaps = int(head[0]), U(head[1]), int(head[2]), int(head[3])
        self.words, self.ones = high, ones
        self.low = low.reshape(-1, max(self.n, 1)) if self.width else None

    @staticmethod
    def parts(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        base = values[0] if n else U(0)
        rest = values - base
        top = int(rest[-1]) if n else 0
        width = 0
        while n and (top >> (8 * width)) > 2 * n:
            width += 1
        high = (rest >> U(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        gaps = int(high[-1]) + 1 if n else 0
        bits = np.zeros((n + gaps + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        low = np.ascontiguousarray(rest).view(np.uint8).reshape(n, 8)[:, :width].T.copy() if n else np.zeros(0, np.uint8)
        words = np.packbits(bits, bitorder="little").view(U)
        ones = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
        return [np.array([n, base, width, gaps], U), words, low.reshape(-1), ones.astype(np.uint32 if n < 2**32 else np.int64)]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one, or zero, from 0: its word by the directory, then the place in it by halves."""
        if one:
            word = np.searchsorted(self.ones, k, side="right") - 1
            left = k - self.ones[word].astype(np.int64)
            bits = self.words[word]
        else:
            zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones
            word = np.searchsorted(zeros, k, side="right") - 1
            left = k - zeros[word]
            bits = ~self.words[word]
        at = word * 64
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & U((1 << half) - 1)).astype(np.int64)
            over = left >= count
            left = np.where(over, left - count, left)
            bits = np.where(over, bits >> U(half), bits)
            at = at + np.where(over, half, 0)
        return at

    def lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U)
        for k in range(self.width):
            out |= self.low[k][at].astype(U) << U(8 * k)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        high = (self._select(at, True) - at).astype(U)
        return self.base + ((high << U(8 * self.width)) | self.lows(at) if self.width < 8 else self.lows(at))

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x within [begin, end) (end if none), and whether it equals x."""
        begin = np.zeros(len(x), np.int64) if begin is None else begin
        end = np.full(len(x), self.n) if end is None else end
        if self.n == 0:
            return begin, np.zeros(len(x), bool)
        below = x < self.base
        rest = np.where(below, U(0), x - self.base)
        high = (rest >> U(8 * self.width)).astype(np.int64) if self.width < 8 else np.zeros(len(x), np.int64)
        past = high >= self.gaps
        high = np.minimum(high, self.gaps - 1)
        # values with this high part lie between the zeros before and after them
        high_end = self._select(high, False) - high
        low = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        lo, hi = np.clip(low, begin, end), np.clip(high_end, begin, end)
        stop = hi.copy()
        tail = rest & U((1 << 8 * self.width) - 1) if self.width < 8 else rest
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less = self.lows(mid) < tail[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        equal = (lo < stop) & ~past & ~below
        equal[equal] = self.lows(lo[equal]) == tail[equal]
        return np.where(past, end, np.where(below, begin, lo)), equal


class Level:
    """Named arrays in one memory-mapped file that is gone when the last reader is."""

    def __init__(self, **parts: np.ndarray):
        file, path = tempfile.mkstemp(prefix="level-")
        at, self.places = 0, {}
        with os.fdopen(file, "wb") as out:
            for name, x in parts.items():
                pad = -at % 8
                out.write(b"\0" * pad + x.tobytes())
                self.places[name] = (at + pad, x.dtype, len(x))
                at += pad + x.nbytes
        self.map = np.memmap(path, np.uint8, "r") if at else np.zeros(0, np.uint8)
        os.unlink(path)

    def __getitem__(self, name: str) -> np.ndarray:
        at, kind, n = self.places[name]
        return self.map[at : at + n * kind.itemsize].view(kind)

    def sequence(self, name: str) -> Monotone:
        return Monotone([self[f"{name}{k}"] for k in range(4)])


def _sequence(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}{k}": x for k, x in enumerate(Monotone.parts(values))}


def word_level(keys: np.ndarray, counts: np.ndarray) -> Level:
    """Words with counts, numbered by falling count: what is written of frequent words is small."""
    numbers = np.empty(len(keys), np.int64)
    numbers[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
    return Level(**_sequence("words", keys), counts=counts, numbers=numbers)


def pair_level(contexts: np.ndarray, totals: np.ndarray, children: np.ndarray, counts: np.ndarray, prior: float) -> Level:
    """From pairs in order of (context, child), with counts above 0. Probabilities are stored as 16-bit logarithms."""
    new = np.ones(len(contexts), bool)
    new[1:] = contexts[1:] != contexts[:-1]
    first = np.flatnonzero(new)
    span = U(int(children.max()) + 1 if len(children) else 1)
    smoothed = np.log10(counts / (totals + prior))
    low = float(smoothed.min()) if len(smoothed) else 0.0
    step = ((float(smoothed.max()) - low) / 65534 if len(smoothed) else 0) or 1.0
    return Level(
        **_sequence("contexts", contexts[first]),
        **_sequence("pointers", np.r_[first, len(contexts)].astype(U)),
        **_sequence("children", (np.cumsum(new) - 1).astype(U) * span + children),
        codes=np.round((smoothed - low) / step).astype(np.uint16),
        scale=np.array([low, step, float(span)]),
    )


def pair_codes(level: Level, contexts: np.ndarray, sizes: np.ndarray, children: np.ndarray) -> np.ndarray:
    """1 + the code of each pair, 0 for pairs that are not there: the context's number, its range by the two pointers there, then
    the first successor not below the child within the range."""
    rank, known = level.sequence("contexts").successor(contexts)
    pointers = level.sequence("pointers")
    begin, end = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    begin[known], end[known] = (pointers.get(rank[known] + k).astype(np.int64) for k in (0, 1))
    rank, known, begin, end = (np.repeat(x, sizes) for x in (rank, known, begin, end))
    span = U(int(level["scale"][2]))
    known &= children < span  # beyond it, the number is no word that follows any context here
    at, equal = level.sequence("children").successor(rank.astype(U) * span + np.where(known, children, U(0)), begin, end)
    out = np.zeros(len(children), np.uint32)
    good = known & equal
    out[good] = level["codes"][at[good]].astype(np.uint32) + 1
    return out


def _requests(batch: pa.RecordBatch, id_col: str, held_out, shards: int) -> tuple[pa.RecordBatch, list[tuple[int, bytes]]]:
    data, offsets = flat(batch.column(1))
    words, counts = word_hashes(data, offsets)
    held = np.array([x is not None and held_out(x) for x in batch.column(0).to_pylist()], bool)
    tokens = np.full(len(words) + len(counts), END, U)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    tokens[inner] = words
    values, which = np.unique(tokens, return_inverse=True)
    train = np.bincount(which[np.repeat(~held, counts + 1)], minlength=len(values)).astype(np.uint32)
    bounds = _bounds(values, shards)
    asked = [(s, chunks.arrays(values[a:b], train[a:b])) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
    blob = chunks.arrays(held.astype(np.uint8), (counts + 1).astype(np.int64), which.astype(np.uint32))
    kept = pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["ids", "blob"])
    return kept, asked


def _bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.r_[0, np.searchsorted(keys, np.array([(s << 64) // shards for s in range(1, shards)], U)), len(keys)].astype(np.int64)


def _words(group: pa.Table, shards: int) -> pa.Table:
    asked = [chunks.unarrays(x.as_py()) for x in group.column("blob")]
    keys, counts = (np.concatenate([x[k] for x in asked]) for k in (0, 1))
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    seen = total > 0
    level, shard = word_level(k[first][seen], total[seen]), group.column("shard")[0].as_py()
    words, stored, numbers = level.sequence("words"), level["counts"], level["numbers"]
    out = []
    for x in asked:
        at, equal = words.successor(x[0])
        c = np.where(equal, stored[np.minimum(at, max(len(stored) - 1, 0))], 0) if len(stored) else np.zeros(len(at), np.int64)
        number = np.where(equal, numbers[np.minimum(at, len(stored) - 1)] * shards + shard, UNKNOWN) if len(stored) else np.full(len(at), UNKNOWN)
        small = not len(number) or number.max() < 2**31
        out.append(chunks.arrays(c.astype(np.uint32 if not len(c) or c.max() < 2**32 else np.int64), number.astype(np.int32 if small else np.int64)))
    n = len(out)
    return pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"), "blob": pa.array(out, pa.binary()), "kind": pa.array([chunks.ANSWER] * n, pa.int32()), "tokens": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()), "words": pa.array([int(seen.sum())] + [0] * (n - 1), pa.int64())})


class Chunk:
    """A chunk's tokens with what the word level answered."""

    def __init__(self, batch: pa.RecordBatch, back: list[tuple[int, bytes, int]], shards: int, tokens: int):
        self.ids = batch.column("ids")[0].as_py()
        held, self.counts, which = chunks.unarrays(batch.column("blob")[0].as_py())
        self.held, self.which = held > 0, which.astype(np.int64)
        answers = [chunks.unarrays(blob) for _, blob, kind in back if kind == chunks.ANSWER]
        self.c = np.concatenate([x[0] for x in answers]).astype(np.int64)
        self.number = np.concatenate([x[1] for x in answers]).astype(np.int64)
        n, self.shards = len(self.c), shards
        first = np.cumsum(self.counts) - self.counts
        before = np.empty_like(self.which)
        before[1:] = self.which[:-1]
        before[first] = n  # the place of the beginning
        documents = self.c[self.which[np.cumsum(self.counts)[0] - 1]]  # as often as the end token
        self.context_c, context_number = np.r_[self.c, documents], np.r_[self.number, BEGIN]
        if documents == 0:
            context_number[n] = UNKNOWN
        self.before = before
        usable = (context_number[before] != UNKNOWN) & (self.number[self.which] >= 0)
        self.usable = np.flatnonzero(usable)
        code, self.pair_of = np.unique(before[usable] * (n + 1) + self.which[usable], return_inverse=True)
        self.pair_context, self.pair_child = code // (n + 1), code % (n + 1)
        train = np.repeat(~self.held, self.counts)[usable]
        self.pair_train = np.bincount(self.pair_of[train], minlength=len(code)).astype(np.uint32)
        spread = 1 + self.context_c[self.pair_context] * shards // max(tokens, 1)
        x, y = (context_number[self.pair_context] + 2).astype(U), self.number[self.pair_child].astype(U)
        self.pair_shard = ((mix(x) % U(shards) + mix(y ^ U(0x5BD1E995)) % spread.astype(U)) % U(shards)).astype(np.int64)
        self.order = np.lexsort((y, x, self.pair_shard))
        self.x, self.y = x, y


def _pairs(group: pa.Table, prior: float) -> pa.Table:
    asked = [chunks.unarrays(x.as_py()) for x in group.column("blob")]
    contexts = np.concatenate([np.repeat(x[0], x[2]) for x in asked]).astype(U)
    totals = np.concatenate([np.repeat(x[1], x[2]) for x in asked])
    children, counts = np.concatenate([x[3] for x in asked]).astype(U), np.concatenate([x[4] for x in asked])
    seen = np.flatnonzero(counts > 0)
    order = seen[np.lexsort((children[seen], contexts[seen]))]
    x, y = contexts[order], children[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order].astype(np.int64), first) if len(x) else np.zeros(0, np.int64)
    level = pair_level(x[first], totals[order][first].astype(float), y[first], sums, prior)
    scale = level["scale"][:2].copy()
    out = [chunks.arrays(pair_codes(level, a[0].astype(U), a[2], a[3].astype(U)), scale) for a in asked]
    return pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"), "blob": pa.array(out, pa.binary()), "kind": pa.array([chunks.WINDOWS] * len(out), pa.int32())})


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or int(x.max()) < 2**32 else x


def every_seventh(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def lm_scores(docs: DataFrame, held_out=every_seventh, prior: float = 100.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; ``held_out(id)`` says which documents the model does not learn from."""
    spark = docs.sparkSession
    chunks.small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = chunks.shards_for(docs, "text")
    payload, asked, path = chunks.chunked(docs, "text", CHUNK, lambda batch: _requests(batch, "doc_id", held_out, shards), "lm")
    words, _ = materialise(asked.groupBy("shard").applyInArrow(lambda group: _words(group, shards), chunks.FIELDS + ", tokens long, words long"), "words")
    remove(spark, f"{path}/kind={chunks.REQUEST}")
    release(spark)
    totals = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    tokens, vocabulary = int(totals[0]), int(totals[1])
    words = words.select("chunk", "shard", "blob", "kind")

    def ask(number: int, batch: pa.RecordBatch, back: list[tuple[int, bytes, int]]) -> pa.Table:
        c = Chunk(batch, back, shards, tokens)
        shard = c.pair_shard[c.order]
        edges = np.searchsorted(shard, np.arange(shards + 1))
        out = []
        for s in range(shards):
            part = c.order[edges[s] : edges[s + 1]]
            if len(part):
                x = c.x[part]
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                out.append((number, s, chunks.arrays(_small(x[first]), _small(c.context_c[c.pair_context[part[first]]]), np.diff(np.r_[first, len(part)]).astype(np.uint32), _small(c.y[part]), c.pair_train[part]), chunks.REQUEST))
        return pa.Table.from_batches([chunks.rows(out)]) if out else chunks.SCHEMA.empty_table()

    pairs, _ = materialise(chunks.with_answers(payload, words, ask, chunks.FIELDS).groupBy("shard").applyInArrow(lambda group: _pairs(group, prior), chunks.FIELDS), "pairs")
    release(spark)

    def score(number: int, batch: pa.RecordBatch, back: list[tuple[int, bytes, int]]) -> pa.Table:
        c = Chunk(batch, back, shards, tokens)
        alpha = np.zeros(len(c.order))
        codes = [chunks.unarrays(blob) for _, blob, kind in back if kind == chunks.WINDOWS]
        if codes:
            alpha[c.order] = np.concatenate([np.where(x[0] > 0, 10 ** (x[1][0] + x[1][1] * (x[0].astype(float) - 1)), 0) for x in codes])
        uni = (c.c + 1) / (tokens + vocabulary + 1)
        p = uni[c.which]
        found = np.zeros(len(p))
        found[c.usable] = alpha[c.pair_of]
        total = c.context_c[c.before]
        p = found + prior * p / (total + prior)  # an unknown context has no counts: the unigram alone
        first = np.cumsum(c.counts) - c.counts
        add = lambda x: np.add.reduceat(x, first) if len(first) else x
        n = len(first)
        return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "held_out": pa.array(c.held), "n_tokens": pa.array(c.counts), "n_known": pa.array(add((c.c[c.which] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(n, tokens)), "base_score": pa.array(add(np.log10(uni)[c.which])), "score": pa.array(add(np.log10(p)))})

    return chunks.with_answers(payload, words.unionByName(pairs), score, SCORES)
