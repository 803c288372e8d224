"""Removal of byte strings that also start earlier in the corpus, by a sampled, partitioned suffix sort.

A string of ``length`` bytes is filed under its anchor: the k-gram in it with the smallest hash, leftmost first. The
anchor follows from the string's bytes alone, so equal strings have equal anchors at equal places, and only suffixes
that begin at anchors need sorting. Strings in a row with the same anchor make a group of neighbouring bytes.

1. Each chunk reports its distinct anchors, once each, to shards by hash. An anchor that occurs nowhere else is done.
   If all its occurrences lie in the same bytes, the first keeps them and the rest lose them.
2. Of the other anchors, the surrounding bytes are dealt by range of their leading tokens, at sampled splitters, and
   sorted in their bucket by multikey quicksort on 8-byte characters. Suffixes that share the anchor are compared to
   both sides; what reaches ``length`` bytes is removed from all but the first.
3. An anchor with very many different surroundings is dealt over several buckets. Each sorts its part, and
   strings that are first in their bucket are compared across bucket boundaries by 128-bit digests.

Order is by id, then start; rows that share an id are ordered by a checksum of the text, and null ids come last. Null
text is empty. Texts shorter than ``length`` lose nothing. An empty table gives no rows. All columns are
kept; a column named ``removed`` is replaced.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import chunks
from strandloom.llm.text import CODES, U, flat, mix, powers, prefix_hash, trim, trimmed
from strandloom.operators.shared import materialise, release, remove

CHUNK, SEGMENT = 2 << 20, 1 << 16
#: Bytes of an anchor; surroundings of one anchor from which it is dealt over buckets, SPREAD at least and twice as many for each
#: doubling; from which strings are sorted one by one.
ANCHOR, MANY, SPREAD, FEW = 24, 4096, 64, 12
#: Pairs that are compared at once; rows of a batch handed to Spark.
PAIRS, ROWS = 1 << 16, 10000
LAST = np.iinfo(np.int64).max
SUFFIX = "lead binary, salt int, bytes binary, anchor int, doc_id long, tie long, start long, chunk long, low int"
#: What comes back for a chunk, by places in its bytes: [low, past) to remove; strings that are first though dealt; runs [low, past) of dealt strings.
SPANS, FIRST, DEALT = chunks.WINDOWS, chunks.WINDOWS + 1, chunks.WINDOWS + 2


class Groups:
    """All strings of a chunk, as runs with the same anchor: first start, past the last byte, anchor, document, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        width, low, end, anchor, key, body = length - ANCHOR + 1, [], [], [], [], []
        for at in range(0, len(data), SEGMENT):
            part = data[at : at + SEGMENT + length - 1]
            n = min(SEGMENT, len(part) - length + 1)
            if n <= 0:
                break
            prefix, inverse = prefix_hash(part), powers(len(part) + 1)[1]
            kgram = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * inverse[: len(part) - ANCHOR + 1])
            best = (kgram & U(0xFFFFFFFF00000000)) | np.arange(len(kgram), dtype=U)
            step = 1
            while 2 * step <= width:
                best = np.minimum(best[:-step], best[step:])
                step *= 2
            best = np.minimum(best[:n], best[width - step :][:n])
            valid = np.zeros(n + 1, np.int8)  # strings that end within their document
            docs = slice(max(0, int(np.searchsorted(offsets, at, side="right")) - 1), int(np.searchsorted(offsets, at + n)))
            first, past = offsets[:-1][docs] - at, offsets[1:][docs] - length + 1 - at
            fine = past > first
            np.add.at(valid, np.clip(first[fine], 0, n), 1)
            np.add.at(valid, np.clip(past[fine], 0, n), -1)
            inside = np.cumsum(valid[:n], dtype=np.int8) > 0
            doc_start = np.zeros(n, bool)
            doc_start[first[(first >= 0) & (first < n)]] = True
            new = inside.copy()
            new[1:] &= (best[1:] != best[:-1]) | ~inside[:-1] | doc_start[1:]
            l = np.flatnonzero(new)
            stop = np.flatnonzero(inside & ~np.r_[inside[1:] & ~new[1:], False]) + 1
            e, a = stop + length - 1, (best[l] & U(0xFFFFFFFF)).astype(np.int64)
            content = (prefix[e] - prefix[l]) * inverse[l]
            low.append(l + at)
            end.append(e + at)
            anchor.append(a + at)
            key.append(mix(kgram[a]))  # the least hashes of their strings: mixed again, they are even
            body.append(mix(content + mix((a - l).astype(U) * U(512) + (e - l).astype(U))))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.low, self.end, self.anchor = (join(x, np.int64) for x in (low, end, anchor))
        self.key, self.body = join(key, U), join(body, U)
        self.doc = np.searchsorted(offsets, self.low, side="right") - 1
        order = np.argsort(self.key, kind="stable")
        k = self.key[order]
        new_key = np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        tied = np.flatnonzero(~(new_key & np.r_[new_key[1:], True]))
        rows = order[tied]
        order[tied] = rows[np.lexsort((self.body[rows], self.key[rows]))]  # stable: occurrences stay in order
        b = self.body[order]
        new_body = new_key.copy()
        new_body[1:] |= b[1:] != b[:-1]
        #: sorted occurrences; entry (distinct anchor) of each; whether it is its bytes' first in the chunk
        self.order, self.entry, self.leads = order, np.cumsum(new_key) - 1, new_body
        self.first_of = np.flatnonzero(new_key)
        self.kinds = np.add.reduceat(new_body.astype(np.int64), self.first_of) if len(k) else np.zeros(0, np.int64)


def _ordered(batch: pa.RecordBatch, id_col: str, text_col: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch by id and checksum, with its ids, checksums, bytes and offsets."""
    data, offsets = flat(batch.column(text_col))
    ids = batch.column(id_col).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
    ties = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
    order = np.lexsort((ties, ids))
    if (order != np.arange(len(order))).any():
        batch = batch.take(pa.array(order))
        data, offsets = flat(batch.column(text_col))
    return batch, ids[order], ties[order], data, offsets


def _requests(batch: pa.RecordBatch, id_col: str, text_col: str, length: int, shards: int) -> tuple[pa.RecordBatch, list[tuple[int, bytes]]]:
    batch, ids, ties, data, offsets = _ordered(batch, id_col, text_col)
    g = Groups(data, offsets, length)
    at = g.order[g.first_of]
    keys, bounds = g.key[at], _bounds(g.key[at], shards)
    out = []
    for shard in range(shards):
        part = slice(bounds[shard], bounds[shard + 1])
        if part.start < part.stop:
            docs, own = np.unique(g.doc[at[part]], return_inverse=True)
            out.append((shard, chunks.arrays(keys[part], g.body[at[part]], np.minimum(g.kinds[part], 65535).astype(np.uint16), own.astype(np.uint32), (g.low[at[part]] - offsets[:-1][g.doc[at[part]]]).astype(np.uint32 if offsets[-1] < 2**32 else np.uint64), ids[docs], ties[docs])))
    return batch, out


def _bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    edges = np.array([(s << 64) // shards for s in range(1, shards)], object)
    return np.r_[0, np.searchsorted(keys, np.array([int(x) for x in edges], U)), len(keys)].astype(np.int64)


def _status(group: pa.Table) -> pa.Table:
    """For each chunk's anchors of a shard: 0 nowhere else, 1 same bytes and first, 2 same bytes and later, 3 other bytes, 4 or more very many: one
    more for each doubling."""
    asked = [chunks.unarrays(x.as_py()) for x in group.column("blob")]
    sizes = np.array([len(x[0]) for x in asked])
    keys, body, kinds, start = (np.concatenate([x[k] for x in asked]) for k in (0, 1, 2, 4))
    ids, ties = (np.concatenate([x[k][x[3]] for x in asked]) for k in (5, 6))
    number = np.repeat(np.array(group.column("chunk").to_pylist(), np.int64), sizes)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    own = np.cumsum(new) - 1
    many = np.bincount(own)[own] > 1
    status = np.zeros(len(keys), np.uint8)
    status[order[~many & (kinds[order] > 1)]] = 3
    rest = order[many]
    rest = rest[np.lexsort((number[rest], start[rest].astype(np.int64), ties[rest], ids[rest], keys[rest]))]
    if len(rest):
        k, b = keys[rest], body[rest]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(new)
        own = np.cumsum(new) - 1
        mixed = (np.minimum.reduceat(b, at) != np.maximum.reduceat(b, at)) | (np.maximum.reduceat(kinds[rest], at) > 1)
        status[rest] = np.where(mixed[own], 3, np.where(new, 1, 2))
        total = np.add.reduceat(kinds[rest].astype(np.int64), at)
        large = (total > MANY) & mixed
        status[rest[large[own]]] = _very_many(total[own][large[own]])
    alone = (kinds > MANY) & (status == 3)
    status[alone] = _very_many(kinds[alone].astype(np.int64))
    ends = np.cumsum(sizes)
    return pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"), "blob": pa.array([chunks.arrays(status[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary()), "kind": pa.array([chunks.ANSWER] * len(sizes), pa.int32())})


def _very_many(total: np.ndarray) -> np.ndarray:
    return (4 + np.ceil(np.log2(np.maximum(total / (2 * MANY), 1)))).astype(np.uint8)


def _entry_status(back: list[tuple[int, bytes, int]]) -> np.ndarray:
    found = [chunks.unarrays(blob)[0] for _, blob, kind in back if kind == chunks.ANSWER]
    return np.concatenate(found) if found else np.zeros(0, np.uint8)


def _characters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one little-endian number, as a view of the bytes."""
    return np.ndarray(len(data) + 1, np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def multikey_sort(text: np.ndarray, at: np.ndarray, group: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by group, then by the characters text[at + step] for each step in turn; only rows that are still equal
    to another are looked at again. Gives the order and the class of equal rows in it."""
    order = np.argsort(group, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    place, own, first = np.arange(len(at)), np.cumsum(new), new
    for step in steps:
        alone = first.copy()
        alone[:-1] &= first[1:]
        place, own = place[~alone], own[~alone]
        if not len(place):
            break
        rows = order[place]
        key = text[at[rows] + step].byteswap()  # bytes in order
        inner = np.lexsort((key, own))
        order[place], key = rows[inner], key[inner]
        first = np.ones(len(place), bool)
        first[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        new[place[first]] = True
        own = np.cumsum(first)
    return order, np.cumsum(new) - 1


def _reach(text: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Equal bytes from (or, back, before) both positions, up to most."""
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    step = 0
    while len(live):
        shift = -8 * (step + 1) if back else 8 * step
        differ = text[i[live] + shift] ^ text[j[live] + shift]
        some = differ != 0
        bits = differ[some]
        if back:  # highest byte first: without the bits after the first one, rounding cannot reach the next power
            bits &= ~(bits >> U(1))
        else:  # lowest byte first
            bits &= ~bits + U(1)
        equal = np.full(len(live), 8)
        place = (np.frexp(bits.astype(np.float64))[1] - 1) // 8
        equal[some] = 7 - place if back else place
        out[live] = 8 * step + equal
        live = live[~some & (8 * (step + 1) < most[live])]
        step += 1
    return np.minimum(out, most)


def _pairs(number: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within classes of 2 to FEW rows, some at a time."""
    held, size = [], 0
    for c in range(2, FEW + 1):
        x, y = np.triu_indices(c, 1)
        at = begins[number == c]
        each = max(1, PAIRS // len(x))
        for k in range(0, len(at), each):
            held.append(((at[k : k + each, None] + x).ravel(), (at[k : k + each, None] + y).ravel()))
            size += len(held[-1][0])
            if size >= PAIRS:
                yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def _pairs_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2).astype(np.int64)


def _bucket(rows: pa.Table, length: int) -> tuple[list, list, list]:
    """Of all suffixes of a bucket: spans of later strings and runs of strings of dealt anchors, both as chunk, low, past, and digests of
    the strings of dealt anchors that are still first."""
    data, offsets = flat(rows.column("bytes"))
    pad = np.zeros(256, np.uint8)
    text = _characters(np.concatenate([pad, data, pad]))
    base, end = offsets[:-1] + 256, offsets[1:] + 256
    anchor = base + rows.column("anchor").to_numpy()
    ids, ties, start, salt, number_of, place = (rows.column(c).to_numpy() for c in ("doc_id", "tie", "start", "salt", "chunk", "low"))
    order, label = multikey_sort(text, anchor, salt, np.arange(0, ANCHOR, 8))
    number = np.bincount(label)
    later = np.zeros(len(data) + 513, np.int32)  # marks of strings, by the place of their first byte
    begins = np.cumsum(number) - number
    before = np.empty(len(base), np.int64)  # places in the order of strings
    before[np.lexsort((place, number_of, start + anchor - base, ties, ids))] = np.arange(len(base))
    for x, y in _pairs(number, begins):
        i, j = order[x], order[y]
        i = np.where(before[i] < before[j], j, i)  # i is later
        j = order[x] + order[y] - i
        right = _reach(text, anchor[i], anchor[j], np.minimum(end[i] - anchor[i], end[j] - anchor[j]), False)
        most = np.minimum(anchor[i] - base[i], anchor[j] - base[j])
        near = right + most >= length
        i, j, right = i[near], j[near], right[near]
        left = _reach(text, anchor[i], anchor[j], most[near], True)
        both = left + right >= length
        np.add.at(later, (anchor[i] - left)[both], 1)
        np.add.at(later, (anchor[i] + right - length + 1)[both], -1)
    later = np.cumsum(later)
    steps = np.r_[np.arange(0, length - 7, 8), length - 8]
    large, batch, size = np.flatnonzero(number > FEW), [], 0
    for k, g in enumerate(large):  # anchors with many surroundings: all their strings, some anchors at a time
        batch.append(order[begins[g] : begins[g] + number[g]])
        size += int(number[g])
        if size < 4000 and k + 1 < len(large):
            continue
        rank = np.concatenate(batch)
        which = np.repeat(np.arange(len(batch)), [len(x) for x in batch])
        batch, size = [], 0
        count = end[rank] - base[rank] - length + 1
        own = np.repeat(rank, count)
        at = np.repeat(base[rank], count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        inner, same = multikey_sort(text, at, np.repeat(which, count) * 1024 + (anchor[own] - at), steps)
        by = np.lexsort((before[own[inner]], same))  # equal strings lie as far before their anchors
        inner, same = inner[by], same[by]
        again = np.zeros(len(same), bool)
        again[1:] = same[1:] == same[:-1]
        later[at[inner[again]]] = 1
    marked = np.zeros(len(later) + 1, np.int8)  # strings that end within their row and begin later, without dealt ones
    count = np.where(salt < 0, end - base - length + 1, 0)
    np.add.at(marked, base, 1)
    np.add.at(marked, base + count, -1)
    marked = (np.cumsum(marked[:-1], dtype=np.int8) > 0) & (later > 0)
    edge = np.diff(marked.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    low, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = np.searchsorted(base, low, side="right") - 1
    spans = [number_of[own], low - base[own] + place[own], past - base[own] + place[own] + length - 1]
    runs, firsts = [], []
    dealt = np.flatnonzero(salt >= 0)
    if len(dealt):
        hashes = prefix_hash(data), prefix_hash(data, mix(CODES))
        inverse = powers(len(data) + 1)[1]
        count = end[dealt] - base[dealt] - length + 1
        own = np.repeat(dealt, count)
        w = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        keep = later[base[own] + w] <= 0
        own, w = own[keep], w[keep]
        p = w + base[own] - 256
        digests = [mix((h[p + length] - h[p]) * inverse[p]).view(np.int64) for h in hashes]
        runs = [number_of[dealt], place[dealt], place[dealt] + count]
        firsts = [*digests, ids[own], ties[own], w + start[own], number_of[own], w + place[own]]
    return spans, runs, firsts


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``removed``: the maximal byte ranges [start, end) covered by strings of ``length`` bytes that also start earlier."""
    if length < ANCHOR + 8:
        raise ValueError(f"length must be at least {ANCHOR + 8}")
    spark = docs.sparkSession
    chunks.small_batches(spark)
    docs = docs.drop("removed")
    shards = chunks.shards_for(docs, text_col)
    payload, asked, path = chunks.chunked(docs, text_col, CHUNK, lambda batch: _requests(batch, id_col, text_col, length, shards), "suffix")
    status, status_path = materialise(asked.groupBy("shard").applyInArrow(_status, chunks.FIELDS), "status")
    remove(spark, f"{path}/kind={chunks.REQUEST}")
    release(spark)

    def surroundings(number: int, batch: pa.RecordBatch, back: list[tuple[int, bytes, int]]) -> pa.Table:
        _, ids, ties, data, offsets = _ordered(batch, id_col, text_col)
        g = Groups(data, offsets, length)
        state = _entry_status(back)
        at = np.flatnonzero(g.leads & (state[g.entry] >= 3)) if len(state) else np.zeros(0, np.int64)
        inst = g.order[at]
        body = [data[a:b].tobytes() for a, b in zip(g.low[inst], g.end[inst], strict=True)]
        lead = [data[a : a + ANCHOR].tobytes() for a in g.anchor[inst]]
        many = state[g.entry[at]] if len(at) else np.zeros(0, np.uint8)
        salt = np.where(many >= 4, (g.body[inst] % (U(SPREAD) << np.maximum(many, 4).astype(U) - U(4))).astype(np.int64), -1)
        doc = g.doc[inst]
        columns = [salt, g.anchor[inst] - g.low[inst], ids[doc], ties[doc], g.low[inst] - offsets[:-1][doc], np.full(len(at), number), g.low[inst]]
        gone = np.sort(g.order[~g.leads | (state[g.entry] == 2)]) if len(state) else at
        if len(gone):  # settled already: a row that passes through the bucket of an even key
            low, end = g.low[gone], np.maximum.accumulate(g.end[gone])
            new = np.flatnonzero(np.r_[True, low[1:] > end[:-1]])
            body.append(np.column_stack([low[new], end[np.r_[new[1:] - 1, len(end) - 1]]]).astype("<i4").tobytes())
            lead.append(mix(np.array([number], U) + U(1)).tobytes())
            columns = [np.r_[x, y] for x, y in zip(columns, (-1, -1, 0, 0, 0, number, 0), strict=True)]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32()]
        salt, anchor, *rest = (pa.array(x, t) for x, t in zip(columns, kinds, strict=True))
        return pa.Table.from_arrays([pa.array(lead, pa.binary()), salt, pa.array(body, pa.binary()), anchor, *rest], names=["lead", "salt", "bytes", "anchor", "doc_id", "tie", "start", "chunk", "low"])

    suffixes, suffix_path = materialise(chunks.with_answers(payload, status, surroundings, SUFFIX), "suffixes")
    remove(spark, status_path)
    release(spark)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]  # one bucket between splitters
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        del held
        settled = pc.less(whole.column("anchor"), 0)
        ready, whole = whole.filter(settled), whole.filter(pc.invert(settled)).combine_chunks()
        spans, runs, firsts = _bucket(whole, length)
        del whole
        trim()
        out = [(number, -1, blob, SPANS) for number, blob in zip(ready.column("chunk").to_pylist(), ready.column("bytes").to_pylist(), strict=True)]
        for kind, found in ((SPANS, spans), (DEALT, runs)):
            if found and len(found[0]):
                by = np.argsort(found[0], kind="stable")
                number, pairs = found[0][by], np.column_stack(found[1:])[by].astype("<i4")
                cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                out += [(n, -1, x.tobytes(), kind) for n, x in zip(number[cuts].tolist(), np.split(pairs, cuts[1:]), strict=True)]
        names = ["chunk", "shard", "blob", "kind", "hi", "lo", "doc_id", "tie", "at", "place"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.int32()]
        if out:
            whole = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*whole, *(pa.nulls(len(out), t) for t in kinds[4:])], names=names)
        for k in range(0, len(firsts[0]) if firsts else 0, ROWS):
            hi, lo, doc, tie, at, number, place = (x[k : k + ROWS] for x in firsts)
            none = [pa.nulls(len(hi), t) for t in kinds[1:4]]
            yield pa.RecordBatch.from_arrays([pa.array(number), *none, *(pa.array(x, t) for x, t in zip((hi, lo, doc, tie, at, place), kinds[4:], strict=True))], names=names)

    spread = suffixes.repartitionByRange(4 * shards, "lead", "salt")
    done, done_path = materialise(spread.mapInArrow(sort, chunks.FIELDS + ", hi long, lo long, doc_id long, tie long, at long, place int"), "sorted")
    # across bucket boundaries: the first of all strings with this digest, by a hash aggregate
    first = done.filter("kind is null").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "tie", "at", "chunk", "place")).alias("f"))
    first = first.select("f.chunk", "f.place").groupBy("chunk").agg(F.collect_list("place").alias("x"))
    first = first.select("chunk", F.lit(-2).cast("int").alias("shard"), F.to_json("x").cast("binary").alias("blob"), F.lit(FIRST).alias("kind"))
    back = done.filter("kind is not null").select("chunk", "shard", "blob", "kind").unionByName(first)
    remove(spark, suffix_path)
    release(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def cover(number: int, batch: pa.RecordBatch, back: list[tuple[int, bytes, int]]) -> pa.Table:
        batch, _, _, data, offsets = _ordered(batch, id_col, text_col)
        marks = np.zeros(len(data) + 1, np.int32)
        spans, dealt = (_pairs_of([blob for _, blob, kind in back if kind == k]) for k in (SPANS, DEALT))
        np.add.at(marks, spans[:, 0], 1)
        np.add.at(marks, spans[:, 1], -1)
        if len(dealt):  # all their strings but those that came back as first
            strings = np.zeros(len(data) + 1, np.int32)
            np.add.at(strings, dealt[:, 0], 1)
            np.add.at(strings, dealt[:, 1], -1)
            strings = np.cumsum(strings)
            for _, blob, kind in back:
                if kind == FIRST:
                    strings[json.loads(blob)] = 0
            edge = np.diff(strings, prepend=0)
            np.add.at(marks, np.flatnonzero(edge == 1), 1)
            np.add.at(marks, np.flatnonzero(edge == -1) + length - 1, -1)
        covered = np.cumsum(marks[:-1]) > 0
        before = np.r_[False, covered[:-1]] if len(covered) else covered
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after = np.r_[covered[1:], False] if len(covered) else covered
        after[offsets[1:][full] - 1] = False
        starts, ends = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
        counts = np.searchsorted(starts, offsets)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(starts - offsets[:-1][doc]), pa.array(ends - offsets[:-1][doc])], names=["start", "end"])
        return pa.Table.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), spans)], names=[*batch.schema.names, "removed"])

    return chunks.with_answers(payload, back, cover, schema)


def without_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts without their ``removed`` bytes; a character that is only partly covered stays whole."""
    keep = T.StructType([f for f in docs.schema.fields if f.name != "removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, column = batch.column("removed"), batch.column(text_col)
            texts = []
            for k in range(batch.num_rows):
                value = column[k].as_py()
                if value and len(spans[k]):
                    data, at, out = value.encode(), 0, []
                    for span in spans[k].as_py():
                        a, b = span["start"], span["end"]
                        while a < b and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        out.append(data[at:a])
                        at = b
                    value = b"".join([*out, data[at:]]).decode()
                texts.append(value)
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(f.name) for f in keep.fields]
            yield pa.RecordBatch.from_arrays(columns, names=keep.names)

    return docs.mapInArrow(trimmed(run), keep)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            out = []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                own, at, digest = data[offsets[k] : offsets[k + 1]], 0, hashlib.sha256()
                for x in spans:
                    digest.update(own[at : x["start"]])
                    at = x["end"]
                digest.update(own[at:])
                out.append((len(own), sum(x["end"] - x["start"] for x in spans), len(spans), digest.hexdigest()))
            n, gone, number, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select(F.col(id_col).cast("long"), text_col, "removed").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
