"""Near-duplicate documents by SetSketch registers over word shingles.

1. A document's set is its distinct shingle hashes. Each element has a Poisson process of points in time that
   fall on random registers; a register keeps the earliest time, and stores it as an exponentially spaced,
   truncated integer. Sketches of parts merge by maximum, and registers of similar sets agree often.
2. Rows with equal sets form a class, which is numbered by its first row; only classes go on.
3. Bands of consecutive registers are grouped by value. Every member of a group is paired with one hub only, the
   member that shares the most bands with others, which a hash aggregate with map-side combine finds.
4. Pairs whose Jaccard similarity, estimated jointly from both sketches and both set sizes by maximum
   likelihood, is not far below the threshold are verified on the full sets.
5. Components of verified links and of classes that have an id in common. Groups whose members are not all in one component by then get a second hub from
   the rest; in what is still open, members of different components are compared exactly in tiles of bounded
   size, which return a spanning set of the links. Pairs within a component cannot change it and are not listed.

Null or blank texts have the empty set and are linked with nothing. Rows with a null id have null component and kept.
Rows that share an id are one node, with the links of all their texts. Texts shorter than a shingle count as one whole shingle. An empty
table gives no rows. Columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.chunks import small_batches
from strandloom.llm.text import U, blocks, by_doc, flat, mix, trim, trimmed, word_hashes
from strandloom.operators.components import connected_components
from strandloom.operators.shared import materialise, release, remove

REGISTERS, ROWS = 128, 4
#: SetSketch parameters: ratio of neighbouring register values, rate, and largest value.
RATIO, RATE, TOP = 1.001, 20.0, 65534
TILE = 512
#: Members of a group of one (band, key) from which it is dealt over several tasks.
HOT = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and their numbers."""
    words, counts = word_hashes(data, offsets)
    n_docs, ends = len(counts), np.cumsum(counts)
    doc = np.repeat(np.arange(n_docs), counts)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    h = mix(words + U(0x1000000000000001))
    size = np.repeat(counts, counts)
    last = np.minimum(width, size)  # a short text is one shingle of all its words
    for k in range(1, width):
        use = place + last <= size
        use &= k < last
        nxt = np.zeros_like(words)
        nxt[: len(words) - k] = words[k:]
        h = np.where(use, mix(h * U(0x9E3779B97F4A7C15) + nxt), h)
    keep = place + last <= size
    h, doc = h[keep] ^ (last[keep].astype(U) << U(56)), doc[keep]
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if n_docs < 65536 else np.int64), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=n_docs)


def setsketch(elements: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Register values (documents x m, uint16) of sets given end to end. Empty sets have zeros.

    Points beyond the time by which all registers are almost surely taken are not made; a set with a register
    still free then is done again with twice the time, so the values do not depend on that limit."""
    n_docs = len(counts)
    times = np.full((n_docs, m), np.inf)
    limit = np.where(counts > 0, m * (np.log(m) + 5) / np.maximum(counts, 1), 0)
    todo = counts > 0
    starts = np.cumsum(counts) - counts
    while todo.any():
        docs = np.flatnonzero(todo)
        own = np.repeat(docs, counts[docs])
        x = elements[np.repeat(starts[docs], counts[docs]) + np.arange(len(own)) - np.repeat(np.cumsum(counts[docs]) - counts[docs], counts[docs])]
        now, flat_times = np.zeros(len(x)), times.reshape(-1)
        step = 0
        while len(x):
            step += 1
            bits = mix(x + U(step * 0xD1342543DE82EF95 % 2**64))
            now = now - np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = now <= limit[own]
            x, own, now, bits = x[live], own[live], now[live], bits[live]
            np.minimum.at(flat_times, own * m + (mix(bits) % U(m)).astype(np.int64), now)
        todo &= np.isinf(times).any(axis=1)
        limit = np.where(todo, 2 * limit, limit)
    with np.errstate(divide="ignore"):
        values = np.floor(1 - np.log(times / (RATE * m)) / np.log(RATIO))
    return np.where(np.isinf(times), 0, np.clip(values, 0, TOP + 1)).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 40) -> np.ndarray:
    """Jaccard similarity of pairs of sketches: maximum likelihood of how many registers of a are above, equal to
    or below those of b, given both set sizes (golden section over all pairs at once)."""
    above, below = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - above - below
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)

    def log_p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (RATIO - 1) / RATIO) / np.log(RATIO)

    def loss(j: np.ndarray) -> np.ndarray:
        more, less = np.clip(log_p(np.clip(u - v * j, 0, 1)), 1e-12, 1), np.clip(log_p(np.clip(v - u * j, 0, 1)), 1e-12, 1)
        return above * np.log(more) + below * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

    low, high, g = np.zeros(len(a)), top.copy(), (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = high - g * (high - low), low + g * (high - low)
        better = loss(c) >= loss(d)
        high, low = np.where(better, d, high), np.where(better, low, c)
    return (low + high) / 2


def set_digests(elements: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set."""
    return [by_doc(mix(elements ^ U(salt)), counts).view(np.int64) for salt in (0x5DEECE66D, 0x2545F4914F6CDD1D)]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set, and the sketch as one 64-bit value for each band of 4 registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for low, high in blocks(offsets):
                elements, counts = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)
                sketch = setsketch(elements, counts)
                bands = np.ascontiguousarray(sketch).view(np.int64).reshape(-1)
                digests = set_digests(elements, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(counts.astype(np.int64)), *map(pa.array, digests), pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * (REGISTERS // ROWS)), pa.array(bands))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _sketches(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values).view(np.uint16).reshape(len(column), REGISTERS)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links of Jaccard
    similarity >= threshold, a number of hundredths) and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    hundredths = round(100 * threshold)
    margin = threshold - 6 * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs, _ = materialise(signatures(docs, width).withColumn("row", F.monotonically_increasing_id()), "sigs")
    real = sigs.filter("n_shingles > 0 and doc_id is not null")
    # a class is told by a row's number: several classes can have the same smallest id
    classes = real.groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"))
    own = F.col("row") == F.col("rep")
    member, _ = materialise(real.join(classes, ["d1", "d2"]).select("doc_id", "rep", "least_id", *(F.when(own, F.col(c)).alias(c) for c in ("bands", "d1", "d2")), F.col("n_shingles").alias("n")), "members")
    reps = member.filter("bands is not null").select("rep", "least_id", "n", "bands", "d1", "d2")
    # a group is in 64 parts by its members' hash until its size is known, and in as many as its size needs from then on
    keyed = reps.select("rep", F.posexplode("bands").alias("band", "key")).withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(64)).cast("int"))
    parted = keyed.groupBy("band", "key", "part").agg(F.count("*").alias("size"))
    sizes = parted.groupBy("band", "key").agg(F.sum("size").alias("size"), F.collect_list("part").alias("part")).filter("size > 1")
    sizes = sizes.withColumn("part", F.explode("part"))
    salts = F.ceil(F.col("size") / HOT)
    grouped, grouped_path = materialise(keyed.join(sizes, ["band", "key", "part"]).drop("part").withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "rep"), salts)), "groups")
    by_group = ["band", "key", "salt"]

    def dealt(groups: DataFrame) -> DataFrame:
        """A row of each group, which has its size, for each of its salts."""
        return groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("size")

    # a member that others resemble in many bands is nearest the middle of its copies
    degree = grouped.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked, ranked_path = materialise(grouped.join(degree, "rep"), "ranked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            asked = [batch.column(c).to_numpy() for c in ("d1", "d2")]
            for low, high in blocks(offsets):
                elements, counts = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)
                ends = np.cumsum(counts)
                same = np.logical_and(*(x[low:high] == y for x, y in zip(asked, set_digests(elements, counts), strict=True)))
                found = [elements[e - n : e].tobytes() for e, n in zip(ends[same], counts[same], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(low, high - low).filter(pa.array(same)), pa.array(found, pa.binary())], names=["rep", "s"])

    # the other texts of an id are told apart by their digests
    wanted = reps.join(degree.select("rep"), "rep").select(F.col("least_id").alias("doc_id"), "rep", "d1", "d2")
    whole, whole_path = materialise(docs.join(wanted, "doc_id").select("text", "rep", "d1", "d2").mapInArrow(trimmed(sets), "rep long, s binary"), "sets")
    whole = whole.dropDuplicates(["rep"])

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose estimate is not far below the threshold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(_sketches(batch.column("xa")), _sketches(batch.column("xb")), na, nb) >= margin))

        left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bands").alias("xa"))
        right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("xb"))
        sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * hundredths
        return pairs.join(left, "a").join(right, "b").filter(sized).select("a", "b", "na", "nb", "xa", "xb").mapInArrow(trimmed(run), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are links on the full sets."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                    a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                    keep.append(100 * both >= hundredths * (len(a) + len(b) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        out = pairs.join(whole.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
        return out.select("a", "b", "sa", "sb").mapInArrow(trimmed(check), "a long, b long")

    def with_hub(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        return rows.join(dealt(hubs.select("band", "key", "size", "hub")), by_group).filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()

    best = F.max(F.struct("degree", -F.col("rep")))
    first = ranked.groupBy("band", "key").agg((-best["col2"]).alias("hub"), F.max("size").alias("size"))
    tested, tested_path = materialise(close(with_hub(ranked, first)), "close")
    ids = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id", "a")
    same_id = member.join(ids, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
    links, links_path = materialise(verified(tested).unionByName(same_id), "links")
    parts, parts_path = materialise(connected_components(links, "a", "b"), "parts")
    done = [tested_path, links_path]

    def open_groups() -> DataFrame:
        """Members of groups that are not all in one component; of groups with the same members only one."""
        named = ranked.join(parts.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        stats = named.groupBy("band", "key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.sum(F.xxhash64("rep") % 1_000_000_000_039).alias("sign"), F.count("*").alias("size")).filter("low <> high and size > 2")
        one = stats.groupBy("sign", "size").agg(F.min(F.struct("band", "key")).alias("g")).select("g.band", "g.key", "size")
        return named.join(dealt(one), by_group)

    # once more, from the middle of what is outside the first hub's component
    rows, rows_path = materialise(open_groups(), "open")
    if not rows.isEmpty():
        main = rows.join(dealt(first), by_group).filter("rep = hub").select("band", "key", "size", F.col("c").alias("main"))
        outer = rows.join(dealt(main), by_group)
        second = outer.filter("c <> main").groupBy("band", "key").agg((-best["col2"]).alias("hub"), F.max("size").alias("size"))
        again, again_path = materialise(verified(close(with_hub(rows, second))), "links")
        links = links.unionByName(again)
        done += [again_path, parts_path, rows_path]
        parts, parts_path = materialise(connected_components(links, "a", "b"), "parts")
        rows, rows_path = materialise(open_groups(), "open")
    if not rows.isEmpty():  # exactly: members of different components meet in tiles of bounded size
        rows = rows.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("band", "key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "rep", "c")
        rows = rows.join(whole, "rep")
        extra, extra_path = materialise(rows.groupBy("band", "key", "t1", "t2").applyInArrow(lambda group: _tile_links(group, hundredths), "a long, b long").distinct(), "links")
        done.append(extra_path)
        if not extra.isEmpty():
            done.append(parts_path)
            parts, parts_path = materialise(connected_components(links.unionByName(extra), "a", "b"), "parts")
    for path in (*done, rows_path, grouped_path, ranked_path, whole_path):
        remove(spark, path)
    release(spark)
    # components by their smallest ids
    parts = reps.select(F.col("rep").alias("node"), "least_id").join(parts, "node")
    parts = parts.join(parts.groupBy("component").agg(F.min("least_id").alias("name")), "component").select(F.col("node").alias("rep"), "name")
    named = member.select("doc_id", "rep", "least_id").distinct().join(parts, "rep", "left")
    named = named.groupBy("doc_id").agg(F.min(F.coalesce("name", "least_id")).alias("component"))
    out = sigs.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _tile_links(group: pa.Table, hundredths: int) -> pa.Table:
    """A spanning set of the links between members of different components: all intersections of the tile at
    once as products of the incidence matrix, over shingles that several members have."""
    order = np.argsort(group.column("rep").to_numpy(), kind="stable")
    ids, comps = (group.column(c).to_numpy()[order] for c in ("rep", "c"))
    own = [np.frombuffer(x.as_buffer(), U) for x in group.column("s").combine_chunks().take(pa.array(order))]
    sizes = np.array([len(x) for x in own])
    values, which, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = times[which] > 1
    row, column = np.repeat(np.arange(len(ids)), sizes)[shared], (np.cumsum(times > 1) - 1)[which][shared]
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    both = np.zeros((len(ids), len(ids)), np.float32)
    for low in range(0, int((times > 1).sum()), 4096):
        part = slice(*np.searchsorted(column, (low, low + 4096)))
        incidence = np.zeros((len(ids), 4096), np.float32)
        incidence[row[part], column[part] - low] = 1
        both += incidence @ incidence.T
    link = (100 * both >= hundredths * (sizes[:, None] + sizes[None, :] - both)) & (comps[:, None] != comps[None, :])
    part_of = {int(c): int(c) for c in comps}

    def find(x: int) -> int:
        while part_of[x] != x:
            part_of[x] = part_of[part_of[x]]
            x = part_of[x]
        return x

    del both, own, values, which
    trim()
    a, b = [], []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(link, 1))), strict=True):
        x, y = find(int(comps[i])), find(int(comps[j]))
        if x != y:
            part_of[max(x, y)] = min(x, y)
            a.append(int(ids[j]))
            b.append(int(ids[i]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
