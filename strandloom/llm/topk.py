"""Exact top-k inner products by a pivot-distance index.

Components become integers. An added component brings all vectors to one length M, so the nearest vector to a query is
the one with the largest inner product: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its nearest pivot
and its distance to it; a range sort by that key, cut into blocks, gives each pivot's vectors in annuli. A query first
searches the blocks around its own distance, which gives a lower bound of its k-th score. By the triangle inequality only
vectors with |d(q, p) - d(x, p)| <= d(q, k-th) can reach that, so all other blocks, and all other rows of the blocks, are left out.
Bounds are floating-point with a margin; scores are exact.

The pivots are rows chosen by hash, as many as the square root of all rows, 32 at least and 1,024 at most; every row is indexed.
Vectors so long that a score may not fit 64 bits raise an error. Null vectors, and those with null or
non-finite components, take no part, nor do null ids. Vectors of other lengths are compared over zeros. A repeated id is one
candidate for each of its rows, and never its own. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.chunks import small_batches
from strandloom.operators.shared import materialise, partitions, remove

#: Least and most pivots (the square root of the rows between them), rows of a block, queries and blocks of a slice.
PIVOTS, ROWS, QUERIES_EACH, DIRECTORY = (32, 1024), 4096, 50_000, 100_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, x in enumerate(column):
        own = np.frombuffer(x.as_buffer(), np.int64)
        out[k, : len(own)] = own
    return out


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact x @ q: in doubles while no partial sum can pass 2**53."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, n2): floor(scale * component) as 64-bit integers, and their squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, norm = [], [], []
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k is None or not row.is_valid or row.values.null_count:
                    continue
                x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    x = np.floor(scale * x)
                    if np.abs(x).max(initial=0) >= 2.0**62:
                        raise ValueError("a scaled component does not fit 64 bits: use a smaller scale")
                    v = x.astype(np.int64)
                    ids.append(k)
                    out.append(v.tobytes())
                    norm.append(float((v.astype(np.float64) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norm, pa.float64())], names=["vec_id", "v", "n2"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "vec_id long, v binary, n2 double")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (on vec_id) the k highest integer inner products."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, rows_path = materialise(integers(vectors, scale, id_col, vector_col), "vectors")
    top, width, n_queries, n = rows.agg(F.coalesce(F.max("n2"), F.lit(0.0)), F.coalesce(F.max(F.octet_length("v")), F.lit(0)), F.count_if(is_query), F.count("*")).first()
    width //= 8
    if top >= 2.0**62:  # no score is larger than the largest squared length
        raise ValueError("scores of the scaled vectors may not fit 64 bits: use a smaller scale")
    pivots = min(max(math.isqrt(n), PIVOTS[0]), PIVOTS[1])
    m2 = float(top) * (1 + 1e-12) + 1
    margin = 1e-9 * m2 + 1e-6
    chosen = [np.frombuffer(x[0], np.int64) for x in rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    base = np.zeros((len(chosen), width), np.float64)
    for i, x in enumerate(chosen):
        base[i, : len(x)] = x
    lift = np.sqrt(np.maximum(m2 - (base**2).sum(1), 0))

    def to_pivots(v: np.ndarray, query: bool) -> np.ndarray:
        """Distances to all pivots of vectors in the lifted space; a query has 0 as its added component."""
        x = v.astype(np.float64)
        n2 = (x**2).sum(1)
        own = np.zeros(len(x)) if query else np.sqrt(np.maximum(m2 - n2, 0))
        d2 = (n2 + own**2)[:, None] + m2 - 2 * (x @ base.T + own[:, None] * lift[None])
        return np.sqrt(np.maximum(d2, 0))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = to_pivots(_matrix(batch.column("v"), width), False)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "v", "pivot", "d"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in (*batches, None):
            if batch is not None:
                held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
            while held is not None and held.num_rows:
                pivot = held.column("pivot").to_numpy()
                end = min(ROWS, int(np.searchsorted(pivot, pivot[0], side="right")))
                if batch is not None and end == held.num_rows and end < ROWS:
                    break  # the annulus may go on
                part = held.slice(0, end).combine_chunks()
                d = part.column("d").to_numpy()
                v = _matrix(part.column("v").combine_chunks(), width)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(pivot[0])], pa.int32()), pa.array([d[0]]), pa.array([d[-1]]), pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([d.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["block", "pivot", "low", "high", "ids", "ds", "vs"])
                number, held = number + 1, held.slice(end)

    keyed = rows.mapInArrow(key, "vec_id long, v binary, pivot int, d double") if chosen else rows.selectExpr("vec_id", "v", "0 pivot", "0D d")
    keyed, keyed_path = materialise(keyed, "keyed")
    blocks = keyed.repartitionByRange(partitions(spark), "pivot", "d", "vec_id").sortWithinPartitions("pivot", "d", "vec_id")
    blocks, _ = materialise(blocks.mapInArrow(cut, "block long, pivot int, low double, high double, ids binary, ds binary, vs binary"), "blocks")
    remove(spark, keyed_path)
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "v").repartition(partitions(spark))
    split = 1 + n_queries // QUERIES_EACH
    n_blocks = blocks.count()
    directory = blocks.select("block", "pivot", "low", "high")

    def requests(asked: DataFrame, first: bool) -> DataFrame:
        """Each query with the blocks it must search: at first the nearest ones, then all that its bound allows.
        The directory (four numbers for each block) goes to the workers in slices of bounded length."""
        out = None
        slices = 1 if first else 1 + n_blocks // DIRECTORY
        for part in range(slices):
            own = directory.filter(F.pmod(F.hash("block"), F.lit(slices)) == part) if slices > 1 else directory
            if first and n_blocks > DIRECTORY:  # any blocks give a bound; those of a slice will do
                own = own.orderBy(F.hash("block")).limit(DIRECTORY)
            found = own.toPandas()
            shared = spark.sparkContext.broadcast([found[c].to_numpy() for c in ("block", "pivot", "low", "high")])

            def choose(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                block, pivot, low, high = shared.value
                for batch in batches:
                    if not batch.num_rows or not len(block):
                        continue
                    v = _matrix(batch.column("v"), width)
                    d = to_pivots(v, True)[:, pivot]
                    gap = np.maximum(np.maximum(low - d, d - high), 0)
                    n2 = (v.astype(np.float64) ** 2).sum(1)
                    if first:
                        take = np.zeros(gap.shape, bool)
                        np.put_along_axis(take, np.argsort(gap, axis=1, kind="stable")[:, :2], True, 1)
                        bound = np.full(len(v), np.nan)
                    else:
                        bound = np.array([np.nan if x is None else x for x in batch.column("bound").to_pylist()], float)
                        reach = (n2[:, None] + m2 - gap**2) / 2
                        take = ~(reach + margin < bound[:, None])
                        for i, done in enumerate(batch.column("done").to_pylist()):
                            if done:
                                take[i, np.isin(block, done)] = False
                    q, b = np.nonzero(take)
                    at = pa.array(q)
                    yield pa.RecordBatch.from_arrays([pa.array(block[b]), batch.column("query_id").take(at), batch.column("v").take(at), pa.array(d[q, b]), pa.array(bound[q], from_pandas=True)], names=["block", "query_id", "v", "dq", "bound"])

            part_out = asked.mapInArrow(choose, "block long, query_id long, v binary, dq double, bound double")
            out = part_out if out is None else out.unionByName(part_out)
        return out.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(split)).cast("int"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of a block for each query, from the annulus that its bound leaves."""
        names = ["query_id", "block", "vec_id", "score"]
        q_out, v_out, s_out = [], [], []
        if left.num_rows and right.num_rows:
            ids = np.frombuffer(left.column("ids")[0].as_py(), np.int64)
            ds = np.frombuffer(left.column("ds")[0].as_py(), np.float64)
            x = np.frombuffer(left.column("vs")[0].as_py(), np.int64).reshape(len(ids), width)
            qs = _matrix(right.column("v").combine_chunks(), width)
            dq = right.column("dq").to_numpy()
            bounds = [None if b is None else b for b in right.column("bound").to_pylist()]
            for i, query in enumerate(right.column("query_id").to_pylist()):
                low, high, least = 0, len(ids), None
                if bounds[i] is not None:
                    least = bounds[i]
                    n2 = float((qs[i].astype(np.float64) ** 2).sum())
                    radius = np.sqrt(max(n2 + m2 - 2 * least, 0) + 2 * margin)
                    low, high = np.searchsorted(ds, [dq[i] - radius, dq[i] + radius * (1 + 1e-9)])
                scores = _products(x[low:high], qs[i])
                keep = ids[low:high] != query
                if least is not None:
                    keep &= scores >= least
                at = np.flatnonzero(keep)
                at = at[np.lexsort((ids[low:high][at], -scores[at]))[:k]]
                q_out += [query] * len(at)
                v_out += ids[low:high][at].tolist()
                s_out += scores[at].tolist()
        block = left.column("block")[0].as_py() if left.num_rows else None
        return pa.table([pa.array(q_out, pa.int64()), pa.array([block] * len(q_out), pa.int64()), pa.array(v_out, pa.int64()), pa.array(s_out, pa.int64())], names=names)

    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1)))) if split > 1 else blocks.withColumn("part", F.lit(0))

    def searched(asked: DataFrame) -> DataFrame:
        return dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search, "query_id long, block long, vec_id long, score long")

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked, _ = materialise(requests(queries, True), "asked")
    near, _ = materialise(searched(asked), "near")
    bound = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    done = asked.groupBy("query_id").agg(F.collect_set("block").alias("done"))  # two at most
    again = queries.join(bound, "query_id", "left").join(done, "query_id", "left")
    rest = searched(requests(again, False))
    best = near.unionByName(rest).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
