"""Closing gaps: dead ends that overlap are tied by a bridge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import reverse_complement
from strandloom.operators.kmers import shared_pairs
from strandloom.operators.shared import materialise


def overlap(a: str, b: str, least: int, most: int, divergence: float, loss: int = 10) -> tuple[int, int]:
    """Symbols of the end of a and of the beginning of b that align best, (0, 0) if too few or too different.

    A match gains 1, a difference loses ``loss``; of equal scores the later beginning in a wins, then the shorter part of b."""
    x = np.frombuffer(a[max(0, len(a) - most) :].encode(), np.uint8)
    y = np.frombuffer(b[:most].encode(), np.uint8)
    unit = len(x) + 1  # a score and where it begins in one number
    row, fall = np.arange(len(x) + 1, dtype=np.int64), loss * unit * np.arange(len(x) + 1, dtype=np.int64)
    best, top = 0, int(row[-1])
    for j, c in enumerate(y):
        new = row - loss * unit
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(x == c, unit, -loss * unit))
        row = np.maximum.accumulate(new + fall) - fall
        if row[-1] > top:
            best, top = j + 1, int(row[-1])
    used, score = len(x) - top % unit, top // unit
    if min(used, best) < least or score < max(used, best) * (1 - divergence - divergence * loss):
        return 0, 0
    return used, best


def dead_ends(edges: DataFrame, longer: int, cov: float = 2) -> DataFrame:
    """(edge_id, seq) of edges (edge_id, src, dst, label, cov) that are long and covered and end where nothing else ends or begins."""
    ends = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n")).filter("n = 1")
    tips = edges.filter((F.length("label") > longer) & (F.col("cov") > cov)).join(ends, edges.dst == ends.v, "left_semi")
    return tips.join(edges.select(F.col("src").alias("begun")).distinct(), F.col("dst") == F.col("begun"), "left_anti").select("edge_id", F.col("label").alias("seq"))


def patches(tips: DataFrame, k: int = 311, least: int = 700, most: int = 10000, divergence: float = 0.05) -> DataFrame:
    """(a, b, end_a, end_b, seq): pairs of tips (edge_id, seq), each the other's only partner, of which one's end overlaps the other
    strand of the other's end; seq is what a has of the overlap, the bridge between both. Candidates share a k-mer within ``most`` symbols of their ends."""
    numbered, _ = materialise(tips.select(F.col("edge_id").cast("string").alias("edge_id"), "seq").withColumn("n", F.monotonically_increasing_id()), "tips")
    ends = numbered.select(F.col("n").alias("read_id"), F.right("seq", F.lit(most)).alias("seq"))
    both = ends.select((F.col("read_id") * 2).alias("read_id"), "seq").unionByName(ends.select((F.col("read_id") * 2 + 1).alias("read_id"), reverse_complement(F.col("seq")).alias("seq")))
    # one tip as it is and the other one turned: an even and an odd number
    met = shared_pairs(both, k).filter("a % 2 <> b % 2").select(F.expr("a div 2").alias("a"), F.expr("b div 2").alias("b")).filter("a <> b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = met.join(numbered.select(F.col("n").alias("a"), F.col("edge_id").alias("ia"), F.col("seq").alias("sa")), "a").join(numbered.select(F.col("n").alias("b"), F.col("edge_id").alias("ib"), reverse_complement(F.col("seq")).alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [overlap(x, y, least, most, divergence) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            keep = pa.array([x[0] > 0 for x in found], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in found], pa.int32()) for i in (0, 1))], names=[*batch.schema.names, "end_a", "end_b"])
            yield out.filter(keep)

    fine = rows.select("a", "b", "ia", "ib", "sa", "sb").mapInArrow(run, "a long, b long, ia string, ib string, sa string, sb string, end_a int, end_b int")
    fine, _ = materialise(fine, "overlaps")
    # a tip that overlaps two others is tied to none, whichever side it stands on
    sides = fine.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("m")).filter("m = 1")
    good = fine.join(sides.select(F.col("n").alias("a")), "a", "left_semi").join(sides.select(F.col("n").alias("b")), "b", "left_semi")
    return good.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "end_a", "end_b", F.expr("right(sa, end_a)").alias("seq"))
