"""Operators on half-open intervals (contig, lo, hi) and points (contig, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins that turn a range condition into an equi-join.
BIN = 64


def binned(intervals: DataFrame, bin_width: int = BIN) -> DataFrame:
    """One row for each bin that an interval touches."""
    return intervals.filter("lo < hi").withColumn("bin", F.explode(F.expr(f"sequence(floor(lo / {bin_width}), floor((hi - 1) / {bin_width}))")))


def points_in(points: DataFrame, intervals: DataFrame, bin_width: int = BIN) -> DataFrame:
    """points x intervals with lo <= pos < hi, by an equi-join on (contig, bin)."""
    left = points.withColumn("bin", F.floor(F.col("pos") / bin_width))
    return left.join(binned(intervals, bin_width), ["contig", "bin"]).filter("lo <= pos and pos < hi").drop("bin")


def overlaps(a: DataFrame, b: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals of one contig with (lo, hi) and (lo2, hi2); each pair in the bin where the later of both begins."""
    right = binned(b.withColumnsRenamed({"lo": "lo_", "hi": "hi_"}).withColumnsRenamed({"lo_": "lo", "hi_": "hi"}), bin_width).withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    found = binned(a, bin_width).join(right, ["contig", "bin"]).filter("lo < hi2 and lo2 < hi")
    return found.filter(F.col("bin") == F.floor(F.greatest("lo", "lo2") / bin_width)).drop("bin")


def uncovered_points(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    return points.join(points_in(points, intervals).select(key).distinct(), key, "left_anti")


def band_semi(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Points of left with a point of right of the same contig at most so far away."""
    near = right.select("contig", F.explode(F.sequence(F.col("pos") - distance, F.col("pos") + distance)).alias("pos")).distinct()
    return left.join(near, ["contig", "pos"], "left_semi")


def merged(intervals: DataFrame, by: str = "contig", gap: int = 0) -> DataFrame:
    """Overlapping or touching (or at most ``gap`` apart) intervals as one: (by, lo, hi, n)."""
    order = Window.partitionBy(by).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = intervals.withColumn("new", F.when(F.col("lo") <= reach + gap, 0).otherwise(1))
    part = new.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(by, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("part")


def depth_steps(intervals: DataFrame, by: str = "contig") -> DataFrame:
    """(by, pos, depth): the depth from each place on where it may change."""
    events = intervals.select(by, F.col("lo").alias("pos"), F.lit(1).alias("d")).unionAll(intervals.select(by, F.col("hi").alias("pos"), F.lit(-1).alias("d")))
    steps = events.groupBy(by, "pos").agg(F.sum("d").alias("d"))
    return steps.select(by, "pos", F.sum("d").over(Window.partitionBy(by).orderBy("pos")).alias("depth"))


def depth_islands(intervals: DataFrame, least: int, by: str = "contig") -> DataFrame:
    """Covered stretches whose greatest depth is over ``least``: (by, lo, hi, top)."""
    order = Window.partitionBy(by).orderBy("pos")
    steps = depth_steps(intervals, by).withColumn("end", F.lead("pos").over(order)).withColumn("before", F.lag("depth", 1, 0).over(order))
    part = steps.withColumn("part", F.sum(F.when((F.col("before") == 0) & (F.col("depth") > 0), 1).otherwise(0)).over(order)).filter("depth > 0")
    return part.groupBy(by, "part").agg(F.min("pos").alias("lo"), F.max("end").alias("hi"), F.max("depth").alias("top")).filter(F.col("top") > least).drop("part")


def uncovered(intervals: DataFrame, by: str = "contig") -> DataFrame:
    """Gaps between covered stretches, from 0 on, up to the last interval: (by, lo, hi)."""
    order = Window.partitionBy(by).orderBy("lo")
    return merged(intervals, by).select(by, F.coalesce(F.lag("hi").over(order), F.lit(0)).alias("lo"), F.col("lo").alias("hi")).filter("lo < hi")


def clusters(points: DataFrame, gap: int, least: int, by: str = "contig") -> DataFrame:
    """Runs of points with steps of at most ``gap``, of ``least`` points at least: (by, lo, hi, n)."""
    order = Window.partitionBy(by).orderBy("pos")
    new = points.withColumn("new", F.when(F.col("pos") - F.lag("pos").over(order) <= gap, 0).otherwise(1))
    part = new.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(by, "part").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("part")


def segment_algebra(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Of [a, b) and [c, d): gap between them, whether and how far they overlap, and what unites them."""
    return {"gap": F.greatest(F.lit(0), F.greatest(a, c) - F.least(b, d)), "meets": F.greatest(a, c) < F.least(b, d), "common": F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c)), "united": F.greatest(b, d) - F.least(a, c)}


def contained(inner: DataFrame, outer: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Pairs with [lo, hi) within [lo2, hi2)."""
    return overlaps(inner, outer, bin_width).filter("lo2 <= lo and hi <= hi2")


def binned_coverage(intervals: DataFrame, width: int, by: str = "contig") -> DataFrame:
    """(by, bin, total): covered places, with multiplicity, in bins of a width."""
    rows = binned(intervals, width)
    size = F.least("hi", (F.col("bin") + 1) * width) - F.greatest("lo", F.col("bin") * width)
    return rows.groupBy(by, "bin").agg(F.sum(size).alias("total"))


def low_regions(rows: DataFrame, low: Column, gap: int, by: str, order: str) -> DataFrame:
    """Stretches (by, lo, hi, n) of low places that fewer than ``gap`` good ones separate."""
    return clusters(rows.filter(low).select(by, F.col(order).alias("pos")), gap, 1, by)


def simulated(placements: DataFrame, references: DataFrame) -> DataFrame:
    """Reads (key, seq) cut out of references at [lo, hi), reversed on strand -; ends are clamped."""
    both = placements.join(references.select(F.col("read_id").alias("contig"), "seq"), "contig")
    part = F.expr("substr(seq, greatest(lo, 0) + 1, greatest(least(hi, length(seq)) - greatest(lo, 0), 0))")
    return both.select("key", F.when(F.col("strand") == "-", F.reverse(F.translate(part, "ACGT", "TGCA"))).otherwise(part).alias("seq"))
