"""Summaries of contigs, reads and placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ng(lengths: DataFrame, genome: int | None = None, share: float = 0.5, strict: bool = False) -> DataFrame:
    """n, total, and the length at which the lengths in descending order reach a share of the genome (or total); null if they don't.

    Equal lengths are one row first, so the running sum is over distinct lengths."""
    counted = lengths.groupBy("len").agg(F.count("*").alias("c"), F.sum("len").alias("s"))
    total = counted.agg(F.sum("c").alias("n"), F.sum("s").alias("total"))
    running = counted.withColumn("cum", F.sum("s").over(Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)))
    target = F.lit(genome) if genome is not None else F.col("total")
    cond = F.col("cum") > target * share if strict else F.col("cum") >= target * share
    return running.crossJoin(F.broadcast(total)).groupBy("n", "total").agg(F.max(F.when(cond, F.col("len"))).alias("ng"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """n, total and the element n // 2 in ascending order, from counts of distinct values."""
    counted = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    running = counted.withColumn("cum", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    total = counted.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("total"))
    return running.crossJoin(F.broadcast(total)).filter(F.col("cum") > F.floor(F.col("n") / 2)).groupBy("n", "total").agg(F.min("v").alias("median"))


def histogram(df: DataFrame, value: Column, width: int, most: int) -> DataFrame:
    """Counts by ceil(value / width), capped."""
    return df.groupBy(F.least(F.ceil(value / width), F.lit(most)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last one."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def running_mean(df: DataFrame, by: str, order: str | list[str], value: str, width: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(width - 1), 0)
    return df.withColumn("mean", F.avg(value).over(w)).withColumn("k", F.count("*").over(w)).filter(F.col("k") == width).drop("k")


def prefix_sums(df: DataFrame, by: str, order: str | list[str], value: str) -> DataFrame:
    return df.withColumn("prefix", F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def range_added(df: DataFrame, updates: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Values after adding ``d`` to all places in [lo, hi) for each update: differences at both ends, then prefix sums."""
    ends = updates.select(by, F.col("lo").alias(order), F.col("d")).unionAll(updates.select(by, F.col("hi").alias(order), (-F.col("d")).alias("d"))).groupBy(by, order).agg(F.sum("d").alias("d"))
    both = df.join(ends, [by, order], "full")
    out = both.withColumn("added", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(by).orderBy(order)))
    return out.filter(F.col(value).isNotNull()).withColumn(value, F.col(value) + F.col("added")).drop("d", "added")


def reliable_neighbours(df: DataFrame, by: str, order: str, good: Column) -> DataFrame:
    """The place of the last good row before and the first after each row."""
    w = Window.partitionBy(by).orderBy(order)
    at = F.when(good, F.col(order))
    return df.withColumn("before", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(at, True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def best_span(df: DataFrame, by: str) -> DataFrame:
    """The longest span (lo, hi) of each query."""
    return df.groupBy(by).agg(F.max(F.col("hi") - F.col("lo")).alias("span"))


def ratio_gaps(df: DataFrame, by: str, value: str, least: float = 1.5) -> DataFrame:
    """Where sorted values of a component jump by at least a ratio: (by, low, high)."""
    w = Window.partitionBy(by).orderBy(value)
    return df.withColumn("low", F.lag(value).over(w)).filter(F.col(value) >= F.col("low") * least).select(by, "low", F.col(value).alias("high"))


def covered_share(segments: DataFrame, by: str, percent: int = 95) -> DataFrame:
    """Per group the covered length, largest segment, and how many of the largest make up so many percent."""
    size = F.col("hi") - F.col("lo")
    w = Window.partitionBy(by).orderBy(F.desc("size"), "lo")
    ranked = segments.withColumn("size", size).withColumn("cum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("size").over(Window.partitionBy(by)))
    return ranked.groupBy(by).agg(F.max("total").alias("covered"), F.max("size").alias("largest"), (F.count_if(F.col("cum") * 100 < F.col("total") * percent) + 1).alias("n"))


def consensus_votes(votes: DataFrame) -> DataFrame:
    """(contig, pos, run_len): the lower median of all votes for a place."""
    return votes.groupBy("contig", "pos").agg(F.expr("percentile_disc(0.5) within group (order by run_len)").cast("int").alias("run_len"))


def assembled(voted: DataFrame) -> DataFrame:
    """(contig, seq): each symbol as often as voted, in order; from (contig, pos, symbol, run_len)."""
    parts = voted.groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("pos", "symbol", "run_len"))).alias("p"))
    return parts.select("contig", F.array_join(F.transform("p", lambda x: F.repeat(x["symbol"], x["run_len"].cast("int"))), "").alias("seq"))
