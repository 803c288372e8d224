"""Correction of reads along a graph: stretches of rarely seen edges give way to the one well-supported path that resembles them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.alignment import nearest
from strandloom.operators.paths import align
from strandloom.operators.shared import materialise, remove


def alternatives(edges: DataFrame, asked: DataFrame, least: int, most: int = 30, effort: int = 10_000) -> DataFrame:
    """(key, path, seq): all walks over edges of mean coverage ``least`` or more from src to dst whose length is in [low, high],
    for asked (key, src, dst, low, high). A key with over ``most`` walks, or over ``effort`` steps, has none: what fits too well
    is no evidence. The frontier is a table, one edge longer each round."""
    spark = edges.sparkSession
    size = F.length("label") - F.length("src")
    good = edges.filter(F.col("cov") >= F.lit(least) * F.col("n")).select(F.col("src").alias("v"), F.col("dst").alias("to"), "edge_id", size.alias("size"), F.expr("substr(label, length(src) + 1)").alias("tail"))
    start = asked.select("key", F.col("src").alias("v"), "dst", "low", "high", F.array().cast("array<string>").alias("path"), F.col("src").alias("seq"), F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("spent"))
    front, path = materialise(start, "walks")
    rounds = []
    while not front.isEmpty():
        longer = front.join(good, "v").withColumn("len", F.col("len") + F.col("size")).filter("len <= high")
        longer = longer.select("key", F.col("to").alias("v"), "dst", "low", "high", F.concat("path", F.array("edge_id")).alias("path"), F.concat("seq", "tail").alias("seq"), "len", "spent")
        cost = longer.groupBy("key").agg((F.count("*") + F.max("spent")).alias("now"))
        longer = longer.join(cost, "key").withColumn("spent", F.col("now")).drop("now")
        grown, new = materialise(longer, "walks")
        rounds.append(grown.select("key", "v", "dst", "low", "path", "seq", "len", "spent"))
        front = grown.filter(F.col("spent") <= effort)
    walked = rounds[0] if rounds else front.select("key", "v", "dst", "low", "path", "seq", "len", "spent")
    for more in rounds[1:]:
        walked = walked.unionByName(more)
    tired = walked.groupBy("key").agg(F.max("spent").alias("spent"), F.count_if((F.col("v") == F.col("dst")) & (F.col("len") >= F.col("low"))).alias("n"))
    fine = tired.filter((F.col("spent") <= effort) & (F.col("n") <= most)).select("key")
    found, _ = materialise(walked.filter("v = dst and len >= low").select("key", "path", "seq").join(fine, "key", "left_semi"), "found")
    remove(spark, path)
    return found


def _nearest(candidates: Column, target: Column) -> Column:
    @F.pandas_udf("long")
    def run(c: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([nearest(list(x), y) for x, y in zip(c, t, strict=True)], dtype="Int64")

    return run(candidates, target)


def corrected(reads: DataFrame, edges: DataFrame, k: int, least: int, slack: int = 100) -> DataFrame:
    """(read_id, seq, n): reads with inner stretches of mean coverage under ``least`` replaced, and how many were.

    Edges (edge_id, src, dst, label, cov, n) hold every k-mer of the reads. A stretch between two well-covered steps is asked
    for walks of its length, give or take ``slack`` or 3 %; of those the nearest string is taken if the choice is safe.
    Stretches at either end, and those without a safe choice, stay as they are; so do reads shorter than k."""
    size = F.length("label") - F.length("src")
    info = edges.select("edge_id", "src", "dst", "label", size.alias("size"), (F.col("cov") < F.lit(least) * F.col("n")).alias("weak"))
    order = Window.partitionBy("read_id").orderBy("i")
    rows = align(reads, edges, k).join(info, "edge_id")
    rows = rows.withColumn("part", F.sum(F.when(F.col("weak"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps, steps_path = materialise(rows.withColumn("last", F.max("part").over(Window.partitionBy("read_id"))), "steps")
    inner = steps.filter("weak").withColumn("later", F.col("last") > F.col("part")).filter("part > 0 and later")
    stretch = inner.groupBy("read_id", "part").agg(F.sort_array(F.collect_list(F.struct("i", "src", "dst", "label"))).alias("p"), F.sum("size").alias("size"))
    whole = F.concat(F.col("p")[0]["src"], F.array_join(F.transform("p", lambda x: F.substring(x["label"], F.length(x["src"]) + 1, F.length(x["label"]))), ""))
    give = F.greatest(F.lit(slack), F.floor(F.col("size") * 0.03))
    asked = stretch.select("read_id", "part", F.concat_ws(":", "read_id", "part").alias("key"), F.col("p")[0]["src"].alias("src"), F.element_at("p", -1)["dst"].alias("dst"), (F.col("size") - give).alias("low"), (F.col("size") + give).alias("high"), whole.alias("old"))
    asked, _ = materialise(asked, "asked")
    offers = alternatives(edges, asked, least).groupBy("key").agg(F.sort_array(F.collect_list("seq")).alias("c"))
    picked = asked.join(offers, "key").withColumn("best", _nearest(F.col("c"), F.col("old"))).filter("best is not null")
    new, _ = materialise(picked.select("read_id", "part", F.get("c", F.col("best").cast("int")).alias("new")), "picked")
    flagged = steps.join(new, ["read_id", "part"], "left").withColumn("gone", F.col("weak") & F.col("new").isNotNull())
    first = F.col("i") == F.min("i").over(Window.partitionBy("read_id"))
    own = F.when(first, F.expr(f"substr(label, left + 1, right - left + {k - 1})")).otherwise(F.expr(f"substr(label, left + {k}, right - left)"))
    kept = flagged.withColumn("text", own).filter("not gone").select("read_id", "i", "text", F.lit(0).alias("n"))
    put = flagged.filter("gone").groupBy("read_id", "part").agg(F.min("i").alias("i"), F.first("new").alias("new")).select("read_id", "i", F.expr(f"substr(new, {k})").alias("text"), F.lit(1).alias("n"))
    spelled = kept.unionByName(put).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("p"), F.sum("n").alias("n"))
    spelled = spelled.select("read_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("spelled"), "n")
    out, _ = materialise(reads.select("read_id", "seq").join(spelled, "read_id", "left").select("read_id", F.coalesce("spelled", "seq").alias("seq"), F.coalesce("n", F.lit(0)).cast("long").alias("n")), "corrected")
    remove(reads.sparkSession, steps_path)
    return out
