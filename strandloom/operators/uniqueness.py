"""Which edges of a graph (edge_id, src, dst, size, cov) occur once: long ones, bulge paths, loops by votes of coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.graph import chained, contract, degrees
from strandloom.operators.shared import materialise, remove


def bundles(edges: DataFrame) -> DataFrame:
    """(src, dst, n, lo, hi, first, second): edges between the same vertices as one, with their extreme sizes and ids."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("edge_id").alias("first"), F.max("edge_id").alias("second"))


def _simple(found: DataFrame, end: str, ratio: float) -> DataFrame:
    """Vertices with a single edge on a side, or two that end alike and differ in size by less than the ratio."""
    sides = found.groupBy(F.col(end).alias("v")).agg(F.count("*").alias("m"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    alike = (F.col("n") == 1) | ((F.col("n") == 2) & (F.col("hi") < F.col("lo") * F.lit(ratio)))
    return sides.filter((F.col("m") == 1) & alike).select("v")


def bulge_chains(edges: DataFrame, ratio: float = 1.3) -> DataFrame:
    """Bundles with head and rank (and ring): those that meet at vertices that are simple on both sides are one path.

    Bundles that touch no such vertex are left out. Edges with a null end take no part."""
    found = bundles(edges.filter("src is not null and dst is not null")).withColumn("id", F.xxhash64("src", "dst"))
    inner = _simple(found, "src", ratio).join(_simple(found, "dst", ratio), "v", "left_semi")
    touched = found.join(inner.select(F.col("v").alias("src")), "src", "left_semi").unionByName(found.join(inner.select(F.col("v").alias("dst")), "dst", "left_semi").select(*found.columns)).distinct()
    return chained(touched, inner).drop("id")


def bulge_paths(edges: DataFrame, ratio: float = 1.3) -> DataFrame:
    """(src, dst, n, total): paths of ``bulge_chains``, the larger edge of each bulge counted."""
    parts = bulge_chains(edges, ratio).groupBy("head").agg(F.min_by("src", "rank").alias("src"), F.max_by("dst", "rank").alias("dst"), F.count("*").alias("n"), F.sum("hi").alias("total"))
    return parts.drop("head")


def unique_edges(edges: DataFrame, k: int, least: int = 100000, ratio: float = 1.3) -> DataFrame:
    """(edge_id) of edges that occur once.

    In a bulge path of at least ``least`` symbols both sides of every bulge are unique if one of them is longer than k; else the single edges of over twice
    ``least``. Edges with an end outside of such paths, the first and the last one of a path too, are unique if longer than ``least``, and at dead
    ends from over a third of it with a coverage above 4."""
    chains = bulge_chains(edges, ratio)
    sizes = chains.groupBy("head").agg(F.sum("hi").alias("total"), F.count("*").alias("parts"), F.max(F.when(F.col("n") == 2, F.col("hi"))).alias("bulge"))
    kept = chains.join(sizes.filter(F.col("total") >= least), "head")
    bad = (F.col("parts") > 1) & (F.coalesce("bulge", F.lit(0)) <= k)
    pair = F.array("first", "second")
    chosen: Column = F.when(bad, F.when((F.col("n") == 1) & (F.col("lo") > 2 * least), F.array("first"))).when(F.col("parts") > 1, F.when(F.col("n") == 2, pair)).otherwise(F.array("first"))
    in_paths = kept.select(F.explode(chosen).alias("edge_id"))
    # a vertex inside a kept path: one bundle of it ends there and another begins there
    inside = kept.select("head", F.col("dst").alias("v")).join(kept.select("head", F.col("src").alias("v")), ["head", "v"], "left_semi").select("v").distinct()
    begun, ended = edges.select(F.col("src").alias("v")).distinct(), edges.select(F.col("dst").alias("v")).distinct()
    mark = lambda df, rows, end, name: df.join(rows.select(F.col("v").alias(end), F.lit(True).alias(name)), end, "left")
    rows = mark(mark(mark(mark(edges, inside, "src", "s_in"), inside, "dst", "d_in"), ended, "src", "entered"), begun, "dst", "left_on")
    tip = F.col("entered").isNull() | F.col("left_on").isNull()
    long = (F.col("size") > least) | (tip & (F.col("size") * 3 > least) & (F.col("cov") > 4))
    outside = rows.filter((F.col("s_in").isNull() | F.col("d_in").isNull()) & long).select("edge_id")
    return in_paths.unionByName(outside).distinct()


def support(longest: int = 20000) -> Column:
    """Evidence for a unique edge (size, cov, cnt): paths that pass it, and for edges below ``longest`` not more than its coverage."""
    return F.when(F.col("size") < longest, F.least(F.col("cnt").cast("double"), F.col("cov").cast("double"))).otherwise(F.col("cnt").cast("double"))


def coverage_range(edges: DataFrame, by: str = "component", longest: int = 20000) -> DataFrame:
    """Least and largest support of each group's unique edges, and the bounds that follow: ``one`` below which an edge occurs once at
    most, ``two`` below which twice at most, ``real`` from which it does occur."""
    found = edges.filter("unique").withColumn("x", support(longest)).groupBy(by).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    times = lambda c, x: F.col(c) * F.lit(x)
    return found.select(by, "low", "high", F.greatest(times("low", 1.4), times("high", 1.2)).alias("one"), times("low", 2.4).alias("two"), F.least(times("low", 0.9), times("high", 0.7)).alias("real"))


def loops(edges: DataFrame, forward_most: int = 30000, back_most: int = 50000) -> DataFrame:
    """Two vertices tied by an edge there (forward) and one back, with one unique edge into the pair and one out of it: ids and coverages."""
    ins = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n_in"))
    outs = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n_out"))
    deg = ins.join(outs, "v")
    first, last = deg.filter("n_in = 2 and n_out = 1").select("v"), deg.filter("n_in = 1 and n_out = 2").select("v")
    plain = edges.filter("not unique")
    there = plain.filter(F.col("size") <= forward_most).join(first, plain.src == first.v, "left_semi").join(last, plain.dst == last.v, "left_semi")
    back = plain.filter(F.col("size") <= back_most).select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("edge_id").alias("back"), F.col("cov").alias("back_cov"))
    pair = there.filter("src <> dst").select("src", "dst", F.col("edge_id").alias("forward"), F.col("cov").alias("forward_cov")).join(back, ["src", "dst"])
    alone = edges.filter("unique").withColumn("x", support())
    into = alone.select(F.col("dst").alias("src"), F.col("src").alias("from"), F.col("edge_id").alias("into"), F.col("x").alias("into_x"))
    out = alone.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("edge_id").alias("out"), F.col("x").alias("out_x"))
    whole = pair.join(into, "src").join(out, "dst")
    return whole.filter("`from` <> src and `from` <> dst and `to` <> src and `to` <> dst").drop("from", "to")


def loop_votes(edges: DataFrame, bridged: DataFrame | None = None) -> DataFrame:
    """(forward, back, into, out, times, path): how often a loop's way back is taken, where both coverages agree; path lists the edges of a read through it.

    Edges are (edge_id, src, dst, size, cov, cnt, unique). Loops that a read spans, given as ``bridged`` (into, out), need no vote."""
    low, high = F.least("into_x", "out_x"), F.greatest("into_x", "out_x")
    found = loops(edges).withColumn("med", (low + high) / 2).withColumn("dev", F.greatest(F.lit(4.0), high - low) / F.col("med") / 2)
    vote = lambda c: F.floor(F.col(c) / F.col("med") + F.lit(0.5)).cast("long")
    found = found.withColumn("vote", vote("forward_cov")).withColumn("times", vote("back_cov"))
    agreed = found.filter((F.col("med") > 0) & (F.col("vote") * F.col("dev") * 2 <= F.col("med")) & (F.col("vote") == F.col("times") + 1))
    if bridged is not None:
        agreed = agreed.join(bridged, ["into", "out"], "left_anti")
    again = F.flatten(F.array_repeat(F.array("back", "forward"), F.col("times").cast("int")))
    return agreed.select("forward", "back", "into", "out", "times", F.concat(F.array("into", "forward"), again, F.array("out")).alias("path"))


def reliable_extensions(edges: DataFrame, starts: DataFrame, length: int, least: float) -> DataFrame:
    """(key, path, seq, len): from each start (key, v) the edges (edge_id, src, dst, label, cov) that follow, until they have ``length`` symbols, where each is the only one
    of coverage ``least`` or more. Starts without such a way have no row."""
    spark = edges.sparkSession
    good = edges.filter(F.col("cov") >= least)
    alone = good.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("edge_id", "dst", "label"))).filter("m = 1")
    steps, steps_path = materialise(alone.select("v", "edge_id", "dst", F.expr("substr(label, length(v) + 1)").alias("tail")), "steps")
    front = starts.select("key", "v", F.array().cast(f"array<{dict(edges.dtypes)['edge_id']}>").alias("path"), F.lit("").alias("seq"), F.lit(0).alias("len"))
    found = [front.filter(F.lit(length <= 0)).drop("v")]
    while length > 0:
        longer = front.join(steps, "v").select("key", F.col("dst").alias("v"), F.concat("path", F.array("edge_id")).alias("path"), F.concat("seq", "tail").alias("seq"), (F.col("len") + F.length("tail")).alias("len"))
        grown, _ = materialise(longer, "front")
        found.append(grown.filter(F.col("len") >= length).drop("v"))
        front = grown.filter(F.col("len") < length)
        if front.isEmpty():
            break
    out, _ = materialise(reduce(DataFrame.unionByName, found), "extended")
    remove(spark, steps_path)
    return out


def extended_contigs(edges: DataFrame) -> DataFrame:
    """(seq, n): each edge of (src, dst, label, cov) extended forward while one edge follows and back while one precedes, without those that lie within another one; n counts
    unbranching paths. A way that comes round ends before its first repeated edge; a pure ring is one contig.

    An unbranching path within another's extension is one that begins where several end and it alone begins, or ends where it alone ends and several begin."""
    spark = edges.sparkSession
    units, units_path = materialise(contract(edges).select("src", "dst", "label", F.sha1("label").alias("id")), "units")
    d = degrees(units)
    at = lambda c: d.select(F.col("v").alias(c), F.col("n_in").alias(f"{c}_in"), F.col("n_out").alias(f"{c}_out"))
    rows = units.join(at("src"), "src").join(at("dst"), "dst")
    seeds = rows.filter("not (src_in > 1 and src_out = 1) and not (dst_out > 1 and dst_in = 1)")
    before = rows.filter("dst_in = 1").select(F.col("dst").alias("v"), F.col("src").alias("to"), F.col("id").alias("next"), F.expr("left(label, length(label) - length(dst))").alias("text"))
    after = rows.filter("src_out = 1").select(F.col("src").alias("v"), F.col("dst").alias("to"), F.col("id").alias("next"), F.expr("substr(label, length(src) + 1)").alias("text"))
    walks, path = materialise(seeds.select(F.col("src").alias("v"), F.col("dst").alias("end"), F.array("id").alias("path"), F.col("label").alias("seq")), "walks")
    for steps, back in ((before, True), (after, False)):
        done = []
        while True:
            went = walks.join(steps, "v", "left").withColumn("on", F.col("next").isNotNull() & ~F.array_contains("path", F.col("next")))
            moved = went.select("on", F.when(F.col("on"), F.col("to")).otherwise(F.col("v")).alias("v"), "end", F.when(F.col("on"), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"), F.when(F.col("on"), F.concat("text", "seq") if back else F.concat("seq", "text")).otherwise(F.col("seq")).alias("seq"))
            grown, _ = materialise(moved, "walks")
            done.append(grown.filter("not on").drop("on"))
            walks = grown.filter("on").drop("on")
            if walks.isEmpty():
                break
        whole = reduce(DataFrame.unionByName, done)
        walks, _ = materialise(whole.select(F.col("end").alias("v"), "end", "path", "seq"), "walks")
    remove(spark, units_path)
    remove(spark, path)
    return walks.groupBy("seq").agg(F.max(F.size("path")).cast("long").alias("n"))
