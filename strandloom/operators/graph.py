"""De Bruijn graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.kmers import spectrum
from strandloom.operators.shared import materialise, remove


def edges_of(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(src, dst, label, cov): each k-mer joins its prefix to its suffix of k - 1 symbols."""
    found = spectrum(reads, k).filter(F.col("cnt") >= least)
    return found.select(F.expr(f"substr(kmer, 1, {k - 1})").alias("src"), F.expr(f"substr(kmer, 2, {k - 1})").alias("dst"), F.col("kmer").alias("label"), F.col("cnt").alias("cov"))


def degrees(edges: DataFrame) -> DataFrame:
    """(v, n_in, n_out)."""
    ends = edges.select(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(F.col("dst").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("v").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def degree_matrix(edges: DataFrame, most: int = 4) -> DataFrame:
    """How many vertices have each (capped) in- and out-degree."""
    return degrees(edges).groupBy(F.least("n_in", F.lit(most)).alias("n_in"), F.least("n_out", F.lit(most)).alias("n_out")).agg(F.count("*").alias("n"))


def coverage_histogram(edges: DataFrame, most: int = 200) -> DataFrame:
    return edges.groupBy(F.least(F.col("cov"), F.lit(most)).cast("long").alias("cov")).agg(F.count("*").alias("n"), F.sum(F.length("label")).alias("total"))


def without_tips(edges: DataFrame, least: int) -> DataFrame:
    """One round: edges of coverage under ``least`` go that begin where nothing ends, or end where nothing begins."""
    d = degrees(edges)
    marked = edges.join(d.select(F.col("v").alias("src"), F.col("n_in").alias("src_in")), "src").join(d.select(F.col("v").alias("dst"), F.col("n_out").alias("dst_out")), "dst")
    return marked.filter((F.col("cov") >= least) | ((F.col("src_in") > 0) & (F.col("dst_out") > 0))).select("src", "dst", "label", "cov")


def tip_free(edges: DataFrame, least: int) -> DataFrame:
    """Rounds of ``without_tips`` until nothing goes: as many as the longest tip has edges."""
    work, path = materialise(edges, "tips")
    n = work.count()
    while True:
        shorter, new = materialise(without_tips(work, least), "tips")
        remove(edges.sparkSession, path)
        work, path, left = shorter, new, shorter.count()
        if left == n:
            return work
        n = left


def three_colors(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(kmer, color, cnt_a, cnt_b): k-mers of the first set only, of the second only, or of both."""
    left, right = spectrum(a, k).withColumnRenamed("cnt", "cnt_a"), spectrum(b, k).withColumnRenamed("cnt", "cnt_b")
    both = left.join(right, "kmer", "full")
    color = F.when(F.col("cnt_b").isNull(), "first").when(F.col("cnt_a").isNull(), "second").otherwise("both")
    return both.select("kmer", color.alias("color"), F.coalesce("cnt_a", F.lit(0)).cast("long").alias("cnt_a"), F.coalesce("cnt_b", F.lit(0)).cast("long").alias("cnt_b"))


def complex_vertices(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("n_in > 1 and n_out > 1")


def through(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, left_label, right_label): every way in and out of the given vertices."""
    into = edges.select(F.col("dst").alias("v"), F.col("label").alias("left_label"))
    out = edges.select(F.col("src").alias("v"), F.col("label").alias("right_label"))
    return vertices.select("v").join(into, "v").join(out, "v")


def chained(keep: DataFrame, inner: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (id, src, dst, ...) with head, rank and ring: edges that meet at inner vertices (v) are one chain, in order of rank.
    Pointers to the row before double their reach each round; a ring begins at its smallest id."""
    spark = keep.sparkSession
    before = keep.join(inner, keep.src == inner.v, "left_semi").select("id", F.col("src").alias("mid")).join(keep.select(F.col("dst").alias("mid"), F.col("id").alias("prev")), "mid").select("id", "prev")
    steps = keep.select("id").join(before, "id", "left").select("id", F.coalesce("prev", "id").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.least("id", F.coalesce("prev", "id")).alias("low"))
    steps, path = materialise(steps.withColumn("done", F.col("rank") == 0), "chain")
    mark = None
    for _ in range(rounds):
        to = steps.select(F.col("id").alias("head"), F.col("head").alias("head2"), F.col("rank").alias("rank2"), F.col("low").alias("low2"))
        jumped = steps.join(to, "head").select("id", F.col("head2").alias("head"), (F.col("rank") + F.col("rank2")).alias("rank"), F.least("low", "low2").alias("low"), (F.col("rank2") == 0).alias("done"))
        jumped, new = materialise(jumped, "chain")
        remove(spark, path)
        steps, path, old = jumped, new, mark
        mark = tuple(steps.filter("not done").agg(F.count("*"), F.sum(F.hash("low").cast("long"))).first())
        if mark[0] == 0 or mark == old:
            break
    # what never reaches a head lies on a ring
    whole = keep.join(steps.select("id", "head", "rank", "low", "done"), "id")
    lines = whole.filter("done").drop("low", "done").withColumn("ring", F.lit(False))
    cyclic = whole.filter("not done").drop("head", "rank", "done").withColumnRenamed("low", "head")
    cut = F.col("id") == F.col("head")
    order, ring_path = materialise(cyclic.join(before, "id").select("id", "head", F.when(cut, F.col("id")).otherwise(F.col("prev")).alias("to"), F.when(cut, 0).otherwise(1).cast("long").alias("rank")), "rings")
    if not order.isEmpty():
        for _ in range(rounds):
            to = order.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("r2"))
            jumped, new = materialise(order.join(to, "to").select("id", "head", F.col("to2").alias("to"), (F.col("rank") + F.col("r2")).alias("rank")), "rings")
            remove(spark, ring_path)
            order, ring_path = jumped, new
            if order.filter("`to` <> head").isEmpty():
                break
    rings = cyclic.join(order.select("id", "rank"), "id").withColumn("ring", F.lit(True))
    return lines.unionByName(rings)


def contract(edges: DataFrame, rounds: int = 40, inner: DataFrame | None = None) -> DataFrame:
    """Unbranching paths as one edge each: (src, dst, label, cov, n). Inner vertices, if not given as (v), have one way in and one out; a pure
    cycle begins at its smallest edge."""
    if inner is None:
        inner = degrees(edges).filter("n_in = 1 and n_out = 1").select("v")
    rows = chained(edges.withColumn("id", F.xxhash64("src", "dst", "label")), inner, rounds)
    parts = rows.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("rank", "src", "dst", "label", "cov"))).alias("p"))
    tail: Column = F.concat_ws("", F.transform(F.expr("slice(p, 2, size(p))"), lambda x: F.substring(x["label"], F.length(x["src"]) + 1, F.length(x["label"]))))
    return parts.select(F.col("p")[0]["src"].alias("src"), F.element_at("p", -1)["dst"].alias("dst"), F.concat(F.col("p")[0]["label"], tail).alias("label"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["cov"]).alias("cov"), F.size("p").cast("long").alias("n"))


def neighbourhood(edges: DataFrame, start: DataFrame, radius: int) -> DataFrame:
    """(v, dist): vertices within ``radius`` of the start vertices, an edge counting as its label beyond the source vertex."""
    spark = edges.sparkSession
    steps = edges.select(F.col("src").alias("v"), "dst", (F.length("label") - F.length("src")).cast("long").alias("len"))
    steps = steps.unionByName(steps.select(F.col("dst").alias("v"), F.col("v").alias("dst"), "len"))
    near, path = materialise(start.select("v", F.lit(0).cast("long").alias("dist")).distinct(), "near")
    while True:
        reach = near.join(steps, "v").select(F.col("dst").alias("v"), (F.col("dist") + F.col("len")).alias("dist")).filter(F.col("dist") <= radius)
        grown, new = materialise(near.unionByName(reach).groupBy("v").agg(F.min("dist").alias("dist")), "near")
        same = grown.exceptAll(near).isEmpty()
        remove(spark, path)
        near, path = grown, new
        if same:
            return near


def segment_degrees(links: DataFrame) -> DataFrame:
    """Of link rows (a, b): how many links each segment has on either side, and whether one is to itself."""
    ends = links.select(F.col("a").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o"), (F.col("a") == F.col("b")).alias("c")).unionAll(links.select(F.col("b").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o"), (F.col("a") == F.col("b")).alias("c")))
    return ends.groupBy("name").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.max("c").alias("circular"))


def ranked_by(by: str, *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def bulge_choice(edges: DataFrame, most: int) -> DataFrame:
    """Of two edges between the same vertices with summed coverage of at most ``most`` the one to keep: higher coverage, then smaller label."""
    best = F.min_by("label", F.struct(-F.col("cov"), "label"))
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("cov").alias("total"), best.alias("keep"))
    return pairs.filter((F.col("n") == 2) & (F.col("total") <= most)).select("src", "dst", "keep", "total")


def peeled(edges: DataFrame) -> DataFrame:
    """(v, level) of an acyclic graph (src, dst): the longest way from a vertex without a way in. Raises on a cycle."""
    spark = edges.sparkSession
    steps, steps_path = materialise(edges.select("src", "dst").distinct(), "steps")
    n = steps.select(F.explode(F.array("src", "dst")).alias("v")).distinct().count()
    level, path = materialise(steps.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("level", F.lit(0).cast("long")), "levels")
    for _ in range(n + 1):
        pushed = level.join(steps, level.v == steps.src).groupBy(F.col("dst").alias("v")).agg((F.max("level") + 1).alias("to"))
        grown, new = materialise(level.join(pushed, "v", "left").select("v", F.greatest("level", F.coalesce("to", F.lit(0))).alias("level")), "levels")
        top, same = grown.join(level.withColumnRenamed("level", "old"), "v").agg(F.max("level"), F.bool_and(F.col("level") == F.col("old"))).first()
        remove(spark, path)
        level, path = grown, new
        if same or same is None:
            remove(spark, steps_path)
            return level
        if top >= n:
            break
    raise ValueError("the graph has a cycle")


def strong_components(edges: DataFrame) -> DataFrame:
    """(v, component): components within which every vertex reaches every other, named by their smallest vertex.

    Colours flow forward until every vertex has the largest one that reaches it; what goes back from a colour's own vertex within its colour is a
    component. Vertices without a way in or out are components of their own and go first."""
    spark = edges.sparkSession
    work, work_path = materialise(edges.select("src", "dst").filter("src <> dst").distinct(), "scc")
    left = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    out: list[DataFrame] = []
    while not work.isEmpty():
        inner = work.select(F.col("src").alias("v")).intersect(work.select(F.col("dst").alias("v")))
        shorter, new = materialise(work.join(inner, work.src == inner.v, "left_semi").join(inner, work.dst == inner.v, "left_semi"), "scc")
        trimmed = shorter.count() < work.count()
        remove(spark, work_path)
        work, work_path = shorter, new
        if trimmed:
            continue
        inner = work.select(F.col("src").alias("v")).distinct()  # nothing was trimmed: every source has a way in too
        colour, path = materialise(inner.withColumn("c", F.col("v")), "colour")
        while True:
            flow = colour.join(work, colour.v == work.src).groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("to"))
            grown, new = materialise(colour.join(flow, "v", "left").select("v", F.greatest("c", F.coalesce("to", "c")).alias("c"), (F.col("to") > F.col("c")).alias("moved")), "colour")
            remove(spark, path)
            colour, path = grown.drop("moved"), new
            if grown.filter("moved").isEmpty():
                break
        within = work.join(colour.select(F.col("v").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b").select("src", "dst", F.col("a").alias("c"))
        back, back_path = materialise(colour.filter("v = c"), "back")
        n = back.count()
        while True:
            grown, new = materialise(back.unionByName(back.join(within.drop("c"), back.v == within.dst).select(F.col("src").alias("v"), "c")).distinct(), "back")
            remove(spark, back_path)
            back, back_path, before, n = grown, new, n, grown.count()
            if n == before:
                break
        out.append(back)
        rest, new = materialise(work.join(back, work.src == back.v, "left_anti").join(back, work.dst == back.v, "left_anti"), "scc")
        remove(spark, work_path)
        work, work_path = rest, new
    found = None
    for part in out:
        found = part if found is None else found.unionByName(part)
    if found is None:
        return left.withColumn("component", F.col("v"))
    names = found.groupBy("c").agg(F.min("v").alias("component"))
    return left.join(found.join(names, "c").select("v", "component"), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def component_measures(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, n_vertices, n_edges, n_tips, n_junctions) of weak components (node, component)."""
    d = degrees(edges).join(parts.select(F.col("node").alias("v"), "component"), "v")
    by = d.groupBy("component").agg(F.count("*").alias("n_vertices"), F.sum("n_out").alias("n_edges"), F.count_if(F.col("n_in") + F.col("n_out") == 1).alias("n_tips"), F.count_if((F.col("n_in") != 1) | (F.col("n_out") != 1)).alias("n_junctions"))
    return by
