"""Alignment of sequences to a contracted graph, paths, and what is counted along them.

Edges are (edge_id, src, dst, label, cov) with labels that begin with the source vertex; every k-mer of the graph is
in one label at one place, so alignment is a join on k-mers and needs no walking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import reverse_complement
from strandloom.operators.kmers import kmers


def identified(edges: DataFrame) -> DataFrame:
    """Edges with an id that depends on the label alone."""
    return edges.withColumn("edge_id", F.sha1("label"))


def places(edges: DataFrame, k: int) -> DataFrame:
    """(kmer, edge_id, at) of all labels."""
    return kmers(edges.select(F.col("edge_id").alias("read_id"), F.col("label").alias("seq")), k).select("kmer", F.col("read_id").alias("edge_id"), F.col("pos").alias("at"))


def align(reads: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(read_id, i, edge_id, left, right): a read's maximal runs along edges in order, as ranges of k-mers of the label.
    K-mers that are in no edge interrupt the path; i counts runs."""
    found = kmers(reads, k).join(places(edges, k), "kmer", "left")
    order = Window.partitionBy("read_id").orderBy("pos")
    goes_on = (F.col("edge_id") == F.lag("edge_id").over(order)) & (F.col("at") == F.lag("at").over(order) + 1)
    runs = found.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("edge_id is not null")
    steps = runs.groupBy("read_id", "run", "edge_id").agg(F.min("at").alias("left"), (F.max("at") + 1).alias("right"), F.min("pos").alias("pos"))
    return steps.withColumn("i", F.row_number().over(order) - 1).select("read_id", "i", "edge_id", "left", "right", "pos")


def spell(steps: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(read_id, seq) of paths without interruptions: the first range's symbols, then each k-mer's last one."""
    parts = steps.join(edges.select("edge_id", "label"), "edge_id").groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("i", "label", "left", "right"))).alias("p"))
    first = F.expr(f"substr(p[0].label, p[0].left + 1, p[0].right - p[0].left + {k - 1})")
    rest = F.expr(f"transform(slice(p, 2, size(p)), x -> substr(x.label, x.left + {k}, x.right - x.left))")
    return parts.select("read_id", F.concat(first, F.array_join(rest, "")).alias("seq"))


def coverage(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, bases, mean): k-mers that paths put on each edge, and per k-mer of it."""
    added = steps.groupBy("edge_id").agg(F.sum(F.col("right") - F.col("left")).alias("bases"))
    size = F.length("label") - F.length("src")
    return edges.join(added, "edge_id", "left").select("edge_id", F.coalesce("bases", F.lit(0)).alias("bases"), (F.coalesce("bases", F.lit(0)) / size).alias("mean"))


def strand_coverage(reads: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(label, bases, mean): reads of either strand count on the edge and, as their reverse complements, on the edge across."""
    across = reads.select(F.concat(F.lit("-"), F.col("read_id").cast("string")).alias("read_id"), reverse_complement(F.col("seq")).alias("seq"))
    both = reads.select(F.concat(F.lit("+"), F.col("read_id").cast("string")).alias("read_id"), "seq").unionByName(across)
    return coverage(align(both, edges, k), edges).join(edges.select("edge_id", "label"), "edge_id").select("label", "bases", "mean")


def compact(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(read_id, src, symbols, left, right): the path as its first vertex, the first symbol of each edge beyond its vertex, and what is cut off at both ends."""
    labelled = steps.join(edges.select("edge_id", "src", F.expr("substr(label, length(src) + 1, 1)").alias("symbol"), (F.length("label") - F.length("src")).alias("size")), "edge_id")
    parts = labelled.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("i", "src", "symbol", "left", "right", "size"))).alias("p"))
    last = F.element_at("p", -1)
    return parts.select("read_id", F.col("p")[0]["src"].alias("src"), F.array_join(F.transform("p", lambda x: x["symbol"]), "").alias("symbols"), F.col("p")[0]["left"].alias("left"), (last["size"] - last["right"]).alias("right"))


def extensions(paths: DataFrame, most: int) -> DataFrame:
    """(src_edge, symbols, cnt): from every step of compact paths, what follows, up to ``most`` symbols."""
    at = F.explode(F.sequence(F.lit(1), F.length("symbols")))
    return paths.filter("symbols <> ''").withColumn("at", at).select(F.expr(f"substr(symbols, at, {most})").alias("symbols")).groupBy("symbols").agg(F.count("*").alias("cnt"))


def starting_with(extensions_: DataFrame, prefix: str) -> DataFrame:
    return extensions_.filter(F.startswith("symbols", F.lit(prefix))).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"))


def unique_extension(extensions_: DataFrame, good: int, bad: int) -> DataFrame:
    """(prefix, next): contexts of which exactly one next symbol has ``good`` or more occurrences and all others at most ``bad``."""
    split = extensions_.filter(F.length("symbols") > 1).select(F.expr("left(symbols, length(symbols) - 1)").alias("prefix"), F.right("symbols", F.lit(1)).alias("next"), "cnt")
    by = split.groupBy("prefix", "next").agg(F.sum("cnt").alias("cnt"))
    found = by.groupBy("prefix").agg(F.count_if(F.col("cnt") >= good).alias("strong"), F.count_if((F.col("cnt") < good) & (F.col("cnt") > bad)).alias("between"), F.max_by("next", "cnt").alias("next"))
    return found.filter("strong = 1 and between = 0").select("prefix", "next")


def adjacent(steps: DataFrame) -> DataFrame:
    """(edge, next_edge, cnt): pairs of edges that follow each other in paths."""
    order = Window.partitionBy("read_id").orderBy("i")
    pairs = steps.withColumn("next_edge", F.lead("edge_id").over(order)).filter("next_edge is not null")
    return pairs.groupBy(F.col("edge_id").alias("edge"), "next_edge").agg(F.count("*").alias("cnt"))


def valid_reads(reads: DataFrame, steps: DataFrame, bad_edges: DataFrame) -> DataFrame:
    """Reads whose paths touch none of the bad edges."""
    return reads.join(steps.join(bad_edges.select("edge_id"), "edge_id", "left_semi").select("read_id"), "read_id", "left_anti")


def maximal_matches(reads: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """(read_id, contig, pos, cpos, len): exact matches of k symbols or more that neither end can extend: runs of shared
    k-mers on a diagonal."""
    index = kmers(contigs, k).select("kmer", F.col("read_id").alias("contig"), F.col("pos").alias("cpos"))
    hits = kmers(reads, k).join(index, "kmer").select("read_id", "contig", F.col("pos").cast("long").alias("pos"), (F.col("pos") - F.col("cpos")).cast("long").alias("d"))
    order = Window.partitionBy("read_id", "contig", "d").orderBy("pos")
    islands = hits.withColumn("island", F.col("pos") - F.row_number().over(order))
    return islands.groupBy("read_id", "contig", "d", "island").agg(F.min("pos").alias("pos"), (F.count("*") + (k - 1)).alias("len")).select("read_id", "contig", "pos", (F.col("pos") - F.col("d")).alias("cpos"), "len")


def found_in(strings: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(read_id, contig, pos): every place of references (read_id, seq) that holds a string (its read_id as contig) of k symbols or more."""
    seeds = strings.select(F.col("read_id").alias("contig"), F.col("seq").alias("s"), F.left("seq", F.lit(k)).alias("kmer")).filter(F.length("s") >= k)
    hits = kmers(references, k).join(seeds, "kmer")
    longer = hits.filter(F.length("s") > k).join(references, "read_id").filter("substr(seq, pos + 1, length(s)) = s").select("read_id", "contig", F.col("pos").cast("long").alias("pos"))
    return hits.filter(F.length("s") == k).select("read_id", "contig", F.col("pos").cast("long").alias("pos")).unionByName(longer)


def wildcard_hits(patterns: DataFrame, references: DataFrame) -> DataFrame:
    """(read_id, contig, pos): every place at which a pattern (read_id, seq), whose ? stand for any symbol, lies within a reference.

    The longest part without ? is looked up as a k-mer, and the rest is compared at its hits. Patterns of ? only are left out."""
    parts = F.transform(F.split("seq", r"\?"), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    best = patterns.withColumn("best", F.array_max(parts)).filter("best.n > 0")
    before = F.expr("length(array_join(slice(split(seq, '\\\\?'), 1, -best.i), '?')) + if(best.i < 0, 1, 0)")
    asked = best.select(F.col("read_id").alias("contig"), F.col("seq").alias("p"), F.col("best.x").alias("kmer"), F.col("best.n").alias("n"), before.cast("int").alias("off"))
    out = None
    for (n,) in asked.select("n").distinct().collect():  # lengths of parts: few
        own = asked.filter(F.col("n") == n)
        hits = kmers(references, n).join(own, "kmer").select("read_id", "contig", "p", (F.col("pos") - F.col("off")).alias("pos"))
        both = hits.join(references, "read_id").withColumn("w", F.expr("substr(seq, cast(pos as int) + 1, length(p))"))
        fits = ~F.exists(F.zip_with(F.split("w", ""), F.split("p", ""), lambda x, y: (x != y) & (y != "?")), lambda x: x)
        found = both.filter("pos >= 0 and length(w) = length(p)").filter(fits).select("read_id", "contig", F.col("pos").cast("long").alias("pos"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = references.limit(0).select("read_id", F.col("read_id").alias("contig"), F.lit(0).cast("long").alias("pos"))
    return out


def supported_ways(reads: DataFrame, k: int, most: int, support: int) -> DataFrame:
    """(src, dst, symbols, support): ways of up to ``most`` symbols between vertices of k - 1 symbols that reads take often enough."""
    at = reads.filter(F.length("seq") >= k).withColumn("i", F.explode(F.expr(f"sequence(0, length(seq) - {k})"))).withColumn("n", F.explode(F.expr(f"sequence(1, least({most}, length(seq) - i - {k - 1}))")))
    path = at.select(F.expr(f"substr(seq, i + 1, n + {k - 1})").alias("path"))
    ways = path.groupBy("path").agg(F.count("*").alias("support")).filter(F.col("support") >= support)
    return ways.select(F.expr(f"left(path, {k - 1})").alias("src"), F.expr(f"right(path, {k - 1})").alias("dst"), F.expr(f"substr(path, {k})").alias("symbols"), "support")


def reversed_path(edges):
    """A path on the other strand: edges in reverse, each with its sign changed."""
    from strandloom.functions.sequences import toggle_strand

    return F.transform(F.reverse(edges), toggle_strand)


def cut_back(edges, first: int, last: int):
    """A path without some edges at its beginning and end."""
    return F.slice(edges, first + 1, F.greatest(F.size(edges) - (first + last), F.lit(0)))


def walked(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(read_id, i, edge_id) of compact paths (read_id, src, symbols): at each vertex the edge whose label goes on with the
    next symbol. One join for each symbol of the longest path; a path ends where no edge goes on."""
    from strandloom.operators.shared import materialise

    steps = edges.select(F.col("src").alias("v"), F.expr("substr(label, length(src) + 1, 1)").alias("c"), "dst", "edge_id")
    live, i, out = paths.select("read_id", F.col("src").alias("v"), "symbols").filter("symbols <> ''"), 0, None
    while True:
        at = live.withColumn("c", F.expr("left(symbols, 1)")).join(steps, ["v", "c"])
        at, _ = materialise(at, "walk")
        if out is not None and at.isEmpty():
            return out
        found = at.select("read_id", F.lit(i).alias("i"), "edge_id")
        out = found if out is None else out.unionByName(found)
        live, i = at.select("read_id", F.col("dst").alias("v"), F.expr("substr(symbols, 2)").alias("symbols")).filter("symbols <> ''"), i + 1


def good_or_partial(placements: DataFrame, slack: int) -> DataFrame:
    """Placements (lo, hi, len) with kind: good if they span the read but for ``slack`` symbols, else partial."""
    return placements.withColumn("kind", F.when(F.col("hi") - F.col("lo") + slack >= F.col("len"), "good").otherwise("partial"))


def graph_kmers(edges: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt): the k-mers that a graph's labels spell, with how often reads hold them."""
    own = places(edges, k).select("kmer").distinct()
    return kmers(reads, k).join(own, "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("cnt"))
