"""Sparse de Bruijn graphs: chosen k-mers are vertices, and what reads hold between two of them is an edge.

A vertex is a k-mer on either strand; vertices are given as canonical k-mers. Edges are (src, dst, label): the label spells both ends, and every
edge has its reverse complement. A dangling edge has no dst: its label begins at the vertex and goes on to the end of a read.
Reads without any vertex give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import canonical, reverse_complement
from strandloom.operators import coded
from strandloom.operators.graph import contract
from strandloom.operators.kmers import junctions, kmers
from strandloom.operators.shared import materialise, release

EDGE = ["src", "dst", "label"]


def vertex_places(reads: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, kmer): where a read holds a vertex, on either strand."""
    found = kmers(reads, k).withColumn("key", canonical(F.col("kmer")))
    return found.join(vertices.select(F.col("kmer").alias("key")).distinct(), "key", "left_semi").select("read_id", "pos", "kmer")


def _edges(reads: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """Edges of the reads' own strand, dangling ones included; ``head`` marks those that begin where the read does.

    Of three places in a row with the same vertex at the same distance under k (a period) the middle one begins no edge."""
    order = Window.partitionBy("read_id").orderBy("pos")
    at = vertex_places(reads, vertices, k)
    for name, by in (("before", F.lag), ("after", F.lead)):
        at = at.withColumn(name, by(F.struct("pos", "kmer")).over(order))
    step = F.col("after.pos") - F.col("pos")
    same = (F.col("before.kmer") == F.col("kmer")) & (F.col("after.kmer") == F.col("kmer"))
    period = same & (F.col("pos") - F.col("before.pos") == step) & (step < k)
    at = at.withColumn("period", F.coalesce(period, F.lit(False))).join(reads.select("read_id", "seq"), "read_id")
    inner = at.filter("after is not null and not period").select(F.col("kmer").alias("src"), F.col("after.kmer").alias("dst"), F.expr(f"substr(seq, pos + 1, after.pos - pos + {k})").alias("label"), F.lit(False).alias("head"))
    tails = at.filter(F.col("after").isNull() & (F.col("pos") + k < F.length("seq"))).select(F.col("kmer").alias("src"), F.lit(None).cast("string").alias("dst"), F.expr("substr(seq, pos + 1)").alias("label"), F.lit(False).alias("head"))
    heads = at.filter(F.col("before").isNull() & (F.col("pos") > 0)).select(reverse_complement(F.col("kmer")).alias("src"), F.lit(None).cast("string").alias("dst"), reverse_complement(F.expr(f"substr(seq, 1, pos + {k})")).alias("label"), F.lit(True).alias("head"))
    return inner.unionByName(tails).unionByName(heads)


def sparse_edges(reads: DataFrame, vertices: DataFrame, k: int, both: bool = True) -> DataFrame:
    """Distinct edges on both strands, or but for dangling ones the smaller, which is enough to cut them. Reads are (read_id, seq), one row for each id.

    Vertices of up to 13 symbols ACGT go to all tasks as a bitmap, which cut the reads where they lie; others are joined to all k-mers."""
    bits = coded.bitmap(vertices, k) if k <= coded.WIDEST else None
    if bits is not None:
        return coded.edges(coded.cut(reads, reads.sparkSession.sparkContext.broadcast(bits), k), k, both)
    found = joined_edges(reads, vertices, k)
    return found if both else found.filter(F.col("dst").isNull() | (F.col("label") <= reverse_complement(F.col("label"))))


def joined_edges(reads: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """``sparse_edges`` by joins, for vertices of any length and symbols."""
    found = _edges(reads, vertices, k)
    across = found.filter("dst is not null").select(reverse_complement(F.col("dst")).alias("src"), reverse_complement(F.col("src")).alias("dst"), reverse_complement(F.col("label")).alias("label"))
    return found.select(*EDGE).unionByName(across).distinct()


def resplit(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """Edges cut at all vertices within their labels."""
    if k <= coded.WIDEST:
        return sparse_edges(edges.select(F.col("label").alias("read_id"), F.col("label").alias("seq")), vertices, k)
    reads = edges.select(F.col("label").alias("read_id"), F.col("label").alias("seq")).distinct()
    return sparse_edges(reads, vertices, k)


def end_vertices(edges: DataFrame, k: int) -> DataFrame:
    """Canonical k-mers at the far ends of dangling edges."""
    return edges.filter("dst is null").select(canonical(F.right("label", F.lit(k))).alias("kmer")).distinct()


def tie_tips(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """The graph in which the ends of dangling edges are vertices too: no edge dangles any more."""
    both = vertices.select("kmer").unionByName(end_vertices(edges, k)).distinct()
    return resplit(edges, both, k)


def tied_edges(reads: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """``tie_tips`` of the reads' sparse edges. With vertices as a bitmap the reads themselves are cut again, those that hold a vertex: what
    their edges spell together."""
    spark = reads.sparkSession
    bits = coded.bitmap(vertices, k) if k <= coded.WIDEST else None
    if bits is None or coded.has_others(reads):
        edges, _ = materialise(sparse_edges(reads, vertices, k, False).select("dst", "label"), "labels")
        return tie_tips(edges, vertices, k)
    marks = spark.sparkContext.broadcast(bits)
    open_ones = coded.labels_of(coded.cut(reads, marks, k, "open"), k)
    both = bits | coded.bitmap(open_ones.select(F.right("label", F.lit(k)).alias("kmer")), k)
    return coded.edges(coded.cut(reads, spark.sparkContext.broadcast(both), k, "held", marks), k)


def without_prefixes(edges: DataFrame) -> DataFrame:
    """Of dangling edges, those that no other label of the same vertex begins with."""
    after = F.lead("label").over(Window.partitionBy("src").orderBy("label"))
    marked = edges.withColumn("longer", after)
    return marked.filter(F.col("dst").isNotNull() | ~F.coalesce(F.startswith("longer", F.col("label")), F.lit(False))).select(*EDGE)


def minimizer_vertices(reads: DataFrame, k: int, w: int) -> DataFrame:
    """Canonical k-mers of least hash among every w in a row; reads of under k + w - 1 symbols have none."""
    found = kmers(reads.filter(F.length("seq") >= k + w - 1), k).withColumn("kmer", canonical(F.col("kmer")))
    window = Window.partitionBy("read_id").orderBy("pos").rowsBetween(0, w - 1)
    least = found.select(F.min(F.struct(F.xxhash64("kmer").alias("h"), "kmer")).over(window).alias("m"), F.count("*").over(window).alias("n"))
    return least.filter(F.col("n") == w).select("m.kmer").distinct()


def _paths(reads: DataFrame, kept, loose, k: int) -> tuple[DataFrame, DataFrame]:
    """Unbranching paths, from reads cut at all vertices but the inner ones: labels as ``coded.cut`` has them, and, contracted, the edges
    (src, dst, label) at the inner vertices that are left, as reads begin or end there.

    Where no read begins or ends with an inner vertex, each read that enters it goes on, so some read holds the path from one kept vertex to the next."""
    spark = reads.sparkSession
    release(spark)
    bits, marks = (spark.sparkContext.broadcast(x) for x in (kept, loose))
    edges, _ = materialise(coded.edges(coded.cut(reads, bits, k, "loose", marks), k), "loose")
    whole = contract(edges.withColumn("cov", F.lit(0).cast("long")), inner=coded.strings_of(spark, marks, k))
    return coded.cut(reads, bits, k, "firm", marks), whole.select(*EDGE)


def disjointigs(reads: DataFrame, k: int, w: int, both: bool = True) -> DataFrame:
    """(read_id, seq): unbranching paths of the sparse graph of minimizers, on both strands or, of most, the smaller one: they spell what the reads
    spell, but places that many reads share only once. Reads of under k + w - 1 symbols take no part.

    k-mers of up to 13 symbols ACGT, at most 31 apart, are bitmaps, and paths are cut from the reads; others are joined."""
    long = reads.filter(F.length("seq") >= k + w - 1)
    bits = coded.minimizer_bits(long, k, w) if 2 <= k <= coded.WIDEST and w <= coded.SHORT else None
    if bits is None:
        paths = _joined_disjointigs(long, k, w)
    else:
        share = reads.sparkSession.sparkContext.broadcast
        own = share(bits)
        dangling, _ = materialise(coded.edges(coded.cut(long, own, k, "open"), k), "dangling")
        beside = coded.cut(long, own, k, "loose", share(coded.bitmap(dangling.select(F.col("src").alias("kmer")), k)))
        longest = without_prefixes(dangling.unionByName(coded.edges(beside, k).join(dangling.select("src"), "src", "left_semi")))
        tied = bits | coded.bitmap(end_vertices(longest, k), k)
        firm, loose = _paths(long, *coded.without_inner(tied, *coded.ways(long, share(tied), k), k), k)
        paths = coded.labels_of(firm, k, both).unionByName(loose.select("label")).select(F.col("label").alias("seq"))
    return paths.select(F.col("seq").alias("read_id"), "seq")


def _joined_disjointigs(long: DataFrame, k: int, w: int) -> DataFrame:
    vertices, _ = materialise(minimizer_vertices(long, k, w), "minimizers")
    edges, _ = materialise(without_prefixes(sparse_edges(long, vertices, k)), "sparse")
    tied, _ = materialise(tie_tips(edges, vertices, k), "tied")
    paths, _ = materialise(contract(tied.withColumn("cov", F.lit(0).cast("long"))).select(F.col("label").alias("seq")), "disjointigs")
    return paths


def compacted(reads: DataFrame, k: int, w: int, both: bool = True) -> DataFrame:
    """(src, dst, label): the de Bruijn graph of reads on both strands, its unbranching paths as edges, on both strands or, of most, the smaller one:
    what contraction of all (k + 1)-mers gives, but that nothing is contracted symbol by symbol. Reads of under k + w - 1 symbols take no part.

    Junctions and ends are vertices first; ends that turn out to lie within a path go. For k of up to 13 and ACGT they are those of the reads,
    in bitmaps; else those of the disjointigs."""
    long = reads.filter(F.length("seq") >= k + w - 1)
    found = coded.branches(long, k) if 2 <= k <= coded.WIDEST else None
    if found is not None:
        firm, loose = _paths(long, *found, k)
        return coded.edges(firm, k, both).unionByName(loose)
    paths = disjointigs(reads, k, w)
    ends = paths.select(F.explode(F.array(F.left("seq", F.lit(k)), F.right("seq", F.lit(k)))).alias("kmer")).select(canonical(F.col("kmer")).alias("kmer"))
    vertices, _ = materialise(junctions(paths, k).unionByName(ends).distinct(), "junctions")
    edges, _ = materialise(sparse_edges(paths, vertices, k), "between")
    return contract(edges.withColumn("cov", F.lit(0).cast("long"))).select(*EDGE)


def graph_of(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, label) of edge sequences on both strands: their first and last k symbols are the vertices."""
    seq = edges.select("seq").unionByName(edges.select(reverse_complement(F.col("seq")).alias("seq"))).filter(F.length("seq") >= k).distinct()
    return seq.select(F.left("seq", F.lit(k)).alias("src"), F.right("seq", F.lit(k)).alias("dst"), F.col("seq").alias("label"))


def split_at(edges: DataFrame, breaks: DataFrame, k: int) -> DataFrame:
    """(edge_id, i, seq): edges cut at break positions (edge_id, pos): neighbours share the k symbols from there on. Breaks that leave
    no symbol on either side are ignored."""
    inside = breaks.join(edges.select("edge_id", F.length("seq").alias("n")), "edge_id").filter((F.col("pos") > 0) & (F.col("pos") + k < F.col("n"))).select("edge_id", F.col("pos").cast("long").alias("pos")).distinct()
    cuts = inside.groupBy("edge_id").agg(F.sort_array(F.collect_list("pos")).alias("cuts"))
    whole = edges.join(cuts, "edge_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    starts = F.concat(F.array(F.lit(0).cast("long")), "cuts")
    ends = F.concat(F.transform("cuts", lambda x: x + k), F.array(F.length("seq").cast("long")))
    rows = whole.select("edge_id", "seq", F.posexplode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("i", "r"))
    return rows.select("edge_id", F.col("i").cast("long").alias("i"), F.expr("substr(seq, cast(r.a as int) + 1, cast(r.b - r.a as int))").alias("seq"))


def covered_pieces(edges: DataFrame, merged: DataFrame, over: int) -> DataFrame:
    """(edge_id, lo, hi): of edges (edge_id, size, cov, joint) their covered ranges; all of an edge with a coverage over 2 that is longer
    than ``over`` (2 k + 5,000 in graphs of k-mers), or that lies at a vertex which is no junction."""
    kept = edges.filter((F.col("cov") > 2) & (F.col("size") > over) | ~F.col("joint"))
    rest = edges.join(kept.select("edge_id"), "edge_id", "left_anti")
    whole = kept.select("edge_id", F.lit(0).cast("long").alias("lo"), F.col("size").cast("long").alias("hi"))
    return whole.unionByName(merged.join(rest.select("edge_id"), "edge_id", "left_semi").select("edge_id", "lo", "hi"))
