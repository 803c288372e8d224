"""De Bruijn graphs over growing k: what one graph says helps to build the next one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import graph as G
from strandloom.operators import kmers as K
from strandloom.operators.shared import materialise
from strandloom.operators.uniqueness import extended_contigs


def crossing(edges: DataFrame, counts: DataFrame, least: int = 4) -> DataFrame:
    """(kmer, cnt): k-mers one symbol longer than labels that lead through a vertex with several ways in and out, if they occur ``least`` times."""
    ways = G.through(edges, G.complex_vertices(edges))
    return counts.filter(F.col("cnt") >= least).join(ways.select(F.expr("left_label || right(right_label, 1)").alias("kmer")).distinct(), "kmer", "left_semi")


def iterative_graphs(reads: DataFrame, shortest: int, longest: int, least: Callable[[int], int], crossings: int = 4) -> Iterator[tuple[int, DataFrame]]:
    """(k, edges) for each k: edges (src, dst, label, cov) of single k-mers, without rarely seen tips.

    k-mers are those of the reads that are frequent, given ``least(k)``; those of the contigs of the graph before, with their number there; and those through its complex vertices that
    occur ``crossings`` times in the reads."""
    more = ways = None
    for k in range(shortest, longest + 1):
        found = K.frequent(reads, k, least(k))
        if more is not None:
            found = found.unionByName(more.join(found, "kmer", "left_anti"))
            found = found.join(ways, "kmer", "left_anti").unionByName(ways)
        labels = found.select(F.expr(f"left(kmer, {k - 1})").alias("src"), F.expr(f"right(kmer, {k - 1})").alias("dst"), F.col("kmer").alias("label"), F.col("cnt").alias("cov"))
        edges = G.tip_free(labels, least(k))
        yield k, edges
        if k < longest:
            contigs = extended_contigs(edges).select(F.sha1("seq").alias("read_id"), "seq")
            more, _ = materialise(K.spectrum(contigs, k + 1), "contig_kmers")
            ways, _ = materialise(crossing(edges, K.spectrum(reads, k + 1), crossings), "crossing")
