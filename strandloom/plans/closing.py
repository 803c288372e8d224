"""Registered queries on uniqueness of edges, loops, polishing and gap closing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import alignment as D
from strandloom.functions import repeats as Z
from strandloom.functions import sequences as S
from strandloom.operators import flow as W
from strandloom.operators import gaps as Q
from strandloom.operators import graph as G
from strandloom.operators import iterative as N
from strandloom.operators import kmers as K
from strandloom.operators import paths as P
from strandloom.operators import polishing as O
from strandloom.operators import uniqueness as U
from strandloom.plans.registry import CONTIGS, SEQS, contigs, event_strings, pairs, query, seqs, table


def ladders(spark, sf) -> DataFrame:
    """Chains of six vertices for each ten customers, with one or two edges between neighbours."""
    key, nation = F.col("c_custkey").cast("long"), F.col("c_nationkey")
    block, step = F.floor(key / 10), F.floor(key % 10 / 2)
    rows = table(spark, sf, "customer").filter((key % 2 == 0) | (nation % 2 == 0))
    size = 1000 + F.pmod(F.floor("c_acctbal").cast("long"), F.lit(500))
    return rows.select(key.alias("edge_id"), (block * 10 + step).alias("src"), (block * 10 + step + 1).alias("dst"), size.alias("size"), (nation % 7).cast("long").alias("cov"))


LADDERS = """(SELECT CAST(c_custkey AS BIGINT) AS edge_id, CAST(c_custkey // 10 * 10 + c_custkey % 10 // 2 AS BIGINT) AS src, CAST(c_custkey // 10 * 10 + c_custkey % 10 // 2 + 1 AS BIGINT) AS dst,
    1000 + (CAST(floor(c_acctbal) AS BIGINT) % 500 + 500) % 500 AS size FROM customer WHERE c_custkey % 2 = 0 OR c_nationkey % 2 = 0)"""


def rings(spark, sf) -> DataFrame:
    """For each four customers a way in, an edge there, an edge back and a way out."""
    key, nation = F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long")
    part, base = key % 4, F.floor(key / 4) * 4
    rows = table(spark, sf, "customer")
    src = base + F.when(part == 0, 0).when(part == 2, 2).otherwise(part - F.when(part == 1, 0).otherwise(1))
    dst = base + F.when(part == 0, 1).when(part == 1, 2).when(part == 2, 1).otherwise(3)
    cov = F.when(part == 1, 60 + nation).when(part == 2, 40 + nation).otherwise(25 + nation % 8)
    return rows.select(key.alias("edge_id"), src.alias("src"), dst.alias("dst"), (5000 + key % 100 * 200).alias("size"), cov.alias("cov"), (20 + nation % 9).alias("cnt"), part.isin(0, 3).alias("unique"))


RINGS = """(SELECT CAST(c_custkey AS BIGINT) AS edge_id, CAST(c_custkey // 4 * 4 + CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS src, CAST(c_custkey // 4 * 4 + CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS BIGINT) AS dst,
    CAST(5000 + c_custkey % 100 * 200 AS BIGINT) AS size, CAST(CASE c_custkey % 4 WHEN 1 THEN 60 + c_nationkey WHEN 2 THEN 40 + c_nationkey ELSE 25 + c_nationkey % 8 END AS BIGINT) AS cov, CAST(20 + c_nationkey % 9 AS BIGINT) AS cnt, c_custkey % 4 IN (0, 3) AS uniq FROM customer)"""
_SUPPORT = "CASE WHEN size < 20000 THEN CAST(least(cnt, cov) AS DOUBLE) ELSE CAST(cnt AS DOUBLE) END"


_SIMPLE = "GROUP BY {0} HAVING count(*) = 1 AND (max(n) = 1 OR (max(n) = 2 AND max(hi) < min(lo) * 1.3e0))"


@query(f"""WITH RECURSIVE b AS MATERIALIZED (SELECT src, dst, count(*) AS n, min(size) AS lo, max(size) AS hi FROM {LADDERS} GROUP BY src, dst),
    inner_ AS MATERIALIZED (SELECT src AS v FROM b {_SIMPLE.format('src')} INTERSECT SELECT dst FROM b {_SIMPLE.format('dst')}),
    lin AS (SELECT src, dst, 1 AS n, hi AS total FROM b WHERE src NOT IN (SELECT v FROM inner_) UNION ALL SELECT l.src, b.dst, l.n + 1, l.total + b.hi FROM lin l JOIN b ON b.src = l.dst WHERE l.dst IN (SELECT v FROM inner_))
    SELECT src, dst, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM lin WHERE dst NOT IN (SELECT v FROM inner_) AND n > 1""")
def h16_bulge_paths(spark, sf):
    return U.bulge_paths(ladders(spark, sf))


@query(None)
def l17_unique_edges(spark, sf):
    return U.unique_edges(ladders(spark, sf), 1200, 3000)


@query(f"""WITH e AS (SELECT src // 4 AS component, {_SUPPORT} AS x FROM {RINGS} WHERE uniq), m AS (SELECT component, min(x) AS low, max(x) AS high FROM e GROUP BY component)
    SELECT component, low, high, greatest(low * 1.4e0, high * 1.2e0) AS one, low * 2.4e0 AS two, least(low * 0.9e0, high * 0.7e0) AS real FROM m""")
def i17_coverage_range(spark, sf):
    return U.coverage_range(rings(spark, sf).withColumn("component", F.floor(F.col("src") / 4)))


@query(f"""WITH e AS (SELECT *, {_SUPPORT} AS x FROM {RINGS}), i AS (SELECT dst AS v, count(*) AS n FROM e GROUP BY dst), o AS (SELECT src AS v, count(*) AS n FROM e GROUP BY src),
    f AS (SELECT e.* FROM e JOIN i a ON a.v = src JOIN o b ON b.v = src JOIN i c ON c.v = dst JOIN o d ON d.v = dst WHERE NOT uniq AND a.n = 2 AND b.n = 1 AND c.n = 1 AND d.n = 2 AND size <= 30000),
    l AS (SELECT f.edge_id AS forward, r.edge_id AS back, x.edge_id AS into_, y.edge_id AS out, f.cov AS fc, r.cov AS rc, least(x.x, y.x) AS low, greatest(x.x, y.x) AS high
        FROM f JOIN e r ON r.src = f.dst AND r.dst = f.src AND NOT r.uniq AND r.size <= 50000 JOIN e x ON x.dst = f.src AND x.uniq AND x.src NOT IN (f.src, f.dst) JOIN e y ON y.src = f.dst AND y.uniq AND y.dst NOT IN (f.src, f.dst)),
    m AS (SELECT *, (low + high) / 2 AS med FROM l), v AS (SELECT *, CAST(floor(fc / med + 0.5) AS BIGINT) AS vote, CAST(floor(rc / med + 0.5) AS BIGINT) AS times FROM m)
    SELECT forward, back, into_ AS "into", out, times, into_ || ',' || forward || repeat(',' || back || ',' || forward, times) || ',' || out AS path FROM v WHERE vote = times + 1 AND vote * (greatest(4.0, high - low) / med / 2) * 2 <= med""")
def l24_loop_votes(spark, sf):
    return U.loop_votes(rings(spark, sf)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(None)
def l19_multiplicities_by_coverage(spark, sf):
    edges = rings(spark, sf)
    vertex = F.floor(F.col("src") / 4)
    # what lies outside of the pair of a ring is one vertex, named null
    outer = lambda c, part: F.when(F.col(c) % 4 == part, F.lit(None)).otherwise(F.col(c))
    return W.multiplicities_by_coverage(edges.select(vertex.alias("component"), F.col("edge_id").alias("edge"), outer("src", 0).alias("src"), outer("dst", 3).alias("dst"), "size", "cov", "cnt", "unique"))


def _RUNS(source: str, name: str) -> str:
    return f"(SELECT {name}, runs, array_to_string(list_transform(runs, lambda x: left(x, 1)), '') AS seq FROM (SELECT read_id AS {name}, regexp_extract_all(seq, 'A+|C+|G+|T+') AS runs FROM {source}))"


@query(f"""WITH r AS MATERIALIZED {_RUNS(SEQS, 'read_id')}, c AS MATERIALIZED {_RUNS(CONTIGS, 'contig')},
    h AS (SELECT contig, runs[instr(r.seq, c.seq) : instr(r.seq, c.seq) + length(c.seq) - 1] AS part FROM (SELECT read_id, seq, runs FROM r) r JOIN (SELECT contig, seq FROM c WHERE seq <> '') c ON instr(r.seq, c.seq) > 0),
    v AS (SELECT contig, pos, length(part[pos + 1]) AS run_len FROM (SELECT *, unnest(range(0, len(part))) AS pos FROM h)), m AS (SELECT contig, pos, quantile_disc(run_len, 0.5) AS n FROM v GROUP BY ALL)
    SELECT contig, string_agg(repeat(symbol, coalesce(n, 1)), '' ORDER BY pos) AS seq FROM (SELECT contig, substr(seq, pos + 1, 1) AS symbol, pos FROM (SELECT contig, seq, unnest(range(0, length(seq))) AS pos FROM c)) LEFT JOIN m USING (contig, pos) GROUP BY contig""")
def m9_polished(spark, sf):
    """Compressed items of the benchmark, each run as long as documents that hold the item have it."""
    reads = seqs(spark, sf)
    short = contigs(spark, sf).select(F.col("read_id").alias("contig"), S.compress_runs(F.col("seq")).alias("seq"))
    at = K.whole_places(reads.withColumn("seq", S.compress_runs(F.col("seq"))), short)
    placed = at.join(short, "contig").select("read_id", "contig", F.col("pos").cast("int").alias("read_from"), F.lit(0).alias("contig_from"), F.concat(F.length("seq").cast("string"), F.lit("=")).alias("cigar"))
    return O.polished(short, O.run_votes(reads, placed))


@query(None)
def l16_gap_patches(spark, sf):
    """Bridges between the two strands' ends of each item of the benchmark, which is cut so that a fifth of it is on both sides."""
    n = F.length("seq")
    cut = (n * 3 / 5).cast("int")
    both = F.array(F.left("seq", cut), S.reverse_complement(F.right("seq", cut)))
    parts = contigs(spark, sf).select("read_id", F.posexplode(both).alias("side", "label"))
    name = F.concat_ws("-", "read_id", "side")
    edges = parts.select(name.alias("edge_id"), F.concat(F.lit("from "), name).alias("src"), F.concat(F.lit("to "), name).alias("dst"), "label", F.lit(3).alias("cov"))
    return Q.patches(Q.dead_ends(edges, 40), k=12, least=20, most=1000)


@query(None)
def h13_contigs(spark, sf):
    return U.extended_contigs(G.edges_of(contigs(spark, sf), 12))


@query(None)
def l5_reliable_extensions(spark, sf):
    edges = P.identified(G.contract(G.edges_of(contigs(spark, sf), 12)))
    starts = edges.select(F.col("src").alias("key"), F.col("src").alias("v")).distinct()
    return U.reliable_extensions(edges, starts, 30, 1).select("key", "seq")


@query(None)
def g20_both_strands(spark, sf):
    """First vertex and edge symbols of each item's path, on either strand."""
    reads = contigs(spark, sf)
    across = reads.select(F.concat(F.lit("-"), F.col("read_id").cast("string")).alias("read_id"), S.reverse_complement(F.col("seq")).alias("seq"))
    both = reads.select(F.col("read_id").cast("string").alias("read_id"), "seq").unionByName(across)
    edges = P.identified(G.contract(G.edges_of(both, 12)))
    return P.compact(P.align(both, edges, 12), edges).select("read_id", "src", "symbols")


@query(None)
def d20_overlap_scores(spark, sf):
    found = pairs(spark, sf).select("a", "b", D.best_overlap(F.col("s"), F.col("t")).alias("o"))
    return found.select("a", "b", "o.score", "o.used_a", "o.used_b")


@query(None)
def d21_cigars(spark, sf):
    return pairs(spark, sf).select("a", "b", D.cigar_of(F.col("s"), F.col("t")).alias("cigar"))


_STATES = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]])


@query(None)
def d32_states(spark, sf):
    """Hidden states of each item of the benchmark, two states over four symbols."""
    codes = F.transform(S.symbols(F.col("seq")), lambda x: F.instr(F.lit("ACGT"), x) - 1)
    return contigs(spark, sf).select("read_id", F.array_join(D.decoded(codes, *_STATES).cast("array<string>"), "").alias("states"))


@query(None)
def e14_dimer_repeats(spark, sf):
    found = seqs(spark, sf).select("read_id", F.explode(Z.dimers(S.compress_runs(F.col("seq")), 3)).alias("d"))
    return found.select("read_id", "d.start", "d.times", "d.dimer")


@query(None)
def e16_dimer_around(spark, sf):
    """How often dimers alternate around the middle of each user's events."""
    return event_strings(spark, sf).select("read_id", Z.dimer_multiplicity(F.col("seq"), F.floor(F.length("seq") / 2)).alias("n"))


@query(None)
def f12_iterative_graph(spark, sf):
    """The last one of three graphs of the benchmark's 8- to 10-mers that occur twice."""
    *_, (_, edges) = N.iterative_graphs(contigs(spark, sf), 8, 10, lambda k: 2)
    return edges
