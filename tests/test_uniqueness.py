"""Uniqueness of edges, loops, polishing and short contigs against plain versions."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import alignment as D
from strandloom.operators import flow, polishing
from strandloom.operators import graph as G
from strandloom.operators import iterative as N
from strandloom.operators import kmers as K
from strandloom.operators import uniqueness as U

EDGE = "edge_id int, src string, dst string, size long, cov long"
FULL = EDGE + ", cnt long, unique boolean"


def test_unique_edges(spark):
    rows = [
        # a - b = c - d with a large bulge: both sides are unique, of the single edges that at a dead end that is long and covered enough
        (1, "a", "b", 400, 9), (2, "b", "c", 300, 5), (3, "b", "c", 310, 5), (4, "c", "d", 500, 3),
        # p - q = r - s with small bulges only: single edges of over twice the bound are
        (5, "p", "q", 2500, 9), (6, "q", "r", 50, 5), (7, "q", "r", 55, 5), (8, "r", "s", 300, 9),
        # too different to be a bulge, nothing unique but what is long
        (9, "x", "y", 100, 5), (10, "x", "y", 200, 5), (11, "y", "z", 1200, 1), (12, "y", "w", 100, 9), (13, "y", "u", 400, 9), (14, "y", "t", 400, 3),
    ]
    df = spark.createDataFrame(rows, EDGE)
    assert {r["edge_id"] for r in U.unique_edges(df, k=100, least=1000).collect()} == {1, 2, 3, 5, 11, 13}
    paths = sorted(tuple(r) for r in U.bulge_paths(df).collect())
    assert paths == [("a", "d", 3, 1210), ("p", "s", 3, 2855)]
    assert U.unique_edges(df.limit(0), 100, 1000).count() == 0


def test_coverage_range(spark):
    rows = [(1, "a", "b", 100, 10, 12, True), (1, "b", "c", 30000, 5, 40, True), (1, "c", "d", 100, 1, 1, False)]
    got = [tuple(r) for r in U.coverage_range(spark.createDataFrame(rows, "component int, src string, dst string, size long, cov long, cnt long, unique boolean")).collect()]
    assert got == [(1, 10.0, 40.0, 48.0, 24.0, 9.0)]


def test_loop_votes(spark):
    def loop(name, base, forward, back):
        return [(base, f"{name}x", f"{name}u", 100, 20, 30, True), (base + 1, f"{name}u", f"{name}v", 100, forward, 0, False), (base + 2, f"{name}v", f"{name}u", 100, back, 0, False), (base + 3, f"{name}v", f"{name}y", 100, 22, 30, True)]

    rows = loop("a", 10, 63, 42) + loop("b", 20, 63, 63) + loop("c", 30, 41, 21) + [(40, "cq", "cu", 100, 20, 30, True)]  # votes that disagree; three ways in
    df = spark.createDataFrame(rows, FULL)
    assert [tuple(r) for r in U.loop_votes(df).collect()] == [(11, 12, 10, 13, 2, [10, 11, 12, 11, 12, 11, 13])]
    assert U.loop_votes(df, spark.createDataFrame([(10, 13)], "into int, out int")).count() == 0
    assert U.loop_votes(df.limit(0)).count() == 0


def brute_fixed(edges):
    """Multiplicity of each edge where all circulations of at most three agree."""
    ranges = [range(low, min(high, 3) + 1) for _, _, low, high in edges]
    found = []
    for values in itertools.product(*ranges):
        net = {}
        for (u, v, _, _), x in zip(edges, values, strict=True):
            net[u], net[v] = net.get(u, 0) - x, net.get(v, 0) + x
        if not any(net.values()):
            found.append(values)
    return [c[0] if len(set(c)) == 1 else None for c in zip(*found, strict=True)] if found else None


def test_multiplicities_by_coverage(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(12):
        u = [20 + rng.randrange(4) for _ in range(2)]
        covs = [rng.choice([5, 20, 45, 90]) for _ in range(4)]
        parts = [(None, "s", u[0], True), ("s", "m", covs[0], False), ("s", "m", covs[1], False), ("m", "t", covs[2], False), ("m", "s", covs[3], False), ("t", None, u[1], True)]
        for i, (a, b, cov, unique) in enumerate(parts):
            rows.append((c, c * 10 + i, a, b, 100, cov, cov, unique))
        least = largest = u[0]

        def bounds(real, two, parts=parts, one=max(1.4 * least, 1.2 * largest)):
            return [(a, b, int(x or v >= real), 1 if x or v < one else 2 if v < two else 9) for a, b, v, x in parts]

        real, values = 0.0, brute_fixed(bounds(0.0, 0))
        if values is None:
            real = min(0.9 * least, 0.7 * largest)
            values = brute_fixed(bounds(real, 0))
        values = brute_fixed(bounds(real, 2.4 * least)) or values or [None] * 6
        want.update({c * 10 + i: v for i, v in enumerate(values)})
    df = spark.createDataFrame(rows, "component int, edge int, src string, dst string, size long, cov long, cnt long, unique boolean")
    assert {r["edge"]: r["mult"] for r in flow.multiplicities_by_coverage(df).collect()} == want


def test_polished(spark):
    reads = spark.createDataFrame([(1, "AAACCGT"), (2, "TAACCCCGT"), (3, "AACCGG"), (4, None)], "read_id int, seq string")
    found = spark.createDataFrame([(1, "x", 0, 0, "4="), (2, "x", 1, 0, "2=1I1="), (3, "x", 0, 0, "2=9="), (4, "x", 0, 0, "1=")], "read_id int, contig string, read_from int, contig_from int, cigar string")
    votes = sorted(tuple(r) for r in polishing.run_votes(reads, found).collect())
    assert votes == [("x", 0, "A", 2), ("x", 0, "A", 2), ("x", 0, "A", 3), ("x", 1, "C", 2), ("x", 1, "C", 2), ("x", 1, "C", 4), ("x", 2, "G", 1), ("x", 2, "G", 2), ("x", 2, "T", 1), ("x", 3, "T", 1)]
    inner = sorted(tuple(r) for r in polishing.run_votes(reads, found.filter("read_id = 1"), margin=1).collect())
    assert inner == [("x", 1, "C", 2), ("x", 2, "G", 1)]
    contig = spark.createDataFrame([("x", "ACGTA"), ("y", "GA")], "contig string, seq string")
    # at G the T does not vote; the last A and y have no votes
    assert {tuple(r) for r in polishing.polished(contig, polishing.run_votes(reads, found)).collect()} == {("x", "AACCGTA"), ("y", "GA")}


def test_whole_places_of_short_contigs(spark):
    reads = spark.createDataFrame([(1, "ACGTACGTACGTTTACGTACGTACG"), (2, "TTT"), (3, "")], "read_id int, seq string")
    parts = ["TTT", "ACG", "ACGTACGTACGTTTACGTACGT", "CGTACGTACGTTTACGTACGTACGA", ""]
    df = spark.createDataFrame(list(enumerate(parts)), "contig int, seq string")
    want = {(r["read_id"], c, r["seq"].index(p)) for r in reads.collect() for c, p in enumerate(parts) if p and p in r["seq"]}
    assert {tuple(r) for r in K.whole_places(reads, df, 20).collect()} == want


def plain_contigs(edges):
    """Each edge extended back and forward, without those within another; edges are (src, dst, label)."""
    out, into = {}, {}
    for e in edges:
        out.setdefault(e[0], []).append(e)
        into.setdefault(e[1], []).append(e)
    paths = set()
    for e in edges:
        path = [e]
        while len(into.get(path[0][0], [])) == 1 and into[path[0][0]][0] not in path:
            path.insert(0, into[path[0][0]][0])
        while len(out.get(path[-1][1], [])) == 1 and out[path[-1][1]][0] not in path:
            path.append(out[path[-1][1]][0])
        paths.add(tuple(path))
    within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    left = [p for p in paths if not any(p != q and within(p, q) for q in paths)]
    return {p[0][2] + "".join(e[2][len(e[0]) :] for e in p[1:]) for p in left}


def test_extended_contigs(spark):
    rng = random.Random(8)
    for k, n, length in ((4, 3, 30), (5, 4, 40), (6, 3, 60)):
        reads = [(i, "".join(rng.choice("ACGT") for _ in range(length))) for i in range(n)]
        edges = G.edges_of(spark.createDataFrame(reads, "read_id int, seq string"), k)
        own = [(r["src"], r["dst"], r["label"]) for r in edges.collect()]
        assert {r["seq"] for r in U.extended_contigs(edges).collect()} == plain_contigs(own)
    ring = spark.createDataFrame([("a", "b", "ab", 1), ("b", "a", "ba", 1)], "src string, dst string, label string, cov long")
    assert [r["seq"] for r in U.extended_contigs(ring).collect()] in (["aba"], ["bab"])
    assert U.extended_contigs(ring.limit(0)).count() == 0


def test_reliable_extensions(spark):
    rows = [(1, "AA", "AC", "AAC", 5), (2, "AA", "AG", "AAG", 1), (3, "AC", "CT", "ACCT", 5), (4, "CT", "TT", "CTT", 5), (5, "CT", "TG", "CTG", 5), (6, "GG", "GG", "GGG", 9)]
    edges = spark.createDataFrame(rows, "edge_id int, src string, dst string, label string, cov long")
    starts = spark.createDataFrame([(x, x) for x in ("AA", "CT", "GG", "TT")], "key string, v string")
    found = lambda n, least: {tuple(map(tuple, [r["path"]])) + (r["key"], r["seq"], r["len"]) for r in U.reliable_extensions(edges, starts, n, least).collect()}
    assert found(3, 2) == {((1, 3), "AA", "CCT", 3), ((6, 6, 6), "GG", "GGG", 3)}
    assert found(4, 2) == {((6, 6, 6, 6), "GG", "GGGG", 4)}
    assert found(1, 1) == {((6,), "GG", "G", 1)}


def test_columns_of_alignment(spark):
    df = spark.createDataFrame([("GGACGT", "ACGTCC", [0, 0, 1, 1]), ("", "A", []), (None, "A", None)], "a string, b string, o array<int>")
    assert [r[0] and tuple(r[0]) for r in df.select(D.best_overlap(F.col("a"), F.col("b"))).collect()] == [(4, 4, 4), (0, 0, 0), (None, None, None)]
    step, emit = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.99, 0.01], [0.01, 0.99]])
    assert [r[0] for r in df.select(D.decoded(F.col("o"), step, emit)).collect()] == [[0, 0, 1, 1], [], None]


def plain_graphs(reads, shortest, longest, least, crossings):
    """The edges (label: cov) of each k."""
    def counted(texts, k):
        found = {}
        for t in texts:
            for i in range(len(t) - k + 1):
                found[t[i : i + k]] = found.get(t[i : i + k], 0) + 1
        return found

    more, ways, out = {}, {}, []
    for k in range(shortest, longest + 1):
        index = counted(reads, k)
        often = {m for m, n in index.items() if n >= least}
        found = {m: index[m] for m in often}
        for t in reads:
            at = [i for i in range(len(t) - k + 1) if t[i : i + k] in often]
            for i in range(at[0], at[-1] + 1) if at else ():
                if index[t[i : i + k]] >= min(4, least):
                    found[t[i : i + k]] = index[t[i : i + k]]
        found = {**more, **found, **ways}
        while True:
            heads, tails = {m[:-1] for m in found}, {m[1:] for m in found}
            gone = {m for m, n in found.items() if n < least and (m[:-1] not in tails or m[1:] not in heads)}
            if not gone:
                break
            found = {m: n for m, n in found.items() if m not in gone}
        out.append(found)
        more = counted(plain_contigs([(m[:-1], m[1:], m) for m in found]), k + 1)
        index = counted(reads, k + 1)
        ins, outs = {}, {}
        for m in found:
            outs.setdefault(m[:-1], []).append(m)
            ins.setdefault(m[1:], []).append(m)
        pairs = [a + b[-1] for v in ins if len(ins[v]) > 1 and len(outs.get(v, [])) > 1 for a in ins[v] for b in outs[v]]
        ways = {m: index[m] for m in pairs if index.get(m, 0) >= crossings}
    return out


def test_iterative_graphs(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(60))
    reads = [genome[i : i + 25] for i in range(0, 36, 4)] + [genome[10:30] + genome[5:25]]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    got = [{r["label"]: r["cov"] for r in edges.collect()} for _, edges in N.iterative_graphs(df, 3, 5, lambda k: 2, 2)]
    assert got == plain_graphs(reads, 3, 5, 2, 2) and len(got[0]) > 10
