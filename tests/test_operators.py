"""Operators on small fixtures and against plain versions."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import graph as G
from strandloom.operators import intervals as I
from strandloom.operators import kmers as K
from strandloom.operators import stats as A
from strandloom.operators.components import connected_components
from strandloom.sources import formats as X


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr).first()[0]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_sequence_functions(spark):
    c = F.col
    assert one(spark, S.compress_runs(c("s")), s="AACCCGTT") == "ACGT"
    assert one(spark, S.reverse_complement(c("s")), s="AACG") == "CGTT"
    assert one(spark, S.as_number(c("s")), s="ACGT") == 27
    assert one(spark, S.min_rotation(c("s")), s="GATTACA") == "ACAGATT"
    assert one(spark, S.toggle_strand(c("s")), s="-x") == "x" and one(spark, S.toggle_strand(c("s")), s="x") == "-x"
    assert one(spark, S.common_prefix(c("a"), c("b")), a="ACGT", b="ACCT") == 2
    assert one(spark, S.hamming(c("a"), c("b")), a="AC?T", b="ACCA") == 1
    assert one(spark, S.cap_dimers(c("s"), 4), s="GG" + "AT" * 9 + "AC") == "GGATATAC"[:6] + "AC"
    cigar = one(spark, S.parse_cigar(c("s")), s="89=1X6=3X76=")
    assert [(x["len"], x["op"]) for x in cigar] == [(89, "="), (1, "X"), (6, "="), (3, "X"), (76, "=")]


def random_reads(n=12, seed=1):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    out = [base[a : a + rng.randint(0, 90)] for a in (rng.randrange(380) for _ in range(n))]
    return list(enumerate([rc(x) if rng.random() < 0.5 else x for x in out] + ["", "A"]))


def test_kmers_match_plain(spark):
    rows = random_reads()
    df = spark.createDataFrame(rows, "read_id long, seq string")
    want = sorted((i, p, s[p : p + 5]) for i, s in rows for p in range(len(s) - 4))
    assert sorted(map(tuple, K.kmers(df, 5).collect())) == want
    long = spark.createDataFrame([(0, "".join(random.Random(2).choice("ACGT") for _ in range(3000)))], "read_id long, seq string")
    assert K.kmers(long, 9).count() == 2992 == K.kmers(long, 9).distinct().count()


def test_minimizers_match_plain(spark):
    rows = random_reads(20, 3)
    df = spark.createDataFrame(rows, "read_id long, seq string")
    for k, w in ((7, 10), (5, 2)):
        want = set()
        for i, s in rows:
            if len(s) < k + w - 1:
                continue
            value = lambda x: sum("ACGT".index(c) * 239 ** (len(x) - 1 - j) for j, c in enumerate(x))
            h = [min(value(s[p : p + k]), value(rc(s[p : p + k]))) for p in range(len(s) - k + 1)]
            want |= {(i, min(h[:w]))} | {(i, min(h[p : p + w + 1])) for p in range(len(h) - w)}
        assert set(map(tuple, K.minimizers(df, k, w).collect())) == want


def test_graph_invariants(spark):
    df = spark.createDataFrame(random_reads(30, 5), "read_id long, seq string")
    edges = G.edges_of(df, 6).cache()
    whole = G.contract(edges).collect()
    plain = {r["label"] for r in edges.collect()}
    spelled = [r["label"][p : p + 6] for r in whole for p in range(len(r["label"]) - 5)]
    assert sorted(spelled) == sorted(plain)
    assert sum(r["cov"] for r in whole) == edges.agg(F.sum("cov")).first()[0]
    degrees = {}
    for r in whole:
        degrees.setdefault(r["src"], [0, 0])[1] += 1
        degrees.setdefault(r["dst"], [0, 0])[0] += 1
    assert all(v != [1, 1] or any(r["src"] == r["dst"] == k for r in whole) for k, v in degrees.items())
    ring = spark.createDataFrame([("AA", "AC", "AAC", 1), ("AC", "CA", "ACA", 2), ("CA", "AA", "CAA", 3), ("GG", "GG", "GGG", 5)], "src string, dst string, label string, cov long")
    assert sorted((r["cov"], r["n"], r["src"] == r["dst"]) for r in G.contract(ring).collect()) == [(5, 1, True), (6, 3, True)]
    assert G.tip_free(edges, 1).count() == edges.count()


def test_components_match_union_find(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i + 1000, i + 1001) for i in range(60)] + [(5, 5), (None, 3)]
    part = {}
    for a, b in pairs:
        if a is not None:
            for x in (a, b):
                part.setdefault(x, x)
    for _ in range(300):
        for a, b in pairs:
            if a is not None:
                part[a] = part[b] = min(part[a], part[b])
    df = spark.createDataFrame(pairs, "src long, dst long")
    assert dict(map(tuple, connected_components(df).collect())) == part


def test_neighbourhood(spark):
    edges = spark.createDataFrame([("a", "b", "a1", 1), ("b", "c", "b23", 1), ("c", "d", "c4567", 1)], "src string, dst string, label string, cov long")
    start = spark.createDataFrame([("a",)], "v string")
    assert dict(map(tuple, G.neighbourhood(edges, start, 3).collect())) == {"a": 0, "b": 1, "c": 3}


def test_intervals_match_plain(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(3), a, a + rng.randrange(0, 90)) for a in (rng.randrange(600) for _ in range(80))]
    df = spark.createDataFrame(rows, "contig long, lo long, hi long")
    pts = [(k, rng.randrange(3), rng.randrange(700)) for k in range(60)]
    p = spark.createDataFrame(pts, "key long, contig long, pos long")
    want = sorted((k, lo, hi) for k, c, x in pts for d, lo, hi in rows if c == d and lo <= x < hi)
    assert sorted(map(tuple, I.points_in(p, df, 16).select("key", "lo", "hi").collect())) == want
    both = sorted((a, b, x, y) for c, a, b in rows for d, x, y in rows if c == d and a < y and x < b and a < b and x < y)
    assert sorted(map(tuple, I.overlaps(df, df, 16).select("lo", "hi", "lo2", "hi2").collect())) == both
    covered = {(c, x) for c, a, b in rows for x in range(a, b)}
    merged = I.merged(df.filter("lo < hi")).collect()
    assert {(r["contig"], x) for r in merged for x in range(r["lo"], r["hi"])} == covered
    depth = {}
    for r in I.depth_steps(df).collect():
        depth[r["contig"], r["pos"]] = r["depth"]
    assert all(v == sum(a <= x < b for d, a, b in rows if d == c) for (c, x), v in depth.items())
    touching = spark.createDataFrame([(0, 0, 5), (0, 5, 9), (0, 20, 30)], "contig long, lo long, hi long")
    assert sorted(map(tuple, I.merged(touching).select("lo", "hi").collect())) == [(0, 9), (20, 30)]
    assert sorted(map(tuple, I.uncovered(touching).select("lo", "hi").collect())) == [(9, 20)]


def test_statistics(spark):
    df = spark.createDataFrame([(x,) for x in (2, 2, 2, 3, 3, 4, 8, 8)], "len long")
    assert tuple(A.ng(df).first()) == (8, 32, 8) and tuple(A.ng(df, genome=1000).first())[2] is None
    assert tuple(A.upper_median(df, "len").first()) == (8, 32, 3)
    zeros = spark.createDataFrame([(0, i, 0) for i in range(10)], "g long, i long, v long")
    adds = spark.createDataFrame([(0, 3, 10, 1), (0, 0, 4, 2)], "g long, lo long, hi long, d long")
    found = [r["v"] for r in A.range_added(zeros, adds, "g", "i", "v").orderBy("i").collect()]
    assert found == [2, 2, 2, 3, 1, 1, 1, 1, 1, 1]
    first = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 2, 5, 6, 50, 100, 200, 201, 202, 204])], "g long, i long, v long")
    assert [r["prefix"] for r in A.prefix_sums(first, "g", "i", "v").orderBy("i").collect()][-1] == 971


def test_formats(spark, tmp_path):
    fasta = tmp_path / "x.fa"
    fasta.write_text(">r1 c\nACGT\nAC\n>r2\nGG\n>r3 a b\n\n")
    want = [("r1", "c", "ACGTAC"), ("r2", "", "GG"), ("r3", "a b", "")]
    assert sorted(map(tuple, X.read_fasta(spark, str(fasta)).collect())) == want
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(fasta.read_text())
    assert sorted(map(tuple, X.read_fasta(spark, str(tmp_path / "y.fa.gz")).collect())) == want
    X.write_fasta(spark.createDataFrame([("a", "ACGTA")], "n string, s string"), str(tmp_path / "out"), F.col("n"), F.col("s"), 2)
    assert [tuple(r) for r in X.read_fasta(spark, str(tmp_path / "out")).collect()] == [("a", "", "ACGTA")]
    fastq = tmp_path / "x.fastq"
    fastq.write_text("@q1 z\nACG\nTT\n+\nII@\nII\n@q2\nA\n+q2\n@\n")
    assert sorted(map(tuple, X.read_fastq(spark, str(fastq)).collect())) == [("q1", "z", "ACGTT", "II@II"), ("q2", "", "A", "@")]
    (tmp_path / "x.paf").write_text("q 10 0 9 - t 100 20 30 1 2 3\nq 10 0 9 + t 100 20 30\n")
    assert sorted((r["local"], r["target_lo"], r["target_hi"]) for r in X.read_paf(spark, str(tmp_path / "x.paf")).collect()) == [("-t", 70, 80), ("t", 20, 30)]
    (tmp_path / "x.bed").write_text("c\t1\t5\nbad\nc\tx\t5\n")
    assert [tuple(r) for r in X.read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("c", 1, 5)]
    edges = spark.createDataFrame([("AC", "CG", "ACG", 3), ("CG", "GT", "CGT", 2)], "src string, dst string, label string, cov long")
    X.gfa_lines(edges, 3).write.text(str(tmp_path / "gfa"))
    segments, links = X.read_gfa(spark, str(tmp_path / "gfa"))
    assert sorted(map(tuple, segments.collect())) == [("AC>CG", "ACG", 3.0), ("CG>GT", "CGT", 2.0)]
    assert [tuple(r) for r in links.collect()] == [("AC>CG", "+", "CG>GT", "+", 2)]


def test_streaming_spectrum(spark, tmp_path):
    from strandloom.streaming.incremental import running_spectrum

    rows = random_reads(10, 13)
    df = spark.createDataFrame(rows, "read_id long, seq string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_spectrum(stream, 5).writeStream.outputMode("complete").format("memory").queryName("spectrum_now").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("spectrum_now").collect())) == sorted(map(tuple, K.spectrum(df, 5).collect()))


@pytest.mark.parametrize("least", [2, 3])
def test_frequent_matches_plain(spark, least):
    rows = random_reads(15, 17)
    counts = {}
    for _, s in rows:
        for p in range(len(s) - 4):
            counts[s[p : p + 5]] = counts.get(s[p : p + 5], 0) + 1
    want = {k for k, v in counts.items() if v >= least}
    for _, s in rows:
        at = [p for p in range(len(s) - 4) if s[p : p + 5] in want]
        if at:
            want |= {s[p : p + 5] for p in range(at[0], at[-1] + 1) if counts[s[p : p + 5]] >= min(4, least)} if least <= 4 else set()
    df = spark.createDataFrame(rows, "read_id long, seq string")
    assert {r["kmer"] for r in K.frequent(df, 5, least).collect()} == want


def test_shared_pairs_match_plain(spark):
    rng = random.Random(19)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    copy, mark = text(40), text(12)
    rows = [(i, copy) for i in range(70)] + [(100 + i, text(15) + mark + text(15)) for i in range(60)]
    rows += [(200, copy), (200, mark), (201, copy), (201, mark), (201, mark), (202, "ACG"), (203, None), (None, copy), (204, text(30) + copy[:20])]
    sets = {}
    for i, s in rows:
        if i is not None:
            sets.setdefault(i, set()).update(s[p : p + 8] for p in range(len(s or "") - 7))
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b])
    df = spark.createDataFrame(rows, "read_id long, seq string")
    for tile in (512, 7):
        assert sorted(map(tuple, K.shared_pairs(df, 8, tile=tile).select("a", "b", "n").collect())) == want


def test_strand_coverage_matches_plain(spark):
    from strandloom.operators import paths as P

    rows, k = random_reads(8, 23), 7
    df = spark.createDataFrame(rows, "read_id long, seq string")
    both = df.unionByName(spark.createDataFrame([(i, rc(s)) for i, s in rows], "read_id long, seq string"))
    edges = P.identified(G.contract(G.edges_of(both, k)))
    found = {r["label"]: (r["bases"], r["mean"]) for r in P.strand_coverage(df, edges, k).collect()}
    times = {}
    for _, s in rows:
        for x in (s, rc(s)):
            for p in range(len(x) - k + 1):
                times[x[p : p + k]] = times.get(x[p : p + k], 0) + 1
    inner = {x: [x[p : p + k] for p in range(len(x) - k + 1)] for x in found}
    assert sorted(y for v in inner.values() for y in v) == sorted(times)
    for x, (bases, mean) in found.items():
        assert bases == sum(times[y] for y in inner[x]) and mean == bases / len(inner[x])
        assert rc(x) not in found or found[rc(x)] == (bases, mean)
