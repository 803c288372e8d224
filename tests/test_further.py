"""Sparse graphs, repeats, formats, gap closing and graph edits against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import repeats as Z
from strandloom.functions import sequences as S
from strandloom.operators import bloom as B
from strandloom.operators import gaps, sparse
from strandloom.operators import graph as G
from strandloom.operators import paths as P
from strandloom.sources import formats as X


def rc(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def one(spark, column, *values):
    """The column over rows (a, b) of the values."""
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_shrunk_dimers_are_a_stack(spark):
    def plain(x):
        out = list(x[:5])
        for c in x[5:]:
            if len(out) >= 5 and c == out[-2] and out[-1] == out[-3] and out[-2] == out[-4] and out[-3] == out[-5]:
                out.pop()
            else:
                out.append(c)
        return "".join(out)

    rng = random.Random(1)
    texts = ["", "A", "ABABABABAB", "AAAAAAAA"] + [dna(rng, rng.randint(0, 60), "AC") for _ in range(200)] + ["G" + "AC" * n + "A" * m + "TATATATA" for n in range(6) for m in range(3)]
    assert one(spark, Z.shrink_dimers(F.col("a")), *((t, "") for t in texts)) == [plain(t) for t in texts]


def test_compression_maps_back(spark):
    def plain(read, most):
        out, places = "", []
        for i, c in enumerate(read):
            if i and read[i - 1] == c:
                continue
            n = len(out)
            if n > 2 * most and c in out[-2:]:
                if all(out[n - 2 * j] == out[n - 2] for j in range(1, most)) and all(out[n - 1 - 2 * j] == out[n - 1] for j in range(1, most)):
                    continue
            out, places = out + c, [*places, i]
        return out, places

    rng = random.Random(2)
    for text in ["", "A", "AAAA", "ACACACACACACGT", "GACACACACACACCCAGAGAGAGAGAGAGT", *(dna(rng, 80, "AC") for _ in range(30)), *(dna(rng, 80) for _ in range(30))]:
        for most in (1, 2, 3, 16):
            out, places = Z.compress_with_map(text, most)
            assert (out, places) == plain(text, most) and out == "".join(text[p] for p in places)
    found = one(spark, Z.compressed_read(F.col("a"), 2), ("AACACACACG", ""))[0]
    assert (found["seq"], found["places"]) == Z.compress_with_map("AACACACACG", 2)
    starts = one(spark, Z.run_starts(F.col("a")), ("AACCCG", ""), ("A", ""))
    assert starts == [[0, 2, 5], [0]]


def test_dimer_repeats(spark):
    def plain(s, least):
        out, start = [], 0
        while start < len(s):
            n = 1
            while start + 2 * n + 1 < len(s) and s[start] == s[start + 2 * n] and s[start + 1] == s[start + 2 * n + 1]:
                n += 1
            if n >= least:
                out.append((start, n, s[start : start + 2]))
                start += 1
            start += 2 * n - 1
        return out

    rng = random.Random(3)
    texts = ["", "A", "ACACAC", *(dna(rng, 50, "AC") for _ in range(100)), *("G" + "AC" * a + "CT" * b + "TT" * c for a in range(5) for b in range(5) for c in range(3))]
    for t in texts:
        assert Z.dimer_repeats(t, 3) == plain(t, 3), t
    assert [[tuple(x) for x in r] for r in one(spark, Z.dimers(F.col("a"), 3), *((t, "") for t in texts))] == [plain(t, 3) for t in texts]
    assert Z.dimer_around("GGACACACTT", 4) == 2 and Z.dimer_around("AAAA", 1) == 0
    assert one(spark, Z.dimer_multiplicity(F.col("a"), F.lit(4)), ("GGACACACTT", ""), ("A", "")) == [2, None]


def test_dimer_codes(spark):
    def plain(s):
        out = []
        for i in range(1, len(s)):
            if i > 1 and s[i] == s[i - 2]:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((s[i - 1 : i + 1], 1))
        return out

    rng = random.Random(4)
    texts = ["", "A", "AC", *(dna(rng, 30, "ACG") for _ in range(50))]
    assert [[tuple(x) for x in r] for r in one(spark, Z.dimer_code(F.col("a")), *((t, "") for t in texts))] == [plain(t) for t in texts]
    difference = Z.code_difference(Z.dimer_code(F.col("a")), Z.dimer_code(F.col("b")))
    assert one(spark, difference, ("ACACG", "ACACACG"), ("ACG", "ACG"), ("ACG", "AGG")) == [1, 0, None]


def test_small_functions(spark):
    rng = random.Random(5)
    for _ in range(50):
        a, b = dna(rng, 20, "AC"), dna(rng, 20, "AC")
        subs = {a[i:j] for i in range(20) for j in range(i + 1, 21)}
        assert len(Z.longest_common(a, b)) == max((len(x) for x in subs if x in b), default=0) and Z.longest_common(a, b) in a
    assert one(spark, Z.occurrences(F.col("a"), "AA"), ("AAAA", ""), ("A", "")) == [[0, 1, 2], []]
    assert one(spark, Z.separate_occurrences(F.col("a"), "AA"), ("AAAAA", "")) == [2]
    x = one(spark, Z.random_sequence(F.lit(50), F.col("a")), ("s", ""), ("s", ""), ("t", ""))
    assert x[0] == x[1] != x[2] and set(x[0]) <= set("ACGT") and len(x[0]) == 50
    y = one(spark, Z.mutated(F.col("a"), 0.2, F.col("b")), (x[0] * 40, "1"), (x[0] * 40, "1"))
    assert y[0] == y[1] and 0.15 < np.mean([p != q for p, q in zip(x[0] * 40, y[0], strict=True)]) < 0.25
    assert one(spark, Z.cigar_counts(S.parse_cigar(F.col("a"))), ("3=1X2I4D", "")) == [(3, 7, 8, 6)]


def plain_sparse(reads, vertices, k):
    both = {v for x in vertices for v in (x, rc(x))}
    out = set()
    for s in reads:
        at = [i for i in range(len(s) - k + 1) if s[i : i + k] in both]
        v = [s[i : i + k] for i in at]
        for j in range(len(at) - 1):
            if j and v[j - 1] == v[j] == v[j + 1] and at[j] - at[j - 1] == at[j + 1] - at[j] < k:
                continue
            label = s[at[j] : at[j + 1] + k]
            out |= {(v[j], v[j + 1], label), (rc(v[j + 1]), rc(v[j]), rc(label))}
        if at and at[0]:
            out.add((rc(v[0]), None, rc(s[: at[0] + k])))
        if at and at[-1] + k < len(s):
            out.add((v[-1], None, s[at[-1] :]))
    return out


def test_sparse_graph(spark):
    rng, k = random.Random(6), 5
    genome = dna(rng, 300)
    reads = [genome[i : i + 60] for i in range(0, 240, 30)] + [rc(genome[100:180]), "ACACACACACACACAC", "AAAAAAAAAAAA", "ACG", "", None]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    texts = [r for r in reads if r]
    vertices = {min(x, rc(x)) for r in texts for x in (r[i : i + k] for i in range(len(r) - k + 1)) if min(x, rc(x)).startswith(("AC", "AAAA"))}
    v = spark.createDataFrame([(x,) for x in vertices], "kmer string")
    edges = sparse.sparse_edges(df, v, k)
    want = plain_sparse(texts, vertices, k)
    assert {tuple(r) for r in edges.collect()} == want and edges.count() == len(want)
    ends = {min(x, rc(x)) for _, d, label in want if d is None for x in [label[-k:]]}
    tied = {tuple(r) for r in sparse.tie_tips(edges, v, k).collect()}
    assert tied == plain_sparse([label for _, _, label in want], vertices | ends, k) and all(d for _, d, _ in tied)
    assert sparse.sparse_edges(df.limit(0), v, k).count() == 0 and sparse.sparse_edges(df, v.limit(0), k).count() == 0


def test_compacted_is_the_contracted_graph(spark):
    rng, k, w = random.Random(7), 9, 6
    genome = dna(rng, 400)
    genome = genome + genome[50:120] + dna(rng, 100)  # a repeat makes junctions
    reads = [genome[i : i + 100] for i in range(0, len(genome) - 99, 17)] + [rc(genome[200:320]), "ACGTAC", dna(rng, 40), genome[150:200] + dna(rng, 30), ""]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    long = df.filter(F.length("seq") >= k + w - 1)
    both = long.unionByName(long.select(F.col("read_id") + 1000, S.reverse_complement(F.col("seq"))).toDF("read_id", "seq"))
    want = {(r["src"], r["dst"], r["label"]) for r in G.contract(G.edges_of(both, k + 1)).collect()}
    found = [tuple(r) for r in sparse.compacted(df, k, w).collect()]
    assert set(found) == want and len(found) == len(want)
    kmers_ = lambda texts: {t[i : i + k] for t in texts for i in range(len(t) - k + 1)}
    paths = [r["seq"] for r in sparse.disjointigs(df, k, w).collect()]
    texts = [r for r in reads if len(r) >= k + w - 1]
    assert kmers_(paths) == kmers_([*texts, *map(rc, texts)])
    assert sparse.compacted(df.limit(0), k, w).count() == 0


def test_split_and_pieces(spark):
    edges = spark.createDataFrame([(1, "ACGTACGTACGTACGT"), (2, "AAAA")], "edge_id int, seq string")
    breaks = spark.createDataFrame([(1, 4), (1, 4), (1, 9), (1, 0), (1, 99), (2, 3)], "edge_id int, pos int")
    found = sorted(tuple(r) for r in sparse.split_at(edges, breaks, 3).collect())
    assert found == [(1, 0, "ACGTACG"), (1, 1, "ACGTACGT"), (1, 2, "CGTACGT"), (2, 0, "AAAA")]


def test_strong_components_and_levels(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(40, 41), (41, 40), (42, 42)]
    nodes = {x for p in pairs for x in p}
    reach = {v: {v} for v in nodes}
    for _ in nodes:
        for a, b in pairs:
            for v in nodes:
                if a in reach[v]:
                    reach[v].add(b)
    want = {v: min(x for x in nodes if x in reach[v] and v in reach[x]) for v in nodes}
    df = spark.createDataFrame(pairs, "src int, dst int")
    assert {r["v"]: r["component"] for r in G.strong_components(df).collect()} == want
    dag = [(a, b) for a, b in pairs if a < b]
    level = {v: 0 for p in dag for v in p}
    for _ in nodes:
        for a, b in dag:
            level[b] = max(level[b], level[a] + 1)
    assert {r["v"]: r["level"] for r in G.peeled(spark.createDataFrame(dag, "src int, dst int")).collect()} == level
    with pytest.raises(ValueError, match="cycle"):
        G.peeled(spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int"))


def test_bulges_of_text_labels(spark):
    edges = spark.createDataFrame([("AC", "GT", "ACAGT", 3), ("AC", "GT", "ACCGT", 5), ("AC", "TT", "ACGTT", 2), ("AC", "TT", "ACATT", 2), ("AA", "TT", "AATT", 1)], "src string, dst string, label string, cov long")
    assert sorted(tuple(r) for r in G.bulge_choice(edges, 60).collect()) == [("AC", "GT", "ACCGT", 8), ("AC", "TT", "ACATT", 4)]


def test_tips_go_whole(spark):
    chain = [(f"t{i}", f"t{i + 1}", f"t{i}>", 1) for i in range(60)]  # a tip longer than fifty edges
    rows = [*chain, ("t60", "m", "t60>", 9), ("m", "n", "m>", 9), ("n", "m", "n>", 9), ("m", "t60", "x>", 9)]
    left = G.tip_free(spark.createDataFrame(rows, "src string, dst string, label string, cov long"), 3)
    assert {r["label"] for r in left.collect()} == {"t60>", "m>", "n>", "x>"}


def test_gap_patches(spark):
    rng = random.Random(9)
    shared = dna(rng, 120)
    other = dna(rng, 120)
    rows = [("a", dna(rng, 200) + shared), ("b", dna(rng, 150) + rc(shared[:60] + ("A" if shared[60] != "A" else "C") + shared[61:])), ("c", dna(rng, 300))]
    rows += [("d", dna(rng, 100) + other), ("e", dna(rng, 100) + rc(other)), ("f", dna(rng, 90) + rc(other))]  # d has two partners
    df = spark.createDataFrame(rows, "edge_id string, seq string")
    found = [tuple(r) for r in gaps.patches(df, k=21, least=80, most=150, divergence=0.05).collect()]
    assert [(set(x[:2]), x[2], x[3]) for x in found] == [({"a", "b"}, 120, 120)]
    assert gaps.patches(df.limit(0), k=21, least=80, most=150).count() == 0
    assert gaps.overlap("AAAA", "CCCC", 2, 10, 0.05) == (0, 0) and gaps.overlap("GGACGT", "ACGTCC", 3, 10, 0.05) == (4, 4)
    edges = spark.createDataFrame([("x", "u", "v", "A" * 30, 5), ("y", "v", "w", "A" * 30, 5), ("z", "w", "q", "A" * 5, 5)], "edge_id string, src string, dst string, label string, cov long")
    assert [r["edge_id"] for r in gaps.dead_ends(edges, 10).collect()] == []
    assert [r["edge_id"] for r in gaps.dead_ends(edges.filter("edge_id <> 'y'"), 10).collect()] == ["x"]


def test_walked_paths(spark):
    rng, k = random.Random(10), 7
    genome = dna(rng, 200) + "ACGTACG" + dna(rng, 60) + "ACGTACG" + dna(rng, 50)
    reads = spark.createDataFrame([(0, genome), (1, genome[40:180]), (2, genome[150:])], "read_id int, seq string")
    edges = P.identified(G.contract(G.edges_of(reads, k)))
    steps = P.align(reads, edges, k)
    found = sorted(tuple(r) for r in P.walked(P.compact(steps, edges), edges).collect())
    assert found == sorted((r["read_id"], r["i"], r["edge_id"]) for r in steps.collect())


def test_bloom_filters(spark):
    bits, hashes = B.sizes(500, 0.01)
    df = spark.range(1000).selectExpr("cast(id as string) as k")
    a, b = B.bloom(df.filter("k < 500"), "k", bits, hashes), B.bloom(df.filter("k >= 500"), "k", bits, hashes)
    held = {r["k"] for r in B.contained(df, "k", a, bits, hashes).collect()}
    assert held >= {str(i) for i in range(500)} and len(held) < 530
    assert B.contained(df, "k", B.combined(a, b, "or"), bits, hashes).count() == 1000
    assert B.combined(a, a, "xor").count() == 0 and B.combined(a, a, "and").exceptAll(a).count() == 0
    assert 0 < B.false_rate(a, bits, hashes).first()["rate"] < 0.05
    assert B.contained(df, "k", B.bloom(df.limit(0), "k", bits, hashes), bits, hashes).count() == 0


def test_formats(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@q x\nAC\nGT\n+\n!!\n!!\n")
    (tmp_path / "r.fa").write_text(">f\nAC\nG\n")
    found = X.read_sequences(spark, f"{tmp_path}/r.fq", f"{tmp_path}/r.fa")
    assert sorted(tuple(r) for r in found.collect()) == [("f", "", "ACG"), ("q", "x", "ACGT")]
    assert X.existing(spark, f"{tmp_path}/r.fq") == [f"{tmp_path}/r.fq"]
    with pytest.raises(FileNotFoundError, match="none.fa"):
        X.existing(spark, f"{tmp_path}/r.fq", f"{tmp_path}/none.fa")
    (tmp_path / "a.bed").write_text("c 1 2\nc 3 4\nbad\nc 5 6\n")
    (tmp_path / "b.bed").write_text("d 7 8\n")
    assert sorted(tuple(r) for r in X.read_bed_until_malformed(spark, f"{tmp_path}/a.bed", f"{tmp_path}/b.bed").collect()) == [("c", 1, 2), ("c", 3, 4), ("d", 7, 8)]
    (tmp_path / "v.gfa").write_text("S\ta\tACG\nS\tb\tCGT\nL\ta\t+\tb\t-\t2M\n")
    vertices, edges = X.read_vertex_gfa(spark, f"{tmp_path}/v.gfa")
    assert vertices.count() == 2 and sorted(tuple(r) for r in edges.collect()) == [("a", "-b", 2), ("b", "-a", 2)]
    (tmp_path / "rows.txt").write_text("r 1 2 -c 3 4\nr 5 6 d 7 8\n")
    assert sorted((r["read"], r["contig"], r["reverse"]) for r in X.read_alignments(spark, f"{tmp_path}/rows.txt").collect()) == [("r", "c", True), ("r", "d", False)]
    (tmp_path / "m.txt").write_text("2 2\n0.9 0.1\n0.2 0.8\n0.5 0.5\n1 0\n")
    transitions, observed = X.read_hmm(f"{tmp_path}/m.txt")
    assert transitions.tolist() == [[0.9, 0.1], [0.2, 0.8]] and observed.tolist() == [[0.5, 0.5], [1, 0]]
    (tmp_path / "short.txt").write_text("2 2\n0.9\n")
    with pytest.raises(ValueError, match="complete"):
        X.read_hmm(f"{tmp_path}/short.txt")
    numbers = spark.range(5).withColumnRenamed("id", "h")
    X.write_numbers(numbers, f"{tmp_path}/numbers", "h")
    assert sorted(r["h"] for r in X.read_numbers(spark, f"{tmp_path}/numbers").collect()) == list(range(5))
    (tmp_path / "cut.txt").write_text("hashes 3\n1\n2\n")
    with pytest.raises(ValueError, match="complete"):
        X.read_numbers(spark, f"{tmp_path}/cut.txt")
    edges = spark.createDataFrame([("AC", "CG", "ACG", 0), ("CG", "GT", "CGT", 4)], "src string, dst string, label string, cov long")
    lines = {r["value"] for r in X.coloured_dot_lines(edges, F.when(F.col("cov") > 0, "black").otherwise("red")).collect()}
    assert '"AC" -> "CG" [label="3 0" color="red"]' in lines and '"AC" [style=filled fillcolor="yellow"]' in lines and len(lines) == 3


def test_stages_are_read_again(spark, tmp_path):
    runs = []

    def step(name):
        def run(table):
            runs.append(name)
            return spark.range(3) if table is None else table.filter("id > 0")

        return name, run

    stages = [step("one"), step("two")]
    for _ in range(2):
        assert X.staged(spark, str(tmp_path), stages).count() == 2
    assert runs == ["one", "two"]


def test_sessions(spark, tmp_path):
    from strandloom.streaming.incremental import sessions

    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:20"), ("u", "2024-01-01 00:05:00"), ("v", "2024-01-01 00:00:10"), ("z", "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = sessions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "t", "30 seconds", "1 minute")
    run = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in spark.sql("select * from found").collect()) == [("u", 1), ("u", 2), ("v", 1)]
