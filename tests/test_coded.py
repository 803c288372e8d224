"""k-mers as numbers against plain Python and against the joins."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.operators import coded, sparse
from strandloom.plans import registry

SF = "/root/testdata/sf0.001"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def made(rng):
    word = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(3, 40))) for _ in range(30)]
    reads = ["".join(rng.choice(word) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    return [*reads, "A" * 90, "AC" * 60, "ACGT" * 20, "TTTTT" + "A" * 40, "ACGNACGTTACGAACNNACGTAC", "acgtACGTAC", "ACéGTACGTACGTéACGTAAAC", "", None, "AC"]


def test_numbers():
    rng = random.Random(3)
    for k in (1, 2, 5, 11, 13, 14, 16, 17, 31):
        s = "".join(rng.choice("ACGT") for _ in range(50))
        f, r = coded.both_strands(np.array(["ACGT".index(c) for c in s], np.uint8), k)
        assert f.tolist() == [coded.number(s[i : i + k]) for i in range(51 - k)]
        assert r.tolist() == [coded.number(rc(s[i : i + k])) for i in range(51 - k)]


def test_chunks_equal_plain_cuts(monkeypatch):
    k, reads = 5, made(random.Random(10))
    bits = np.zeros(4**k, bool)
    bits[:90] = True
    bits = np.packbits(bits)
    plain = [s for s in reads if s and len(s) >= k]
    want = sorted(x for s in plain if set(s) <= set("ACGT") for x in coded._plain_cut(s, bits, k))
    for chunk in (64, 1 << 18):
        monkeypatch.setattr(coded, "CHUNK", chunk)
        got, odd = [], []
        for part in coded.texts(pa.RecordBatch.from_arrays([pa.array(reads)], names=["seq"]), k):
            if isinstance(part, str):
                odd.append(part)
                continue
            s = "".join("ACGT"[c] for c in part[0])
            for a, b, flip, is_open in zip(*(x.tolist() for x in coded._cut_chunk(*part, bits, k)[:4]), strict=True):
                got.append((rc(s[a:b]) if flip else s[a:b], is_open))
        assert sorted(got) == want and odd == [s for s in plain if not set(s) <= set("ACGT")]


def test_edges_equal_joined_ones(spark):
    k, reads = 5, made(random.Random(8))
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    found = sorted({min(x, rc(x)) for s in reads if s for x in (s[i : i + k] for i in range(len(s) - k + 1)) if set(x) <= set("ACGT")})
    for vertices in ([x for x in found if x[:2] in ("AA", "AC")], found[::17], found, found[:1]):
        v = spark.createDataFrame([(x,) for x in vertices], "kmer string")
        got, want = ([tuple(r) for r in f(df, v, k).collect()] for f in (sparse.sparse_edges, sparse.joined_edges))
        assert len(got) == len(want) and set(got) == set(want)
    odd = spark.createDataFrame([("ACGNA",), ("AACGT",)], "kmer string")
    assert {tuple(r) for r in sparse.sparse_edges(df, odd, k).collect()} == {tuple(r) for r in sparse.joined_edges(df, odd, k).collect()}


def test_distinct_kmers(spark):
    reads = made(random.Random(9))
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    for k in (1, 4, 10):
        one = {s[i : i + k] for s in reads if s for i in range(len(s) - k + 1)}
        for strands, want in (("one", one), ("canonical", {min(x, rc(x)) for x in one}), ("both", one | {rc(x) for x in one})):
            got = [r["kmer"] for r in coded.distinct_kmers(df, k, strands).collect()]
            assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["f4_resplit", "f5_tied_tips"])
def test_no_row_for_each_kmer(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def overlapping(rng, n=40):
    """Reads over ACGT that share ends, prefixes and repeats."""
    genome = "".join(rng.choice("ACGT") for _ in range(150)) + "A" * 25 + "AC" * 12
    genome += genome[20:60] + "".join(rng.choice("ACGT") for _ in range(60))
    reads = []
    for _ in range(n):
        i = rng.randrange(0, len(genome) - 12)
        s = genome[i : i + rng.randrange(12, 50)]
        reads.append(rc(s) if rng.random() < 0.4 else s)
    ring = "".join(rng.choice("ACGT") for _ in range(30))
    return [*reads, genome[40:90], genome[40:80], genome[60:90], ring + ring[:8], ring[10:] + ring[:18], "A" * 40, "ACGT"]


def turned(found, k):
    """Rings by their least turn, other paths as they are."""
    out = set()
    for s in found:
        if s[:k] == s[-k:]:
            body = s[:-k]
            body = min(body[i:] + body[:i] for i in range(len(body)))
            s = "ring " + body
        out.add(s)
    return out


def test_strands_and_permutation():
    for k in (2, 5, 9, 13):
        x = np.random.default_rng(1).integers(0, 4**k, 500).astype(np.uint32)
        assert (coded.unmixed(coded.mixed(x, k), k) == x).all() and coded.mixed(x, k).max() < 4**k
        assert pa.array([rc(s) for s in coded.spelled(x, k).to_pylist()]) == coded.spelled(coded.other_strand(x, k), k)


def test_paths_equal_joined_ones(spark, monkeypatch):
    from strandloom.operators import graph

    for seed, k, w in ((1, 5, 4), (3, 6, 3)):
        reads = overlapping(random.Random(seed))
        df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
        long = [s for s in reads if len(s) >= k + w - 1]
        own = df.filter(f"length(seq) >= {k + w - 1}")
        bits = coded.minimizer_bits(own, k, w)
        least = {min(range(i, i + w), key=lambda j: int(coded.mixed(np.array([min(coded.number(s[j : j + k]), coded.number(rc(s[j : j + k])))]), k)[0])) + 1000 * n for n, s in enumerate(long) for i in range(len(s) - k - w + 2)}
        want = {min(x, rc(x)) for x in (long[p // 1000][p % 1000 : p % 1000 + k] for p in least)}
        assert set(coded.spelled(np.flatnonzero(np.unpackbits(bits)), k).to_pylist()) == want
        vertices = spark.createDataFrame([(x,) for x in want], "kmer string")
        monkeypatch.setattr(sparse, "minimizer_vertices", lambda *_, v=vertices: v)
        joined = [r["seq"] for r in sparse._joined_disjointigs(own, k, w).collect()]
        found = [r["seq"] for r in sparse.disjointigs(df, k, w).collect()]
        assert turned(found, k) == turned(joined, k) and len(found) == len(joined)
        one = {r["seq"] for r in sparse.disjointigs(df, k, w, False).collect()}
        assert turned({x for s in one for x in (s, rc(s))}, k) == turned(joined, k)
        both = spark.createDataFrame(list(enumerate([*long, *map(rc, long)])), "read_id int, seq string")
        whole = [r["label"] for r in graph.contract(graph.edges_of(both, k + 1)).collect()]
        found = [tuple(r) for r in sparse.compacted(df, k, w).collect()]
        assert all((s[:k], s[-k:]) == (a, b) for a, b, s in found)
        assert turned([s for _, _, s in found], k) == turned(whole, k) and len(found) == len(whole)


def test_tied_edges(spark):
    k, reads = 5, [s for s in made(random.Random(12)) if not s or set(s) <= set("ACGT")]
    kmers = {min(x, rc(x)) for s in reads if s for x in (s[i : i + k] for i in range(len(s) - k + 1))}
    v = spark.createDataFrame([(x,) for x in sorted(kmers) if x[:2] == "AC"], "kmer string")
    for own in (reads, [*reads, "ACGNACGTTACGAACNNACGTAC"]):
        df = spark.createDataFrame(list(enumerate(own)), "read_id int, seq string")
        got, want = ([tuple(r) for r in x.collect()] for x in (sparse.tied_edges(df, v, k), sparse.tie_tips(sparse.joined_edges(df, v, k), v, k)))
        assert len(got) == len(want) and set(got) == set(want)


def test_other_symbols_are_joined(spark):
    k, w, reads = 5, 4, [*overlapping(random.Random(5), 6), "ACGTNACGGTTACGNACCA"]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    long = [s for s in reads if len(s) >= k + w - 1]
    spelled = {x[i : i + k] for s in long for x in (s, rc(s)) for i in range(len(s) - k + 1)}
    for found in (sparse.disjointigs(df, k, w).collect(), sparse.disjointigs(df, k, w, False).collect()):
        assert {s[i : i + k] for r in found for s in (r["seq"], rc(r["seq"])) for i in range(len(s) - k + 1)} == spelled
    assert coded.branches(df, k) is None and coded.minimizer_bits(df, k, w) is None


def test_projected(spark):
    from pyspark.sql import functions as F

    from strandloom.functions import sequences

    texts = ["Hello, World! zZyY", "", None, "ÄÖ ß é a\nB\tc 1234", "[`{@", "İıK"]
    df = spark.createDataFrame(list(enumerate(texts)), "read_id int, text string")
    want = df.select("read_id", sequences.project(F.col("text")).alias("seq"))
    assert sorted(map(tuple, coded.projected(df).collect())) == sorted(map(tuple, want.collect()))
