"""Correction along graphs, and flows, against plain versions."""

import itertools
import random

from pyspark.sql import functions as F

from strandloom.operators import correction as C
from strandloom.operators import flow as W
from strandloom.operators import graph as G
from strandloom.operators import paths as P


def test_reads_are_corrected(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(260))
    good = [genome[i : i + 120] for i in (0, 20, 40, 60, 80, 100, 120, 140)] * 3
    changed = genome[30:90] + "ACGT"["TGCA".index(genome[90])] + genome[91:150]
    missing = genome[60:120] + genome[121:180]
    end = genome[100:158] + "ACGT"["TGCA".index(genome[158])]
    reads = good + [changed, missing, end, "ACG"]
    table = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string").cache()
    edges = P.identified(G.contract(G.edges_of(table, 13))).cache()
    found = {r["read_id"]: (r["seq"], r["n"]) for r in C.corrected(table, edges, 13, 3).collect()}
    n = len(good)
    assert all(found[i] == (good[i], 0) for i in range(n))
    assert found[n] == (genome[30:150], 1) and found[n + 1] == (genome[60:180], 1)
    assert found[n + 2] == (end, 0) and found[n + 3] == ("ACG", 0)


def test_alternatives_match_plain(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", f"v{rng.randrange(6)}", f"v{rng.randrange(6)}", rng.randint(1, 4), rng.randint(1, 6)) for i in range(14)]
    table = spark.createDataFrame([(e, u, v, u + "x" * n, cov, 1) for e, u, v, n, cov in rows], "edge_id string, src string, dst string, label string, cov long, n long")
    asked = [(f"{u}>{v}", f"v{u}", f"v{v}", 4, 7) for u in range(6) for v in range(6)]
    found = {}
    for r in C.alternatives(table, spark.createDataFrame(asked, "key string, src string, dst string, low long, high long"), 3, most=4).collect():
        found.setdefault(r["key"], set()).add(tuple(r["path"]))
    want = {}
    for key, u, v, low, high in asked:
        todo = [(u, 0, ())]
        while todo:
            at, size, path = todo.pop()
            if path and at == v and size >= low:
                want.setdefault(key, set()).add(path)
            todo += [(b, size + n, (*path, e)) for e, a, b, n, cov in rows if a == at and cov >= 3 and size + n <= high]
    want = {key: paths for key, paths in want.items() if len(paths) <= 4}
    assert want and found == want


def test_flows_match_enumeration(spark):
    rng = random.Random(1)
    solved, rows, expected = 0, [], {}
    for trial in range(60):
        edges = [(rng.randrange(4), rng.randrange(4), (low := rng.randint(0, 1)), low + rng.randint(0, 2)) for _ in range(6)]
        every = []
        for values in itertools.product(*[range(low, high + 1) for _, _, low, high in edges]):
            balance = [0] * 4
            for (u, v, _, _), f in zip(edges, values):
                balance[u] -= f
                balance[v] += f
            if not any(balance):
                every.append(values)
        flow = W.circulation(edges)
        assert (flow is not None) == bool(every)
        sure = [None] * 6
        if flow is not None:
            solved += 1
            assert tuple(flow) in every
            same = [len({x[i] for x in every}) == 1 for i in range(6)]
            assert W.fixed(edges, flow) == same
            sure = [flow[i] if same[i] else None for i in range(6)]
        rows += [(trial, i, str(u), str(v), low, high) for i, (u, v, low, high) in enumerate(edges)]
        expected |= {(trial, i): x for i, x in enumerate(sure)}
    assert solved > 5
    table = spark.createDataFrame(rows, "component long, edge long, src string, dst string, low long, high long")
    assert {(r["component"], r["edge"]): r["mult"] for r in W.multiplicities(table).collect()} == expected
