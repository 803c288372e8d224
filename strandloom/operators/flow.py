"""Multiplicities of edges as integral flows with lower bounds."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame

Edge = tuple[object, object, int, int]


def _path(out: dict, room: list[int], start, goal, banned: int = -1) -> list[int] | None:
    """A shortest path of arcs with room left; arc a ^ 1 is the reverse of a."""
    came = {start: None}
    queue = deque([start])
    while queue:
        v = queue.popleft()
        if v == goal:
            arcs = []
            while came[v] is not None:
                arc, v = came[v]
                arcs.append(arc)
            return arcs
        for arc, to in out[v]:
            if room[arc] > 0 and arc >> 1 != banned and to not in came:
                came[to] = (arc, v)
                queue.append(to)
    return None


def circulation(edges: list[Edge]) -> list[int] | None:
    """Integers between each edge's (from, to, low, high) bounds that balance at every vertex; None if there are none.

    What the lower bounds leave over or lack at a vertex comes from and goes to two extra vertices along shortest paths."""
    out, room, excess = defaultdict(list), [], defaultdict(int)

    def add(u, v, size):
        out[u].append((len(room), v))
        out[v].append((len(room) + 1, u))
        room.extend((size, 0))

    for u, v, low, high in edges:
        add(u, v, high - low)
        excess[v] += low
        excess[u] -= low
    source, sink = ("source",), ("sink",)
    need = 0
    for v, x in excess.items():
        if x > 0:
            add(source, v, x)
            need += x
        elif x < 0:
            add(v, sink, -x)
    while need:
        arcs = _path(out, room, source, sink)
        if arcs is None:
            return None
        much = min(room[a] for a in arcs)
        for a in arcs:
            room[a] -= much
            room[a ^ 1] += much
        need -= much
    return [low + room[2 * i + 1] for i, (_, _, low, _) in enumerate(edges)]


def fixed(edges: list[Edge], flow: list[int]) -> list[bool]:
    """Which edges have the same value in every circulation: those that no ring of changes runs through."""
    out, room = defaultdict(list), []
    for i, ((u, v, low, high), f) in enumerate(zip(edges, flow, strict=True)):
        out[u].append((2 * i, v))
        out[v].append((2 * i + 1, u))
        room.extend((high - f, f - low))
    found = []
    for i, (u, v, low, high) in enumerate(edges):
        up = room[2 * i] > 0 and _path(out, room, v, u, i) is not None
        down = room[2 * i + 1] > 0 and _path(out, room, u, v, i) is not None
        found.append(not (up or down))
    return found


def multiplicities(edges: DataFrame) -> DataFrame:
    """(component, edge, mult) of edges (component, edge, src, dst, low, high): the multiplicity where it follows from the bounds,
    else null, as in components that have no circulation.

    A component is solved as a whole in one task; cut the graph at edges known to be unique first, so that components are small."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = list(rows[["src", "dst", "low", "high"]].itertuples(index=False, name=None))
        flow = circulation(own)
        sure = fixed(own, flow) if flow is not None else [False] * len(own)
        values = [f if s else None for f, s in zip(flow or [0] * len(own), sure, strict=True)]
        return pd.DataFrame({"component": rows["component"], "edge": rows["edge"], "mult": pd.array(values, dtype="Int64")})

    kind = dict(edges.dtypes)
    return edges.select("component", "edge", "src", "dst", "low", "high").groupBy("component").applyInPandas(run, f"component {kind['component']}, edge {kind['edge']}, mult long")


def multiplicities_by_coverage(edges: DataFrame, reliable: float = 0.0) -> DataFrame:
    """(component, edge, mult) of edges (component, edge, src, dst, size, cov, cnt, unique): as ``multiplicities``, with bounds that follow from coverage.

    A unique edge has flow 1; its end outside the component is null. Others may occur once if they are below 1.4 times the least or 1.2 times the
    largest support of unique edges, whichever is more, and at least once from a coverage of ``reliable``. Where that has no solution and ``reliable`` is 0, edges occur from 0.9
    times the least or 0.7 times the largest support. At last, edges below 2.4 times the least support are held to two, where that can be solved."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        alone = rows["unique"].to_numpy(bool)
        cov = rows["cov"].to_numpy(float)
        entering = rows[alone & rows["dst"].notna().to_numpy()]
        support = [min(n, c) if s < 20000 else n for s, c, n in zip(entering["size"], entering["cov"], entering["cnt"], strict=True)]
        least, largest = min(support, default=100000), max(support, default=0)
        ends = [(None if pd.isna(u) else u, None if pd.isna(v) else v) for u, v in zip(rows["src"], rows["dst"], strict=True)]

        def solved(real: float, two: float) -> list[int | None] | None:
            one = max(least * 1.4, largest * 1.2)
            own = []
            for (u, v), c, unique in zip(ends, cov, alone, strict=True):
                high = 1 if unique or c < one else 2 if c < two else 10**9
                own.append((u, v, int(unique or c >= real), high))
            flow = circulation(own)
            return None if flow is None else [f if s else None for f, s in zip(flow, fixed(own, flow), strict=True)]

        real, values = reliable, solved(reliable, 0)
        if values is None and reliable == 0:
            real = min(least * 0.9, largest * 0.7)
            values = solved(real, 0)
        values = solved(real, 2.4 * least) or values or [None] * len(rows)
        return pd.DataFrame({"component": rows["component"], "edge": rows["edge"], "mult": pd.array(values, dtype="Int64")})

    kind = dict(edges.dtypes)
    return edges.select("component", "edge", "src", "dst", "size", "cov", "cnt", "unique").groupBy("component").applyInPandas(run, f"component {kind['component']}, edge {kind['edge']}, mult long")
