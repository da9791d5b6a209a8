import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loxo.functions import geodesy as G
from loxo.operators import path as P
from loxo.operators import components
from loxo.operators.components import connected_components
from loxo.operators.routing import Graph, RouteParams, edge_costs, route, route_in_cells, search
from loxo.plans.session import cut


def value(spark, sql):
    return spark.sql(f"select {sql} as x").collect()[0].x


def graph(points, edges, elev=None):
    """points: (lat, lon); edges: (a, b, modes, surface, class), both ways."""
    nodes = pd.DataFrame({"node_id": range(len(points)), "lat": [p[0] for p in points], "lon": [p[1] for p in points], "elev_m": elev or [None] * len(points)})
    rows = [(s, d, m, su, c, i) for i, (a, b, m, su, c) in enumerate(edges) for s, d in ((a, b), (b, a))]
    return nodes, pd.DataFrame(rows, columns=["src", "dst", "modes", "surface", "bike_attrs", "way_id"])


def found(points, edges, start, end, modes, elev=None, **kw):
    g = Graph.of(*graph(points, edges, elev))
    p = RouteParams(modes=modes, **kw)
    r = search(g, start, end, edge_costs(g, points[start], points[end], p), modes & 6 != 0)
    return r and r[1]


def test_geodesy(spark):
    pt = lambda a, o: (G.num(a), G.num(o))
    assert value(spark, G.haversine(pt(46.2044, 6.1432), pt(47.3769, 8.5417))) == pytest.approx(224_000, abs=5000)
    assert abs(value(spark, G.cross_track(pt(47.0, 8.0), pt(46.0, 8.0), pt(48.0, 8.0)))) < 100
    a, b = pt(46.17, 8.79), pt(47.68, 8.62)
    assert value(spark, G.in_corridor(pt(47.0, 8.7), a, b, G.num(10_000.0))) is True
    assert value(spark, G.in_corridor(pt(47.0, 6.0), a, b, G.num(10_000.0))) is False
    for d in (0.0005, 0.002, 0.02):
        for k in range(12):
            q = pt(46.9 + d * math.cos(k * math.pi / 6), 7.45 + d * math.sin(k * math.pi / 6))
            x, y = value(spark, G.bearing(pt(46.9, 7.45), q)), value(spark, G.fast_bearing(pt(46.9, 7.45), q))
            assert abs((x - y + math.pi) % (2 * math.pi) - math.pi) < 0.01


def test_corridor_and_choices():
    line = [(0.0, 0.0), (0.0, 1.0)]
    for shift, ok in ((1.0, False), (0.02, True)):
        pts = [*line, (shift, 0.33), (shift, 0.66)]
        got = found(pts, [(0, 2, 3, 0, 1), (2, 3, 3, 0, 1), (3, 1, 3, 0, 1)], 0, 1, 1, half_width_m=5000.0, corridor_max_m=5000.0)
        assert (got is not None) == ok
    smooth = [(0, 0), (0, 0.001), (0, 0.002), (0.0005, 0.001)]
    assert found(smooth, [(0, 1, 7, 0, 1), (1, 2, 7, 0, 1), (0, 3, 7, 0, 1), (3, 2, 7, 0, 1)], 0, 2, 2) == [0, 1, 2]
    cyc = [(0, 0), (0, 0.002), (0.0005, 0.001), (-0.0005, 0.001)]
    edges = [(0, 2, 7, 0, 5), (2, 1, 7, 0, 5), (0, 3, 7, 0, 0), (3, 1, 7, 0, 0)]
    assert found(cyc, edges, 0, 1, 2) == [0, 3, 1] and len(found(cyc, edges, 0, 1, 1)) == 3
    detour = [(0, 0), (0, 0.002), (0.001, 0.001)]
    edges = [(0, 1, 7, 2, 7), (0, 2, 7, 0, 1), (2, 1, 7, 0, 1)]
    assert len(found(detour, edges, 0, 1, 2)) == 3 and len(found(detour, edges, 0, 1, 4)) == 2
    hill = [(0, 0), (0, 0.002), (0.0005, 0.001), (-0.0005, 0.001)]
    edges = [(0, 2, 7, 0, 1), (2, 1, 7, 0, 1), (0, 3, 7, 0, 1), (3, 1, 7, 0, 1)]
    assert found(hill, edges, 0, 1, 2, elev=[100.0, 100.0, 100.0, 110.0]) == [0, 2, 1]
    assert found([(0, 0), (0, 0.001), (0, 0.002)], [(0, 1, 7, 0, 1), (1, 2, 7, 0, 1)], 0, 2, 2) == [0, 1, 2]


def test_broadcast_and_cells_agree(spark):
    pts = [(46 + 0.01 * (i // 12), 7 + 0.01 * (i % 12)) for i in range(144)]
    edges = [(i, i + 1, 7, i % 3, i % 7) for i in range(144) if i % 12 < 11] + [(i, i + 12, 7, i % 4, i % 6) for i in range(132)]
    n, e = (spark.createDataFrame(x) for x in graph(pts, edges, [float(i * 37 % 90) for i in range(144)]))
    c = spark.createDataFrame([(k, k, 143 - k, *map(float, pts[k]), *map(float, pts[143 - k])) for k in range(6)], "candidate long, start_node long, end_node long, slat double, slon double, elat double, elon double")
    p = RouteParams(modes=2, half_width_m=3000.0, corridor_max_m=5000.0)
    a, b = (sorted((r.candidate, round(r.cost, 3), tuple(r.nodes)) for r in f(c, n, e, p).collect()) for f in (route, route_in_cells))
    assert a == b and len(a) == 6


def test_path_kernels():
    nodes = [0, 1, 2, 3, 1, 4]
    assert [nodes[i] for i in P.erase_revisits(nodes)] == [0, 1, 4]
    assert P.erase_revisits([0, 1, 2, 3]) == [0, 1, 2, 3]
    nodes = [0, 1, 2, 1, 3, 1, 4]
    assert [nodes[i] for i in P.erase_revisits(nodes)] == [0, 1, 4]
    t = np.linspace(0, 2 * math.pi, 21)
    lobe_lat, lobe_lon = 0.0005 * (1 - np.cos(t)), 0.0005 * np.sin(t)
    assert len(P.cut_lobes(lobe_lat, lobe_lon, 30, 100)) < 21
    assert len(P.cut_lobes(np.zeros(30), np.arange(30) * 0.001, 30, 250)) == 30
    arc = np.linspace(0, math.pi, 13)
    assert 2 <= len(P.simplified(5000 * np.cos(arc), 5000 * np.sin(arc), 0.12 * 15_000)) <= 5
    ring = np.linspace(0, 2 * math.pi, 17)
    assert len(P.simplified(4000 * np.cos(ring), 4000 * np.sin(ring), 0.12 * 25_000)) >= 4
    assert [len(r) for r in P.stitched([[1, 2], [4, 1], [2, 3, 4]])] == [5]
    assert sorted(P.stitched([[1, 2], [2, 3], [3, 1]])[0][:-1]) == [1, 2, 3]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in up}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), cut)
    assert {r.node: r.component for r in got.collect()} == want
    # Many small tasks, so that components reach across them; and nodes that are strings.
    texts = [(f"{a:05}", f"{b:05}") for a, b in edges]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = connected_components(spark.createDataFrame(texts, "a string, b string").repartition(7), cut)
        assert {int(r.node): int(r.component) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert connected_components(spark.createDataFrame([], "a long, b long"), cut).collect() == []


def test_few_edges_over_many_partitions(spark, monkeypatch):
    """One task labels a graph, in parts of HELD edges, with one write and one go of Python."""
    monkeypatch.setattr(components, "HELD", 5)
    edges = [(i + 1, i) for i in range(40, 0, -1)] + [(90, 80), (70, 80), (7, 7), (99, 99)]
    goes, cuts = spark.sparkContext.accumulator(0), []
    labelled = components._labelled

    def counted(parts):
        goes.add(1)
        return labelled(parts)

    monkeypatch.setattr(components, "_labelled", counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(30), lambda df: cuts.append(1) or cut(df), tasks=1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {i: 1 for i in range(1, 42)} | {70: 70, 80: 70, 90: 70, 99: 99}
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    assert len(cuts) == 1 and goes.value == 1


def test_stars_in_several_holds(monkeypatch):
    monkeypatch.setattr(components, "HELD", 3)
    chain = pd.DataFrame({"a": range(1, 9), "b": range(8)})
    got = list(components._contracted(iter([chain[:2], chain[2:3], chain[3:]])))
    assert [sorted(zip(x.a, x.b)) for x in got] == [[(1, 0), (2, 0), (3, 0)], [(4, 3), (5, 3), (6, 3), (7, 3), (8, 3)]]


def test_smoothing_round(spark):
    from loxo.queries import _smooth

    n = spark.createDataFrame([(0, 100.0), (1, 200.0), (2, 100.0), (3, None)], "node_id long, elev_m double")
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src long, dst long")
    got = {r.node_id: r.z for r in spark.sql(_smooth(1), geo_nodes=n, geo_edges=e).collect()}
    assert got[0] == got[2] == 150 and got[1] == pytest.approx(400 / 3) and got[3] is None
    assert F is not None


def literal_returns(lat, lon, gap, near, along, least, most, around):
    """The rule of loops and tails word by word, in plain loops."""
    if len(lat) < least:
        return 0
    stride = max(len(lat) // most, 1)
    p = [(lat[i], lon[i]) for i in range(0, len(lat), stride)]
    walked = [0.0]
    for x, y in zip(p, p[1:]):
        walked.append(walked[-1] + float(P.metres(*x, *y)))
    used, found = set(), 0
    for i in range(len(p)):
        if i in used:
            continue
        for j in range(i + gap, len(p)):
            if j not in used and walked[j] - walked[i] > along and P.metres(*p[i], *p[j]) <= near:
                found += 1
                used.update(range(max(0, i - around[0]), min(j + around[1] + 1, len(p))))
                break
    return found


def literal_lobes(lat, lon, radius, least):
    n, keep = len(lat), set(range(len(lat)))
    if n < 20:
        return sorted(keep)
    cum = P.running(lat, lon)
    for i in range(n):
        if i in keep:
            back = [j for j in range(i + 5, n) if j in keep and least <= cum[j] - cum[i] <= 20 * least and P.metres(lat[i], lon[i], lat[j], lon[j]) <= radius]
            keep -= set(range(i + 1, back[-1] + 1)) if back else set()
    return sorted(keep)


def test_loops_tails_and_lobes_word_by_word():
    rng = np.random.default_rng(9)
    seen = set()
    for n in (15, 25, 70, 199, 300, 1000, 1300, 1700):
        for _ in range(3):
            lat, lon = 46 + np.cumsum(rng.normal(0, 4e-4, n)), 7 + np.cumsum(rng.normal(0, 4e-4, n))
            a, b = P.tails(lat, lon), P.detour_loops(lat, lon)
            assert a == literal_returns(lat, lon, 10, 30.0, 300.0, 20, 800, (1, 1))
            assert b == literal_returns(lat, lon, 30, 60.0, 1500.0, 200, 600, (2, 2))
            seen |= {a > 0, b > 0}
            if n <= 300:
                assert P.cut_lobes(lat, lon) == literal_lobes(lat, lon, 60.0, 200.0)
    assert seen == {True, False}


def test_rings_of_many_ways():
    rng = np.random.default_rng(2)
    rings = [list(range(100 * k, 100 * k + int(rng.integers(3, 60)))) for k in range(40)]
    ways = []
    for r in rings:
        closed, at = [*r, r[0]], 0
        while at < len(r):
            to = min(at + int(rng.integers(1, 20)), len(r))
            ways.append(closed[at : to + 1][:: int(rng.choice([-1, 1]))])
            at = to
    ways += [[9000, 9001], [9001, 9002], []]
    got = P.stitched([ways[i] for i in rng.permutation(len(ways))])
    assert all(r[0] == r[-1] for r in got) and sorted(sorted(r[:-1]) for r in got) == sorted(rings)
