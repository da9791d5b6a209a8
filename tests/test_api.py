import json

import numpy as np

from loxo import api
from loxo.operators.routing import RouteParams
from loxo.plans.fixtures import views
from loxo.sources.rasters import corner, graph_tables, read_hgt, read_zones, stamped
from loxo.sources.sinks import geojson, gpx

SF = "/root/testdata/sf0.01"


def lattice(spark):
    v = views(spark, SF, "{geo_nodes} {geo_edges}")
    from pyspark.sql import functions as F

    return v["geo_nodes"], v["geo_edges"].withColumn("modes", F.lit(7))


def test_plan_and_explore(spark):
    n, e = lattice(spark)
    row = api.plan(n, e, (46.02, 7.03), (46.1, 7.18), RouteParams(half_width_m=20_000.0, corridor_max_m=30_000.0)).collect()[0]
    assert row.total_km >= 0.9 * row.ref_km and row.score > 0 and len(row.nodes) > 10
    start = spark.createDataFrame([(46.05, 7.1)], "slat double, slon double")
    c = api.fan(start, [0.0, 45.0, 90.0, 180.0, 270.0], [4.0, 5.0])
    got = api.explore(c, n, e, RouteParams(half_width_m=8000.0, corridor_max_m=9000.0), top=3, sep_km=1.0).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and 1 <= len(got) <= 3
    assert [r.score for r in got] == sorted(r.score for r in got)


def test_sources(spark, tmp_path):
    z = np.arange(1201 * 1201, dtype=np.int64).reshape(1201, 1201) % 3000
    z[600, 600] = -32768
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "N46E007.hgt").write_bytes(z.astype(">i2").tobytes())
    (tmp_path / "d" / "bad.hgt").write_bytes(b"xx")
    tiles = read_hgt(spark, str(tmp_path / "d"))
    pts = spark.createDataFrame([(1, 46.5, 7.5), (2, 46.25, 7.25), (3, 10.0, 7.0)], "id long, lat double, lon double")
    got = {r.id: r.elev_m for r in stamped(pts, tiles).collect()}
    assert got[2] == z[900, 300] and got[3] is None and got[1] is None
    assert spark.sql(f"select {corner("'S01W120'")} as c").collect()[0].c.asDict() == {"lat0": -1, "lon0": -120}
    square = [[[7.0, 46.0], [7.1, 46.0], [7.1, 46.1], [7.0, 46.0]], [[7.0, 46.0], [7.1, 46.0]]]
    (tmp_path / "park.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    zones = read_zones(spark, str(tmp_path / "park.geojson")).collect()
    assert len(zones) == 4 and {r.zone for r in zones} == {"park"} and zones[0].lon == 7.0


def test_graph_tables(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.001), (3, 0.0, 0.002), (9, 1.0, 1.0)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(10, [1, 2, 3], {"highway": "tertiary", "bicycle": "designated", "lcn": "yes"}), (11, [1, 9], {"highway": "motorway"}), (12, [1, 9, 3], {"natural": "glacier", "highway": "path"})], "id long, nodes array<long>, tags map<string,string>")
    n, e = graph_tables(nodes, ways)
    assert {r.node_id for r in n.collect()} == {1, 2, 3} and e.count() == 4
    assert {r.bike_attrs for r in e.collect()} == {2 + 16 + 32}


def test_sinks(spark):
    p = spark.createDataFrame([(1, 2, 46.5, 7.25, "x"), (1, 1, 46.0, 7.0, "x")], "route_id long, seq int, lat double, lon double, label string")
    text = gpx(p).collect()[0].gpx
    assert text.index('lat="46.0000000"') < text.index('lat="46.5000000"')
    g = json.loads(geojson(p, properties=["label"]).collect()[0].geojson)
    assert g["geometry"]["coordinates"] == [[7.0, 46.0], [7.25, 46.5]] and g["properties"] == {"route_id": 1, "label": "x"}


def test_nearest_nodes_however_far(spark):
    """Sparse nodes, dense ones and points far outside, against all pairs."""
    import random

    from loxo.operators.nearest import nearest_nodes

    rnd = random.Random(4)
    nodes = [(i, 46 + rnd.random() / 20, 7 + rnd.random() / 20) for i in range(60)] + [(100 + i, 46 + 3 * rnd.random(), 7 + 3 * rnd.random()) for i in range(15)]
    points = [(0, 46.02, 7.02), (1, 48.5, 9.5), (2, 30.0, -20.0), (3, 46.02, 7.02), (4, 46.3, 7.3)]
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    n = spark.createDataFrame(nodes, "node_id long, nlat double, nlon double")
    got = {}
    for r in nearest_nodes(p, n, ["id"], 30).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.node_id
    for i, lat, lon in points:
        want = sorted(((lat - a) * (lat - a) + (lon - b) * (lon - b), k) for k, a, b in nodes)[:30]
        assert [got[i][k + 1] for k in range(30)] == [k for _, k in want]
    few = nearest_nodes(p, n.limit(3), ["id"], 30)
    assert few.count() == 15 and nearest_nodes(p, n.limit(0), ["id"], 30).count() == 0
