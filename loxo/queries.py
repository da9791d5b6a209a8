"""Named queries over the domain views.

``both`` holds SQL that Spark and the comparison engine read alike; where they
differ (generators, array functions) a query has a text for either, made from
the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import cost as C
from .functions import geodesy as G
from .functions import tags as T
from .plans.fixtures import portable, views

SPARK, DUCK = "spark", "duck"
WAY = {"route": "route", "highway": "highway", "surface": "surface_tag", "tracktype": "tracktype", "bicycle": "bicycle", "foot": "foot", "access": "access", "lcn": "lcn", "rcn": "rcn", "ncn": "ncn"}


def gen(engine: str, name: str, lo: str, hi: str, column: str = "i") -> str:
    """A lateral generator of lo..hi inclusive, for the from clause."""
    if engine == SPARK:
        return f" lateral view explode(sequence(cast({lo} as int), cast({hi} as int))) {name} as {column}"
    return f", unnest(range(cast({lo} as bigint), cast({hi} as bigint) + 1)) as {name}({column})"


def m(x: str) -> str:
    return f"round({x}, 3)"


def deg(x: str) -> str:
    return f"round({x}, 6)"


S, E, P = ("slat", "slon"), ("elat", "elon"), ("lat", "lon")
both: dict[str, str] = {}
pairs: dict[str, Callable[[str], str]] = {}

both["geo_haversine"] = f"select candidate, {m(G.haversine(S, E))} as dist_m from {{candidates}}"
both["geo_bearing"] = f"select candidate, {deg(f'degrees({G.bearing(S, E)})')} as bearing_deg, {deg(f'degrees({G.fast_bearing(S, E)})')} as fast_deg, {deg(G.normal_degrees(f'degrees({G.bearing(S, E)})'))} as norm_deg, {deg(G.degrees_apart(f'degrees({G.bearing(S, E)})', 'cast(170 as double)'))} as apart_deg from {{candidates}}"
_line = "(select z.zone, z.clat as lat, z.clon as lon, c.* from {zones} z join {candidates} c on c.candidate % 25 = z.zone)"
both["geo_cross_along_track"] = f"select candidate, zone, {m(G.cross_track(P, S, E))} as cross_m, {m(G.along_track(P, S, E))} as along_m from {_line} x"
both["geo_destination"] = "select candidate, {} as lat, {} as lon from {{candidates}}".format(*(deg(x) for x in G.destination(S, G.bearing(S, E), "cast(12345 as double)")))
both["geo_segment_distance"] = f"select candidate, zone, {m(G.segment_distance(P, S, E))} as dist_m from {_line} x"
both["geo_project_offset"] = "select candidate, {} as lat, {} as lon from {{candidates}}".format(*(deg(x) for x in G.project_offset(S, G.bearing(S, E), "cast(candidate * 10 + 5 as double)", "cast(250 as double)")))
both["corridor_filter"] = f"select candidate, zone, {G.in_corridor(P, S, E, 'cast(4000 as double)')} as inside from {_line} x"
both["tag_classify"] = f"select way_id, {T.modes(WAY, 7)} as modes, {T.modes(WAY, 2)} as bike_modes, {T.way_surface(WAY)} as surface, {T.bike_attrs(WAY)} as bike_attrs from {{geo_ways}}"

_msg = "case o_orderpriority when '1-URGENT' then 'Endpoint too far from graph: start 9 m' when '2-HIGH' then 'max deviation 9 m exceeds corridor half-width 5 m' when '3-MEDIUM' then 'no-go: zone' when '5-LOW' then 'routed distance 5 km above maximum 4 km' else case o_orderstatus when 'F' then 'graph empty' when 'O' then 'leg 2: no-go zone' else 'shape fidelity cap' end end"
both["reject_buckets"] = f"select grp % 7 as batch, {', '.join(f'sum(case when bucket = {n!r} then 1 else 0 end) as {n}' for n in [b for b, _ in T.BUCKETS] + ['other'])}, count(*) as total from (select grp, {T.reject_bucket('msg')} as bucket from (select grp, {_msg} as msg from {{scored}}) a) b group by grp % 7"
pairs["alpha_sweep"] = lambda e: f"select n, i, {deg(T.alpha('n', 'i'))} as alpha from (select n_nationkey + 1 as n from {{nation}} where n_nationkey < 9) a{gen(e, 'g', '0', 'n - 1')}"
pairs["parse_modes"] = lambda e: (
    f"select id, bit_or(bit) as modes, count(*) - count(bit) as unknown from (select id, {T.mode_bit('trim(lower(token))')} as bit from (select p_partkey as id, "
    + ("explode(split(spec, ','))" if e == SPARK else "unnest(string_split(spec, ','))")
    + " as token from (select p_partkey, case p_size % 5 when 0 then 'Foot,bike' when 1 then 'mtb' when 2 then 'walk, ,gravel' when 3 then 'cycle,swim' else 'hike,BICYCLE,mtb' end as spec from {part}) a) b) c group by id"
)


def _fan(e: str) -> str:
    point = G.destination(S, "radians(bearing)", "dist_km * 1000")
    return (
        f"select candidate, bearing, dist_km, {deg(point[0])} as elat, {deg(point[1])} as elon from (select c.*, {G.normal_degrees('cast(320 + 5 * b as double)')} as bearing, cast(80 + 20 * d as double) as dist_km "
        f"from {{candidates}} c{gen(e, 'gb', '0', '16', 'b')}{gen(e, 'gd', '0', '6', 'd')}) x"
    )


pairs["fan_candidates"] = _fan
both_lcg = lambda x: f"(cast({x} as bigint) * 1103515245 + 12345) % 2147483648"


def _bbox(e: str) -> str:
    h = lambda k: f"cast({both_lcg(f'(attempt * {7919 + 1013 * k} + batch * {104729 + 577 * k} + {7907 * k}) % 1000003')} as double) / 2147483648"
    d = G.haversine(("slat", "slon"), ("elat", "elon"))
    return (
        f"select batch, attempt, {deg('slat')} as slat, {deg('slon')} as slon, {deg('elat')} as elat, {deg('elon')} as elon, {m(d)} as dist_m, row_number() over (partition by batch order by attempt) as pick from ("
        f"select batch, attempt, 46 + {h(1)} as slat, 7 + 2 * {h(2)} as slon, 46 + {h(3)} as elat, 7 + 2 * {h(4)} as elon from (select n_nationkey as batch, i as attempt from {{nation}}{gen(e, 'g', '0', '1999')}) a) b "
        f"where {d} between 30000 and 60000"
    )


pairs["bbox_candidates"] = lambda e: f"select * from ({_bbox(e)}) q where pick <= 25"


def _border(e: str) -> str:
    h = lambda k: f"cast({both_lcg(f'(attempt * {7919 + 1013 * k} + batch * {104729 + 577 * k} + {7907 * k}) % 1000003')} as double) / 2147483648"
    strip = "cast(5 as double) / 111"
    lon_strip = f"{strip} / greatest(cos(radians(cast(46.5 as double))), cast(0.1 as double))"
    lat = lambda s, u, v: f"case {s} when 0 then 47 - {u} * {strip} when 2 then 46 + {u} * {strip} else 46 + {v} end"
    lon = lambda s, u, v: f"case {s} when 1 then 9 - {u} * {lon_strip} when 3 then 7 + {u} * {lon_strip} else 7 + 2 * {v} end"
    return (
        f"select batch, attempt, s1, s2, {deg(lat('s1', 'u1', 'v1'))} as slat, {deg(lon('s1', 'u1', 'v1'))} as slon, {deg(lat('s2', 'u2', 'v2'))} as elat, {deg(lon('s2', 'u2', 'v2'))} as elon from ("
        f"select batch, attempt, (attempt * 31 + batch) % 4 as s1, (attempt * 17 + batch * 3 + 1) % 4 as s2, {h(1)} as u1, {h(2)} as v1, {h(3)} as u2, {h(4)} as v2 from (select n_nationkey as batch, i as attempt from {{nation}}{gen(e, 'g', '0', '199')}) a) b where s1 <> s2"
    )


pairs["border_candidates"] = _border


def _sampled(e: str, step: int = 2000) -> str:
    x = f"select c.*, {G.haversine(S, E)} as total, {G.bearing(S, E)} as theta from {{candidates}} c"
    n = f"case when total < {step} then 1 else ceil(total / {step}) end"
    y = f"select candidate, slat, slon, elat, elon, theta, total, {n} as n, i from ({x}) x{gen(e, 'g', '0', n)}"
    d = G.destination(S, "theta", "total * i / n")
    end = f"(total < {step} and i = 1)"
    return f"select candidate, cast(i as bigint) as i, n, case when {end} then elat else {d[0]} end as lat, case when {end} then elon else {d[1]} end as lon from ({y}) y"


pairs["geo_sample_line"] = lambda e: f"select candidate, i, {deg('lat')} as lat, {deg('lon')} as lon from ({_sampled(e)}) s"


def _ring(e: str) -> str:
    w = "over (partition by candidate order by i)"
    q = f"select *, coalesce(lead(lat) {w}, lat) as nlat, coalesce(lead(lon) {w}, lon) as nlon, lag(lat) {w} as plat, lag(lon) {w} as plon from ({_sampled(e, 5000)}) s"
    b = f"case when i < n then {G.bearing(P, ('nlat', 'nlon'))} else {G.bearing(('plat', 'plon'), P)} end"
    left, right = (G.destination(P, f"(theta {s} pi() / 2)", "cast(2500 as double)") for s in "-+")
    t = f"select candidate, i, n, lat, lon, {b} as theta from ({q}) q"
    one = lambda point, pos, extra="": f"select candidate, cast({pos} as bigint) as pos, {deg(point[0])} as lat, {deg(point[1])} as lon from ({t}) t{extra}"
    return f"{one(left, 'i')} union all {one(right, '2 * n + 1 - i')} union all {one(left, '2 * n + 2', ' where i = 0')}"


pairs["corridor_ring"] = _ring


def _polygon(e: str) -> str:
    star = "case when i % 2 = 0 then 1 else cast(0.4 as double) end"
    heart_x, heart_y = "16 * power(sin(t), 3)", "(13 * cos(t) - 5 * cos(2 * t) - 2 * cos(3 * t) - cos(4 * t))"
    kinds = [("circle", 16, "sin(t)", "cos(t)"), ("triangle", 3, "sin(t)", "cos(t)"), ("square", 4, "sin(t)", "cos(t)"), ("star", 10, f"{star} * sin(t)", f"{star} * cos(t)"), ("heart", 32, heart_x, heart_y), ("eight", 64, "sin(t) * cos(t)", "sin(t)")]
    rows = " union all ".join(f"select '{k}' as kind, i, {x} as x, {y} as y from (select i, 2 * pi() * i / {n} as t from (select 1 as one) o{gen(e, 'g', '0', str(n))}) a" for k, n, x, y in kinds)
    return f"select kind, i, x / r as x, y / r as y from (select *, max(sqrt(x * x + y * y)) over (partition by kind) as r from ({rows}) u) v"


pairs["shape_vertices"] = lambda e: f"select kind, cast(i as bigint) as i, {deg('x + 0')} as x, {deg('y + 0')} as y from ({_polygon(e)}) p"


def _placed(e: str) -> str:
    per = f"select kind, sum(case when px is null then 0 else sqrt((x - px) * (x - px) + (y - py) * (y - py)) end) as perimeter from (select *, lag(x) over (partition by kind order by i) as px, lag(y) over (partition by kind order by i) as py from ({_polygon(e)}) p) q group by kind"
    d = G.destination(S, "atan2(x, y) + radians(cast(30 as double))", "cast(50000 as double) / perimeter * sqrt(x * x + y * y)")
    zero = "x * x + y * y < cast(0.000000000001 as double)"
    # The shapes are a fixed table, placed at every candidate.
    hint = "/*+ broadcast(p), broadcast(r) */ " if e == SPARK else ""
    return f"select {hint}candidate, p.kind, cast(i as bigint) as i, {deg(f'case when {zero} then slat else {d[0]} end')} as lat, {deg(f'case when {zero} then slon else {d[1]} end')} as lon from ({_polygon(e)}) p join ({per}) r on p.kind = r.kind cross join {{candidates}} c"


pairs["shape_placed"] = _placed


def _ways(e: str) -> str:
    big = "(select max(c_custkey) + 1 as n from {customer})"
    return f"select w.way_id, i as pos, (w.p_partkey * 13 + i * 7) % b.n as node_id from {{geo_ways}} w cross join {big} b{gen(e, 'g', '0', '1 + w.p_size % 6')} where coalesce(w.natural_tag, '') <> 'glacier' and {T.modes(WAY, 7)} <> 0"


def _way_edges(e: str) -> str:
    # The one-row bound joins before the generator, so ways fan out only to their own nodes.
    steps = f"select way_id, pos, node_id as src, lead(node_id) over (partition by way_id order by pos) as dst from ({_ways(e)}) w"
    d = G.haversine(("a.lat", "a.lon"), ("b.lat", "b.lon"))
    return f"select s.way_id, cast(s.pos as bigint) as pos, s.src, s.dst, {m(d)} as length_m from ({steps}) s join {{geo_nodes}} a on a.node_id = s.src join {{geo_nodes}} b on b.node_id = s.dst where {d} > 0"


pairs["way_edges"] = _way_edges
pairs["graph_node_set"] = lambda e: f"select distinct node_id from (select src as node_id from ({_way_edges(e)}) a union all select dst as node_id from ({_way_edges(e)}) b) c"
both["graph_bbox"] = f"select {deg('min(lat)')} as lat0, {deg('max(lat)')} as lat1, {deg('min(lon)')} as lon0, {deg('max(lon)')} as lon1, {deg('min(lat) - cast(0.1 as double)')} as padded0, count(*) as n from {{geo_nodes}}"

# Point in polygon: zones are hexagons; cells of 1/20 degree bring points and zones together before the exact test.
_corners = " union all ".join(f"select zone, {k} as k, clat + half * {{}} as lat, clon + half * {{}} as lon from {{{{zones}}}}".format(f"cos(radians(cast({60 * k} as double)))", f"sin(radians(cast({60 * k} as double)))") for k in range(7))


def _inside(e: str, points: str) -> str:
    """(key.., zone) for points(id, lat, lon): crossing parity over the zone's edges."""
    box = f"select zone, min(lat) as lat0, max(lat) as lat1, min(lon) as lon0, max(lon) as lon1 from ({_corners}) c group by zone"
    cells = f"select zone, cy, cx from (select * from ({box}) b{gen(e, 'gy', 'floor(lat0 * 20)', 'floor(lat1 * 20)', 'cy')}{gen(e, 'gx', 'floor(lon0 * 20)', 'floor(lon1 * 20)', 'cx')}) d"
    edges = f"select zone, lat as y0, lon as x0, lead(lat) over (partition by zone order by k) as y1, lead(lon) over (partition by zone order by k) as x1 from ({_corners}) c"
    near = f"select p.id, p.lat, p.lon, c.zone from ({points}) p join ({cells}) c on cast(floor(p.lat * 20) as bigint) = c.cy and cast(floor(p.lon * 20) as bigint) = c.cx"
    cross = "case when (y0 > lat) <> (y1 > lat) and lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0 then 1 else 0 end"
    return f"select n.id, n.zone from ({near}) n join (select * from ({edges}) f where y1 is not null) e on e.zone = n.zone group by n.id, n.zone, n.lat, n.lon having sum({cross}) % 2 = 1"


_mid = "select concat(src, '-', dst) as id, (slat + dlat) / 2 as lat, (slon + dlon) / 2 as lon from {geo_edges}"
pairs["glacier_anti"] = lambda e: f"select e.src, e.dst from {{geo_edges}} e left join (select distinct id from ({_inside(e, _mid)}) i) z on z.id = concat(e.src, '-', e.dst) where z.id is null"
_route_pts = "select route_id * 100 + seq as id, lat, lon from {route_points}"
pairs["nogo_points"] = lambda e: f"select cast(floor(id / 100) as bigint) as route_id, zone, count(*) as n_points from ({_inside(e, _route_pts)}) i group by cast(floor(id / 100) as bigint), zone"


def _hits(e: str) -> str:
    """Routes that touch a zone: a step crosses one of its edges, or a point lies inside."""
    step = f"select route_id, seq, plat, plon, lat, lon from ({_steps}) s where plat is not null"
    cells = f"select * from ({step}) s{gen(e, 'gy', 'floor(least(plat, lat) * 20)', 'floor(greatest(plat, lat) * 20)', 'cy')}{gen(e, 'gx', 'floor(least(plon, lon) * 20)', 'floor(greatest(plon, lon) * 20)', 'cx')}"
    edges = f"select zone, lat as y0, lon as x0, lead(lat) over (partition by zone order by k) as y1, lead(lon) over (partition by zone order by k) as x1 from ({_corners}) c"
    near = f"select * from (select * from ({edges}) f where y1 is not null) e{gen(e, 'hy', 'floor(least(y0, y1) * 20)', 'floor(greatest(y0, y1) * 20)', 'ey')}{gen(e, 'hx', 'floor(least(x0, x1) * 20)', 'floor(greatest(x0, x1) * 20)', 'ex')}"
    side = lambda a, b, p: f"(({b[1]} - {a[1]}) * ({p[0]} - {a[0]}) - ({b[0]} - {a[0]}) * ({p[1]} - {a[1]}))"
    s0, s1, z0, z1 = ("plat", "plon"), ("lat", "lon"), ("y0", "x0"), ("y1", "x1")
    crossing = f"{side(s0, s1, z0)} * {side(s0, s1, z1)} <= 0 and {side(z0, z1, s0)} * {side(z0, z1, s1)} <= 0"
    return f"select distinct route_id, zone from (select route_id, zone from ({cells}) c join ({near}) n on c.cy = n.ey and c.cx = n.ex where {crossing} union all select cast(floor(id / 100) as bigint) as route_id, zone from ({_inside(e, _route_pts)}) i) u"


def _knn(k: int) -> str:
    """For the other engine: all nodes of all ends, ranked."""
    d2 = "(n.lat - q.lat) * (n.lat - q.lat) + (n.lon - q.lon) * (n.lon - q.lon)"
    q = "select candidate, 's' as side, slat as lat, slon as lon from {candidates} union all select candidate, 'e' as side, elat as lat, elon as lon from {candidates}"
    return f"select * from (select q.candidate, q.side, q.lat as qlat, q.lon as qlon, n.node_id, n.lat, n.lon, row_number() over (partition by q.candidate, q.side order by {d2}, n.node_id) as rank from ({q}) q cross join {{geo_nodes}} n) r where rank <= {k}"


_parts = "select node_id, min(component) as component from (select node_id, component from reach union all select node_id, node_id as component from {geo_nodes}) p group by node_id"
_near = f"select x.*, {G.haversine(('qlat', 'qlon'), P)} as d, component from ({_knn(30)}) x join ({_parts}) p on p.node_id = x.node_id"
SNAPPED: dict[str, str] = {
    "knn30": f"select candidate, side, node_id, cast(rank as bigint) as rank from ({_knn(30)}) k",
    "snap_pair": "with reach as (select src as node_id, src as component from {geo_edges} group by src union select e.dst as node_id, r.component from reach r join {geo_edges} e on e.src = r.node_id where r.component < e.dst or r.component = e.dst) "
    f"select candidate, start_node, end_node, {m('sd')} as sd, {m('ed')} as ed from (select a.candidate, a.node_id as start_node, b.node_id as end_node, a.d as sd, b.d as ed, row_number() over (partition by a.candidate order by a.d + b.d, a.rank, b.rank) as r "
    f"from (select * from ({_near}) x where side = 's') a join (select * from ({_near}) y where side = 'e') b on a.candidate = b.candidate and a.component = b.component) t where r = 1",
}


def knn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .api import both_ends
    from .operators.nearest import nearest_nodes

    v = views(spark, sf_dir, "{candidates} {geo_nodes}")
    near = nearest_nodes(both_ends(v["candidates"]), v["geo_nodes"].selectExpr("node_id", "lat as nlat", "lon as nlon"), ["candidate", "side"], 30)
    return near.selectExpr("candidate", "side", "node_id", "cast(rank as bigint) as rank")


def snap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of nodes of one component of the graph."""
    from .api import snapped

    v = views(spark, sf_dir, "{candidates} {geo_nodes}")
    parts = components_query(spark, sf_dir)
    nodes = v["geo_nodes"].join(parts, "node_id", "left").selectExpr("node_id", "lat", "lon", "coalesce(component, node_id) as component")
    return snapped(v["candidates"], nodes).where("start_node is not null").selectExpr("candidate", "start_node", "end_node", f"{m('sd')} as sd", f"{m('ed')} as ed")


# Routes: steps with the previous point, distances, deviations from the line between first and last point.
_w = "over (partition by route_id order by seq)"
_steps = f"select *, lag(lat) {_w} as plat, lag(lon) {_w} as plon, lag(elev_m) {_w} as pelev, first_value(lat) {_w} as alat, first_value(lon) {_w} as alon, last_value(lat) over (partition by route_id order by seq rows between unbounded preceding and unbounded following) as blat, last_value(lon) over (partition by route_id order by seq rows between unbounded preceding and unbounded following) as blon from {{route_points}}"
_A, _B, _PP, _MID = ("alat", "alon"), ("blat", "blon"), ("plat", "plon"), ("(lat + plat) / 2", "(lon + plon) / 2")
_legs = f"select *, case when plat is not null then {G.haversine(_PP, P)} else cast(0 as double) end as len, case when plat is not null then abs({G.cross_track(_MID, _A, _B)}) else cast(0 as double) end as mid_dev, abs({G.cross_track(P, _A, _B)}) as dev from ({_steps}) s"
_mode = "case when plat is null then '-' when (modes & 8) <> 0 then 'ferry' when (modes & 1) <> 0 then 'foot' when (modes & 2) <> 0 then 'bike' else 'mtb' end"
_report = (
    "select route_id, count(*) as n, sum(len) / 1000 as total_km, max(greatest(dev, mid_dev)) as max_dev, case when sum(len) > 0 then sum(mid_dev * len) / sum(len) else 0 end as avg_dev, "
    + ", ".join(f"sum(case when {_mode} = '{k}' then len else 0 end) / 1000 as {k}_km" for k in ("foot", "bike", "mtb", "ferry"))
    + ", "
    + ", ".join(f"sum(case when surface = {i} then len else 0 end) / 1000 as {s}_surface_km" for i, s in enumerate(T.SURFACES))
    + ", sum(case when len >= 800 then len else 0 end) / 1000 as long_km, sum(case when elev_m > pelev then elev_m - pelev else 0 end) as ascent, max("
    + G.haversine(_A, _B)
    + f") / 1000 as ref_km from ({_legs}) l group by route_id"
)
_km = ["total_km", "foot_km", "bike_km", "mtb_km", "ferry_km", *(f"{s}_surface_km" for s in T.SURFACES)]
both["route_report"] = f"select route_id, n, {', '.join(f'round({c}, 6) as {c}' for c in _km)}, {m('max_dev')} as max_dev_m, {m('avg_dev')} as avg_dev_m from ({_report}) r"
both["long_edges"] = f"select route_id, seq, {m('len')} as length_m, (modes & 8) <> 0 as is_ferry from ({_legs}) l where len >= 800"
_detour = "100 * greatest(cast(0 as double), case when ref_km > cast(0.000000001 as double) then total_km / ref_km - 1 else 0 end)"
_score = f"{_detour} + 5 * long_km + 8 * max_dev / 1000 + case when total_km > 0 then cast(0.05 as double) * ascent / total_km else 0 end"
both["route_score"] = f"select route_id, round({_score}, 4) as score from ({_report}) r where total_km > cast(0.001 as double) and ref_km > cast(0.05 as double)"
both["route_rank"] = f"select route_id, rank, round(score, 4) as score from (select route_id, round(score, 4) as score, row_number() over (order by round(score, 4), route_id) as rank from (select route_id, {_score} as score from ({_report}) r where total_km > 1 and ref_km > 1) s) t where rank <= 10"
both["cum_distance"] = f"select route_id, seq, {m('sum(len) over (partition by route_id order by seq rows between unbounded preceding and current row)')} as cum_m from ({_legs}) l"

pairs["nogo_hits"] = _hits


def _resample(e: str, n: int = 8) -> str:
    cum = f"select route_id, seq, lat, lon, plat, plon, len, sum(len) {_w[:-1]} rows between unbounded preceding and current row) as cum, sum(len) over (partition by route_id) as total from ({_legs}) l"
    targets = f"select route_id, i, total * i / {n - 1} as t from (select distinct route_id, total from ({cum}) c where total > 0) d{gen(e, 'g', '0', str(n - 1))}"
    # As-of: the first step whose running distance reaches the target, which no later step is looked at for.
    hit = f"select t.route_id, t.i, t.t, c.*, row_number() over (partition by t.route_id, t.i order by c.seq) as r from ({targets}) t join (select route_id as rid, seq, lat, lon, plat, plon, len, cum from ({cum}) x where plat is not null and len > 0) c on c.rid = t.route_id and c.cum >= t.t - cast(0.000001 as double)"
    f = "least(cast(1 as double), greatest(cast(0 as double), (t - (cum - len)) / len))"
    return f"select route_id, cast(i as bigint) as i, {deg(f'plat + (lat - plat) * {f}')} as lat, {deg(f'plon + (lon - plon) * {f}')} as lon from ({hit}) h where r = 1"


pairs["resample"] = _resample
_tw = "over (partition by route_id order by seq)"
both["elev_profile"] = f"select route_id, count(*) as n, {m('min(elev_m)')} as min_m, {m('max(elev_m)')} as max_m, {m('sum(case when elev_m > p then elev_m - p else 0 end)')} as ascent_m, {m('sum(case when elev_m < p then p - elev_m else 0 end)')} as descent_m from (select *, lag(elev_m) {_tw} as p from {{trajectories}}) t group by route_id having max(abs(elev_m)) > 0"
both["elev_cache_join"] = "select p.route_id, p.seq, coalesce(c.elev_m, cast(0 as double)) as elev_m from (select route_id, seq, cast(round(lat * 10000) as bigint) as ky, cast(round(lon * 10000) as bigint) as kx from {route_points}) p left join (select cast(round(lat * 10000) as bigint) as ky, cast(round(lon * 10000) as bigint) as kx, max(elev_m) as elev_m from {trajectories} group by 1, 2) c on p.ky = c.ky and p.kx = c.kx"
both["surface_share"] = "select surface, n, round(cast(n as double) / sum(n) over (), 6) as share from (select surface, count(*) as n from {geo_edges} group by surface) s"
_turns_of = lambda view: f"select *, lag(lat) {_tw} as plat, lag(lon) {_tw} as plon, lead(lat) {_tw} as nlat, lead(lon) {_tw} as nlon from {{{view}}}"
_turns = _turns_of("trajectories")
_angle = f"abs({G.wrapped('(' + G.bearing(P, ('nlat', 'nlon')) + ' - ' + G.bearing(_PP, P) + ')')})"


def _turn_metrics(view: str) -> str:
    """Degrees, sharp turns and hairpins per km."""
    leg = f"select route_id, {G.haversine(_PP, P)} as len, case when nlat is not null and {G.haversine(_PP, P)} >= 5 and {G.haversine(P, ('nlat', 'nlon'))} >= 5 then degrees({_angle}) else cast(0 as double) end as angle from ({_turns_of(view)}) t where plat is not null and nlat is not null"
    return f"select route_id, sum(angle) / (sum(len) / 1000) as turn_deg, sum(case when angle >= 60 then 1 else 0 end) / (sum(len) / 1000) as sharp, sum(case when angle >= 110 then 1 else 0 end) / (sum(len) / 1000) as hairpins from ({leg}) u group by route_id having sum(len) > 0"


both["turn_metrics"] = f"select route_id, round(turn_deg, 4) as turn_deg_per_km, round(sharp, 6) as sharp_per_km, round(hairpins, 6) as hairpins_per_km from ({_turn_metrics('trajectories')}) t"
_surface_count = " + ".join(f"case when {s}_surface_km >= cast(0.3 as double) then 1 else 0 end" for s in T.SURFACES)
both["surface_frag"] = f"select route_id, round(greatest(0, {_surface_count} - 1) / greatest(total_km, cast(1 as double)), 6) as fragmentation from ({_report}) r"
# The largest means that pass.
_gate = [("detour_pct", _detour, 22), ("ascent_m_per_km", "case when total_km > 0 then ascent / total_km else 0 end", 14)]
_turn_gate = [("turn_deg_per_km", "turn_deg", 260), ("sharp_per_km", "sharp", 0.75), ("hairpins_per_km", "hairpins", 0.1)]
both["quality_gate"] = " union all ".join(
    [f"select '{n}' as metric, round(avg({x}), 5) as mean, avg({x}) <= cast({t} as double) as passed from ({_report}) r where total_km > 1 and ref_km > 1" for n, x, t in _gate]
    + [f"select '{n}' as metric, round(avg({x}), 5) as mean, avg({x}) <= cast({t} as double) as passed from ({_turn_metrics('route_points')}) r" for n, x, t in _turn_gate]
)
both["run_compare"] = f"select a.metric, round(b.mean - a.mean, 5) as delta, case when b.mean < a.mean then 'better' when b.mean > a.mean then 'worse' else 'same' end as trend from (select 'total_km' as metric, avg(total_km) as mean from ({_report}) r where route_id % 2 = 0 union all select 'avg_dev' as metric, avg(avg_dev) as mean from ({_report}) r where route_id % 2 = 0) a join (select 'total_km' as metric, avg(total_km) as mean from ({_report}) r where route_id % 2 = 1 union all select 'avg_dev' as metric, avg(avg_dev) as mean from ({_report}) r where route_id % 2 = 1) b on a.metric = b.metric"

_half = "corridor_m / 2"
_code = f"case when snap_m > greatest({_half}, cast(2000 as double)) then 'snap_too_far' when no_route then 'no_route' when hits_zone then 'no_go' when max_dev > {_half} then 'corridor_violated' when real_km < 40 then 'too_short' when real_km > 180 then 'too_long' end"
both["filter_ladder"] = f"select candidate, {_code} as reject_code from {{scored}}"
_line_score = "100 * greatest(cast(0 as double), real_km / ref_km - 1) + 5 * long_km + 8 * max_dev / 1000 + cast(0.05 as double) * ascent_per_km"
_viable = f"select *, {_line_score} as score from {{scored}} where {_code} is null"
both["tight_loose"] = f"select grp % 20 as request, section, candidate, rank from (select *, row_number() over (partition by grp % 20, section order by round(score, 6), candidate) as rank from (select v.*, case when corridor_m <= 5001 then 0 else 1 end as section from ({_viable}) v) s) t where rank <= 12"
both["rescore_rerank"] = f"select request, candidate, rank2 from (select *, row_number() over (partition by request order by round(score, 6), candidate) as rank2 from (select v.*, grp % 20 as request, row_number() over (partition by grp % 20 order by round(score - cast(0.05 as double) * ascent_per_km, 6), candidate) as rank1 from ({_viable}) v) s where rank1 <= 12) t where rank2 <= 4"
both["batch_cutoff"] = f"select batch, viable, running, prior < 300 as evaluated from (select batch, viable, sum(viable) over (order by batch rows between unbounded preceding and current row) as running, coalesce(sum(viable) over (order by batch rows between unbounded preceding and 1 preceding), 0) as prior from (select candidate % 8 as batch, sum(case when {_code} is null then 1 else 0 end) as viable from {{scored}} group by candidate % 8) b) c"


def _dedup(e: str, start: str, end: str, sep_km: str, keep: int = 4) -> str:
    """Per request, the best that aren't within sep of a kept one at both ends.

    In Spark a round a kept row: the best row of all that is not near a kept one.  The comparison's SQL is an ordered fold over all.
    """
    top = f"select * from (select grp % 20 as request, candidate, {start[0]} as a, {start[1]} as b, {end[0]} as c, {end[1]} as d, row_number() over (partition by grp % 20 order by round(score, 6), candidate) as r from ({_viable}) v) t"
    near = lambda k, x: f"{G.haversine((f'{k}.a', f'{k}.b'), (f'{x}.a', f'{x}.b'))} < {sep_km} * 1000 and {G.haversine((f'{k}.c', f'{k}.d'), (f'{x}.c', f'{x}.d'))} < {sep_km} * 1000"
    if e == SPARK:
        rows = f"select grp % 20 as request, struct(round(score, 6) as s, candidate, {start[0]} as a, {start[1]} as b, {end[0]} as c, {end[1]} as d) as x from ({_viable}) v"
        kept = f"select request, array(min(x)) as kept from ({rows}) r group by request"
        for _ in range(keep - 1):
            far = f"case when not exists(kept, k -> k.candidate = x.candidate or coalesce({near('k', 'x')}, false)) then x end"
            kept = f"select k.request, concat(any_value(kept), array_compact(array(min({far})))) as kept from ({rows}) r join ({kept}) k on k.request = r.request group by k.request"
        return f"select request, k.candidate as candidate, cast(pos + 1 as bigint) as rank from ({kept}) q lateral view posexplode(kept) p as pos, k"
    items = "list(struct_pack(r := r, candidate := candidate, a := a, b := b, c := c, d := d) order by r)"
    fold = f"list_reduce(list_transform({items}, lambda x: [x]), lambda acc, y: case when len(acc) >= {keep} or len(list_filter(acc, lambda k: {near('k', 'y[1]')})) > 0 then acc else list_concat(acc, y) end)"
    return f"select request, kept[i].candidate as candidate, cast(i as bigint) as rank from (select request, kept, unnest(range(1, len(kept) + 1)) as i from (select request, {fold} as kept from ({top}) t group by request) q) z"


pairs["dedup_lines"] = lambda e: _dedup(e, S, E, "8")
# Shapes of 120 km around: a radius apart, and 8 km at least.
pairs["dedup_shapes"] = lambda e: _dedup(e, S, S, "greatest(cast(120 as double) / (2 * pi()), cast(8 as double))")

_dev = "abs(({} + {}) / 2)".format(G.cross_track(("slat", "slon"), _CA := ("cast(46.01 as double)", "cast(7.01 as double)"), _CB := ("cast(46.14 as double)", "cast(7.2 as double)")), G.cross_track(("dlat", "dlon"), _CA, _CB))
_edge = f"select e.*, {G.haversine(('slat', 'slon'), ('dlat', 'dlon'))} as len, {_dev} as dev from {{geo_edges}} e"
both["edge_cost_foot"] = f"select src, dst, {m('len')} as length_m, {m('len * ' + C.weight('dev', 'cast(5000 as double)', 'cast(4 as double)'))} as cost from ({_edge}) e where {C.admissible('modes', 1, 'dev', 'cast(8000 as double)', 'cast(5000 as double)')}"
both["edge_cost_bike"] = " union all ".join(
    f"select {k} as wanted, src, dst, {m('len * ' + C.weight('dev', 'cast(5000 as double)', 'cast(4 as double)') + ' * ' + C.bike_factor('bike_attrs', 'surface', 'modes', k) + ' + ' + C.climb('len', 'selev', 'delev', 'surface', k))} as cost from ({_edge}) e where {C.admissible('modes', k, 'dev', 'cast(8000 as double)', 'cast(5000 as double)')}" for k in (2, 4, 6, 3)
)
both["path_turn_cost"] = f"select route_id, {m('sum(' + str(C.TURN) + ' * turn)')} as turn_cost from (select route_id, abs({G.wrapped('(' + G.fast_bearing(P, ('nlat', 'nlon')) + ' - ' + G.fast_bearing(_PP, P) + ')')}) as turn from ({_turns}) t where plat is not null and nlat is not null) u group by route_id"


def _smooth(rounds: int) -> str:
    # Single precision after each round; sums of such values are exact in double precision, in whatever order.
    q = "select node_id, cast(elev_m as float) as z from {geo_nodes}"
    for _ in range(rounds):
        q = f"select node_id, cast(sum(cast(z as double)) / count(z) as float) as z from (select e.dst as node_id, n.z from {{geo_edges}} e join ({q}) n on n.node_id = e.src union all select node_id, z from ({q}) s) u group by node_id"
    return q


both["elev_smooth2"] = f"select node_id, {m('cast(z as double)')} as elev_m from ({_smooth(2)}) q"


def _text(e: str) -> tuple[str, str]:
    if e == SPARK:
        lines = "select doc_id, ln, line from {documents} lateral view posexplode(split(text, '\n')) p as ln, line"
        tokens = f"select doc_id, ln, pos, token from ({lines}) l lateral view posexplode(regexp_extract_all(line, '( +|[^ ]+)', 1)) q as pos, token"
    else:
        lines = "select doc_id, unnest(range(0, len(a))) as ln, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from {documents}) d"
        tokens = f"select doc_id, ln, unnest(range(0, len(b))) as pos, unnest(b) as token from (select doc_id, ln, regexp_extract_all(line, '( +|[^ ]+)', 1) as b from ({lines}) l) m"
    return lines, tokens


pairs["text_tokens"] = lambda e: f"select doc_id, cast(ln as bigint) as line, cast(pos as bigint) as pos, token, substring(token, 1, 1) = ' ' as is_space from ({_text(e)[1]}) t"
_known = {SPARK: "length(regexp_replace(token, '[^ -~]', ''))", DUCK: "length(regexp_replace(token, '[^ -~]', '', 'g'))"}
pairs["glyph_missing"] = lambda e: f"select doc_id, sum(length(token)) as chars, sum(length(token) - {_known[e]}) as missing from ({_text(e)[1]}) t group by doc_id"
pairs["gpx_text"] = lambda e: (
    "select route_id, concat('<trkseg>', {}, '</trkseg>') as gpx from {{route_points}} group by route_id".format(
        "array_join(transform(array_sort(collect_list(struct(seq, lat, lon))), p -> format_string('<trkpt lat=\"%.7f\" lon=\"%.7f\"/>', p.lat, p.lon)), '')" if e == SPARK else "string_agg(printf('<trkpt lat=\"%.7f\" lon=\"%.7f\"/>', lat, lon), '' order by seq)"
    )
)
both["hgt_names"] = "select zone, lat_deg, lon_deg, concat(case when lat_deg < 0 then 'S' else 'N' end, lpad(cast(abs(lat_deg) as varchar(9)), 2, '0'), case when lon_deg < 0 then 'W' else 'E' end, lpad(cast(abs(lon_deg) as varchar(9)), 3, '0')) as tile from (select zone, cast(floor(clat) as int) - 47 * (zone % 2) as lat_deg, cast(floor(clon) as int) - 9 * (zone % 3) as lon_deg from {zones}) z"
both["region_urls"] = "select r_regionkey, concat('https://download.geofabrik.de/', case when name like '%/%' then name else concat('europe/', name) end, '-latest.osm.pbf') as url from (select r_regionkey, case when r_regionkey % 2 = 0 then lower(r_name) else concat('asia/', lower(r_name)) end as name from {region}) r"
both["route_keys"] = f"select candidate, concat(cast(cast(round(slat * 10000) as bigint) as varchar(12)), ',', cast(cast(round(slon * 10000) as bigint) as varchar(12)), '-', cast(cast(round(elat * 10000) as bigint) as varchar(12)), ',', cast(cast(round(elon * 10000) as bigint) as varchar(12))) as route_key from {{candidates}}"
# Bilinear elevation: the four grid posts around a point, void posts dropped and weights renormalised.
_post = "case when (y * 31 + x * 17) % 11 = 0 then null else cast((y * 7919 + x * 6101) % 2000 as double) end"
_corner = " union all ".join(f"select node_id, y + {b} as y, x + {a} as x, (case when {b} = 1 then fy else 1 - fy end) * (case when {a} = 1 then fx else 1 - fx end) as w from (select node_id, floor((lat - 46) * 1200) as y, floor((lon - 7) * 1200) as x, (lat - 46) * 1200 - floor((lat - 46) * 1200) as fy, (lon - 7) * 1200 - floor((lon - 7) * 1200) as fx from {{geo_nodes}}) g" for a in (0, 1) for b in (0, 1))
both["dem_bilinear"] = f"select node_id, {m('sum(case when z is not null then w * z end) / nullif(sum(case when z is not null then w end), 0)')} as elev_m from (select node_id, w, {_post.replace('y * ', 'cast(y as bigint) * ').replace('x * ', 'cast(x as bigint) * ')} as z from ({_corner}) c) d group by node_id"


def components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.components import connected_components
    from .plans.session import cut

    edges = spark.sql("select src as a, dst as b from {geo_edges}", **views(spark, sf_dir, "{geo_edges}"))
    return connected_components(edges, cut).selectExpr("node as node_id", "component")


COMPONENTS_SQL = (
    "with reach as (select src as node_id, src as component from {geo_edges} group by src union select e.dst as node_id, r.component from reach r join {geo_edges} e on e.src = r.node_id where r.component < e.dst or r.component = e.dst) select node_id, min(component) as component from reach group by node_id"
)


def _sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(text, **views(spark, sf_dir, text))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .operators import requests as asked
    from .operators.routing import QUERIES as routing
    from .operators.text import QUERIES as text

    found = {k: _sql_query(v) for k, v in both.items()} | {k: _sql_query(f(SPARK)) for k, f in pairs.items()}
    found |= {k: _sql_query(v) for k, v in asked.SPARK_SQL.items()} | {"nearest_node": asked.nearest_query}
    return found | {"components": components_query, "knn30": knn_query, "snap_pair": snap_query} | routing | text


def oracle_sql() -> dict[str, str]:
    from .operators import requests as asked
    from .operators.routing import SQL as routing

    more = {k: portable(v) for k, v in asked.DUCK_SQL.items()} | {"nearest_node": portable(asked.NEAREST_SQL)}
    return more | {k: portable(v) for k, v in both.items()} | {k: portable(f(DUCK)) for k, f in pairs.items()} | {"components": portable(COMPONENTS_SQL)} | {k: portable(v) for k, v in SNAPPED.items()} | {k: portable(v) for k, v in routing.items()}
