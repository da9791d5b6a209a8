"""What a request says and what follows from it: parsers, sweeps, sample sizes, centres and anchors, scores and totals of shapes and texts.

All are SQL expressions and generators, so they stay inside generated code;
random draws come from a linear congruential rule over ids, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import geodesy as G
from ..functions import tags as T
from ..plans.fixtures import views
from ..queries import DUCK, SPARK, _knn, _legs, _PP, both_lcg, deg, gen, m
from ..queries import pairs as known

S, P = ("slat", "slon"), ("lat", "lon")
N = G.num
both: dict[str, str] = {}
pairs: dict[str, Callable[[str], str]] = {}

#: Names of shapes and fonts, and their aliases.
SHAPES = {
    "circle": "circle", "triangle": "triangle", "square": "square", "pentagon": "pentagon", "hexagon": "hexagon", "star": "star", "heart": "heart",
    "figure-8": "figure-8 figure8 figureeight infinity", "swiss-cross": "swiss-cross swisscross cross swiss", "switzerland": "switzerland ch swiss-map ch-outline",
}
FONTS = {"simplex": "simplex", "cursive": "cursive"}


def named(text: str, names: dict[str, str]) -> str:
    """The name whose alias text is, in any case; else null."""
    return "(case " + " ".join(f"when {T.one_of(f'lower({text})', alias)} then '{name}'" for name, alias in names.items()) + " end)"


def number(e: str, text: str) -> str:
    """A decimal number with blanks around it; else null."""
    like = "regexp_like" if e == SPARK else "regexp_matches"
    return f"case when {like}(trim({text}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(trim({text}) as double) end"


def latlon(e: str, source: str, text: str) -> str:
    """source(id, ..) with lat and lon of 'lat,lon'; both null unless there are two numbers in range."""
    part = lambda i: number(e, f"split_part({text}, ',', {i})")
    q = f"select id, {part(1)} as lat, {part(2)} as lon, length({text}) - length(replace({text}, ',', '')) as commas from ({source}) s"
    ok = "commas = 1 and lat between -90 and 90 and lon between -180 and 180"
    return f"select id, case when {ok} then lat end as lat, case when {ok} then lon end as lon from ({q}) p"


_spec = "select c_custkey as id, concat(case c_custkey % 9 when 0 then '46.5,7.' when 1 then ' 46.25 , 7.' when 2 then '91,' when 3 then '46.' when 4 then '46,7,' when 5 then 'x,' when 6 then '-90,17' when 7 then '1e1,-1.8e' else ',' end, cast(c_custkey % 3 as varchar(3))) as spec from {customer}"
pairs["latlon_parse"] = lambda e: latlon(e, _spec, "spec")
_word = "case p_partkey % 11 when 0 then 'Circle' when 1 then 'FIGURE-8' when 2 then 'infinity' when 3 then 'Swiss' when 4 then 'ch-outline' when 5 then 'Simplex' when 6 then 'CURSIVE' when 7 then 'hexagon' when 8 then '' when 9 then 'Heart' else p_name end"
both["name_parse"] = f"select id, {named('word', SHAPES)} as shape, {named('word', FONTS)} as font from (select p_partkey as id, {_word} as word from {{part}}) w"
# Modes are refused as a whole if a token is unknown or none is chosen.
pairs["parse_modes_strict"] = lambda e: f"select id, case when unknown = 0 and modes <> 0 then modes end as modes from ({known['parse_modes'](e)}) a"


def steps(lo: str, hi: str, step: str) -> str:
    """The last index of lo, lo + step, .. up to hi; 0 if there is no way up."""
    return f"case when {step} <= 0 or {hi} < {lo} then 0 else floor(({hi} - {lo}) / {step}) end"


_sweep = f"select n_nationkey as id, cast(n_nationkey * 15 as double) as lo, cast((n_nationkey * 47) % 360 as double) as hi, cast(n_nationkey % 6 as double) * {N(7.5)} as step from {{nation}}"
_wrapped = f"select id, lo, case when step > 0 and hi < lo then hi + 360 else hi end as hi, step from ({_sweep}) r"
pairs["float_range"] = lambda e: f"select id, cast(i as bigint) as i, {deg('lo + i * step')} as x from ({_sweep}) s{gen(e, 'g', '0', steps('lo', 'hi', 'step'))}"
pairs["bearing_range"] = lambda e: f"select id, cast(i as bigint) as i, {deg(G.normal_degrees('(lo + i * step)'))} as bearing from ({_wrapped}) s{gen(e, 'g', '0', steps('lo', 'hi', 'step'))}"

# An edge stays in a plan's graph if either of its ends lies in the corridor.
_line = ((N(46.0), N(7.0)), (N(46.1), N(7.2)), N(1500))
both["corridor_edges"] = f"select src, dst from {{geo_edges}} where {G.in_corridor(('slat', 'slon'), *_line)} or {G.in_corridor(('dlat', 'dlon'), *_line)}"
# Coordinates in ten-millionths of a degree, kept inside a box.
_micro = "select node_id, cast(round(lat * 10000000) as bigint) as y, cast(round(lon * 10000000) as bigint) as x from {geo_nodes}"
both["decimicro_box"] = f"select node_id, round(lat, 7) as lat, round(lon, 7) as lon from (select node_id, y * {N(1e-7)} as lat, x * {N(1e-7)} as lon from ({_micro}) a) b where lat between 46 and {N(46.05)} and lon between {N(7.01)} and {N(7.2)}"


def _coverage(e: str) -> str:
    tile = "concat(case when y < 0 then 'S' else 'N' end, lpad(cast(abs(y) as varchar(9)), 2, '0'), case when x < 0 then 'W' else 'E' end, lpad(cast(abs(x) as varchar(9)), 3, '0'))"
    points = f"select candidate, y, x, {tile} as tile, (y + x) % 2 <> 0 as missing from (select candidate, cast(floor(slat) as int) - 47 * (candidate % 2) as y, cast(floor(slon) as int) - 9 * (candidate % 3) as x from {{candidates}}) c"
    names = "array_join(array_sort(collect_set(case when missing then tile end)), ', ')" if e == SPARK else "coalesce(string_agg(distinct tile, ', ' order by tile) filter (where missing), '')"
    return f"select count(*) as nodes, sum(case when missing then 0 else 1 end) as hits, round(100 * cast(sum(case when missing then 0 else 1 end) as double) / greatest(count(*), 1), 1) as pct, {names} as missing_tiles from ({points}) p"


pairs["dem_coverage"] = _coverage

# Sizes of samples, pools and caps that follow from a request.
_asked = "select p_partkey as id, (p_partkey * 13) % 70 - 5 as asked, (p_partkey * 7) % 40 as legs, p_partkey % 2 = 0 as with_elevation, cast(p_partkey % 5 as double) / 2 as wider_km from {part}"
_count = f"select id, legs, with_elevation, wider_km, greatest(1, least(50, asked)) as n, case when greatest(legs, 1) >= 24 then 3 when greatest(legs, 1) >= 12 then 4 else 8 end as factor from ({_asked}) a"
both["sample_sizes"] = f"select id, n, greatest(6 * n, 20) as country_sample, greatest(n * factor, n + 8, 16) as shape_sample, case when with_elevation then greatest(3 * n, n + 4) else n end as pool, round({N(1.2)} + {N(0.15)} * wider_km, 6) as leg_cap from ({_count}) c"
_letters = f"select p_partkey as id, cast((p_partkey * 977) % 30000 as double) as h, {_word} as word, cast(p_partkey % 40 as double) / 10 as cap, (p_partkey * 31) % 1500 as asked from {{part}}"
_fault = f"case when h < 500 then 'letter_height' when {named('word', FONTS)} is null then 'font' end"
both["text_params"] = f"select id, {_fault} as refused, round(greatest({N(300)}, least({N(1500)}, h / 10)), 6) as half_width_m, {N(30)} as alpha, greatest({N(1)}, cap) as detour_cap, greatest(20, least(1000, asked)) as candidates from ({_letters}) l"

# Random draws by id.
_h = lambda a, b, k: f"(cast({both_lcg(f'({a} * {7919 + 1013 * k} + {b} * {104729 + 577 * k} + {7907 * k}) % 1000003')} as double) / 2147483648)"
#: Arm of the cross as a part of its half span, and its corners in order.
ARM = "(cast(1 as double) / 3)"
CROSS = [("-a", "1"), ("a", "1"), ("a", "a"), ("1", "a"), ("1", "-a"), ("a", "-a"), ("a", "-1"), ("-a", "-1"), ("-a", "-a"), ("-1", "-a"), ("-1", "a"), ("-a", "a"), ("-a", "1")]
_cross = " union all ".join(f"select {i} as i, cast({x.replace('a', ARM)} as double) as x, cast({y.replace('a', ARM)} as double) as y" for i, (x, y) in enumerate(CROSS))
_spot = G.destination(S, "atan2(x, y) + radians(cast(30 as double))", f"{N(50_000)} / 8 * sqrt(x * x + y * y)")
pairs["cross_placed"] = lambda e: f"select {'/*+ broadcast(v) */ ' if e == SPARK else ''}candidate, cast(i as bigint) as i, {deg(_spot[0])} as lat, {deg(_spot[1])} as lon from {{candidates}} c cross join ({_cross}) v"


def _centres(e: str) -> str:
    # Perimeter and greatest radius of the unit shapes.
    units = [("triangle", "3 * sqrt(cast(3 as double))", "1", "false"), ("square", "4 * sqrt(cast(2 as double))", "1", "false"), ("swiss-cross", "8", "sqrt(cast(10 as double)) / 3", "false")]
    shapes = " union all ".join(f"select {k} as k, '{kind}' as kind, cast({per} as double) as per, cast({far} as double) as far, {lock} as upright" for k, (kind, per, far, lock) in enumerate(units))
    q = f"select zone, k, kind, upright, clat, clon, cast(20 + 20 * (zone % 15) as double) * 1000 / per * far as extent from {{zones}} z cross join ({shapes}) u"
    pad = "extent / 111000"
    box = f"select zone, k, kind, upright, clat - {N(0.4)} + {pad} as lat0, clat + {N(0.4)} - {pad} as lat1, clon - {N(0.6)} + {pad} / c as lon0, clon + {N(0.6)} - {pad} / c as lon1 from (select q.*, greatest(cos(radians(clat)), {N(0.1)}) as c from ({q}) q) p"
    draw = lambda lo, hi, k: f"{lo} + ({hi} - {lo}) * {_h('i', '(zone * 3 + k)', k)}"
    return f"select zone, kind, cast(i as bigint) as i, {deg(draw('lat0', 'lat1', 1))} as lat, {deg(draw('lon0', 'lon1', 2))} as lon, {deg('case when upright then 0 else 360 * ' + _h('i', '(zone * 3 + k)', 3) + ' end')} as rotation from ({box}) b{gen(e, 'g', '0', '15')} where lat0 < lat1 and lon0 < lon1"


pairs["shape_centres"] = _centres


def _anchors(e: str) -> str:
    q = f"select zone, n, lat0, lat1, clon - {N(0.2)} + ({N(0.2)} - (lat1 - clat)) / c as lon0, clon + {N(0.2)} - ({N(0.2)} - (lat1 - clat)) / c as lon1 from (select zone, clat, clon, 20 + zone * 7 as n, clat - {N(0.2)} + pad as lat0, clat + {N(0.2)} - pad as lat1, greatest(cos(radians(clat)), {N(0.001)}) as c from (select z.*, {N(1.5)} * (500 + 1000 * zone) / 111000 as pad from {{zones}} z) a) b"
    i, j = gen(e, "gi", "0", "greatest(ceil(cast(n as double) / 5), 1) - 1"), gen(e, "gj", "0", "4", "j")
    return f"select zone, cast(i as bigint) as i, 60 + 15 * cast(j as bigint) as bearing, {deg('lat0 + (lat1 - lat0) * ' + _h('i', 'zone', 1))} as lat, {deg('lon0 + (lon1 - lon0) * ' + _h('i', 'zone', 2))} as lon from ({q}) q{i}{j} where lat0 < lat1 and lon0 < lon1"


pairs["text_anchors"] = _anchors


def _jitter(e: str, h: float = 2000.0) -> str:
    r, theta, turn = f"({N(h / 4)} * {_h('j', 'candidate', 1)})", f"(2 * pi() * {_h('j', 'candidate', 2)})", f"(20 * {_h('j', 'candidate', 3)} - 10)"
    lat, lon = G.destination(S, f"atan2({r} * cos({theta}), {r} * sin({theta}))", r)
    here = "j = 0"
    return f"select candidate, cast(j as bigint) as j, {deg(f'case when {here} then slat else {lat} end')} as lat, {deg(f'case when {here} then slon else {lon} end')} as lon, {deg(f'case when {here} then 90 else 90 + {turn} end')} as bearing from {{candidates}} c{gen(e, 'g', '0', '12', 'j')}"


pairs["letter_jitter"] = _jitter

# Scores and totals of shapes and texts.
_loop = f"100 * greatest({N(0)}, real_km / ref_km - 1) + 80 * long_km"
both["shape_score"] = f"select candidate, round({_loop}, 4) as score, round({_loop} + {N(0.05)} * ascent_per_km, 4) as rescored from {{scored}}"
_leg = f"select route_id, leg, sum(len) as len, {G.haversine(('alat', 'alon'), ('blat', 'blon'))} as straight from (select route_id, leg, len, lat0 as alat, lon0 as alon, lat1 as blat, lon1 as blon from (select *, min_by(plat, seq) over w as lat0, min_by(plon, seq) over w as lon0, max_by(lat, seq) over w as lat1, max_by(lon, seq) over w as lon1 from (select *, cast(floor((seq - 2) / 2) as bigint) + 1 as leg from ({_legs}) l where plat is not null) s window w as (partition by route_id, leg)) t) u group by route_id, leg, alat, alon, blat, blon"
_detour = "greatest(cast(0 as double), len / greatest(straight, cast(1 as double)) - 1)"
both["leg_detours"] = f"select route_id, count(*) as legs, round(max({_detour}), 5) as max_leg_detour, min(case when {_detour} > {N(1.2)} then leg end) as failed_leg from ({_leg}) g group by route_id"
_km = ", ".join(f"round(sum(case when least(surface, 5) = {i} then len else 0 end) / 1000, 6) as {s}_km" for i, s in enumerate(T.SURFACES))
both["shape_surface"] = f"select route_id, {_km}, round(sum(case when (modes & 8) <> 0 then len else 0 end) / 1000, 6) as ferry_km from ({_legs}) l where plat is not null group by route_id"
_climb = f"select route_id, case when route_id % 7 <> 0 then sum(case when elev_m > pelev then elev_m - pelev else 0 end) end as ascent from ({_legs}) l group by route_id"
both["ascent_total"] = f"select route_id % 20 as request, round(sum(ascent)) as ascent_m, count(ascent) as with_elevation from ({_climb}) c group by route_id % 20 having count(ascent) > 0"
_message = "select l_orderkey as message, cast(l_quantity as double) * 100 as intended, cast(l_quantity as double) * (100 + l_linenumber * 9) as routed, cast(l_linenumber % 3 as double) / 4 as worst, case when l_partkey % 17 = 0 then 1 else 0 end as missing from {lineitem}"
_total = f"select message, count(*) as letters, sum(intended) as intended, sum(routed) as routed, max(worst) as worst, sum(missing) as missing from ({_message}) l group by message"
both["text_totals"] = f"select message, letters, round(intended, 3) as intended_m, round(routed, 3) as routed_m, worst as max_stroke_detour, round(100 * case when intended > 0 then greatest({N(0)}, routed / intended - 1) else 0 end + {N(0.5)} * missing, 5) as score from ({_total}) t"
# Ends that were moved by more than 50 m to reach the graph: a point and a leg each.
_ends = " union all ".join(f"select candidate, '{side}' as side, {x} as alat, {y} as alon, {x} + (candidate % 5) * {N(0.0002)} as lat, {y} + (candidate % 3) * {N(0.0002)} as lon from {{candidates}}" for side, x, y in (("start", "slat", "slon"), ("end", "elat", "elon")))
both["snap_marks"] = f"select candidate, side, kind, {m('d')} as moved_m from (select candidate, side, {G.haversine(('alat', 'alon'), P)} as d from ({_ends}) e) x cross join (select 'snap' as kind union all select 'snap-leg' as kind) k where d > 50"
# The k-th pen-up is ridden before the stroke that follows it.
_ride = f"select route_id, cast(floor((seq - 1) / 2) as bigint) as stroke, 1 as kind, (seq - 1) % 2 as point, lat, lon from {{route_points}} union all select route_id, cast(floor((seq - 1) / 2) as bigint) as stroke, 0 as kind, 0 as point, (lat + plat) / 2 as lat, (lon + plon) / 2 as lon from ({_legs}) l where seq > 1 and seq % 2 = 1"
both["ride_order"] = f"select route_id, row_number() over (partition by route_id order by stroke, kind, point) as pos, kind = 0 as pen_up, {deg('lat')} as lat, {deg('lon')} as lon from ({_ride}) r"
# Of parallel edges the cheapest one is ridden, ties to the smaller way; lengths are of the edges that are.
_twin = "select route_id, seq, len, 0 as twin, len * (1 + surface) as cost from ({0}) a where plat is not null union all select route_id, seq, len * {1} as len, 1 as twin, len * {1} * (1 + (surface + seq) % 6) as cost from ({0}) b where plat is not null".format(_legs, N(1.25))
both["parallel_steps"] = f"select route_id, sum(twin) as twins, {m('sum(len)')} as length_m from (select route_id, seq, len, twin, row_number() over (partition by route_id, seq order by cost, twin) as r from ({_twin}) t) p where r = 1 group by route_id"


def _stats(e: str) -> str:
    names = [*(b for b, _ in T.BUCKETS), "other"]
    body = ", ',', ".join(f"'\"{n}\":', cast(sum({n}) as varchar(20))" for n in names)
    return f"select batch % 2 as request, concat(chr(123), {body}, ',\"total\":', cast(sum(total) as varchar(20)), chr(125)) as stats from ({_rejects()}) b group by batch % 2"


def _rejects() -> str:
    from ..queries import both as earlier

    return earlier["reject_buckets"]


pairs["reject_json"] = _stats


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..api import both_ends
    from .nearest import nearest_nodes

    v = views(spark, sf_dir, "{candidates} {geo_nodes}")
    near = nearest_nodes(both_ends(v["candidates"]), v["geo_nodes"].selectExpr("node_id", "lat as nlat", "lon as nlon"), ["candidate", "side"], 1)
    return near.select("candidate", "side", "node_id")


NEAREST_SQL = f"select candidate, side, node_id from ({_knn(1)}) k"
SPARK_SQL = both | {k: f(SPARK) for k, f in pairs.items()}
DUCK_SQL = both | {k: f(DUCK) for k, f in pairs.items()}
