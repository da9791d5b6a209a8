"""Plan one line, or explore many, over a graph of nodes and edges.

nodes(node_id, lat, lon, elev_m), edges(src, dst, slat, slon, dlat, dlon,
modes, surface, bike_attrs, way_id).  Candidates are rows; all that follows is
one lazy plan of joins, aggregates and windows around the routing kernel.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import geodesy as G
from .functions.tags import SURFACES
from .operators.nearest import nearest_nodes
from .operators.routing import RouteParams, route
from .plans.session import cut

S, E = ("slat", "slon"), ("elat", "elon")


def fan(start: DataFrame, bearings: list[float], distances_km: list[float]) -> DataFrame:
    """Candidates from start(slat, slon) over bearings and distances."""
    lists = start.withColumns({"bearing": F.explode(F.array(*map(F.lit, bearings)))}).withColumn("dist_km", F.explode(F.array(*map(F.lit, distances_km))))
    lat, lon = G.destination(S, "radians(bearing)", "dist_km * 1000")
    return lists.withColumns({"elat": F.expr(lat), "elon": F.expr(lon)}).withColumn("candidate", F.xxhash64("slat", "slon", "bearing", "dist_km"))


def both_ends(candidates: DataFrame) -> DataFrame:
    """(candidate, side, lat, lon): side s and e."""
    return candidates.selectExpr("candidate", "'s' as side", "slat as lat", "slon as lon").unionByName(candidates.selectExpr("candidate", "'e' as side", "elat as lat", "elon as lon"))


def snapped(candidates: DataFrame, nodes: DataFrame, k: int = 30, cell: float = 0.05) -> DataFrame:
    """candidates with start_node, end_node, sd, ed: of each end's k nearest nodes (planar degrees, however far), the pair in one component (nodes.component, if there) with the least sum of distances."""
    comp = "component" if "component" in nodes.columns else "0"
    n = nodes.selectExpr("node_id", "lat as nlat", "lon as nlon", f"{comp} as component")
    near = nearest_nodes(both_ends(candidates), n, ["candidate", "side"], k, cell).withColumn("d", F.expr(G.haversine(("lat", "lon"), ("nlat", "nlon"))))
    a = near.where("side = 's'").selectExpr("candidate", "component", "node_id as start_node", "d as sd", "rank as ra")
    b = near.where("side = 'e'").selectExpr("candidate", "component", "node_id as end_node", "d as ed", "rank as rb")
    pair = a.join(b, ["candidate", "component"]).withColumn("best", F.row_number().over(Window.partitionBy("candidate").orderBy(F.col("sd") + F.col("ed"), "ra", "rb"))).where("best = 1")
    return candidates.join(pair.select("candidate", "start_node", "end_node", "sd", "ed"), "candidate", "left")


def report(routed: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame, long_m: float = 800.0) -> DataFrame:
    """One row per route: lengths by mode and surface, deviations, ascent, score."""
    steps = routed.select("candidate", F.posexplode("nodes").alias("seq", "node_id"))
    w = Window.partitionBy("candidate").orderBy("seq")
    steps = steps.withColumn("prev", F.lag("node_id").over(w)).join(nodes.select("node_id", "lat", "lon", "elev_m"), "node_id")
    # Of parallel edges the one with the smallest way counts.
    e = edges.groupBy("src", "dst").agg(F.min(F.struct("way_id", "modes", "surface", "slat", "slon", "selev")).alias("e")) if "selev" in edges.columns else edges.groupBy("src", "dst").agg(F.min(F.struct("way_id", "modes", "surface", "slat", "slon", F.lit(None).cast("double").alias("selev"))).alias("e"))
    x = steps.join(e.selectExpr("src as prev", "dst as node_id", "e.*"), ["prev", "node_id"], "left").join(candidates.select("candidate", *S, *[F.col(c) for c in E]).withColumnsRenamed({"slat": "alat", "slon": "alon"}), "candidate")
    a, b = ("alat", "alon"), E
    x = x.withColumns({"len": F.expr(f"case when slat is null then cast(0 as double) else {G.haversine(S, ('lat', 'lon'))} end"), "mid": F.expr(f"case when slat is null then cast(0 as double) else abs({G.cross_track(('(slat + lat) / 2', '(slon + lon) / 2'), a, b)}) end"), "dev": F.expr(f"abs({G.cross_track(('lat', 'lon'), a, b)})")})
    km = lambda cond: F.sum(F.when(F.expr(cond), F.col("len")).otherwise(0.0)) / 1000
    modes = {"ferry_km": "modes & 8 <> 0", "foot_km": "modes & 8 = 0 and modes & 1 <> 0", "bike_km": "modes & 9 = 0 and modes & 2 <> 0", "mtb_km": "modes & 11 = 0 and modes & 4 <> 0"}
    out = x.groupBy("candidate").agg(
        (F.sum("len") / 1000).alias("total_km"), F.max(F.greatest("dev", "mid")).alias("max_dev_m"), (F.sum(F.col("mid") * F.col("len")) / F.expr("nullif(sum(len), 0)")).alias("avg_dev_m"),
        *[km(c).alias(n) for n, c in modes.items()], *[km(f"surface = {i}").alias(f"{s}_surface_km") for i, s in enumerate(SURFACES)], km(f"len >= {long_m}").alias("long_km"),
        F.sum(F.greatest(F.lit(0.0), F.col("elev_m") - F.col("selev"))).alias("ascent_m"), F.max(F.expr(G.haversine(a, b)) / 1000).alias("ref_km"),
    )
    detour = "100 * greatest(cast(0 as double), coalesce(total_km / nullif(ref_km, 0) - 1, 0))"
    return out.withColumn("score", F.expr(f"{detour} + 5 * long_km + 8 * max_dev_m / 1000 + coalesce(0.05D * ascent_m / nullif(total_km, 0), 0)"))


def explore(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, params: RouteParams = RouteParams(), top: int = 10, min_km: float | None = None, max_km: float | None = None, enforce_corridor: bool = True, sep_km: float = 8.0) -> DataFrame:
    """The best routes of candidates(candidate, slat, slon, elat, elon), ranked and without near twins, with their reports; ``reject_code`` is null in them."""
    c = snapped(candidates, nodes)
    tol = max(params.half_width_m, 2000.0)
    r = route(c.where(f"greatest(sd, ed) <= {tol}"), nodes, edges, params)
    rep = report(r, c, nodes, edges)
    code = F.when(F.lit(enforce_corridor) & (F.col("max_dev_m") > params.half_width_m), "corridor_violated")
    code = code.when(F.col("total_km") < F.lit(min_km if min_km is not None else float("-inf")), "too_short").when(F.col("total_km") > F.lit(max_km if max_km is not None else float("inf")), "too_long")
    ok = rep.withColumn("reject_code", code).where("reject_code is null").join(c.select("candidate", *S, *E), "candidate")
    # A round a kept route: the best of all that is not near a kept one.
    pool = cut(ok.select("score", "candidate", *S, *E))
    names, kept = ("slat", "slon", "elat", "elon"), []
    while len(kept) < top:
        near = F.lit(False)
        for k in kept:
            near = near | F.coalesce(_close({x: F.col(x) for x in names}, {x: F.lit(k[x]) for x in names}, sep_km), F.lit(False)) | (F.col("candidate") == k["candidate"])
        best = pool.where(~near).orderBy("score", "candidate").first()
        if best is None:
            break
        kept.append(best)
    kept = ok.sparkSession.createDataFrame([(i + 1, k["candidate"]) for i, k in enumerate(kept)], "rank int, candidate long")
    return ok.join(kept, "candidate").join(r.select("candidate", "nodes"), "candidate").orderBy("rank")


def _close(x, y, sep_km: float):
    def d(a, b, c, e):
        h = F.pow(F.sin((F.radians(c) - F.radians(a)) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin((F.radians(e) - F.radians(b)) / 2), 2)
        return 2 * 6371008.8 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    return (d(x["slat"], x["slon"], y["slat"], y["slon"]) < sep_km * 1000) & (d(x["elat"], x["elon"], y["elat"], y["elon"]) < sep_km * 1000)


def plan(nodes: DataFrame, edges: DataFrame, start: tuple[float, float], end: tuple[float, float], params: RouteParams = RouteParams()) -> DataFrame:
    """One line from start to end, (lat, lon) each: its route and report; nothing is rejected."""
    spark = nodes.sparkSession
    c = snapped(spark.createDataFrame([(0, *start, *end)], "candidate long, slat double, slon double, elat double, elon double"), nodes)
    r = route(c, nodes, edges, params)
    return report(r, c, nodes, edges).join(r.select("candidate", "nodes", "cost"), "candidate")


def between(nodes: DataFrame, edges: DataFrame, start: tuple[float, float], end: tuple[float, float], alphas: list[float], params: RouteParams = RouteParams()) -> DataFrame:
    """plan for each strictness, best score first."""
    out = None
    for a in alphas:
        one = plan(nodes, edges, start, end, replace(params, alpha=a)).withColumn("alpha", F.lit(float(a)))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("score", "alpha")
