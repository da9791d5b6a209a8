"""Elevation rasters, polygons and map extracts as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = -32768
SIDES = (1201, 3601)


def corner(stem: str) -> str:
    """SQL: struct(lat0, lon0) of a tile name such as N46E007; null unless it is one."""
    ok = f"upper({stem}) rlike '^[NS][0-9]{{2}}[EW][0-9]{{3}}$'"
    lat = f"cast(substring({stem}, 2, 2) as int) * case when upper(left({stem}, 1)) = 'S' then -1 else 1 end"
    lon = f"cast(substring({stem}, 5, 3) as int) * case when upper(substring({stem}, 4, 1)) = 'W' then -1 else 1 end"
    return f"case when {ok} then struct({lat} as lat0, {lon} as lon0) end"


def read_hgt(spark: SparkSession, folder: str) -> DataFrame:
    """(lat0, lon0, side, row, z array<int>): tile rows from north to south, voids null.  Files of other sizes or names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{hgt,HGT}").load(folder)
    sizes = [s * s * 2 for s in SIDES]
    files = files.where(F.col("length").isin(sizes)).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.(?i:hgt)$", 1))
    files = files.withColumn("at", F.expr(corner("stem"))).where("at is not null").select("at.lat0", "at.lon0", "content")

    def rows(batches):
        for pdf in batches:
            for t in pdf.itertuples():
                side = int(round((len(t.content) / 2) ** 0.5))
                z = np.frombuffer(t.content, ">i2").reshape(side, side).astype(np.int32)
                yield pd.DataFrame({"lat0": t.lat0, "lon0": t.lon0, "side": side, "row": range(side), "z": [[None if v == VOID else int(v) for v in r] for r in z]})

    return files.mapInPandas(rows, "lat0 int, lon0 int, side int, row int, z array<int>")


def stamped(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """points(id, lat, lon) with elev_m: bilinear over the four posts around, voids dropped and weights renormalised; null without posts.

    Each point asks for two tile rows in an equi-join, so only rows that are asked for move.
    """
    p = points.withColumns({"lat0": F.floor("lat").cast("int"), "lon0": F.floor("lon").cast("int")})
    side = tiles.select("lat0", "lon0", "side").distinct()
    p = p.join(side, ["lat0", "lon0"]).withColumns({"fy": (F.col("lat0") + 1 - F.col("lat")) * (F.col("side") - 1), "fx": (F.col("lon") - F.col("lon0")) * (F.col("side") - 1)})
    p = p.withColumn("row", F.explode(F.array(F.floor("fy").cast("int"), F.floor("fy").cast("int") + 1)))
    j = p.join(tiles.drop("side"), ["lat0", "lon0", "row"])
    wy = 1 - F.abs(F.col("fy") - F.col("row"))
    x0 = F.floor("fx").cast("int")
    each = [(F.get("z", x0 + k), wy * (1 - F.abs(F.col("fx") - (x0 + k)))) for k in (0, 1)]
    top = sum((F.when(z.isNotNull(), z * w).otherwise(0.0) for z, w in each), F.lit(0.0))
    low = sum((F.when(z.isNotNull(), w).otherwise(0.0) for z, w in each), F.lit(0.0))
    found = j.groupBy("id").agg(F.sum(top).alias("t"), F.sum(low).alias("w")).select("id", F.when(F.col("w") > 0, F.col("t") / F.col("w")).alias("elev_m"))
    return points.join(found, "id", "left")


_POSITION = T.ArrayType(T.DoubleType())
_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """(zone, poly, ring, seq, lon, lat) of the Polygon and MultiPolygon features of GeoJSON files; zone is the file's stem, ring 0 the outer one; rings under three points are left out."""
    feature = T.StructType([T.StructField("geometry", _GEOMETRY)])
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(feature)), T.StructField("geometry", _GEOMETRY), T.StructField("coordinates", T.StringType())])
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("zone"), F.from_json("value", schema).alias("g"))
    one = F.when(F.col("g.type") == "FeatureCollection", F.transform("g.features", lambda f: f["geometry"])).when(F.col("g.type") == "Feature", F.array("g.geometry")).otherwise(F.array(F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates"))))
    geo = raw.select("zone", F.posexplode(one).alias("part", "geo")).where(F.col("geo.type").isin("Polygon", "MultiPolygon"))
    rings = T.ArrayType(T.ArrayType(_POSITION))
    polygons = F.when(F.col("geo.type") == "Polygon", F.array(F.from_json("geo.coordinates", rings))).otherwise(F.from_json("geo.coordinates", T.ArrayType(rings)))
    p = geo.select("zone", "part", F.posexplode(polygons).alias("k", "rings")).select("zone", (F.col("part") * 1000 + F.col("k")).alias("poly"), F.posexplode("rings").alias("ring", "points"))
    return p.where(F.size("points") >= 3).select("zone", "poly", "ring", F.posexplode("points").alias("seq", "at")).select("zone", "poly", "ring", "seq", F.get("at", F.lit(0)).alias("lon"), F.get("at", F.lit(1)).alias("lat"))


def graph_tables(nodes: DataFrame, ways: DataFrame, want: int = 7) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (both ways) of a routable graph from decoded map tables nodes(id, lat, lon) and ways(id, nodes array<bigint>, tags map).

    Ways are filtered by their tags before any node is read, node pairs are
    made inside each row, and coordinates join on ids; nodes without an edge
    don't appear, parallel edges stay.
    """
    from ..functions import geodesy as G
    from ..functions import tags as K

    names = {"route": "route", "highway": "highway", "surface": "surface", "tracktype": "tracktype", "bicycle": "bicycle", "foot": "foot", "access": "access", "lcn": "lcn", "rcn": "rcn", "ncn": "ncn"}
    of = {k: f"tags['{v}']" for k, v in names.items()}
    kept = ways.where("coalesce(tags['natural'], '') <> 'glacier'").selectExpr("id as way_id", "nodes", f"{K.modes(of, want)} as modes", f"{K.way_surface(of)} as surface", f"{K.bike_attrs(of)} as bike_attrs").where("modes <> 0 and size(nodes) > 1")
    pair = kept.selectExpr("way_id", "modes", "surface", "bike_attrs", "explode(transform(sequence(0, size(nodes) - 2), i -> named_struct('a', nodes[i], 'b', nodes[i + 1]))) as p").selectExpr("way_id", "modes", "surface", "bike_attrs", "p.a as src", "p.b as dst")
    at = lambda k, s: nodes.selectExpr(f"id as {k}", f"lat as {s}lat", f"lon as {s}lon")
    one = pair.join(at("src", "s"), "src").join(at("dst", "d"), "dst").withColumn("length_m", F.expr(G.haversine(("slat", "slon"), ("dlat", "dlon")))).where("length_m > 0")
    cols = ["src", "dst", "slat", "slon", "dlat", "dlon", "length_m", "modes", "surface", "bike_attrs", "way_id"]
    back = one.selectExpr("dst as src", "src as dst", "dlat as slat", "dlon as slon", "slat as dlat", "slon as dlon", *cols[6:])
    edges = one.select(*cols).unionByName(back.select(*cols))
    return edges.selectExpr("src as node_id", "slat as lat", "slon as lon").distinct(), edges
