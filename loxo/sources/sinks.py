"""Routes as GPX and GeoJSON text, one row per route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(seq: str, lat: str, lon: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))))


def gpx(points: DataFrame, key: str = "route_id", name: str = "route") -> DataFrame:
    """(key, gpx) with 7 decimals; points(key, seq, lat, lon)."""
    p = points.groupBy(key).agg(_ordered("seq", "lat", "lon").alias("p"))
    track = F.array_join(F.transform("p", lambda x: F.format_string('<trkpt lat="%.7f" lon="%.7f"></trkpt>', x["lat"], x["lon"])), "\n")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="loxo" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return p.select(key, F.concat(F.lit(head), F.lit(f"{name} "), F.col(key).cast("string"), F.lit("</name><trkseg>\n"), track, F.lit("\n</trkseg></trk></gpx>\n")).alias("gpx"))


def geojson(points: DataFrame, key: str = "route_id", properties: list[str] = ()) -> DataFrame:
    """(key, geojson): a LineString feature in [lon, lat] order; properties are columns of points that are constant in a route."""
    p = points.groupBy(key).agg(_ordered("seq", "lat", "lon").alias("p"), *[F.first(c).alias(c) for c in properties])
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))
    return p.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*[F.col(c) for c in (key, *properties)]).alias("properties"))).alias("geojson"))
