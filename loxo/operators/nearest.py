"""Nearest nodes of points by grid cells that grow until the answer is certain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut


def nearest_nodes(points: DataFrame, nodes: DataFrame, key: list[str], k: int, cell: float = 0.05) -> DataFrame:
    """points(key.., lat, lon) with each one's k nearest nodes(node_id, nlat, nlon, ..): their columns, d2 (planar square degrees) and rank.

    A point meets the nodes of the 5 x 5 cells around it, so nothing nearer
    than two cells is missed.  The first cells, ``cell`` wide at most, are such
    that a circle of two cells holds some 2 k nodes where there are any.  Points whose k-th node lies within that are
    done; the others, where nodes are sparse or far, go on with cells four
    times as wide, until a cell holds everything.  On an even graph that is
    one join.  Ties go to the smaller node_id.
    """
    both = points.selectExpr("lat", "lon", "0 as here").unionByName(nodes.selectExpr("nlat as lat", "nlon as lon", "1 as here"))
    dense = both.groupBy(F.floor(F.col("lat") / cell), F.floor(F.col("lon") / cell)).agg(F.sum("here").alias("here"), *[f("lat").alias(f"{f.__name__}_lat") for f in (F.min, F.max)], *[f("lon").alias(f"{f.__name__}_lon") for f in (F.min, F.max)])
    box = dense.agg(F.greatest(F.max("max_lat") - F.min("min_lat"), F.max("max_lon") - F.min("min_lon")).alias("span"), F.avg(F.when(F.col("here") > 0, F.col("here"))).alias("mean")).first()
    cell = min(cell, cell * math.sqrt(2 * k / (4 * math.pi * (box["mean"] or 1))))
    around, found, todo = F.explode(F.sequence(F.lit(-2), F.lit(2))), None, points
    best = Window.partitionBy(*key).orderBy("d2", "node_id")
    while True:
        last = (box["span"] or 0.0) <= 2 * cell
        ring = todo.withColumn("_dy", around).withColumn("_dx", around).withColumns({"_cy": F.floor(F.col("lat") / cell) + F.col("_dy"), "_cx": F.floor(F.col("lon") / cell) + F.col("_dx")}).drop("_dy", "_dx")
        dealt = nodes.withColumns({"_cy": F.floor(F.col("nlat") / cell), "_cx": F.floor(F.col("nlon") / cell)})
        near = ring.join(dealt, ["_cy", "_cx"]).drop("_cy", "_cx").withColumn("d2", F.expr("(lat - nlat) * (lat - nlat) + (lon - nlon) * (lon - nlon)"))
        near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if last:
            return near if found is None else found.unionByName(near)
        near = cut(near)
        sure = near.groupBy(*key).agg(F.count("*").alias("_n"), F.max("d2").alias("_far")).where((F.col("_n") == k) & (F.col("_far") < (2 * cell) ** 2)).select(*key)
        part = near.join(sure, key, "left_semi")
        found = part if found is None else found.unionByName(part)
        todo = cut(todo.join(sure, key, "left_anti"))
        if not todo.limit(1).count():
            return found
        cell *= 4
