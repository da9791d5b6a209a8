"""Connected components by contraction, in joins and aggregates over edges that each task has contracted first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task contracts at a time: a bound of its memory, not of the graph.
HELD = 1 << 20


def _tops(edges: pd.DataFrame):
    """The nodes in order, and for each the place of the smallest of its component."""
    codes, nodes = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True), sort=True)
    a, b = np.split(codes, 2)
    up = np.arange(len(nodes))
    while True:
        p, q = up[a], up[b]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(up, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (up[up] != up).any():
            up = up[up]
    return nodes, up


def _stars(edges: pd.DataFrame) -> pd.DataFrame:
    """The same components with every node joined to the smallest of its own."""
    nodes, up = _tops(edges)
    leaf = np.flatnonzero(up != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[leaf], "b": nodes[up[leaf]]})


def _contracted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part)
        if rows >= HELD:
            yield _stars(pd.concat(held, ignore_index=True))
            held, rows = [], 0
    if rows:
        yield _stars(pd.concat(held, ignore_index=True))


def _labelled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The labels of a whole graph that comes in parts; between them, what is held are a link a node and HELD edges."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part)
        if rows >= HELD:
            whole = pd.concat(held, ignore_index=True)
            nodes, up = _tops(whole)
            held, rows = [pd.DataFrame({"a": nodes, "b": nodes[up]})], 0
    if held:
        nodes, up = _tops(pd.concat(held, ignore_index=True))
        yield pd.DataFrame({"node": nodes, "component": nodes[up]})


def connected_components(edges: DataFrame, cut, tasks: int | None = None) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Each task first puts stars in place of the edges that it has, so long
    chains go, and a graph that fits a task is done.  Each round then hooks
    every node to its smallest neighbour, follows the hooks to their ends by
    doubling, and puts the edges between the ends in place of the edges; at
    least half of the nodes that still have edges go away, so a billion edges
    take some thirty rounds at most and mostly under six.  Hubs only meet in
    minima, which are partial before their exchange.  ``cut`` writes a
    DataFrame and returns it without lineage (a checkpoint).  Edges that are few
    beside the session's partitions are contracted in so many ``tasks``, each in
    one go of Python; one task labels the whole graph, without an exchange.
    """
    if tasks == 1:
        kind = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).schema
        return cut(edges.select("a", "b").coalesce(1).mapInPandas(_labelled, kind))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def contracted(pairs: DataFrame) -> DataFrame:
        slim = pairs.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        slim = slim.coalesce(tasks) if tasks else slim
        return cut(both(cut(slim.mapInPandas(_contracted, slim.schema))).distinct())

    left = contracted(edges)
    labels = cut(both(edges).select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while left.limit(1).count():
        hook = cut(left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("up")))
        while True:
            top = hook.select(F.col("x").alias("up"), F.col("up").alias("top"))
            hook = cut(hook.join(top, "up", "left").select("x", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")))
            if not hook.where("moved").limit(1).count():
                break
            hook = hook.drop("moved")
        hook = hook.select("x", "up")
        labels = cut(labels.join(hook.select(F.col("x").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        moved = left.join(hook.select(F.col("x").alias("a"), F.col("up").alias("p")), "a").join(hook.select(F.col("x").alias("b"), F.col("up").alias("q")), "b")
        left = contracted(moved.select(F.col("p").alias("a"), F.col("q").alias("b")))
    return labels
