"""Approximate nearest neighbours: NN-descent builds a graph, greedy search answers queries.

Nearness is the largest inner product.  For the graph, vectors get one more
component that brings all to one norm, so that close in the graph means close
for any query; queries have 0 there.  Vectors travel as half-precision
binaries, scores are computed at the end from the original vectors in double
precision.

Graph.  Edges (id, nbr, sim, fresh), ``degree`` per id.  They start from blocks
of ``BLOCK`` vectors, adjacent in a range order of random hyperplane codes,
compared within the block.  In each round every id hands its vector to a
hashed share of the ids it lists and of those that list it, all in joins; what
meets at an id (neighbours of a neighbour) is compared where one of two is
fresh, and pairs that beat a member's worst edge go back to it.  Ids meet in
streams sorted by id, so memory holds one id's meeting; an id that very many
list compares its meeting in pieces of ``MEETING``.

Search.  A query is a row of the table, so it enters the graph at its own
edges.  Each round expands the unexpanded ids among its best ``beam`` along
edges both ways, and scores what it hasn't seen; it ends when nothing better
turns up, or after ``hops``.  Where norms differ, the ``beam`` longest vectors
are entries too.

Copies.  Equal vectors (by a 64-bit hash) are one class, and its smallest id
stands for it in graph and search, for queries too.  What is found is expanded
exactly: a class's ``k`` + 1 smallest ids are all that an answer can use, and
the queries of a class share one list of ``k`` + 1, each without itself.

All vectors are indexed.  Recall against brute force is measured in the tests.

Defined cases: vectors that are null, empty, zero, of another length than the
commonest or hold null or non-finite components take no part; of rows that
repeat an id the smallest vector counts; ties go to the smaller id; fewer
candidates than k give shorter lists; an empty table an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, written

BLOCK, MEETING = 256, 192
#: So many queries of a class meet its list in one go.
SHARE = 64


@dataclass(frozen=True)
class Descent:
    degree: int = 48
    trees: int = 3
    rounds: int = 7
    share: float = 0.5
    best: int = 8
    beam: int = 128
    hops: int = 4
    seed: int = 11


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v array<double>, norm) of the vectors that take part."""
    v = F.col("v")
    df = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    df = df.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    df = df.groupBy("id").agg(F.min("v").alias("v"))
    return df.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _halves(column) -> np.ndarray:
    """Rows of half-precision binaries as a float32 matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return data.view(np.float16).reshape(len(c), -1).astype(np.float32)


def _binaries(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m.astype(np.float16)], pa.binary())


def _prepared(vectors: DataFrame, largest: float, bits: int, s: Descent, dims: int) -> DataFrame:
    """(id, vec, code0.., order): binaries scaled by the largest norm, with the further component and block codes."""
    planes = np.random.default_rng(s.seed).normal(size=(s.trees, dims + 1, bits + 1)).astype(np.float32)

    def make(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(len(b), dims) / largest
            rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
            m = np.hstack([x, rest[:, None]]).astype(np.float32)
            cols = [b.column(0), _binaries(m)]
            for p in planes:
                y = m @ p
                cols += [pa.array(((y[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64)), pa.array(y[:, bits].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["id", "vec"] + [f"{x}{t}" for t in range(s.trees) for x in ("code", "place")]
    return vectors.select("id", "v").mapInArrow(make, "id long, vec binary, " + ", ".join(f"code{t} long, place{t} double" for t in range(s.trees)))


def _blocks(v: DataFrame, t: int, keep: int, n: int) -> DataFrame:
    """Edges within blocks of BLOCK in the order of tree t's codes."""

    def compare(batches):
        ids, vecs = [], []

        def out(i, m):
            sim = m @ m.T
            np.fill_diagonal(sim, -np.inf)
            k = min(keep, len(i) - 1)
            if k < 1:
                return None
            top = np.argpartition(-sim, k - 1, 1)[:, :k]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(i, k)), pa.array(i[top].ravel()), pa.array(np.take_along_axis(sim, top, 1).ravel().astype(np.float32))], names=["id", "nbr", "sim"])

        held = 0
        for b in batches:
            ids.append(b.column(0).to_numpy())
            vecs.append(_halves(b.column(1)))
            held += len(b)
            if held < 2 * BLOCK:
                continue
            i, m = np.concatenate(ids), np.vstack(vecs)
            full = (held // BLOCK - 1) * BLOCK
            for a in range(0, full, BLOCK):
                yield out(i[a : a + BLOCK], m[a : a + BLOCK])
            ids, vecs, held = [i[full:]], [m[full:]], held - full
        if held:
            i, m = np.concatenate(ids), np.vstack(vecs)
            cut = [0, held] if held <= BLOCK else [0, held // 2, held]
            for a, z in zip(cut, cut[1:], strict=False):
                if (r := out(i[a:z], m[a:z])) is not None:
                    yield r

    key = [f"code{t}", f"place{t}", "id"]
    return v.select("id", "vec", *key[:2]).repartitionByRange(n, *key).sortWithinPartitions(*key).select("id", "vec").mapInArrow(compare, "id long, nbr long, sim float")


def _best_edges(edges: DataFrame, degree: int, n: int) -> DataFrame:
    """The ``degree`` best of edges(id, nbr, sim, fresh) per id, each nbr once, not fresh if it was there before."""

    def best(batches):
        rest = None
        for b in batches:
            part = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if rest is not None:
                part = [np.append(x, y) for x, y in zip(rest, part, strict=True)]
            last = int(np.searchsorted(part[0], part[0][-1]))
            if len(part[0]) - last > 50_000:  # one id with very many offers: keep its best and go on
                head, tail = [x[:last] for x in part], [x[last:] for x in part]
                rest = cut(tail)
            else:
                head, rest = [x[:last] for x in part], [x[last:] for x in part]
            if last:
                yield batch(cut(head))
        if rest is not None and len(rest[0]):
            yield batch(cut(rest))

    def cut(p):
        i, nbr, sim, fresh = p
        order = np.lexsort((fresh, nbr, i))
        i, nbr, sim, fresh = (x[order] for x in (i, nbr, sim, fresh))
        first = np.append(True, (i[1:] != i[:-1]) | (nbr[1:] != nbr[:-1]))
        i, nbr, sim, fresh = (x[first] for x in (i, nbr, sim, fresh))
        order = np.lexsort((nbr, -sim, i))
        i, nbr, sim, fresh = (x[order] for x in (i, nbr, sim, fresh))
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        return [x[rank < degree] for x in (i, nbr, sim, fresh)]

    def batch(p):
        return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), pa.array(p[2], pa.float32()), pa.array(p[3].astype(bool))], names=["id", "nbr", "sim", "fresh"])

    return edges.repartition(n, "id").sortWithinPartitions("id").mapInArrow(best, "id long, nbr long, sim float, fresh boolean")


def _meet(handed: DataFrame, best: int, n: int) -> DataFrame:
    """From handed(center, member, fresh, vec, worst): offers (id, nbr, sim) that beat id's worst edge."""

    def compare(batches):
        rest = None

        def offers(part):
            center, member, fresh, worst, m = part
            bounds = np.flatnonzero(np.append(True, center[1:] != center[:-1]))
            outs = ([], [], [])
            for a, z in zip(bounds, np.append(bounds[1:], len(center)), strict=True):
                for lo in range(a, z, MEETING):
                    hi = min(lo + MEETING, z)
                    if hi - lo < 2 or not fresh[lo:hi].any():
                        continue
                    x = m[lo:hi]
                    sim = x @ x.T
                    old = ~fresh[lo:hi]
                    sim[np.ix_(old, old)] = -np.inf
                    ids = member[lo:hi]
                    sim[ids[:, None] == ids[None, :]] = -np.inf
                    k = min(best, hi - lo - 1)
                    top = np.argpartition(-sim, k - 1, 1)[:, :k]
                    s = np.take_along_axis(sim, top, 1)
                    r, c = np.nonzero(s > worst[lo:hi, None])
                    outs[0].append(ids[r])
                    outs[1].append(ids[top[r, c]])
                    outs[2].append(s[r, c])
            if outs[0]:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(outs[0])), pa.array(np.concatenate(outs[1])), pa.array(np.concatenate(outs[2]).astype(np.float32))], names=["id", "nbr", "sim"])

        for b in batches:
            part = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False), _halves(b.column(3))]
            if rest is not None:
                part = [np.concatenate([x, y]) for x, y in zip(rest, part, strict=True)]
            last = int(np.searchsorted(part[0], part[0][-1]))
            if len(part[0]) - last >= 4 * MEETING:  # an id with very many members: its pieces needn't wait for the rest
                last = len(part[0])
            if last and (r := offers([x[:last] for x in part])) is not None:
                yield r
            rest = [x[last:] for x in part] if last < len(part[0]) else None
        if rest is not None and (r := offers(rest)) is not None:
            yield r

    ordered = handed.select("center", "member", "fresh", "vec", "worst").repartition(n, "center").sortWithinPartitions("center")
    return ordered.mapInArrow(compare, "id long, nbr long, sim float")


def build_graph(v: DataFrame, s: Descent, n: int, blocks: int) -> DataFrame:
    """Edges (id, nbr, sim, fresh) among v(id, vec, code.., place..)."""
    first = None
    for t in range(s.trees):
        b = _blocks(v, t, max(s.degree // 2, 1), blocks)
        first = b if first is None else first.unionByName(b)
    edges = checkpointed(_best_edges(first.withColumn("fresh", F.lit(True)), s.degree, n))
    for r in range(s.rounds):
        lot = F.pmod(F.xxhash64("id", "nbr", F.lit(s.seed + r)), F.lit(1000)) < int(1000 * s.share)
        now = edges.withColumn("used", lot)
        sent = now.where("used")
        listed = sent.select(F.col("id").alias("center"), F.col("nbr").alias("member"), "fresh").unionByName(sent.select(F.col("nbr").alias("center"), F.col("id").alias("member"), "fresh"))
        worst = edges.groupBy("id").agg(F.when(F.count("*") >= s.degree, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        held = v.select("id", "vec").join(worst, "id", "left").select(F.col("id").alias("member"), "vec", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
        offers = _meet(listed.groupBy("center", "member").agg(F.max("fresh").alias("fresh")).join(held, "member"), s.best, n)
        both = now.select("id", "nbr", "sim", (F.col("fresh") & ~F.col("used")).alias("fresh")).unionByName(offers.withColumn("fresh", F.lit(True)))
        edges = checkpointed(_best_edges(both, s.degree, n))
    return edges


def _scored(pairs: DataFrame, queries: DataFrame, v: DataFrame) -> DataFrame:
    """pairs(q, cand) with sim."""

    def dot(batches):
        for b in batches:
            sim = np.einsum("ij,ij->i", _halves(b.column(2)), _halves(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim.astype(np.float32))], names=["q", "cand", "sim"])

    joined = pairs.join(queries, "q").join(v.select(F.col("id").alias("cand"), "vec"), "cand").select("q", "cand", "qvec", "vec")
    return joined.mapInArrow(dot, "q long, cand long, sim float")


def search(v: DataFrame, edges: DataFrame, queries: DataFrame, s: Descent, entries: tuple = ()) -> DataFrame:
    """(q, cand): the best ``beam`` found for each of queries(q), from its own edges and ``entries``."""

    def as_query(batches):
        for b in batches:
            m = _halves(b.column(1))
            m[:, -1] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), _binaries(m)], names=["q", "qvec"])

    q = checkpointed(v.select("id", "vec").join(queries.select(F.col("q").alias("id")), "id", "left_semi").mapInArrow(as_query, "q long, qvec binary"))
    ways = checkpointed(edges.select("id", "nbr").unionByName(edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct())
    own = ways.select(F.col("id").alias("q"), F.col("nbr").alias("cand")).join(q.select("q"), "q", "left_semi")
    if entries:
        own = own.unionByName(q.select("q", F.explode(F.array(*[F.lit(e) for e in entries])).alias("cand")).where("q != cand")).distinct()
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "cand")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.beam).drop("rank")
    seen = checkpointed(_scored(own, q, v).withColumn("hop", F.lit(0)))
    beam = checkpointed(top(seen.drop("hop")).withColumn("done", F.lit(False)))
    for hop in range(1, s.hops + 1):
        step = beam.where("not done").select("q", F.col("cand").alias("id")).join(ways, "id").select("q", F.col("nbr").alias("cand")).where("q != cand").distinct()
        new = checkpointed(_scored(step.join(seen.select("q", "cand"), ["q", "cand"], "left_anti"), q, v))
        seen = seen.unionByName(new.withColumn("hop", F.lit(hop)))
        worst = beam.groupBy("q").agg(F.when(F.count("*") >= s.beam, F.min("sim")).otherwise(F.lit(-3.0)).alias("least"))
        better = new.join(worst, "q").where("sim > least").select("q", "cand", "sim", F.lit(False).alias("done"))
        beam = checkpointed(top(beam.withColumn("done", F.lit(True)).unionByName(better)))
        if not beam.where("not done").limit(1).count():
            break
    return beam.select("q", "cand")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", settings: Descent = Descent()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which is_query, a condition on ``id``, holds."""
    n = partitions(rows.sparkSession)
    vectors = usable(rows, vec_id, vector)
    length = F.size("v")
    common = vectors.groupBy(length.alias("dims")).agg(F.count("*").alias("n"), F.max("norm").alias("largest"), F.min("norm").alias("least")).orderBy(F.desc("n"), "dims").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return rows.sparkSession.createDataFrame([], schema)
    dims, count, largest, least = common[0]
    classed = vectors.where(length == dims).withColumn("class", F.xxhash64("v"))
    classes = written(classed.groupBy("class").agg(F.min(F.struct("id", "v", "norm")).alias("r")).select("class", "r.*"))
    ids = written(classed.select("class", "id"))
    count = classes.count()
    bits = int(min(48, max(0, np.ceil(np.log2(max(count, 1) / BLOCK)))))
    v = checkpointed(_prepared(classes, largest, bits, settings, dims))
    edges = build_graph(v, settings, n, max(1, min(n, count // (4 * BLOCK))))
    asked = ids.where(is_query)
    sizes = asked.groupBy("class").agg(F.count("*").alias("asked"))
    queries = classes.join(sizes, "class", "left_semi").select(F.col("id").alias("q"))
    # Where norms differ, long vectors are near many queries: the longest few are entries beside a query's own edges.
    few = classes.orderBy(F.desc("norm"), "id").limit(settings.beam).select("id") if least < 0.98 * largest else None
    found = search(v, edges, queries, settings, tuple(r.id for r in few.collect()) if few is not None else ())
    found = found.unionByName(queries.select("q", F.col("q").alias("cand")))
    a, b = classes.select(F.col("id").alias("q"), F.col("class").alias("asking"), F.col("v").alias("x")), classes.select(F.col("id").alias("cand"), "class", F.col("v").alias("y"))
    exact = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda acc, t: acc + t)
    scored = found.join(a, "q").join(b, "cand").select("asking", "class", "cand", exact.alias("score"))

    def best(df: DataFrame, of: str, *order, to: int = k + 1) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(*order))).where(F.col("rank") <= to)

    # A class beyond the first k + 1 has no id among the first k + 1 ids.
    near = best(scored, "asking", F.desc("score"), "cand").select("asking", "class", "score")
    members = best(ids, "class", "id").groupBy("class").agg(F.collect_list("id").alias("ids"))
    spread = near.join(members, "class").select("asking", "score", F.explode("ids").alias("vec_id"))
    lists = best(spread, "asking", F.desc("score"), "vec_id").groupBy("asking").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("list")).withColumnRenamed("asking", "class")
    # Classes that many queries share are dealt out in shares.
    hot = F.broadcast(sizes.where(F.col("asked") > SHARE).select("class", F.ceil(F.col("asked") / SHARE).alias("shares")))
    shares = F.coalesce("shares", F.lit(1))
    dealt = asked.join(hot, "class", "left").select("class", F.pmod(F.xxhash64("id"), shares).alias("share"), F.col("id").alias("query_id"))
    given = lists.join(hot, "class", "left").select("class", F.explode(F.sequence(F.lit(0).cast("long"), shares.cast("long") - 1)).alias("share"), "list")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = dealt.join(given, ["class", "share"]).select("query_id", F.posexplode(others).alias("pos", "t"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "t.vec_id", "t.score")
