import numpy as np
import pytest
from pyspark.sql import functions as F

from loxo.llm.neighbours import nearest


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors], "vec_id long, embedding array<float>, rank int")


def brute(vectors, k, step):
    ids = [i for i, _ in vectors]
    x = np.array([np.asarray(v, np.float32) for _, v in vectors], float)
    out = {}
    for q in range(len(ids)):
        if ids[q] % step == 0:
            s = x @ x[q]
            out[ids[q]] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != q), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


@pytest.mark.parametrize('varied', [False, True])
def test_recall_on_clusters_and_noise(spark, varied):
    rnd = np.random.default_rng(2)
    centers = rnd.normal(size=(12, 32))
    x = np.vstack([rnd.normal(size=(1200, 32)), centers[rnd.integers(0, 12, 900)] + 0.3 * rnd.normal(size=(900, 32)), centers[0] + 0.02 * rnd.normal(size=(400, 32))])
    x *= rnd.uniform(0.5, 2, size=(len(x), 1)) if varied else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = list(enumerate(x))
    got = {}
    for r in nearest(frame(spark, vectors), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(vectors, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(want[q]) & {r.vec_id for r in got[q]}) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        assert [r.rank for r in rows] == list(range(1, 21)) and q not in {r.vec_id for r in rows}
        for r in rows:
            assert abs(r.score - float(np.float32(x[q]).astype(float) @ np.float32(x[r.vec_id]).astype(float))) < 1e-9
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))


def test_hard_cases(spark):
    v = [(0, [1, 0]), (20, [0, 1]), (3, None), (4, []), (5, [0, 0]), (6, [None, 1]), (7, [float("nan"), 1]), (8, [float("inf"), 1]), (9, [1, 2, 3]), (10, [1, 0]), (11, [1, 0]), (11, [1, 0]), (None, [1, 1])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(frame(spark, v), F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 10, 1.0), (0, 2, 11, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 10, 0.0), (20, 3, 11, 0.0)]
    assert nearest(frame(spark, [(0, [1, 0])]), F.col("id") % 20 == 0).collect() == []
    assert nearest(frame(spark, []), F.col("id") % 20 == 0).collect() == []


def test_copies_give_the_smallest_ids(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rnd.permutation(700)[:600]] = x[0]  # more than a block
    x[680:] = x[680]  # fewer than k
    vectors = list(enumerate(x))
    got = {}
    for r in nearest(frame(spark, vectors), F.col("id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(vectors, 20, 5)
    same = [(i, [1, 0]) for i in range(300)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(frame(spark, same), F.col("id") == 280, k=3).collect())
    assert got == [(280, 1, 0, 1.0), (280, 2, 1, 1.0), (280, 3, 2, 1.0)]
