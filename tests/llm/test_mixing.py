from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loxo.llm.mixing import emitted, mix_sources

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (i % 3) + 1.0 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), "en", ["a", "b", "Z", None, "tiny"][0 if i % 3 == 0 else 4 if i == 1 else i % 4], 0) for i in range(600)]
    rows += [(7, "same words here", "en", "a", 0)] * 5 + [(900, None, "en", "b", 0), (901, " \t", None, "b", 0), (None, "x y", None, "Z", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_copies_and_reruns(spark):
    first = mix_sources(docs(spark)).drop("text")
    got = first.collect()
    assert len(got) == docs(spark).count()
    sizes = defaultdict(int)
    for r in docs(spark).collect():
        sizes[r.source] += len((r.text or "").split())
    want = water_fill(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 100
    assert sorted(map(str, mix_sources(docs(spark)).drop("text").collect())) == sorted(map(str, got))
    assert emitted(first).count() == sum(r.copies for r in got)


def test_empty_and_clashing_columns(spark):
    assert mix_sources(docs(spark).limit(0)).collect() == []
    d = docs(spark).withColumn("taken", F.lit(1)).withColumn("other", F.lit(2))
    assert mix_sources(d).columns.count("taken") == 1
