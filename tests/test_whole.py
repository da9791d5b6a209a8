"""Queries do the whole job: brute force over small tables of the test's own."""

import re

from loxo import api
from loxo import queries as own

SF01 = "/root/testdata/sf0.01"


def test_texts_are_split_to_their_end(spark, tmp_path):
    texts = {1: "ab  cd\n" * 60 + "é end", 2: "x" * 500 + " ñ", 3: "", 4: None, 5: " \n\n a"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, i, j, t, t[0] == " ") for d, text in texts.items() if text is not None for i, line in enumerate(text.split("\n")) for j, t in enumerate(re.findall(" +|[^ ]+", line))]
    got = own.queries()["text_tokens"](spark, str(tmp_path)).select("doc_id", "line", "pos", "token", "is_space").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    missing = {}
    for d, _, _, t, _ in want:
        c, n = missing.get(d, (0, 0))
        missing[d] = c + len(t), n + sum(not " " <= x <= "~" for x in t)
    assert {r.doc_id: (r.chars, r.missing) for r in own.queries()["glyph_missing"](spark, str(tmp_path)).collect()} == missing


def test_shapes_are_placed_at_every_candidate(spark):
    n = spark.read.parquet(f"{SF01}/supplier.parquet").count()
    placed = own.queries()["shape_placed"](spark, SF01)
    sizes = {r.kind: r["count"] for r in own.queries()["shape_vertices"](spark, SF01).groupBy("kind").count().collect()}
    got = {(r.candidate, r.kind): r["count"] for r in placed.groupBy("candidate", "kind").count().collect()}
    assert n > 20 and len(got) == n * len(sizes) and all(c == sizes[k] for (_, k), c in got.items())
    assert "CartesianProduct" not in placed._jdf.queryExecution().executedPlan().toString()


def test_deduplication_goes_beyond_hot_starts(spark):
    # 70 copies of one line, then 5 of another, then three apart.
    starts = [46.0] * 70 + [46.5] * 5 + [47.0, 47.5, 48.0]
    rows = [(i, 0, lat, 7.0, lat + 0.1, 7.5, 60.0 + i / 100, 50.0) for i, lat in enumerate(starts)]
    scored = spark.createDataFrame(rows, "candidate long, grp long, slat double, slon double, elat double, elon double, real_km double, ref_km double")
    scored = scored.selectExpr("*", "10000D as corridor_m", "0D as snap_m", "false as no_route", "false as hits_zone", "0D as max_dev", "0D as long_km", "0D as ascent_per_km")
    for name in ("dedup_lines", "dedup_shapes"):
        got = spark.sql(own.pairs[name](own.SPARK), scored=scored).collect()
        assert sorted((r["rank"], r.candidate) for r in got) == [(1, 0), (2, 70), (3, 75), (4, 76)]


def test_explore_goes_beyond_hot_starts(spark, monkeypatch):
    starts = [46.0] * 230 + [46.5, 47.0]
    c = spark.createDataFrame([(i, lat, 7.0, lat + 0.1, 7.5) for i, lat in enumerate(starts)], "candidate long, slat double, slon double, elat double, elon double")
    monkeypatch.setattr(api, "snapped", lambda c, n: c.selectExpr("*", "0D as sd", "0D as ed"))
    monkeypatch.setattr(api, "route", lambda c, n, e, p: c.selectExpr("candidate", "array(1L) as nodes"))
    monkeypatch.setattr(api, "report", lambda r, c, n, e: r.selectExpr("candidate", "0D as max_dev_m", "50D as total_km", "candidate / 10D as score"))
    got = api.explore(c, None, None, top=3).collect()
    assert [(r["rank"], r.candidate) for r in got] == [(1, 0), (2, 230), (3, 231)]
