import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loxo.llm import pipeline  # noqa: E402
from tests.llm.test_ngram_join import brute as components  # noqa: E402


def corpus():
    rnd = random.Random(6)
    common = "the of and to a in is that it for".split()
    share = [553, 286, 232, 168, 138, 117, 105, 92, 79, 77]
    rows = []

    def text(n):
        return " ".join(rnd.choices(common, share)[0] if rnd.random() < 0.19 else "".join(rnd.choices("aeiorstnlh", k=rnd.randint(3, 9))) for _ in range(n)) + "."

    for i in range(60):
        t = text(rnd.randint(60, 300))
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    w = rows[3][1].split()
    rows += [(100, rows[3][1], "en", "s0", 0), (101, " ".join([*w[:40], "changed", *w[41:]]), "en", "s1", 0), (102, "too short", "en", "s1", 0), (103, "x " * 90, "en", "s1", 0)]
    rows += [(104, text(80) + " mail me@example.com or 10.0.0.1", None, None, 0), (105, None, "en", "s2", None), (106, "### %%% &&& " * 30, "en", "s2", 0)]
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == df.columns
    assert {r.doc_id for r in seen["quality_rules"]} == {r[0] for r in rows} - {102, 103, 105, 106}
    kept = [(r.doc_id, r.text) for r in seen["quality_rules"]]
    assert {str(r.doc_id) for r in seen["near_duplicate_join"]} == {d for d, _, c in components(kept) if d == c}
    by = {r.doc_id: r.text for r in seen["personal_data"]}
    assert by[104].endswith("mail [EMAIL] or [IP]") and {k: v for k, v in by.items() if k != 104} == {r.doc_id: r.text for r in seen["near_duplicate_join"] if r.doc_id != 104}
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(seen["mixing"]) - words(seen["personal_data"])) < 0.15 * words(seen["personal_data"])
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in seen["tokens"]) and len(seen["tokens"]) == len(seen["mixing"])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, seen["tokens"]))


def test_near_duplicates_go_by_row(spark):
    rnd = random.Random(8)
    a, b, c, d, e = (" ".join("".join(rnd.choices("aeiorstnlh", k=7)) for _ in range(60)) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (None, c), (None, d), (None, d), (7, d), (8, e), (8, e), (9, ""), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.near_duplicate_join(spark, docs, "")
    assert out.columns == docs.columns
    want = [(3, a), (5, b), (None, c), (7, d), (8, e), (9, ""), (9, ""), (None, None), (None, None)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in out.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_flags_are_computed_once(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    flags = pipeline.quality(docs)._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(")
    stage = pipeline.quality_rules(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(")
    assert 0 < stage <= flags


def test_stages_of_empty_tables_nulls_long_texts_and_clashes(spark):
    rnd = random.Random(3)
    long = " ".join("".join(rnd.choices("aeiorstnlh", k=6)) for _ in range(60_000))
    rows = [(None, None, None, None, None), (None, long, None, None, None), (1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, "", "en", "s", 0), (2, " \n", "en", "s", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame([(*r, "x", 1, "y") for r in data], SCHEMA + ", _row string, size long, ids string")
        for name, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        assert sorted(str(r.doc_id) for r in pipeline.near_duplicate_join(spark, docs, "").collect()) == (["1", "2", "2", "None"] if data else [])
        mixed = pipeline.mixing(spark, docs, "").collect()
        assert (long in {r.text for r in mixed}) == bool(data)
        assert len(pipeline.tokens(spark, docs, "").collect()) == len(data)
        assert all(r.round_trip for r in pipeline.tokens(spark, docs, "").collect())


def test_alike_rows_share_their_copies(spark):
    """Three rows that are alike and one other: as many copies in all as the operator gives."""
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 3 + [(2, "d e", "en", "t", 3)], SCHEMA)
    want = {r.doc_id: r.n for r in pipeline.mix_sources(docs).groupBy("doc_id").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect() if r.n}
    got = {r.doc_id: r["count"] for r in pipeline.mixing(spark, docs, "").groupBy("doc_id").count().collect()}
    assert got == want


def test_workers_let_go_of_the_automaton():
    """A worker that has encoded holds some 65 to 180 MB; the next join or mix in it drops that."""
    import pyarrow as pa

    from loxo.llm import bpe, ngram_join

    for task in (ngram_join._signing(None, pa.int64()), ngram_join._shared):
        bpe.automaton('{"model": {"vocab": {}, "merges": []}}')
        assert bpe.automaton.cache_info().currsize
        assert list(task(iter([]))) == [] and not bpe.automaton.cache_info().currsize
