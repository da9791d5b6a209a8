import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loxo.llm.toxicity import Field, _ratios, fit, learn, score

BAD = ["zorkface", "grubhead", "flimwit"]


def corpus(n=600):
    rnd, out = random.Random(4), []
    word = lambda: "".join(rnd.choices("abdeilnorst", k=rnd.randint(2, 7)))
    for i in range(n):
        w = [word() for _ in range(rnd.randint(5, 120))]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            w[rnd.randrange(len(w))] = rnd.choice(BAD)
        out.append((i, " ".join(w), y))
    return out


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(1)
    e, moves, start = rnd.normal(size=(1, 6)), rnd.normal(size=(2, 2)), 0.3
    total, marg = 0.0, np.zeros(6)
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        w = np.exp(start * y[0] + sum(e[0, i] * y[i] for i in range(6)) + sum(moves[y[i], y[i + 1]] for i in range(5)))
        total += w
        marg += w * np.array(y)
    assert np.allclose(_ratios(e, np.ones((1, 6), bool), moves, start)[2][0], marg / total)
    padded, mask = np.hstack([e, np.zeros((1, 3))]), np.array([[True] * 6 + [False] * 3])
    assert np.allclose(_ratios(padded, mask, moves, start)[2][0, :6], marg / total)


def test_held_out_accuracy_spans_and_hard_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (902, "fine words " * 60000, "s"), (0, rows[0][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (901, None)], "doc_id long, toxic int")
    model = learn(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = score(docs, model).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum((by[i].score >= 0.7) == bool(y) for i, _, y in held)
    assert right >= 0.97 * len(held)
    for i, t, y in held:
        if y and by[i].score >= 0.7:
            assert {t[s.start : s.end] for s in by[i].toxic_spans} & set(BAD)
    assert by[900].score == by[901].score < 0.5 and by[902].score < 0.5
    assert score(docs.limit(0), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = learn(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert model is None and score(docs, model).collect()[0].score == 0.0
    assert fit(["a"], [1]) is None and isinstance(fit(["a b", "c d"], [1, 0]), Field)


def test_offsets_are_of_the_text_itself(spark):
    """A character that lower-casing makes longer doesn't shift spans."""
    from loxo.llm.toxicity import SIZE, names

    w = np.zeros(SIZE, np.float32)
    w[zlib.crc32(names("badword")[0].encode()) % SIZE] = 9.0
    model = Field(w, np.zeros((2, 2)), -4.0)
    text = "İİ İstanbul badword end"
    r = score(spark.createDataFrame([(text,)], "text string"), model, least=0.9).collect()[0]
    assert [text[x.start : x.end] for x in r.toxic_spans] == ["badword"]
