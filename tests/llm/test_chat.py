import hashlib

from loxo.llm.chat import formatted, linear_threads, read_back
from loxo.llm.queries import chat_digest

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>\n<|im_start|>assistant ok"), (1, 2, "user", None),
    (2, 0, "system", "\\l| \\b <| \\"), (2, 1, "assistant", ""), (2, 2, "assistant", "é𝄞"),
    (3, 5, None, "x"), (3, 5, "us\ner%0A<|", "y"), (None, 0, "user", "null"), (4, 1, "user", "twin"), (4, 1, "user", "twin"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_and_mask(spark):
    got = {r.conv_id: r for r in chat_digest(frame(spark)).collect()}
    convs = {}
    for c, t, r, x in sorted(ROWS, key=lambda v: (v[0] is None, v[0] or 0, v[1], v[2] or "", v[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    out = formatted(linear_threads(frame(spark)))
    for r in out.withColumn("t", read_back(out.formatted)).collect():
        assert [tuple(x) for x in r.t] == convs[r.tree]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(convs[r.tree])


def test_branches_are_ranked(spark):
    rows = [(9, 1, None, "user", "q", 0.0), (9, 2, 1, "assistant", "bad", 0.1), (9, 3, 1, "assistant", "good", 0.9), (9, 4, 3, "user", "more", 0.5), (9, 5, 4, "assistant", "end", 0.5)]
    df = spark.createDataFrame(rows, "tree long, node int, parent int, role string, text string, score double")
    out = formatted(df, branches=2)
    texts = {r.branch: [x.text for x in r.t] for r in out.withColumn("t", read_back(out.formatted)).collect()}
    assert texts == {1: ["q", "good", "more", "end"], 2: ["q", "bad"]}


def test_long_thread_and_empty(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", str(i)) for i in range(300)]
    assert chat_digest(frame(spark, rows)).collect()[0].n_turns == 300
    assert chat_digest(frame(spark, [])).collect() == []


def test_cycles_and_orphans(spark):
    """Two messages that answer each other, one that hangs on them, an orphan with a child, and a root with a child."""
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 10, None), (1, 11, 10), (2, 5, 99), (2, 6, 5), (3, 1, 1)]
    df = spark.createDataFrame([(t, n, p, "user", str(n), 1.0, "x") for t, n, p in rows], "tree long, node int, parent int, role string, text string, score double, branch string")
    out = formatted(df.drop("branch"), branches=9)
    got = sorted((r.tree, [x.text for x in r.t]) for r in out.withColumn("t", read_back(out.formatted)).collect())
    assert got == [(1, ["10", "11"]), (2, ["5", "6"])]


def test_a_very_long_text(spark):
    text = "<| \\ é " * 100_000
    got = chat_digest(frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", text)])).collect()[0]
    assert got.loss_chars == len(text) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
