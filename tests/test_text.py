import random
import re

from loxo.operators import text
from loxo.operators.text import block_size, laid_out


def test_wrapping_missing_and_size(spark):
    glyphs = spark.createDataFrame([(ord("A"), 10), (ord(" "), 5)], "code int, width int")
    texts = spark.createDataFrame([(1, "AA AA\nA"), (2, "Añ"), (3, ""), (4, None)], "id long, text string")
    got = sorted((r.id, r.line, r.pos, r.row, r.token, r.x, r.width, r.missing) for r in laid_out(texts, glyphs, 10.0, 45.0).collect())
    # Tracking is 6: AA is 26 wide, the blank stays on the first row.
    assert got[:4] == [(1, 0, 0, 0, "AA", 0.0, 26.0, 0), (1, 0, 1, 0, " ", 32.0, 5.0, 0), (1, 0, 2, 1, "AA", 0.0, 26.0, 0), (1, 1, 0, 0, "A", 0.0, 10.0, 0)]
    assert got[4][4:] == ("Añ", 0.0, 16.0, 1) and len(got) == 5
    size = {r.id: (r.width, r.height) for r in block_size(laid_out(texts, glyphs, 10.0, 45.0), 10.0).collect()}
    assert size[1] == (37.0, 45.0)


def fold(text, widths, cap, limit):
    """Tokens one after the other, in plain Python."""
    spaced, out = 0.6 * cap, []
    for line, body in enumerate((text or "").split("\n")):
        x, row = 0.0, 0
        for pos, token in enumerate(re.findall("( +|[^ ]+)", body)):
            width = 0.0
            for c in token:
                width = width + (widths.get(ord(c)) or 0.0) + spaced
            width -= spaced
            if token[0] != " " and x > 0 and x + width > limit:
                x, row = 0.0, row + 1
            out.append((line, pos, row, token, x, width, sum(widths.get(ord(c)) is None for c in token)))
            x = x + width + spaced
    return out


def test_a_line_of_many_words_is_one_pass(spark, monkeypatch):
    # 60,000 tokens on a line: copying what is laid out at each step did not end in minutes.
    monkeypatch.setattr(text, "AT_ONCE", 500)
    rnd = random.Random(3)
    words = ["a", "bc", "déf", "😀gh", "i" * 70, "x,y", "\t", "\r"]
    texts = {i: "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", " \n\n "]) for _ in range(rnd.randrange(200))) for i in range(40)} | {40: "ab cde " * 30_000, 41: None, 42: "", 43: "\n", 44: "x" * 5000, 45: " "}
    widths = {ord(c): 5.0 + ord(c) % 13 for c in " abcdefghi😀"} | {ord("x"): None}
    glyphs = spark.createDataFrame(list(widths.items()), "code int, width double")
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    for wrap in (900.0, None):
        want = {(i, *r) for i, t in texts.items() for r in fold(t, widths, 23.0, wrap or float("inf"))}
        assert {tuple(r) for r in laid_out(docs, glyphs, 23.0, wrap).collect()} == want
        sums = {}
        for i, _, _, _, _, x, width, missing in want:
            n, m, w = sums.get(i, (0, 0, 0.0))
            sums[i] = n + 1, m + missing, max(w, x + width)
        assert {r[0]: tuple(r[1:]) for r in text.extents(docs, glyphs, 23.0, wrap).collect()} == sums
