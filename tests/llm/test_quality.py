import math
import random
import re
from collections import Counter

from loxo.llm.quality import COMMON_WORDS, QualityRules, quality, references

RULES = QualityRules()


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def base(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by the plain rule."""
    w = words(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    inside = {j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def classes(t):
    solid = "".join(words(t))
    upper, symbol, digit = (sum(c in s for c in solid) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&|<>", "0123456789"))
    mark = sum(c in "!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`{|}~" for c in solid)
    return [len(solid) - mark, upper, symbol, digit, mark - upper - symbol - digit]


def language(t):
    w = words(t)
    return max((sum(x in common for x in w), k) for k, common in COMMON_WORDS.items())


def common_counts(t, k):
    c = [words(t).count(x) for x in COMMON_WORDS[k]]
    return [*c, len(words(t)) - sum(c)]


def distance(counts, reference):
    if not sum(counts):
        return 1.0
    p, q = [c / sum(counts) for c in counts], [r / sum(reference) for r in reference]
    one = lambda a, m: a * math.log2(a / m) if a else 0.0
    return math.sqrt(max(0.0, sum(one(x, (x + y) / 2) + one(y, (x + y) / 2) for x, y in zip(p, q, strict=True)) / 2))


def learned(texts):
    chars, counts = {}, {}
    for t in texts:
        n, k = language(t)
        if len(words(t)) >= RULES.min_words and 100 * n >= RULES.least_known * len(words(t)):
            chars[k] = [a + b for a, b in zip(chars.get(k, [0] * 5), classes(t), strict=True)]
            counts[k] = [a + b for a, b in zip(counts.get(k, [0] * 11), common_counts(t, k), strict=True)]
    good = [k for k in counts if sum(counts[k]) >= RULES.least_words]
    return {k: chars[k] for k in good}, {k: counts[k] for k in good}


def corpus(seed=4):
    rnd = random.Random(seed)

    def text(lang, n):
        w = [rnd.choice(COMMON_WORDS[lang]) if rnd.random() < 0.25 else "".join(rnd.choices("aeiourstlnhé", k=rnd.randint(2, 9))) for _ in range(n)]
        w = [x.capitalize() + "." if rnd.random() < 0.1 else x for x in w]
        return "".join(x + rnd.choice([" ", " ", " ", "\n", " \t", "\x0b"]) for x in w)

    out = [text(rnd.choice(["en", "de"]), rnd.randint(1, 400)) for _ in range(60)] + [text("fr", 90)]
    line = text("en", 12).replace("\n", " ")
    out += [out[0], out[0], None, "", " \n\t", "\n".join([line] * 30), line + "\n\n" + line, (line + "\n") * 2 + text("en", 300), "x " * 5000]
    out += ["### $$$ 12 | " * 20 + text("en", 80), "1 2 3 4 " * 9, " ".join(str(rnd.random()) for _ in range(200)), "中文 字\xa0é 𝄞 " * 9, "a\x1cb\x85c " * 30, text("en", 40_000)]
    base8 = [f"w{i}" for i in range(8)]
    out += [" ".join(base8 + ["mid"] + base8 + [f"v{i}" for i in range(40)]), " ".join(f"{i % 9}" for i in range(100)), text("es", 30)]
    return out


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, _words int").repartition(5)
    chars, counts = learned(texts)
    known = references(docs)
    assert {k: list(v) for k, v in known.chars.items()} == chars and {k: list(v) for k, v in known.words.items()} == counts and set(counts) == {"en", "de"}
    out = quality(docs)
    assert [c for c in out.columns if c.startswith("_")] == ["_words"]
    for r in out.collect():
        t = texts[r.doc_id]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base(t), r.doc_id
        far_chars = min(distance(classes(t), c) for c in chars.values())
        far_words = distance(common_counts(t, language(t)[1]), counts[language(t)[1]]) if language(t)[1] in counts else None
        assert abs(r.char_distance - far_chars) < 1e-9 and (r.word_distance is None) == (far_words is None)
        assert far_words is None or abs(r.word_distance - far_words) < 1e-9
        chance = lambda n, k: math.sqrt((k - 1) / 8 / math.log(2) / max(n, 1))
        far = far_chars > RULES.char_far + RULES.char_spread * chance(r.word_chars, 5) or (far_words is not None and far_words > RULES.word_far + RULES.word_spread * chance(r.n_words, 11))
        assert r.kept == (not r.base_failed and not far) and r["_words"] == -1 and r.text == t


def test_no_references_and_no_rows(spark):
    few = spark.createDataFrame([(1, "the of and " + " ".join(f"w{i}" for i in range(30))), (1, None), (None, "short")], "doc_id long, text string")
    rows = quality(few).collect()
    assert sorted((r.kept, r.char_distance, r.word_distance) for r in rows) == [(False, None, None), (False, None, None), (True, None, None)]
    assert quality(few.limit(0)).collect() == []
