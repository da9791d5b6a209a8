import random
import re

import numpy as np

from loxo.llm.ngram_join import near_duplicates, parities, signatures
from loxo.llm.shingles import shingle_sets


def brute(rows):
    """(n_shingles, component_id) per row, all pairs compared."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(s), str(d if not s else least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def rows(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdé", k=rnd.randint(2, 6)))
    passage = " ".join(word() for _ in range(30))
    out = []
    for n in (1, 3, 5, 8, 9, 12, 20, 43, 44, 45, 60, 90, 200, 700):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(5):
                w = list(base)
                for _ in range(rnd.randint(0, 1 + n // 25)):
                    k = rnd.randrange(len(w)) if w else 0
                    w[k : k + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
                t = " ".join(w)
                out.append(rnd.choice([t, t, t.upper() if "é" not in t else t, t.replace(" ", "\n\t"), t + "\n" + passage]))
    out += ["", None, " \n", "\x0b", "x\xa0y z", "X\xa0Y z"] + [passage] * 4
    rnd.shuffle(out)
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (3, "other text of a repeated id here"), (None, out[5])]


def test_against_all_pairs(spark):
    for seed in (1, 2):
        r = rows(seed)
        df = spark.createDataFrame([(d, t, 0) for d, t in r], "doc_id long, text string, component_id int").repartition(5)
        got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in near_duplicates(df).collect())
        assert got == brute(r)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_partners_share_a_signature():
    rnd = np.random.default_rng(3)
    seen = 0
    for n in (4, 5, 9, 20, 38, 39, 40, 41, 49, 50, 59, 60, 75, 89, 90, 134, 135, 300, 1000):
        for _ in range(40):
            r = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
            s = r[rnd.permutation(len(r))[rnd.integers(0, n // 5 + 1) :]]
            more = int(len(s) / 0.8 - len(r))
            if more < 0:
                continue
            s = np.unique(np.append(s, rnd.integers(0, 2**64, more, dtype=np.uint64)))
            common = len(np.intersect1d(r, s))
            if 100 * common >= 80 * (len(r) + len(s) - common) and common < max(len(r), len(s)):
                seen += 1
                assert len(np.intersect1d(signatures(r), signatures(s)))
                for share in (0.3, 0.8):  # any features may be called frequent
                    of = lambda x, share=share: x % np.uint64(1000) < np.uint64(1000 * share)
                    assert len(np.intersect1d(signatures(r, of(r)), signatures(s, of(s))))
    assert seen > 200


def test_sets_do_not_depend_on_the_batch():
    texts = [b"a b c d e f g", b"", b"One TWO", b"x " * 5000, "é ü A b c d e".encode()]
    whole = shingle_sets(texts)
    assert all((a == shingle_sets([t])[0]).all() for a, t in zip(whole, texts, strict=True))


def test_large_buckets_and_long_texts(spark, monkeypatch):
    """Buckets beyond BIG, a text of 30,000 words with a near copy, and 200 copies, against all pairs."""
    from loxo.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BIG", 3)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefg", k=5))
    long = [word() for _ in range(30_000)]
    passage = [word() for _ in range(150)]
    texts = [" ".join(long), " ".join(long[:29_000])]
    texts += [" ".join(passage + [word() for _ in range(50)]) for _ in range(40)]
    texts += [" ".join(passage)] * 200
    r = list(enumerate(texts))
    df = spark.createDataFrame([(f"{i:04}", t, "x") for i, t in r], "doc_id string, text string, sig string").repartition(6)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(df, rounds=0).collect())
    want = brute([(f"{i:04}", t) for i, t in r[:44]])
    least = {d: c for d, _, c in want}
    assert [x for x in got if int(x[0]) < 44] == want
    assert {x[2] for x in got if int(x[0]) >= 42} == {least["0042"]}


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(8)
    for n in (5, 100, 3000):
        r = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        s = np.unique(np.append(r[n // 5 :], rnd.integers(0, 2**64, n // 9, dtype=np.uint64)))
        x, y = (np.frombuffer(parities(v), np.uint8) for v in (r, s))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(r, s))


def test_bloom_filter_takes_one_worker(spark, monkeypatch):
    """The filter holds what it was made of; its workers are Arrow's alone, one a task (RDDs of Python would take further ones, which stay)."""
    import pytest
    from pyspark import RDD

    from loxo.llm import ngram_join as N

    monkeypatch.setattr(RDD, "treeAggregate", lambda *a: pytest.fail("an RDD of Python"))
    ids = np.random.default_rng(6).integers(-(2**63), 2**63, 3000)
    bits = np.zeros(1 << 20, bool)
    bits[N._bits(ids, 1 << 20).ravel()] = True
    made = N._bloom(spark.createDataFrame([(int(x),) for x in ids], "row long").repartition(90), 1 << 20)
    assert made.value == np.packbits(bits).tobytes()
    assert not any(N._bloom(spark.createDataFrame([], "row long"), 1 << 20).value)
