import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from loxo.llm.bpe import automaton, _vocabulary, decode, encode, encode_digest  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "<|endoftext|>", " a<|endoftext|> b<|endoftext|><|endoft", "  \n\n x\t y  ", "é𝄞 中文字 한국어 Привет", "a" * 400, "$$$ %%% &&& ===== ------- $$$$$$$",
    "it's I'll we've DON'T'", "0123456789" * 20, " \x1c\x85 \xa0x", "\x00\x01", "Der Preis, unbelievable! " * 40, "Der Preis, unbelievable! " * 40,
]


def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_digest_equals_library(spark):
    t = library()
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    for r in encode_digest(df, PATH, ["doc_id"]).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_encode_decode_columns(spark):
    t = library()
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    for r in decode(encode(df, PATH), PATH).collect():
        assert list(r.ids) == t.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert decode(encode(df.limit(0), PATH), PATH).collect() == []


def test_random_splices_of_the_vocabulary():
    a, t, rnd = automaton(_vocabulary(PATH)), library(), random.Random(5)
    pool = [b.decode("utf-8", "ignore") for b in a.labels.values()]
    texts = ["".join(rnd.sample(pool, 4)) for _ in range(5000)] + ["".join(rnd.choices("$%&ab \n", k=30)) for _ in range(3000)]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [int(i) for w in a.encode(x)[0] for i in w.split(",")] == e.ids


def test_arcs_are_those_of_the_finished_automaton():
    a, t = automaton(_vocabulary(PATH)), library()
    rnd = random.Random(8)
    words = [i for i, b in a.labels.items() if b.isalpha() and b.isascii()]
    for _ in range(3000):
        u, v = rnd.sample(words, 2)
        both = (a.labels[u] + a.labels[v]).decode()
        assert a.arc(u, v) == (t.encode(both, add_special_tokens=False).ids == [u, v])


def test_tokenized_in_small_batches_with_clashes_and_a_long_text(spark, monkeypatch):
    from loxo.llm import bpe

    monkeypatch.setattr(bpe, "FLUSH", 50)
    texts = [*TEXTS, "unbelievable things " * 20_000]
    t = library()
    df = spark.createDataFrame([(i, x, "k", 7) for i, x in enumerate(texts)], "doc_id long, text string, ids string, round_trip int")
    out = bpe.tokenized(df, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "round_trip"]
    rows = {r.doc_id: r for r in out.collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == ids and rows[i].n_tokens == len(ids) and rows[i].round_trip and rows[i].text == x
    assert bpe.tokenized(df.limit(0), PATH).collect() == []
