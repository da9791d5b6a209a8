import re

from pyspark.sql import functions as F

from loxo.llm.pii import find_pii, redacted
from loxo.llm.queries import pii_digest

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    found = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if ok(k, m[0]))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


TEXTS = [
    "mail a.b+c@d-e.f.g, a@b.c_d@e.f x@y @z.w a@b.c@d.e.f ..@a.b é𝄞 q@r.s", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 12345.1.1.1 0000000000000255.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 41111111111111112 4111  111111111111 378282246310005 1 4111111111111111 4111111111111111 9 3530111333300000-", "+1 (555) 123-4567 +1(((((( +49 30 1234567 ++1 555 555 5555 +1-2 +123456789012345678 +1 (5)",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, bad DE88370400440532013000", "token = \"9742a250774262d69ad6a86100194ed53da5a0ef\" and 9742a250774262d69ad6a86100194ed53da5a0ef; my ssn 123-45-6789 or 123-45-6789",
    "", None, "@", "5 " * 3000, "9" * 5000, "a" * 20000 + "@", "a." * 4000 + "@b.c", "+" * 500 + "1 2", "0-1 " * 2000, "𝄞" * 50 + "a@b.cd" + "𝄞1.1.1.1",
]


def frame(spark):
    return spark.createDataFrame([(i % 9, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, pii string")


def test_base_spans_against_brute_force(spark):
    got = sorted((r.doc_id, r.spans) for r in pii_digest(frame(spark)).collect())
    only = sorted((d, ",".join(x for x in s.split(",") if x.split(":")[0] in BASE)) for d, s in got)
    assert only == sorted((i % 9, brute(t or "")) for i, t in enumerate(TEXTS))


def test_further_kinds_and_context(spark):
    got = {r.text: [(s.kind, r.text[s.start : s.end]) for s in r.pii] for r in find_pii(frame(spark)).collect() if r.text}
    assert [k for k, _ in got[TEXTS[4]] if k == "iban"] == ["iban", "iban"] and ("iban", "DE89 3704 0044 0532 0130 00") in got[TEXTS[4]]
    assert [k for k, _ in got[TEXTS[5]]].count("secret") == 1 and [k for k, _ in got[TEXTS[5]]].count("ssn") == 1


def test_redaction_and_empty(spark):
    out = find_pii(frame(spark)).withColumn("clean", redacted(F.col("text"), F.col("pii"))).collect()
    by = {r.text: r.clean for r in out}
    assert by[None] is None and by[""] == "" and by["9" * 5000] == "9" * 5000
    assert by[TEXTS[1]].startswith("[IP] [IP]") and "@" not in by["𝄞" * 50 + "a@b.cd" + "𝄞1.1.1.1"]
    assert find_pii(frame(spark).limit(0)).collect() == []
