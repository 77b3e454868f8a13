import hashlib
import re

from emberline.llm import pii

SCHEMA = "doc_id long, text string, spans string, m_email string"


def brute(text):
    """The contract's plain patterns."""
    text, spans = text or "", []

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    iban = lambda m: 15 <= len(m) <= 34 and int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", lambda m: iban(m.replace(" ", ""))),
    ]
    for k, (kind, pattern, ok) in enumerate(rules):
        spans += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    spans.sort()
    line = lambda s: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in s)
    base = [s for s in spans if s[1] < 4]
    return (*[sum(s[1] == k for s in base) for k in range(4)], hashlib.sha256(line(base).encode()).hexdigest(), line(spans))


TEXTS = [
    None, "", "nothing here", "ñ😀 write to a.b+c@ex-ample.co.uk. or x@y@z.org", "a@b.c_d@e.f g@h.i@j.k @x.y a@b a@.b",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.000.1.01 1.2.3 999999999999999999999.1.1.1 1.2.3.4567", "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 12345",
    "4111  1111 1111 1111 and 00000000000000 and 1 2 3", "call +1 (555) 010-9999 or +49 30 1234567 +12 +1-2 ++44 20 7946 0958. tel.+1234567890123456", "+1 555.010.9999 4111111111111111",
    "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 xGB82WEST12345698765432 GB83WEST12345698765432", "é" * 50 + "a@b.c" + "😀" * 3 + "8.8.8.8",
    "a" * 30_000 + " " + "9" * 30_000 + " " + "9 " * 20_000 + "x@y" + ".z" * 20_000, "a@b.c " * 500,
]


def test_against_the_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "a@b.c", None, None)], SCHEMA).repartition(3)
    out = pii.pii_digest(docs).collect()
    got = {r["doc_id"]: tuple(r)[1:-1] for r in out}
    assert len(out) == len(TEXTS) and out[0].__fields__[-1] == "scores"
    for r in out:  # a score for each span
        scores = [float(x) for x in r["scores"].split(",") if x]
        assert len(scores) == len([x for x in r["spans"].split(",") if x]) and all(0.5 <= x <= 1 for x in scores)
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), (i, (t or "")[:80])


def test_context_raises_the_score(spark):
    docs = spark.createDataFrame([(1, "my visa card 4111111111111111", None, None), (2, "number 4111111111111111", None, None)], SCHEMA)
    got = {r["doc_id"]: r["spans"][0] for r in pii.find_pii(docs).collect()}
    assert got[1]["score"] > got[2]["score"] and got[1]["value"] == "4111111111111111"


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:-1] for r in pii.pii_digest(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_empty_table_and_no_python(spark):
    empty = pii.pii_digest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
