from collections import Counter
from itertools import permutations

from emberline.llm import audit
from tests.oracle import check, database

DOCS = "doc_id long, text string, lang string, good int, mask int"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(i, text, docs):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": i is not None and any(j is not None and j < i and t == text for j, t, _ in docs),
    }


def brute(docs, labels):
    docs = [(i, t or "", p or "") for i, t, p in docs]
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    masks = [(p, fails(i, t, docs), i in good, i in toxic) for i, t, p in docs]
    out, shapley = [], Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                gone = [any(f[x] for x in order[:k]) for _, f, _, _ in own]
                here = [m for m, g in zip(own, gone, strict=True) if m[1][c] and not g]
                shapley[part, c] += len(here)
                kept = sum(not g and not m[1][c] for m, g in zip(own, gone, strict=True))
                redundant = sum(g and m[1][c] for m, g in zip(own, gone, strict=True))
                alone = sum(m[1][c] and sum(m[1].values()) == 1 for m in own)
                out.append((part, "".join(order), k + 1, kept, len(here), redundant, alone, sum(m[2] for m in here), sum(m[3] for m in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, 7, 7) for d in docs], DOCS).repartition(3)
    got = audit.filter_audit(df, spark.createDataFrame([(*x, "clash") for x in labels], LABELS))
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r) for r in got.collect())


def test_against_every_order(spark):
    long = " ".join(f"w{k}" for k in range(120))
    texts = [long, long.upper(), long + " $", "same " * 200, "", None, "ÀÉ # x", "A" * 9, long + "\x0b\x0c tail", long + " x", "\n\n", "x\x00y " * 99 + "z"]
    docs = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts * 3)]
    docs += [docs[0], docs[0], (None, long, "en"), (None, None, None), (-5, long, "fr"), (4, "other text of the same id", "de")]
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 30, 2)] + [(0, 0, 1), (0, 1, None), (None, 1, 1), (6, None, None), (999, 1, 1)]
    got = audited(spark, docs, labels)
    assert len(got) == 4 * 600 and got == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    assert audited(spark, [(1, "x", None)], []) == brute([(1, "x", None)], [])


def test_cells_add_up(spark):
    sf = "/root/testdata/sf0.001"
    found = audit.cells(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sum(r["n"] for r in found.collect()) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_equals_sql_at_larger_scale(spark):
    sf = "/root/testdata/sf0.01"
    check(spark, database(sf), lambda s, d: audit.filter_audit(s.read.parquet(f"{d}/documents.parquet"), s.read.parquet(f"{d}/labels.parquet")), audit.ORACLE, sf)
