import duckdb

from emberline.operators import dedup
from emberline.plans import catalogue


def test_a_text_that_matches_a_duplicate_alone(spark, tmp_path):
    first = [f"w{k}" for k in range(300)]
    second = first[:264] + [f"x{k}" for k in range(36)]
    third = [f"y{k}" for k in range(36)] + second[36:]
    texts = [first, second, third, ["lone"], second]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["id"], r["is_duplicate"]) for r in catalogue.queries()["near_dup_documents"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(db.sql(catalogue.oracle_sql()["near_dup_documents"]).fetchall()) == {(0, False), (1, True), (2, True), (3, False), (4, True)}
    assert {r["id"]: r["duplicate_of"] for r in dedup.near_duplicates(docs, "doc_id", "text").collect()}[2] is None
