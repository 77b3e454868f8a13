"""The corpus pipeline: documents in, packed sequences out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

- language_id: documents whose language the calibrated classifier doesn't accept go.
- line_dedup: texts lose the lines that at least three documents share, but in the last of them; a document
  that keeps nothing stays, with an empty text. n_chars follows the text.
- near_dedup: of each component of near copies the smallest doc_id stays.
- decontamination: documents that hold a benchmark item go.
- packing: token ids cut and packed; the rows of the packing operator.

Rows without doc_id can't be judged against others: they pass the filters and are left out of the packing.
Empty tables pass through. SQL can't express learned models, SimHash components or tokenizers, so ORACLE_SQL
is None; tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontam, langid, lines, neardup, packing
from emberline.session import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.apply_bitmaps(docs, lines.line_keep_bitmaps(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
