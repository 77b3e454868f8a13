"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Tokens are runs of letters and digits, and runs of other signs, in whole texts; features are hashed one- and
two-token n-grams with the share of the text's n-grams as value, times a constant. Weights are learned on
the driver from a bounded sample of labelled rows (sample_rows texts of at most sample_chars characters,
chosen by a hash of doc_id) and broadcast: 2**bits x 4 bytes, whatever the input. A score is a sparse dot
product, summed in pieces for long texts.

Null or empty text has no n-gram and gets the bias alone. Labels that are null are not learned from; without
labels every score is 0.5. Rows without doc_id are left out; repeated rows repeat; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import crc32_of_id, hash_sample, mix, slim

TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
PIECE = 1 << 18
#: All two-token n-grams of one token twice share a bucket: it is the repeating that tells, whatever the token.
REPEAT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text cut at white space, near every PIECE bytes; a token is never cut unless it is longer than a piece."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c" and end < at + 2 * PIECE:
            end += 1
        yield raw[at:end]
        at = end


def ngrams(raw: bytes, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the one- and two-token n-grams, an array for each piece."""
    mask = np.uint64((1 << bits) - 1)
    before = np.zeros(0, np.uint64)
    for piece in _pieces(raw):
        tokens = TOKEN.findall(piece)
        one = mix(np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens)))
        line = np.concatenate([before, one])
        two = np.where(line[:-1] == line[1:], REPEAT, mix(line[:-1] * np.uint64(3) + line[1:]))
        before = line[-1:]
        yield (np.concatenate([one, two]) & mask).astype(np.int64)


def _bag(text: str, bits: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    found = list(ngrams(text.encode(), bits))
    ids, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return ids, n * (scale / max(1, n.sum()))


def train(texts: list[str], labels: list[int], bits: int = 18, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, scale: float = 30.0, seed: int = 0) -> Model:
    """FTRL-proximal: per-coordinate rates, L1 keeps weights that evidence doesn't support at zero."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    bags = [_bag(t, bits, scale) for t in texts]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, x = bags[i]
            w, b = weight(z[ids], n[ids]), float(weight(np.float64(bias_z), np.float64(bias_n)))
            g0 = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - labels[i]
            g = g0 * x
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
            bias_z += g0 - (np.sqrt(bias_n + g0 * g0) - np.sqrt(bias_n)) / alpha * b
            bias_n += g0 * g0
    return Model(weight(z, n).astype(np.float32), float(weight(np.float64(bias_z), np.float64(bias_n))), scale)


def score(model: Model, raw: bytes) -> float:
    bits = len(model.weights).bit_length() - 1
    total, n = 0.0, 0
    for ids in ngrams(raw, bits):
        total += float(model.weights[ids].sum(dtype=np.float64))
        n += len(ids)
    return float(1 / (1 + np.exp(-np.clip(total * model.scale / max(1, n) + model.bias, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample_rows: int = 6000, sample_chars: int = 20_000, **params) -> Model:
    """A model from at most sample_rows labelled documents for which learn_from, a condition on doc_id, holds.

    The sample is drawn among labels first; its ids, at most sample_rows longs, are broadcast to the documents.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    if learn_from is not None:
        known = known.where(learn_from)
    known = hash_sample(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), sample_rows, "doc_id")
    rows = slim(docs).where(F.length("text") <= sample_chars).join(F.broadcast(known), "doc_id").collect()
    rows = sorted({(r["doc_id"], r["text"], r["quality"]) for r in rows})
    return train([r[1] for r in rows], [r[2] for r in rows], **params)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(shared.value, t.as_buffer().to_pybytes()) for t in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array(found, pa.float64())], names=["doc_id", "score"])

    return slim(docs).mapInArrow(f, "doc_id long, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    held_out = F.pmod(crc32_of_id(), F.lit(5)) == 0
    return score_documents(docs, fit(docs, labels, ~held_out)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
