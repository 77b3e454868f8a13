"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are n-grams of 2 to 4 lower-cased characters of a word with its ends marked; each is hashed to a
bucket with an embedding. A text is the mean of its subwords' embeddings; a linear softmax over it gives the
languages. Both layers are trained by stochastic gradient descent in numpy on the driver, from a bounded
sample (sample_rows texts of at most sample_chars characters, chosen by a hash of doc_id). A part of the
sample is kept out of training: on it a temperature is fitted, and the confidence below which a text is
rejected, so that accepted texts reach the target precision there: half way from the least sure text accepted
to the next one, and never under 0.5. Texts without a letter are rejected anyway and no part of either.

Scoring folds the two layers into one table of buckets x languages x 4 bytes, which is broadcast: its size
comes from the model, not from the documents. Whole texts are scored, in pieces, so that a long one takes no
more memory than a short one.

Null text or text without a letter: `und`, score 0, rejected. No labelled rows: everything is `und`. Rows
without doc_id are left out; repeated rows repeat; an empty table gives an empty result. Ties in score go to
the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import crc32_of_id, hash_sample, slim, small_batches

PIECE = 1 << 16


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # bucket x language: embeddings times the softmax layer
    bias: np.ndarray
    temperature: float
    reject_below: float


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points with 0 for anything but letters, in pieces that overlap by three."""
    for k in range(0, len(text), PIECE):
        piece = text[max(0, k - 3) : k + PIECE].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        points = np.where(_letters()[np.minimum(points, 0x10FFFF)], points, np.uint32(0))
        yield np.concatenate([np.zeros(int(k == 0), np.uint32), points, np.zeros(int(k + PIECE >= len(text)), np.uint32)])


def subwords(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, an array for each piece and length."""
    mask = np.uint32((1 << bits) - 1)
    first = True
    for x in _pieces(text):
        inner = x != 0
        h = x * np.uint32(2654435761)
        for n in (2, 3, 4):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] ^ (h[: len(x) - n + 1] >> np.uint32(15))) * np.uint32(2246822519) + x[n - 1 :] * np.uint32(3266489917) + np.uint32(n)
            ok = inner[n - 1 :] | inner[: len(x) - n + 1] if n == 2 else np.ones(len(x) - n + 1, bool)
            for k in range(1, n - 1):
                ok &= inner[k : len(x) - n + 1 + k]
            skip = 0 if first else 4 - n  # n-grams that the piece before has counted
            v = h[skip:][ok[skip:]]
            yield ((v ^ (v >> np.uint32(13))) * np.uint32(668265263) >> np.uint32(8)) & mask
        first = False


def has_letter(text: str) -> bool:
    return any(p.any() for p in _pieces(text))


def _bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    found = list(subwords(text, bits))
    ids, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
    return ids.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], langs: list[str], bits: int = 16, dim: int = 16, epochs: int = 5, rate: float = 8.0, held_out: float = 0.2, target: float = 0.99, seed: int = 0) -> Model:
    bags = [(_bag(t, bits), lang) for t, lang in zip(texts, langs)]
    bags, langs = [b for b, _ in bags if len(b[0])], [lang for b, lang in bags if len(b[0])]
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.5)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(bags))
    n_cal = int(len(bags) * held_out)
    cal, fit = order[:n_cal], order[n_cal:]
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, x = bags[i]
            now = rate * (1 - done / steps)
            mean = x @ emb[ids]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= now * 0.1 * np.outer(mean, p)
            b -= now * 0.01 * p
            emb[ids] -= now * x[:, None] * back[None, :]
            done += 1
    scores = emb @ w
    z = np.array([x @ scores[ids] + b for ids, x in (bags[i] for i in cal)]).reshape(n_cal, len(names))
    if not n_cal:
        return Model(names, scores, b, 1.0, 0.5)

    def softmax(t):
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min(np.geomspace(0.05, 20, 121), key=lambda t: -np.log(np.maximum(softmax(t)[np.arange(n_cal), y[cal]], 1e-9)).sum())
    p = softmax(temperature)
    sure, right = p.max(1), p.argmax(1) == y[cal]
    down = np.argsort(-sure, kind="stable")
    precise = np.cumsum(right[down]) / np.arange(1, n_cal + 1) >= target
    if precise[-1]:
        return Model(names, scores, b, float(temperature), 0.5)
    last = np.flatnonzero(precise)[-1] if precise.any() else -1
    lowest = (sure[down[last]] + sure[down[last + 1]]) / 2 if last >= 0 else 1.0
    return Model(names, scores, b, float(temperature), max(0.5, float(lowest)))


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, calibrated probability, accepted."""
    if not text or not model.langs:
        return "und", 0.0, False
    bits = len(model.scores).bit_length() - 1
    total, n = np.zeros(len(model.langs)), 0
    for ids in subwords(text, bits):
        if len(ids):
            total += model.scores.take(ids, axis=0).sum(0, dtype=np.float64)
            n += len(ids)
    if not n:
        return "und", 0.0, False
    z = (total / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    k = int(p.argmax())
    return model.langs[k], float(p[k]), bool(p[k] >= model.reject_below)


def fit(docs: DataFrame, learn_from: Column | None = None, sample_rows: int = 4000, sample_chars: int = 20_000, **params) -> Model:
    """A model from at most sample_rows labelled rows (text, lang) where learn_from holds. Equal doc_ids in any order give equal models."""
    rows = slim(docs, "lang").where(F.col("lang").isNotNull() & (F.length("text") <= sample_chars))
    if learn_from is not None:
        rows = rows.where(learn_from)
    rows = hash_sample(rows, sample_rows, "doc_id", "text", "lang").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **params)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(shared.value, t.as_py()) for t in batch["text"]]
            yield pa.record_batch(
                [batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    return slim(docs).mapInArrow(f, "doc_id long, lang_pred string, score double, accepted boolean")


def language_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score (and accepted)."""
    held_out = F.pmod(crc32_of_id(), F.lit(4)) == 2
    return identify(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents (all their columns) whose language the model accepts. A model that learned no language judges none: all stay."""
    if not model.langs:
        return docs
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([predict(shared.value, t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(f, docs.schema)
