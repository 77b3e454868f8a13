"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to maximal exact repeats.

Words are runs of anything but ASCII white space, unchanged. A window is `window` consecutive words of one
document. Each word goes that a window covers whose word sequence also starts in a document with a smaller
doc_id; windows are judged on the input.

1. Anchors. Documents are indexed by their non-overlapping blocks of window / 2 words, and every rolling window
   of that many words probes the index. A repeated window holds a whole block of each document it stands in, so
   it can't be missed. Probes travel as packed arrays, a few bytes each, by bucket of their hash; a hash that
   several documents of one batch share is settled there and sent once, so a passage that a third of all
   documents hold costs a bucket one entry a batch. Hashes meet on 32 bits of the bucket: false anchors cost
   a look and change nothing. A bucket answers each batch in one row, and a batch's answers meet again by batch.
2. Extension. Around the anchors, in documents that have any, each window of `window` words is keyed by 128 bits
   and compared with the smallest doc_id that has it, again first within a batch. Windows found in a smaller
   document, joined where they overlap, are the maximal repeats to remove.

Texts move once, by document, for both uses. Buckets follow the size of the input, so each stays as large as
it is today. Nothing is capped, no pairs of documents are formed.

Null text has no words. Rows without doc_id are left out. Repeated rows of a doc_id are one document and
repeat in the result. Documents of under `window` words lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import buckets_for, mix, runs, slim, text_bytes

WINDOW = 50
CHUNK = 1 << 16
FLUSH = 1 << 20  # windows that are settled together
MOST_PARTITIONS = 1 << 15
Q = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers
POWERS = [np.multiply.accumulate(np.array([1] + [q] * CHUNK, np.uint64)) for q in Q]
INVERSES = [np.multiply.accumulate(np.array([1] + [pow(q, -1, 1 << 64)] * CHUNK, np.uint64)) for q in Q]
ROWS = "bucket int, flush long, kind int, keys binary, flags binary, docs binary, counts binary, pos binary"
REPLIES = "flush long, docs binary, counts binary, pos binary"
RANGES = "doc_id long, ranges binary"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `width` words: a polynomial over word hashes, free of the run's place."""
    out = []
    for k in range(0, len(words) - width + 1, CHUNK - width + 1):
        own = words[k : k + CHUNK] if which == 0 else mix(words[k : k + CHUNK] ^ np.uint64(Q[1]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * POWERS[which][: len(own)], dtype=np.uint64)])
        out.append(mix((sums[width:] - sums[:-width]) * INVERSES[which][: len(own) - width + 1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Integers by byte planes: the high bytes, mostly zero, then compress to nearly nothing in a shuffle."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def to_ranges(slot: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending places as ranges: slot, first, end."""
    at = slot.astype(np.int64) << 32 | pos
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return slot[first], pos[first], pos[last] + 1


def _packed(docs: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places by document: each run of one doc_id becomes a difference and a count."""
    at = runs(docs)
    return planes(np.diff(docs[at[:-1]], prepend=np.int64(0))), planes(np.diff(at).astype(np.uint32)), planes(pos.astype(np.uint32))


def _unpacked(docs: bytes, counts: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.cumsum(unplanes(docs, np.int64)), unplanes(counts, np.uint32)), unplanes(pos, np.uint32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "flush", "kind", "keys", "flags", "docs", "counts", "pos"])


def _range_rows(ids: np.ndarray, slot: np.ndarray, pos: np.ndarray, n_buckets: int) -> list[tuple]:
    """Rows of kind 1: ranges settled in the batch, on their way to a bucket that passes them on."""
    if not len(slot):
        return []
    slot, first, end = to_ranges(slot, pos)
    bucket = int(mix(np.array([ids[slot[0]]]).view(np.uint64))[0] % np.uint64(n_buckets))
    return [(bucket, int(ids[0]), 1, b"", b"", *_packed(np.repeat(ids[slot], 2), np.stack([first, end], 1).ravel()))]


def _send(flush: int, bucket: np.ndarray, keys: list[np.ndarray], flags: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> list[tuple]:
    by = np.argsort(bucket, kind="stable")
    at = runs(bucket[by])
    rows = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        s = by[a:b]
        rows.append((int(bucket[s[0]]), flush, 0, b"".join(k[s].tobytes() for k in keys), flags[s].tobytes(), *_packed(docs[s], pos[s])))
    return rows


def _anchors(block: int, n_buckets: int, flush: int):
    def settle(held: list[tuple[int, np.ndarray]]) -> list[tuple]:
        ids = np.array([d for d, _ in held], np.int64)
        sizes = np.array([len(h) for _, h in held])
        h = np.concatenate([x for _, x in held])
        slot = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        pos = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        order = np.argsort(h)
        at = runs(h[order])
        docs = ids[slot[order]]
        shared = np.minimum.reduceat(docs, at[:-1]) != np.maximum.reduceat(docs, at[:-1])
        each = np.repeat(shared, np.diff(at))
        here = np.sort(order[each])
        go = np.sort(np.concatenate([order[~each], order[at[:-1][shared]]]))
        flags = (pos[go] % block == 0).astype(np.uint8)
        mark = np.zeros(len(h), bool)
        mark[order[at[:-1][shared]]] = True
        flags[mark[go]] |= 2
        bucket = (h[go] % np.uint64(n_buckets)).astype(np.int32)
        return _send(int(ids[0]), bucket, [(h[go] >> np.uint64(32)).astype(np.uint32)], flags, ids[slot[go]], pos[go]) + _range_rows(ids, slot[here], pos[here], n_buckets)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = text.as_buffer().to_pybytes().split()
                if len(words) >= 2 * block:
                    held.append((doc_id, rolling(word_hashes(words), block)))
                    n += len(words)
                    if n >= flush:
                        yield _batch(settle(held))
                        held, n = [], 0
        if held:
            yield _batch(settle(held))

    return f


def _met(parts: int):
    """Settle a bucket: what each batch sent, it gets back cut to the places that met, as ranges.

    parts 1: anchors (32-bit keys); parts 2: windows (128-bit keys).
    """

    def f(table: pa.Table) -> pa.Table:
        out, rows = [], []
        keys: list[list[np.ndarray]] = [[] for _ in range(parts)]
        for flush, kind, key, flag, d, c, p in zip(*(table[x].to_pylist() for x in ("flush", "kind", "keys", "flags", "docs", "counts", "pos")), strict=True):
            if kind:  # settled where it came from
                out.append((flush, d, c, p))
                continue
            raw = np.frombuffer(key, np.uint32 if parts == 1 else np.uint64).reshape(parts, -1)
            for k in range(parts):
                keys[k].append(raw[k])
            rows.append((flush, np.frombuffer(flag, np.uint8), *_unpacked(d, c, p)))
        if rows:
            key = [np.concatenate(k) for k in keys]
            flag, doc, place = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
            order = np.argsort(key[0]) if parts == 1 else np.lexsort((key[1], key[0]))
            at = runs(*[k[order] for k in key])
            d, begin, size = doc[order], at[:-1], np.diff(at)
            low = np.minimum.reduceat(d, begin)
            if parts == 1:
                any_ = np.bitwise_or.reduceat(flag[order], begin)
                good = ((np.maximum.reduceat(d, begin) != low) | (any_ & 2 > 0)) & (any_ > 0)
                hit = order[np.repeat(good, size) & (flag[order] & 2 == 0)]
            else:
                hit = order[d > np.repeat(low, size)]
            met = np.zeros(len(doc), bool)
            met[hit] = True
            ends = np.cumsum([len(r[2]) for r in rows])
            for (flush, *_), end, n in zip(rows, ends, [len(r[2]) for r in rows], strict=True):
                own = np.flatnonzero(met[end - n : end]) + end - n
                if len(own):
                    out.append((flush, *_packed(np.repeat(doc[own], 2), np.stack([place[own], place[own] + 1], 1).ravel())))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["flush", "docs", "counts", "pos"])

    return f


def _gathered(table: pa.Table) -> pa.Table:
    """One batch's replies, by document."""
    both = [_unpacked(d, c, p) for d, c, p in zip(*(table[x].to_pylist() for x in ("docs", "counts", "pos")), strict=True)]
    docs = np.concatenate([b[0][::2] for b in both])
    pairs = np.concatenate([b[1] for b in both]).reshape(-1, 2)
    order = np.lexsort((pairs[:, 0], docs))
    docs, pairs = docs[order], pairs[order]
    at = runs(docs)
    return pa.table([pa.array(docs[at[:-1]], pa.int64()), pa.array([pairs[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "ranges"])


def _marked(ranges: list[bytes], n: int, reach: int = 0) -> np.ndarray:
    """How many ranges cover each place below n, each stretched back by reach."""
    steps = np.zeros(n + 1, np.int64)
    if ranges and n > 0:
        both = np.frombuffer(b"".join(ranges), np.uint32).reshape(-1, 2).astype(np.int64)
        np.add.at(steps, np.clip(both[:, 0] - reach, 0, n), 1)
        np.add.at(steps, np.clip(both[:, 1], 0, n), -1)
    return np.cumsum(steps[:n])


def _windows(window: int, n_buckets: int, flush: int):
    """Around a document's anchors, every window; settled in the batch, then sent by bucket."""
    block = window // 2

    def settle(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple]:
        ids = np.array([x[0] for x in held], np.int64)
        pos, a, b = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        slot = np.repeat(np.arange(len(held), dtype=np.int32), [len(x[1]) for x in held])
        order = np.lexsort((b, a))
        at = runs(a[order], b[order])
        docs = ids[slot[order]]
        later = docs > np.repeat(np.minimum.reduceat(docs, at[:-1]), np.diff(at))
        here, go = np.sort(order[later]), np.sort(order[~later])
        bucket = (a[go] % np.uint64(n_buckets)).astype(np.int32)
        return _send(int(ids[0]), bucket, [a[go], b[go]], np.zeros(len(go), np.uint8), ids[slot[go]], pos[go]) + _range_rows(ids, slot[here], pos[here], n_buckets)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc_id, text, ranges in zip(batch["doc_id"].to_pylist(), batch["text"], batch["ranges"].to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                places = np.flatnonzero(_marked(ranges, len(words) - window + 1, window - block))
                if len(places):
                    h = word_hashes(words)
                    held.append((doc_id, places.astype(np.uint32), rolling(h, window, 0)[places], rolling(h, window, 1)[places]))
                    n += len(places)
                    if n >= flush // 2:
                        yield _batch(settle(held))
                        held, n = [], 0
        if held:
            yield _batch(settle(held))

    return f


def _by_bucket(rows: DataFrame, parts: int, n_buckets: int) -> DataFrame:
    """Buckets are dealt to as many partitions, whatever the session's number, so that a task reads a few of them at any size."""
    replies = rows.repartition(min(n_buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(_met(parts), REPLIES)
    return replies.groupBy("flush").applyInArrow(_gathered, RANGES).groupBy("doc_id").agg(F.collect_list("ranges").alias("ranges"))


def repeated_windows(texts: DataFrame, docs: DataFrame, n_buckets: int, window: int = WINDOW, flush: int = FLUSH) -> DataFrame:
    """doc_id, ranges: where windows start (first, end as 32-bit pairs) that a smaller document has too.

    texts are the documents (doc_id, text) dealt out by doc_id, docs the same as they are read.
    """
    anchors = _by_bucket(docs.mapInArrow(_anchors(window // 2, n_buckets, flush), ROWS), 1, n_buckets)
    near = texts.join(anchors, "doc_id").select("doc_id", "text", "ranges")
    return _by_bucket(near.mapInArrow(_windows(window, n_buckets, flush), ROWS), 2, n_buckets)


def kept_words(text: bytes, ranges: list[bytes], window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not ranges:
        return words, len(words)
    steps = np.zeros(len(words) + 1, np.int64)
    both = np.frombuffer(b"".join(ranges), np.uint32).reshape(-1, 2).astype(np.int64)
    np.add.at(steps, np.clip(both[:, 0], 0, len(words)), 1)
    np.add.at(steps, np.clip(both[:, 1] + window - 1, 0, len(words)), -1)
    gone = np.cumsum(steps[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


def dedup_substrings(docs: DataFrame, per_row, schema: str, window: int = WINDOW, bucket_bytes: int = 16 << 20, flush: int = FLUSH) -> DataFrame:
    """per_row(doc_id, kept words, number of words before) for each document, as a tuple of the schema's columns."""
    docs = slim(docs)
    n = buckets_for(text_bytes(docs), bucket_bytes)
    texts = docs.repartition(n, "doc_id")
    found = repeated_windows(texts, docs, n, window, flush)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                per_row(doc_id, *kept_words(text.as_buffer().to_pybytes(), ranges or [], window))
                for doc_id, text, ranges in zip(batch["doc_id"].to_pylist(), batch["text"], batch["ranges"].to_pylist(), strict=True)
            ]
            names = [x.split()[0] for x in schema.split(",")]
            kinds = {"long": pa.int64(), "string": pa.string()}
            types = [kinds[x.split()[1]] for x in schema.split(",")]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return texts.join(found, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(f, schema)


def cut_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text: the words that stay, joined by one space."""
    return dedup_substrings(docs, lambda i, kept, n: (i, b" ".join(kept).decode("utf-8", "replace")), "doc_id long, text string", window)


def substring_digest(docs: DataFrame, **sizes: int) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_removed, kept_sha256."""

    def row(doc_id, kept, n):
        return doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return dedup_substrings(docs, row, "doc_id long, n_words long, n_removed long, kept_sha256 string", **sizes)
