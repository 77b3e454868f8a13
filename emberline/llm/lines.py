"""Line dedup: range-partitioned line hashes, streamed in order, give each document a keep bitmap.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
min_chars code points found in at least min_docs documents lose all their lines except in the largest
doc_id that holds them.

Plan: each document sends one row for each of its long keys: a 128-bit hash, doc_id and the packed line
numbers. The rows are range-partitioned by hash and document, so that a key of a third of all documents
spreads over many partitions, and sorted by hash and document within each. One pass over a partition
decides every key that lies inside it. A key that may go on in a neighbour, at most three a partition, is
summed by partition first; those sums, three rows a partition at most, settle its documents. Only line
numbers to drop are grouped by document, and they come back as compressed bitmaps, not as text.

Null or empty text: one empty line, kept. Rows without doc_id: left out. Repeated rows of one doc_id count as
one document; each gets the document's bitmap. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import buckets_for, free_name, runs, slim, small, text_bytes
from emberline.session import materialize

SPACE = b" \t\n\x0b\x0c\r"
ROWS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("lines", pa.binary())])
VERDICTS = "hi long, lo long, doc_id long, lines binary, pending boolean"


def line_key(line: bytes) -> bytes:
    """bytes.lower() changes A-Z alone."""
    return line.strip(SPACE).lower()


def _keys(min_chars: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los, docs, packed = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                at: dict[int, list[int]] = {}
                for n, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        at.setdefault(xxhash.xxh3_128_intdigest(key), []).append(n)
                for h, lines in at.items():
                    his.append(h >> 64)
                    los.append(h & (2**64 - 1))
                    docs.append(doc_id)
                    packed.append(np.array(lines, "<u4").tobytes())
            if docs:
                yield pa.record_batch(
                    [np.array(his, np.uint64).view(np.int64), np.array(los, np.uint64).view(np.int64), pa.array(docs, pa.int64()), pa.array(packed, pa.binary())],
                    schema=ROWS,
                )

    return f


def _verdicts(min_docs: int):
    """Over one sorted partition: rows to drop, and the rows of keys that may go on elsewhere (pending)."""

    def out(rows: pa.Table, pending: bool) -> Iterator[pa.RecordBatch]:
        rows = rows.append_column("pending", pa.array(np.full(rows.num_rows, pending)))
        yield from rows.combine_chunks().to_batches()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the run that is open; long only where one key fills batches
        first = True
        key = None

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            if not held:
                return
            rows = pa.Table.from_batches(held)
            held = []
            if first or last:
                first = False
                yield from out(rows, True)
                return
            docs = rows["doc_id"].to_numpy()
            if len(runs(docs)) - 1 >= min_docs:
                yield from out(rows.filter(pa.array(docs != docs[-1])), False)

        for batch in batches:
            hi, lo, docs = (batch[k].to_numpy() for k in ("hi", "lo", "doc_id"))
            if not len(hi):
                continue
            starts = runs(hi, lo)
            if key == (hi[0], lo[0]):
                held.append(batch.slice(0, starts[1]))
                begin = 1
            else:
                yield from close(False)
                begin = 0
            n = len(starts) - 1
            if begin >= n:  # the whole batch is one run
                if first:  # a leading run is pending anyway: let it go, so that it never gathers here
                    yield from out(pa.Table.from_batches(held), True)
                    held = []
                continue
            if begin == 1:
                yield from close(False)
            key = (hi[-1], lo[-1])
            inner = np.arange(begin, n - 1)
            if first and len(inner):
                yield from out(pa.Table.from_batches([batch.slice(starts[begin], starts[begin + 1] - starts[begin])]), True)
                first, inner = False, inner[1:]
            # distinct documents of each inner run
            new = np.ones(len(docs), np.int64)
            new[1:] = (docs[1:] != docs[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            total = np.concatenate([[0], np.cumsum(new)])
            many = inner[total[starts[inner + 1]] - total[starts[inner]] >= min_docs]
            if len(many):
                drop = np.zeros(len(docs), bool)
                for r in many:
                    drop[starts[r] : starts[r + 1]] = docs[starts[r] : starts[r + 1]] != docs[starts[r + 1] - 1]
                yield from out(pa.Table.from_batches([batch]).filter(pa.array(drop)), False)
            held = [batch.slice(starts[n - 1])]
        yield from close(True)

    return f


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, maps = [], []
        for n, lines in zip(batch["n_lines"].to_pylist(), batch["lines"].to_pylist(), strict=True):
            gone = np.unique(np.frombuffer(b"".join(lines or ()), "<u4"))
            gone = gone[gone < n]
            keep = np.ones(n, bool)
            keep[gone] = False
            dropped.append(len(gone))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.record_batch([batch["doc_id"], batch["n_lines"], pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "keep_bitmap"])


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, rows_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_bitmap (zlib of packed bits, first line first) for each document."""
    docs = slim(docs)
    n = buckets_for(text_bytes(docs), rows_bytes)
    keys = docs.mapInArrow(_keys(min_chars), "hi long, lo long, doc_id long, lines binary")
    ordered = keys.repartitionByRange(n, "hi", "lo", "doc_id").sortWithinPartitions("hi", "lo", "doc_id")
    verdicts, _ = materialize(ordered.mapInArrow(_verdicts(min_docs), VERDICTS), "line-verdicts")
    pending = verdicts.where("pending")
    # A pending key's documents are made distinct where they are many; what then meets by key is a sum a task.
    edges = pending.select("hi", "lo", "doc_id").distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    edges, _ = materialize(edges.where(F.col("n_docs") >= min_docs), "line-edges")  # three keys a partition at most
    settled = pending.join(small(edges), ["hi", "lo"]).where("doc_id <> last_doc")
    drops = verdicts.where("not pending").select("doc_id", "lines").unionByName(settled.select("doc_id", "lines"))
    drops = drops.groupBy("doc_id").agg(F.collect_list("lines").alias("lines"))
    sizes = docs.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines")).groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
    return sizes.join(drops, "doc_id", "left").mapInArrow(_bitmaps, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary")


def keep_lines(text: str, bitmap: bytes) -> str:
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=None)
    return "\n".join(x for x, k in zip(lines, keep, strict=False) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents (all their columns) with text cut to the kept lines; n_chars, if there is one, follows the text. A document without a bitmap, or with nothing to drop, stays as it is."""
    id_, map_ = free_name(docs, "changed_id"), free_name(docs, "keep_map")
    change = bitmaps.where("n_dropped > 0").select(F.col("doc_id").alias(id_), F.col("keep_bitmap").alias(map_))
    joined = docs.join(change, docs["doc_id"] == change[id_], "left").drop(id_)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            maps = columns.pop(map_)
            texts = columns["text"].to_pylist()
            for k in np.flatnonzero(maps.is_valid().to_numpy(zero_copy_only=False)).tolist():
                texts[k] = keep_lines(texts[k] or "", maps[k].as_py())
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return joined.mapInArrow(f, docs.schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [
            hashlib.sha256((text if not gone else keep_lines(text, bitmap)).encode()).hexdigest()
            for text, gone, bitmap in zip(batch["text"].to_pylist(), batch["n_dropped"].to_pylist(), batch["keep_bitmap"].to_pylist(), strict=True)
        ]
        yield pa.record_batch([batch["doc_id"], batch["n_lines"], batch["n_dropped"], pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_lines, n_dropped, kept_sha256."""
    joined = slim(docs).join(line_keep_bitmaps(docs), "doc_id")
    return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM d),
k AS (SELECT doc_id, n, line,
        translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
many AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, many.key IS NOT NULL AND k.doc_id <> many.last AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
