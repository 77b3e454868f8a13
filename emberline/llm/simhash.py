"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the document's shingle hashes (XXH64,
seed 42, of the UTF-8 shingle). Shingles are runs of `words` words, repeats included, joined by one space,
A-Z lower-cased; fewer words: the whole sequence; none: fingerprint zero.

Links: the fingerprint is cut into equal segments. Each distinct fingerprint enters one table row for every
value in a small Hamming ball around each of its segments. Two fingerprints that meet in a row are compared
in full. With segments of which two fingerprints can meet up to `reach` bits apart, every pair within
segments * (reach + 1) - 1 bits is guaranteed to meet:

- reach 1: a row for the segment itself and one for each of its zero bits set. Of two segments one bit apart,
  one has that bit zero.
- reach 2: a row for the segment itself and one for each of its bits flipped; the balls touch at two bits.

No pairs are emitted. What meets in a table row becomes a tree (each member linked to one it is close to), so
links stay in proportion to rows, however many copies there are. Rows of more than `limit` members are cut
into blocks, and every two blocks of the row are compared in a task of their own, so that nothing gathers in
one task and nothing is dropped. Equal fingerprints are one node from the start, named by their smallest doc_id.
Links stay in Spark; components come from large-star and small-star rounds.

The pipeline's near_dedup needs links at a Jaccard similarity of 0.8, beyond what 64-bit fingerprints guarantee: neardup.py
takes the links found here as candidates and completes them.

Null text counts as empty, rows without doc_id are left out, repeated rows repeat in the result, an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import runs, slim
from emberline.operators.components import connected_components
from emberline.session import materialize

BITS = np.array([1 << k for k in range(32)], np.uint64)


def shingles(text: bytes, words: int) -> list[bytes]:
    own = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if len(own) <= words:
        return [b" ".join(own)] if own else []
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def simhash(parts: list[bytes], seed: int = 42, block: int = 1 << 14) -> int:
    """The unsigned fingerprint; big-endian digests give the highest bit first."""
    if not parts:
        return 0
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, len(parts), block):
        raw = np.frombuffer(b"".join([digest(x, seed) for x in parts[k : k + block]]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, check_words: int | None = None) -> DataFrame:
    """doc_id, fp and, with check_words, fp2 of shingles of so many words (0 without); longs with the fingerprints' bits."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for text in batch["text"]:
                raw = text.as_buffer().to_pybytes()
                first.append(simhash(shingles(raw, words)))
                second.append(simhash(shingles(raw, check_words)) if check_words else 0)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([batch["doc_id"], as_long(first), as_long(second)], names=["doc_id", "fp", "fp2"])

    return slim(docs).mapInArrow(f, "doc_id long, fp long, fp2 long")


def table_rows(nodes: DataFrame, segments: int, reach: int) -> DataFrame:
    """key (segment number and value), node, fp, fp2: a row for each value of each segment's ball."""
    width = 64 // segments
    mask = (1 << width) - 1

    def ball(k: int) -> Column:
        own = F.shiftrightunsigned(F.col("fp"), k * width).bitwiseAND(F.lit(mask).cast("long"))
        bits = [F.lit(1 << j).cast("long") for j in range(width)]
        near = [own.bitwiseXOR(b) if reach == 2 else F.when(own.bitwiseAND(b) == 0, own.bitwiseOR(b)) for b in bits]
        return F.transform(F.array(own, *near), lambda v: v + F.lit(k << 40))

    keys = F.flatten(F.array(*[ball(k) for k in range(segments)])) if segments > 1 else ball(0)
    return nodes.select(F.explode(keys).alias("key"), "node", "fp", "fp2").where(F.col("key").isNotNull())


def _tree(fp: np.ndarray, fp2: np.ndarray, radius: int, radius2: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) of a forest over the members within the radii of each other."""

    def close(i, rest):
        hit = np.bitwise_count(fp[rest] ^ fp[i]) <= radius
        return hit & (np.bitwise_count(fp2[rest] ^ fp2[i]) <= radius2) if radius2 < 64 else hit

    n = len(fp)
    if n <= 256:  # most rows have no link at all
        hit = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        if radius2 < 64:
            hit &= np.bitwise_count(fp2[:, None] ^ fp2[None, :]) <= radius2
        if hit.sum() == n:
            return np.empty(0, int), np.empty(0, int)
    child, parent = [], []
    rest = np.arange(n)
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = close(i, rest)
            if hit.any():
                found = rest[hit]
                child.append(found)
                parent.append(np.full(len(found), i))
                front += found.tolist()
                rest = rest[~hit]
    return (np.concatenate(child), np.concatenate(parent)) if child else (np.empty(0, int), np.empty(0, int))


ROWS = "key long, part long, node long, fp long, fp2 long"
LINKS = "a long, b long"


def whole_runs(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    """solve(rows) over tables of whole runs of (key, part), whatever the batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = runs(batch["key"].to_numpy(), batch["part"].to_numpy())
        if len(at) == 2 and held and (held[-1]["key"][-1], held[-1]["part"][-1]) == (batch["key"][0], batch["part"][0]):
            held.append(batch)
            continue
        yield from solve(pa.Table.from_batches([*held, batch.slice(0, at[-2])]))
        held = [batch.slice(at[-2])]
        # a run that began in the batch before goes on over its end only if the keys are equal; solve() looks again
    if held:
        yield from solve(pa.Table.from_batches(held))


def _links(radius: int, radius2: int):
    """Over a partition sorted by (key, part): the links inside each row of the table."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, part = rows["key"].to_numpy(), rows["part"].to_numpy()
            node, fp, fp2 = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["fp2"].to_numpy().view(np.uint64)
            at, a, b = runs(key, part), [], []
            for k in np.flatnonzero(np.diff(at) > 1):
                s = slice(at[k], at[k + 1])
                child, parent = _tree(fp[s], fp2[s], radius, radius2)
                a.append(node[s][child])
                b.append(node[s][parent])
            if a and len(ab := np.concatenate([np.concatenate(a)[:, None], np.concatenate(b)[:, None]], 1)):
                ab = np.unique(ab, axis=0)
                yield pa.record_batch([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        yield from whole_runs(batches, solve)

    return f


def deal(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    """key, part and columns: rows of a key with over `limit` of them are cut into blocks, and each two blocks are a part."""
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > limit)
    # Keys with over `limit` rows number at most rows / limit; where there are none, the join falls away at run time.
    rows = rows.join(crowded, "key", "left")
    blocks = F.ceil(F.col("__rows") * 2 / limit)
    block = F.pmod(F.xxhash64("node"), blocks)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: F.least(block, i) * blocks + F.greatest(block, i))
    parts = F.when(F.col("__rows").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)
    return rows.select("key", F.explode(parts).alias("part"), *columns)


def links(nodes: DataFrame, radius: int, segments: int, reach: int, radius2: int = 64, limit: int = 1 << 15) -> DataFrame:
    """a, b: forests that connect all nodes (node, fp, fp2) within radius, and radius2 of fp2, of each other."""
    if radius > segments * (reach + 1) - 1:
        raise ValueError("the segments don't guarantee this radius")
    rows = table_rows(nodes, segments, reach)
    dealt = deal(rows, limit, "node", "fp", "fp2")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_links(radius, radius2), LINKS)


def near_duplicate_components(
    docs: DataFrame, words: int = 3, radius: int = 3, segments: int = 2, reach: int = 1, check_words: int | None = None, check_radius: int = 64, limit: int = 1 << 15
) -> DataFrame:
    """doc_id, fp (a long with the fingerprint's bits), component_id (the smallest doc_id reachable) for each document."""
    marks, _ = materialize(fingerprints(docs, words, check_words), "fingerprints")
    nodes, _ = materialize(marks.groupBy("fp", "fp2").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    found = connected_components(links(nodes, radius, segments, reach, check_radius, limit)).withColumnRenamed("node", "__node")
    named = nodes.join(found, F.col("node") == F.col("__node"), "left").select("fp", "fp2", F.coalesce("component", "node").alias("component_id"))
    return marks.join(named, ["fp", "fp2"]).select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint, component_id."""
    return near_duplicate_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
