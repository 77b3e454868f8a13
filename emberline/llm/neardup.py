"""Near copies at a Jaccard similarity of their word shingles: the pipeline's SimHash near-dedup, completed to 0.8.

Two documents are linked if their sets of five-word shingles (words as in simhash.py) have a Jaccard similarity of
`similarity` or more. Candidates come from two indexes, and every link is verified on the texts:

1. The operator's own index: 64-bit SimHash fingerprints, Hamming balls around segments, full distances (simhash.links).
   It finds what lies within `radius` bits. At 0.8 fingerprints differ by 10 bits on average and by up to 20, more than
   any blocks of 64 bits can carry, so the index alone can't give right results at 0.8.
2. Bands of MinHash values: a document enters one row for each of `bands` bands of `rows` values. A pair at similarity s
   shares none with probability (1 - s ** rows) ** bands: 5e-5 at 0.8, less above. Rows that nobody shares fall away where
   they are sorted. What meets in the others is compared by sketches, two bits of each of VALUES MinHash values; a pair at
   0.8 differs in at most SKETCH_RADIUS of them but for about 1e-4.

Nothing is emitted for all pairs of a row. First each document is set against the closest document it meets; the verified
pairs make components. Members of a row that may still link to another component then meet with their sets of shingle hashes
(64 bits); pairs are compared in the row, each in the first band it shares, and a row gives a forest of links at most. A crowd of
documents that are alike but not near copies costs comparisons, no rows. Rows are range-partitioned by key and node, so a hot
key spreads over partitions; crowded rows are cut into blocks (simhash.deal). Equal sets are one node from the start. Only texts with a candidate move: to the partner that most others are set
against, in chunks of at most CHUNK documents, and as sets to rows that aren't settled.

Null text counts as empty, texts without words are equal to each other, rows without doc_id are left out. Repeated rows
of a doc_id are one document; of different texts under one id each is compared, and they are in one component. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import buckets_for, mix, runs, slim, without_ids
from emberline.llm.simhash import LINKS, deal, links, shingles, simhash, whole_runs
from emberline.operators.components import connected_components
from emberline.session import materialize, release

BANDS, ROWS = 25, 5
VALUES = 256  # MinHash values a document: bands x rows of them make keys, two bits of each a sketch
SKETCH = VALUES // 32  # longs of a sketch
SKETCH_RADIUS = 60  # at 0.8 two sketches differ in 38 values on average, with a deviation of 5.7
CHUNK = 256
_ODD = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(VALUES + 1, 2 * VALUES + 1, dtype=np.uint64))
MARKS = "doc_id long, d1 long, d2 long, fp long, sketch binary, keys array<long>"
MEET = "key long, node long"


def min_hashes(own: np.ndarray, block: int = 1 << 10) -> np.ndarray:
    """The smallest of each of VALUES hashes over a set of hashes."""
    return np.min([(own[k : k + block, None] * _ODD + _ADD).min(0) for k in range(0, len(own), block)], axis=0)


def marks_of(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, d1, d2 (a digest of the set of shingles), fp (SimHash), sketch, keys (a key for each band)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps, digests, mins = [], [], []
            for text in batch["text"]:
                parts = shingles(text.as_buffer().to_pybytes(), words)
                own = np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(x, 42) for x in parts or [b""]]), np.uint64))
                fps.append(simhash(parts))
                digests.append(xxhash.xxh3_128_intdigest(own.tobytes()))
                mins.append(min_hashes(own))
            low = mix(np.stack(mins))
            two = np.stack([low >> np.uint64(40) & np.uint64(1), low >> np.uint64(41) & np.uint64(1)], axis=2)
            sketch = [x.tobytes() for x in np.packbits(two.reshape(len(mins), -1).astype(bool), axis=1)]
            key = np.zeros((len(mins), BANDS), np.uint64)
            for r in range(ROWS):
                key = mix(key ^ low[:, r : BANDS * ROWS : ROWS])
            key = mix(key ^ np.arange(BANDS, dtype=np.uint64))
            longs = lambda x: pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))
            big = np.array([[d >> 64, d & (2**64 - 1)] for d in digests], np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS, dtype=np.int32)), longs(key.ravel()))
            yield pa.record_batch([batch["doc_id"], longs(big[:, 0]), longs(big[:, 1]), longs(np.array(fps, np.uint64)), pa.array(sketch, pa.binary()), lists], names=["doc_id", "d1", "d2", "fp", "sketch", "keys"])

    return slim(docs).mapInArrow(f, MARKS)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by key: rows whose key a neighbour has too, and the runs at its ends, which may go on elsewhere."""
    first = last = None
    held: pa.RecordBatch | None = None
    held_stays = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch["key"].to_numpy()
        if first is None:
            first = key[0]
        if held is not None and (held_stays or key[0] == last):
            yield held
        stays = key == first
        stays[1:] |= key[1:] == key[:-1]
        stays[:-1] |= key[1:] == key[:-1]
        stays[0] |= last is not None and key[0] == last
        yield batch.slice(0, len(key) - 1).filter(pa.array(stays[:-1]))
        held, held_stays, last = batch.slice(len(key) - 1), bool(stays[-1]), key[-1]
    if held is not None:
        yield held


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values sketches differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int16)


def _distances(sketch: np.ndarray, own: slice, others: slice) -> np.ndarray:
    a, b = sketch[own], sketch[others]
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(SKETCH):
        out += _distance(a[:, k, None, None], b[None, :, k, None])
    return out


def _sketches(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH)


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[n].combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def _closest(radius: int, block: int = 128):
    """For each member of each run the closest other member within radius (a, b, d); of equally close ones the smallest."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, node = _columns(rows, "key", "part", "node")
        sketch = _sketches(rows)
        at = runs(key, part)
        size = np.diff(at)
        two = at[:-1][size == 2]
        d = _distance(sketch[two], sketch[two + 1])
        ok = d <= radius
        found = [(node[two[ok] + 1], node[two[ok]], d[ok]), (node[two[ok]], node[two[ok] + 1], d[ok])]
        for k in np.flatnonzero(size > 2):
            begin, end = at[k], at[k + 1]
            for i in range(begin, end, block):
                own = slice(i, min(i + block, end))
                dist = _distances(sketch, own, slice(begin, end))
                rank = np.arange(own.start, own.stop)
                dist[rank - i, rank - begin] = 1000
                best = dist.argmin(1)
                d = dist[rank - i, best]
                ok = d <= radius
                found.append((node[rank[ok]], node[begin + best[ok]], d[ok]))
        a, b, d = (np.concatenate([np.asarray(x[j], np.int64) for x in found]) for j in range(3))
        apart = a != b
        yield pa.record_batch([pa.array(a[apart]), pa.array(b[apart]), pa.array(d[apart])], names=["a", "b", "d"])

    return lambda batches: whole_runs(batches, solve)


def _unsettled(radius: int, block: int = 128):
    """The members of runs that have one of another component within radius: no pairs."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, node, group = _columns(rows, "key", "part", "node", "component")
        sketch = _sketches(rows)
        at = runs(key, part)
        stays = np.zeros(len(key), bool)
        for k in np.flatnonzero((np.diff(at) > 1) & (np.minimum.reduceat(group, at[:-1]) != np.maximum.reduceat(group, at[:-1]))):
            begin, end = at[k], at[k + 1]
            for i in range(begin, end, block):
                own = slice(i, min(i + block, end))
                near = (_distances(sketch, own, slice(i, end)) <= radius) & (group[own, None] != group[None, i:end])
                stays[own] |= near.any(1)
                stays[i:end] |= near.any(0)
        yield pa.record_batch([pa.array(x[stays]) for x in (key, node, group)], names=["key", "node", "component"])

    return lambda batches: whole_runs(batches, solve)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, own: the sorted 64-bit hashes of a text's set of shingles."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(x, 42) for x in shingles(t.as_buffer().to_pybytes(), words) or [b""]]), np.uint64)).tobytes() for t in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array(own, pa.binary())], names=["node", "own"])

    return texts.select("doc_id", "text").mapInArrow(f, "node long, own binary")


def _settled(radius: int, similarity: float):
    """Over runs of (key, part): links (a, b) that join members of different components, verified on their sets; a forest, not all pairs.

    A pair is compared in the run of the first band it shares. Where a run holds two blocks, pairs within a block are another part's.
    """

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, block, node, group = _columns(rows, "key", "part", "block", "node", "component")
        sketch, at = _sketches(rows), runs(key, part)
        bands = rows["keys"].combine_chunks().values.to_numpy().reshape(-1, BANDS)
        sets = [np.frombuffer(x, np.uint64) for x in rows["own"].to_pylist()]
        size = np.array([len(x) for x in sets])
        a, b = [], []
        for k in np.flatnonzero(np.diff(at) > 1):
            begin, end = at[k], at[k + 1]
            now = group[begin:end].copy()
            two = (block[begin:end] != block[begin]).any()
            for i in range(begin, end - 1):
                rest = slice(i + 1, end)
                near = (now[i + 1 - begin :] != now[i - begin]) & (np.minimum(size[i], size[rest]) >= similarity * np.maximum(size[i], size[rest]) - 1e-9)
                if two:
                    near &= block[rest] != block[i]
                j = i + 1 + np.flatnonzero(near)
                if len(j):
                    j = j[(_distance(sketch[None, i], sketch[j]) <= radius)]
                if len(j):
                    same = bands[i] == bands[j]
                    j = j[bands[i][same.argmax(1)] == key[i]]
                if not len(j):
                    continue
                flat = np.concatenate([sets[y] for y in j.tolist()])
                spot = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                both = np.add.reduceat(sets[i][spot] == flat, np.concatenate([[0], np.cumsum(size[j])[:-1]]), dtype=np.int64)
                for y in j[both >= similarity * (size[i] + size[j] - both) - 1e-9].tolist():
                    if now[y - begin] != now[i - begin]:
                        a.append(node[i])
                        b.append(node[y])
                        now[now == now[y - begin]] = now[i - begin]
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lambda batches: whole_runs(batches, solve)


def verified(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of distinct pairs (a, b) those of which two texts have this similarity. texts: doc_id, text; of an id with several texts any counts.

    Of a pair the document that stands in more pairs is the hub; its text goes once to every CHUNK documents set against it.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.join(ends.select(F.col("end").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("end").alias("b"), F.col("n").alias("nb")), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    hubs = counted.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("na", "nb").alias("n"))
    dealt, path = materialize(hubs.select("hub", F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / CHUNK)).alias("chunk"), "other"), "dealt-pairs")
    sides = dealt.select("hub", "chunk", F.col("other").alias("doc_id"), F.lit(1).alias("role")).unionByName(dealt.select("hub", "chunk", F.col("hub").alias("doc_id"), F.lit(0).alias("role")).distinct())

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found = set()
            for hub, chunk, doc_id, role, text in zip(*(batch[n].to_pylist() for n in ("hub", "chunk", "doc_id", "role")), batch["text"], strict=True):
                if (hub, chunk) != now:
                    now, held = (hub, chunk), []
                own = set(shingles(text.as_buffer().to_pybytes(), words)) or {b""}
                if role == 0:
                    held.append(own)
                elif any((both := len(own & other)) >= similarity * (len(own) + len(other) - both) - 1e-9 for other in held):
                    found.add((doc_id, hub))
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = texts.join(sides, "doc_id").select("hub", "chunk", "role", "doc_id", "text")
    return materialize(met.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role").mapInArrow(f, LINKS), "links")[0]


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _settle(left: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, limit: int, run_bytes: int = 64 << 20) -> DataFrame:
    """a, b: links between components among the rows (key, node, component) that may hold some.

    The sets travel to the rows, and pairs are compared where they lie: what is written is a forest a run. A run of over `limit`
    members, fewer where sets are large, is cut into blocks, and each two blocks are a part.
    """
    ids, _ = materialize(left.select(F.col("node").alias("doc_id")).distinct(), "unsettled-ids")
    sets, _ = materialize(shingle_sets(texts.join(ids, "doc_id", "left_semi"), words), "shingle-sets")
    largest = sets.agg(F.max(F.octet_length("own"))).first()[0] or 8
    limit = max(32, min(limit, run_bytes // largest))
    counts = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / limit).alias("blocks"))
    whole = F.col("blocks") <= 2
    block = F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("long")
    dealt = left.join(counts, "key").withColumn("block", block)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.least("block", i) * F.col("blocks") + F.greatest("block", i))
    dealt = dealt.select("key", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(meets)).alias("part"), "block", "node", "component")
    rows = dealt.join(nodes.select("node", "sketch", "keys"), "node").join(sets, "node")
    return materialize(rows.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_settled(SKETCH_RADIUS, similarity), LINKS), "links")[0]


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, limit: int = 1 << 13, few: int = 1 << 17, row_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable) for each doc_id."""
    marks, _ = materialize(marks_of(docs, words), "marks")
    nodes = marks.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    nodes, _ = materialize(nodes, "nodes")
    n = buckets_for(nodes.count() * BANDS * 16, row_bytes)
    rows = nodes.select(F.explode("keys").alias("key"), "node").repartitionByRange(n, "key", "node").sortWithinPartitions("key", "node")
    shared, path = materialize(rows.mapInArrow(_shared, MEET), "shared-rows")
    sketches = nodes.select("node", "sketch")  # an id with several texts meets by each
    meet, _ = materialize(deal(shared, limit, "node").join(sketches, "node"), "dealt-rows")
    release(docs.sparkSession, path)

    def met(rows: DataFrame, step, schema: str) -> DataFrame:
        return rows.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(step, schema)

    closest = met(meet, _closest(SKETCH_RADIUS), "a long, b long, d long").groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    near = links(nodes.select("node", "fp", F.lit(0).cast("long").alias("fp2")), radius, 2, 1)
    tried, _ = materialize(_unordered(closest.unionByName(near)), "candidates")
    # whatever is compared later has a closest document, so these are all the texts there are to move
    ids, _ = materialize(tried.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")
    texts, _ = materialize(slim(docs).join(F.broadcast(ids) if ids.count() <= few else ids, "doc_id", "left_semi"), "candidate-texts")
    several = marks.join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node").distinct()
    several, _ = materialize(several, "documents-of-nodes")
    apart = several.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("doc_id", "b")
    sure = [verified(texts, tried, words, similarity), several.join(apart, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")]
    found = connected_components(reduce(DataFrame.unionByName, sure)).withColumnRenamed("node", "__node")
    named = meet.join(found, F.col("node") == F.col("__node"), "left").select("key", "part", "node", "sketch", F.coalesce("component", "node").alias("component"))
    left, _ = materialize(met(named, _unsettled(SKETCH_RADIUS), "key long, node long, component long"), "unsettled")
    if left.head(1):
        sure.append(_settle(left.distinct(), nodes, texts, words, similarity, limit))
        found = connected_components(reduce(DataFrame.unionByName, sure)).withColumnRenamed("node", "__node")
    named = several.join(found, F.col("node") == F.col("__node"), "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return named.distinct()


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents without near copies of an earlier one: of each component the smallest doc_id stays, with all its columns.

    Rows without doc_id stay; repeated rows of a doc_id are one document and stay or go together.
    """
    found = similar_components(docs, words, similarity)
    return without_ids(docs, found.where("doc_id <> component_id").select("doc_id"))
