"""Hard-negative mining by dual-tree search: trees over anchors and candidates, whole node pairs pruned by inner-product intervals.

Components become floor(256 * x), scores are integer inner products. Anchors are the rows whose vec_id is divisible by
`every`. Two searches of all rows, each a job of its own:

1. positives: the n_positives best rows of the anchor's own label;
2. negatives: for each positive score p the n_negatives best rows of other labels with low * p <= 100 * score <= 100 * p.

Rows are dealt to parts by a range partition over (label, cell, vec_id); cells are the closest of PIVOTS rows drawn by hash,
so a part, and each batch of it, holds rows that lie together, and a label or cell of a third of all rows spreads over many parts.
Anchors in groups of at most `group` meet the parts in one partition for each (group, part): first the group, which gets a
tree, then the part's rows, batch by batch, each batch with a tree of its own; trees part labels before they part space. A pair of nodes (centres a and b, radii r and s)
has inner products within a.b +- (r |b| + s |a| + r s). The traversal starts at the two roots and drops a pair if no anchor
below it can gain from any row below: the upper bound doesn't reach the smallest of the group's n-th best scores so far, the
interval misses all windows of the group's positives, or the labels don't fit. Pairs of leaves that stay are scored exactly,
most promising first, and tighten the group's bounds. What each partition holds is its anchors' best rows; these few are
merged by anchor, after the part is done. Nothing is sampled, and no candidate is left out.

A group travels to every part and every group reads all rows once: `group` bounds a task's memory, part_bytes how often
anchors are copied (rows of a part are streamed, not held). Groups run one after another.

Rows with a null label, vector or vec_id, or with a null or non-finite component, take no part. Repeated rows are one; of
different rows under one vec_id the smallest (label, vector) counts. Vectors of different lengths have no inner product and
are never set against each other. Scores are exact 64-bit integers: sums that could pass 2**53 are added as integers, and a
row with a squared length of 2**62 or more, whose scores 64 bits might not hold, takes no part. An anchor without other rows of its label, or a
positive without such negatives, has no rows; an empty table gives none. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import buckets_for, runs
from emberline.session import materialize, release

PIVOTS = 256
LEAF = 64
FEW = 8  # rows that may share a leaf whatever their labels
LABELS = 10
ROWS = "vec_id long, label long, q binary"
HITS = "anchor_id long, slot int, vec_id long, score long"
MOST = float(1 << 62)  # two vectors of a smaller squared length have a score below 2**62


def mined_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (changed where vec_id is divisible by 7), q (floor(256 * x) as little-endian 16-bit integers where all fit, else doubles)."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, at = batch["x"].values, batch["x"].offsets.to_numpy()
            with np.errstate(invalid="ignore", over="ignore"):
                y = np.floor(flat.to_numpy(zero_copy_only=False) * 256.0)
                size = [float((y[a:b] ** 2).sum()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            keep = [k for k, n in enumerate(size) if n < MOST]  # not where it is NaN
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([rows["vec_id"], rows["label"], pa.array([_packed(y[at[k] : at[k + 1]]) for k in keep], pa.binary())], names=["vec_id", "label", "q"])

    return own.where(usable).select("vec_id", changed.alias("label"), "x").mapInArrow(f, ROWS)


def _packed(q: np.ndarray) -> bytes:
    small = not len(q) or np.abs(q).max() < 1 << 15
    return (b"h" + q.astype("<i2").tobytes()) if small else (b"d" + q.astype("<f8").tobytes())


def unpacked(q: bytes) -> np.ndarray:
    return np.frombuffer(q, "<i2" if q[:1] == b"h" else "<f8", offset=1).astype(np.float64)


def matrix(packed: list[bytes]) -> np.ndarray:
    """Rows of one length as a matrix of doubles, which hold the integers exactly."""
    if all(q[:1] == b"h" for q in packed):
        return np.frombuffer(b"".join([q[1:] for q in packed]), "<i2").reshape(len(packed), -1).astype(np.float64)
    return np.array([unpacked(q) for q in packed])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    if np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1] < float(1 << 53):
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Tree:
    """A ball tree in arrays: node k covers rows start[k]:end[k] of x; left[k] is -1 at a leaf."""

    x: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    order: np.ndarray  # of the rows as they were given
    start: np.ndarray = field(init=False)
    end: np.ndarray = field(init=False)
    left: np.ndarray = field(init=False)
    right: np.ndarray = field(init=False)

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, label: np.ndarray, leaf: int = LEAF) -> Tree:
        order, nodes, stack = np.arange(len(x)), [], [(0, len(x), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            k = len(nodes)
            nodes.append([start, end, -1, -1])
            if parent >= 0:
                nodes[parent][2 + side] = k
            own = order[start:end]
            mixed = label[own].min() != label[own].max()
            if end - start <= (FEW if mixed else leaf):
                continue
            if mixed:  # at the border between labels that is closest to the middle
                own = own[np.argsort(label[own], kind="stable")]
                borders = np.flatnonzero(np.diff(label[own])) + 1
                mid = int(borders[np.abs(borders - (end - start) / 2).argmin()])
            else:
                mid = (end - start) // 2
                with np.errstate(over="ignore", invalid="ignore"):
                    spread = np.nan_to_num(x[own].var(0))
                if len(spread):
                    own = own[np.argsort(x[own, spread.argmax()], kind="stable")]
            order[start:end] = own
            stack += [(start + mid, end, k, 1), (start, start + mid, k, 0)]
        tree = cls(x[order], ids[order], label[order], order)
        tree.start, tree.end, tree.left, tree.right = np.array(nodes, np.int64).T
        tree._measure()
        return tree

    def _measure(self) -> None:
        n = len(self.start)
        self.centre, self.radius, self.only = np.zeros((n, self.x.shape[1])), np.zeros(n), np.zeros(n, bool)
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(n):
                own = self.x[self.start[k] : self.end[k]]
                self.centre[k] = own.mean(0)
                self.radius[k] = np.sqrt(((own - self.centre[k]) ** 2).sum(1).max())
                label = self.label[self.start[k] : self.end[k]]
                self.only[k] = (label == label[0]).all()
            self.norm = np.sqrt((self.centre**2).sum(1))
        bits = np.uint64(1) << (self.label % 64).astype(np.uint64)
        self.mask = np.array([np.bitwise_or.reduce(bits[a:b]) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)])
        self.first = self.label[self.start]

    def least(self, per_row: np.ndarray) -> np.ndarray:
        """The smallest value of the rows below each node."""
        return np.array([per_row[a:b].min() for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)])


def intervals(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between nodes i of a and j of b; endless where doubles overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (a.centre[i] * b.centre[j]).sum(1)
        slack = a.radius[i] * b.norm[j] + b.radius[j] * a.norm[i] + a.radius[i] * b.radius[j]
        slack = slack * (1 + 1e-9) + (a.norm[i] * b.norm[j]) * 1e-9 + 1e-6
        low, high = middle - slack, middle + slack
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


class Search:
    """The best rows so far of each slot (an anchor, or an anchor's positive score) of a group, in the group's tree."""

    def __init__(self, tree: Tree, same: bool, k: int, slots: list[list], low: int):
        """slots: of each row of the tree the scores below which rows count (same: one slot without)."""
        self.tree, self.same, self.k, self.low = tree, same, k, low
        self.of = [slots[i] for i in tree.order.tolist()]
        self.n_slots = max((len(s) for s in self.of), default=0)
        self.bound = np.full((len(self.of), self.n_slots), None, object)
        for r, s in enumerate(self.of):
            self.bound[r, : len(s)] = s
        n = len(self.of)
        self.best: dict[tuple[int, int], list[tuple]] = {}
        self.kth = np.full((n, self.n_slots), -np.inf)
        self.floor, self.top = np.full((n, self.n_slots), np.inf), np.full((n, self.n_slots), -np.inf)
        for r, s in enumerate(self.of):
            for c, p in enumerate(s):
                self.floor[r, c], self.top[r, c] = (-np.inf, np.inf) if same else (low * float(p) / 100, float(p))
        self.open()

    def open(self) -> None:
        """What a row must reach to count for some slot below each node, and the largest score that may count."""
        need = np.maximum(self.kth, self.floor)
        need[self.top < self.floor] = np.inf
        self.need = self.tree.least(need.min(1, initial=np.inf))
        self.most = -self.tree.least(-self.top.max(1, initial=-np.inf))

    def run(self, other: Tree) -> None:
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        leaves = []
        while len(i):
            low, high = intervals(self.tree, i, other, j)
            keep = (high >= self.need[i]) & (low <= self.most[i])
            if self.same:
                keep &= (self.tree.mask[i] & other.mask[j]) != 0
            else:
                keep &= ~(self.tree.only[i] & other.only[j] & (self.tree.first[i] == other.first[j]))
            i, j, high = i[keep], j[keep], high[keep]
            end = (self.tree.left[i] < 0) & (other.left[j] < 0)
            leaves.append((high[end], i[end], j[end]))
            i, j = i[~end], j[~end]
            split_a = self.tree.left[i] >= 0
            split_b = other.left[j] >= 0
            both_a = np.where(split_a, self.tree.left[i], i), np.where(split_a, self.tree.right[i], i)
            both_b = np.where(split_b, other.left[j], j), np.where(split_b, other.right[j], j)
            one = np.concatenate([both_a[x] for x in (0, 0, 1, 1)])
            two = np.concatenate([both_b[x] for x in (0, 1, 0, 1)])
            fresh = np.concatenate([np.ones(len(i), bool), split_b, split_a, split_a & split_b])
            i, j = one[fresh], two[fresh]
        high, i, j = (np.concatenate(x) for x in zip(*leaves, strict=True))
        for k in np.argsort(-high, kind="stable").tolist():
            if high[k] >= self.need[i[k]]:
                self.leaf(int(i[k]), other, int(j[k]))

    def leaf(self, node: int, other: Tree, at: int) -> None:
        rows, cols = slice(self.tree.start[node], self.tree.end[node]), slice(other.start[at], other.end[at])
        s = scores(self.tree.x[rows], other.x[cols])
        same = self.tree.label[rows, None] == other.label[None, cols]
        ok = (same & (self.tree.ids[rows, None] != other.ids[None, cols])) if self.same else ~same
        touched = False
        for c in range(self.n_slots):
            need = np.maximum(self.kth[rows, c], self.floor[rows, c])
            slack = np.where(np.isfinite(need), np.abs(need) * 1e-9 + 1e-6, 0.0)
            hit = ok & (s >= (need - slack)[:, None]) & (s <= (self.top[rows, c] * (1 + 1e-9) + 1e-6)[:, None])
            for r in np.flatnonzero(hit.any(1)).tolist():
                row = int(rows.start + r)
                if c >= len(self.of[row]):
                    continue
                found = [(-int(v), int(w)) for v, w in zip(s[r, hit[r]].tolist(), other.ids[cols][hit[r]].tolist(), strict=True)]
                if not self.same:
                    p = self.bound[row, c]
                    found = [f for f in found if self.low * p <= -100 * f[0] <= 100 * p]
                if found:
                    best = self.best[row, c] = sorted(self.best.get((row, c), []) + found)[: self.k]
                    if len(best) == self.k:
                        self.kth[row, c] = float(-best[-1][0])
                        touched = True
        if touched:
            need = np.maximum(self.kth[rows], self.floor[rows])
            need[self.top[rows] < self.floor[rows]] = np.inf
            self.need[node] = need.min()

    def hits(self) -> Iterator[tuple]:
        for (row, c), best in self.best.items():
            for score, vec_id in best:
                yield int(self.tree.ids[row]), c, vec_id, -score


def _search(same: bool, k: int, low: int):
    """Over a partition sorted by (unit, role): groups of anchors, each followed by its part's rows."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, anchors, searches = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            found = [h for s in (searches or {}).values() for h in s.hits()]
            if found:
                anchor, slot, vec_id, score = zip(*found, strict=True)
                yield pa.record_batch([pa.array(anchor, pa.int64()), pa.array(slot, pa.int32()), pa.array(vec_id, pa.int64()), pa.array(score, pa.int64())], names=["anchor_id", "slot", "vec_id", "score"])

        for whole in batches:
            key = (whole["team"].to_numpy(), whole["part"].to_numpy())
            at = runs(*key)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                batch = whole.slice(a, b - a)
                now = (key[0][a], key[1][a])
                if now != unit:
                    yield from close()
                    unit, anchors, searches = now, [], None
                role = batch["role"].to_numpy()
                n = int((role == 0).sum())
                if n:
                    anchors.append(batch.slice(0, n))
                rows = batch.slice(n)
                if not rows.num_rows:
                    continue
                if searches is None:
                    searches = {}
                    for size, tree, own in _trees(pa.Table.from_batches(anchors).combine_chunks().to_batches() if anchors else []):
                        wanted = [[None]] * own.num_rows if same else own["bounds"].to_pylist()
                        searches[size] = Search(tree, same, k, wanted, low)
                for size, tree, _ in _trees([rows]):
                    if size in searches:
                        searches[size].run(tree)
                        searches[size].open()
        yield from close()

    return f


def _trees(batches: list[pa.RecordBatch]) -> Iterator[tuple[int, Tree, pa.RecordBatch]]:
    """A tree for each length of vectors in a batch, each of distinct vec_ids."""
    for batch in batches:
        packed = batch["q"].to_pylist()
        size = np.array([(len(q) - 1) // (2 if q[:1] == b"h" else 8) for q in packed])
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            rows = batch.take(pa.array(own))
            yield d, Tree.of(matrix([packed[k] for k in own.tolist()]), rows["vec_id"].to_numpy(), rows["label"].to_numpy()), rows


def _cells(pivots: list[bytes]):
    """Appends the closest pivot of the same length (by cosine of what lies in the way; only an order, never a result)."""
    by_size: dict[int, np.ndarray] = {}
    for q in pivots:
        v = unpacked(q)
        by_size[len(v)] = np.vstack([by_size.get(len(v), np.zeros((0, len(v)))), v])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch["q"].to_pylist()
            cell = np.zeros(len(packed), np.int32)
            size = np.array([(len(q) - 1) // (2 if q[:1] == b"h" else 8) for q in packed], np.int64)
            for d in np.unique(size).tolist():
                if d and d in by_size:
                    own = np.flatnonzero(size == d)
                    with np.errstate(over="ignore", invalid="ignore"):
                        cell[own] = np.nan_to_num(matrix([packed[k] for k in own.tolist()]) @ by_size[d].T).argmax(1)
            yield pa.record_batch([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return f


def _best(hits: DataFrame, k: int, *key: str) -> DataFrame:
    """The k best hits of each key with their rank; a key has at most k hits from each part."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, low: int = 80, group: int = 1 << 16, part_bytes: int = 128 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    once = mined_rows(embeddings).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    rows, path = materialize(once, "mined-rows")
    n_rows = rows.count()
    pivots = [r["q"] for r in rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) < int((1 << 31) * min(1.0, 2 * PIVOTS / max(1, n_rows)))).select("q").limit(PIVOTS).collect()]
    n_parts = buckets_for(rows.agg(F.sum(F.octet_length("q"))).first()[0] or 0, part_bytes)
    placed = rows.mapInArrow(_cells(pivots), f"{ROWS}, cell int").repartitionByRange(n_parts, "label", "cell", "vec_id")
    parts, _ = materialize(placed.withColumn("part", F.spark_partition_id()), "mined-parts")
    release(spark, path)
    last = parts.agg(F.max("part")).first()[0] or 0
    anchors = parts.where(F.col("vec_id") % every == 0)
    n_teams = max(1, -(-anchors.count() // group))
    anchors = anchors.withColumn("team", F.pmod(F.xxhash64("vec_id"), F.lit(n_teams)).cast("int"))

    def searched(own: DataFrame, same: bool, k: int) -> DataFrame:
        """One job for each team: its anchors go to every part, rows once."""
        out = None
        for team in range(n_teams):
            of = own.where(F.col("team") == team).drop("part", "cell")
            one = of.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"), F.lit(0).alias("role"), F.lit(0).alias("cell"))
            two = parts.select("vec_id", "label", "q", F.lit(None).cast("array<long>").alias("bounds"), F.lit(team).alias("team"), "part", F.lit(1).alias("role"), "cell")
            met = one.unionByName(two).repartition(last + 1, "part").sortWithinPartitions("team", "part", "role", "label", "cell", "vec_id")
            hits, _ = materialize(met.mapInArrow(_search(same, k, low), HITS), "hits")
            out = hits if out is None else out.unionByName(hits)
        return out

    found = _best(searched(anchors.withColumn("bounds", F.lit(None).cast("array<long>")), True, n_positives), n_positives, "anchor_id")
    positives, _ = materialize(found.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = positives.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("bounds"))  # n_positives at most
    asked = anchors.join(bounds, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = _best(searched(asked, False, n_negatives), n_negatives, "anchor_id", "slot")
    found = found.select("anchor_id", (F.col("slot") + 1).alias("slot"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(positives, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows in DuckDB's SQL, from all pairs of anchors and rows.
ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
