"""Packing by cutting-stock column generation.

Every document becomes its token ids and an end id. Ids are cut every `size` ids; what is left of a document
is shorter than `size`, and these rests are packed into sequences of `size`.

How many rests there are of each length is a histogram of at most `size` numbers, all that the driver sees.
Over it a linear program chooses patterns (how many rests of each length share a sequence): the master
problem is solved by a revised simplex, and a knapsack by dynamic programming prices columns with its dual
values until no pattern improves it, its bound is met within `gap`, or the simplex has taken `max_pivots` steps. Counts are rounded
down, then up where the pattern still fits, largest fractions first. What rounding leaves follows the number of lengths,
not of documents: a knapsack over sums fills one sequence after the other with it. Where all this takes more sequences
than the ids need, the emptiest are dissolved: their rests, and no others, are cut into the gaps of the rest, so that
all sequences but one are full. The plan is broadcast: a few
thousand patterns, whatever the number of documents.

Rests are ranked within their length by doc_id: they are range-partitioned by length and doc_id, so a length
that a third of all documents have spreads over many partitions; each partition numbers its own rows, and one
count a partition and length (at most partitions + size rows) makes the numbers global. Rank and plan give
sequence and offset by arithmetic, for a rest that is cut as for a whole one. The ids of a cut rest are made again
from its text to sum their pieces; its document is known by doc_id and the checksum of the rest.

Null or empty text: the end id alone. Rows without doc_id are packed as well, their doc_id stays null. Repeated rows
are packed each; an empty table gives an empty result. Lengths of `size` fill a sequence of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import buckets_for, runs, small_batches
from emberline.session import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = ("<|endoftext|>", 50256)


@cache
def _encoding(vocabulary: str):
    """The byte-level BPE of byte_bpe_50k.json in its tiktoken form: the same ids, five times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids that tokenizers gives with byte_bpe_50k.json: SPECIAL in a text is one id, whatever stands beside it."""
    encode = _encoding(vocabulary).encode_ordinary
    first, *more = text.split(SPECIAL[0])
    ids = encode(first)
    for part in more:
        ids.append(SPECIAL[1])
        ids += encode(part)
    return np.array(ids, "<u4")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def all_texts(docs: DataFrame) -> DataFrame:
    """doc_id (may be null) and text (null: empty) of every row."""
    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut every `size` ids."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = np.append(token_ids(text.as_py(), vocabulary), np.uint32(end_id)).astype("<u4").tobytes()
                n = len(raw) // 4
                rows += [(doc_id, k, min(size, n - k), zlib.crc32(raw[4 * k : 4 * (k + size)]), n) for k in range(0, n, size)]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return all_texts(docs).mapInArrow(f, PIECES)


def _price(lengths: np.ndarray, value: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unbounded knapsack by dynamic programming: for each length the most valuable pattern that holds it (places, counts), the best first."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    use = np.flatnonzero(value > 1e-12)
    own, worth = lengths[use], value[use]  # ascending lengths
    upto = np.searchsorted(own, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            total = best[c - own[:k]] + worth[:k]
            j = int(total.argmax())
            if total[j] > best[c] + 1e-15:
                best[c], last[c] = total[j], j
    filled = np.maximum.accumulate(np.where(last >= 0, np.arange(size + 1), 0))  # the room that the best pattern uses
    for first in np.argsort(-(worth + best[size - own]), kind="stable"):
        items, c = [first], int(filled[size - own[first]])
        while c > 0:
            items.append(last[c])
            c = int(filled[c - own[last[c]]])
        yield np.unique(use[items], return_counts=True)


def _fullest(lengths: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """A knapsack whose values are the lengths: the longest rest there is, and of the others what fills its sequence best. Sums are bits of one number."""
    has = np.flatnonzero(left > 1e-9)[::-1]
    pattern = np.zeros(len(lengths), np.int64)
    pattern[has[0]] = 1
    room = size - int(lengths[has[0]])
    items = [int(i) for i in has if lengths[i] <= room for _ in range(min(int(np.ceil(left[i] - 1e-9)) - int(i == has[0]), room // int(lengths[i])))]
    reach, mask = [1], (1 << room + 1) - 1
    for i in items:
        reach.append((reach[-1] | reach[-1] << int(lengths[i])) & mask)
        if reach[-1] >> room:  # full
            break
    at = reach[-1].bit_length() - 1
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> at & 1:
            pattern[items[k - 1]] += 1
            at -= int(lengths[items[k - 1]])
    return pattern


def _first_basis(lengths: np.ndarray, demand: np.ndarray, size: int) -> np.ndarray:
    """A basis to begin with: one pattern after the other, each taken until a length is met; columns by the length they meet."""
    basis, left = np.diag((size // lengths).astype(float)), demand.astype(float)
    while (left > 1e-9).any():
        p = _fullest(lengths, left, size)
        has = np.flatnonzero(p)
        n = left[has] / p[has]
        met = has[n.argmin()]
        left[has] -= n.min() * p[has]
        left[met] = 0
        basis[:, met] = p
    return basis


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 1e-3, max_pivots: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional counts for the linear program; lengths ascend.

    All columns are what the knapsack finds. Those priced with dual values stay in a pool, over which the simplex runs to its
    end before the knapsack prices again. The dual values are drawn towards the lengths' shares of a sequence, which are
    those of a program without padding, less and less until no column improves the basis.
    """
    m = len(lengths)
    basis = _first_basis(lengths, demand, size)
    inverse = np.linalg.inv(basis)
    x, dual = np.maximum(inverse @ demand, 0), inverse.sum(0)
    bound = (lengths * demand).sum() / size
    share, pivots = lengths / size, 0
    pool: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def enter(at: np.ndarray, n: np.ndarray) -> bool:
        nonlocal x, inverse, dual, pivots
        gain = dual[at] @ n - 1  # every pattern costs one sequence
        if gain <= 1e-7:
            return False
        d = inverse[:, at] @ n
        able = d > 1e-7
        if not able.any():
            return False
        ratio = np.full(m, np.inf)
        ratio[able] = x[able] / d[able]
        tied = np.flatnonzero(ratio <= ratio.min() + 1e-9)
        out = int(tied[d[tied].argmax()])  # of equal steps the largest pivot keeps the basis regular
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        row = inverse[out] / d[out]
        rows, columns = np.flatnonzero(np.abs(d) > 1e-12), np.flatnonzero(row)  # patterns are sparse, and so is what changes
        inverse[np.ix_(rows, columns)] -= d[rows, None] * row[columns]
        inverse[out] = row
        dual = dual - gain * row
        basis[:, out] = 0
        basis[at, out] = n
        pivots += 1
        if pivots % 500 == 0:  # against rounding errors
            inverse = np.linalg.inv(basis)
            x, dual = np.maximum(inverse @ demand, 0), inverse.sum(0)
        return True

    def solve() -> bool:
        columns = list(pool.values())
        width = max(len(at) for at, _ in columns)
        places, times = (np.array([np.pad(c[k], (0, width - len(c[k]))) for c in columns]) for k in (0, 1))
        any_ = False
        while pivots < max_pivots and x.sum() > bound * (1 + gap):
            gains = (dual[places] * times).sum(1)
            best = np.argsort(-gains)[:64]
            if not sum([enter(*columns[k]) for k in best if gains[k] > 1 + 1e-7]):
                break
            any_ = True
        return any_

    def price(values: np.ndarray) -> None:
        for at, n in _price(lengths, values, size):
            pool.setdefault(at.tobytes() + n.tobytes(), (at, n))

    try:
        drawn = 0.75
        while pivots < max_pivots and x.sum() > bound * (1 + gap):
            price(drawn * share + (1 - drawn) * dual)
            if not solve():
                if not drawn:
                    break
                drawn = drawn / 2 if drawn > 0.1 else 0
    except np.linalg.LinAlgError:  # a basis that rounding made singular: its patterns are still patterns
        pass
    return basis.T, x


@dataclass
class Plan:
    """For each interval of ranks of a length: how the ranks map to sequences.

    A rest is whole (stream -1) or cut: rests to cut stand one behind the other in a stream of ids, the gaps that take
    them likewise, so a place in the stream gives the gap by arithmetic.
    """

    length: np.ndarray
    first_rank: np.ndarray
    each: np.ndarray  # rests of this length in a sequence
    sequence: np.ndarray  # of the first rank
    offset: np.ndarray  # of the length's first rest in the sequence
    stream: np.ndarray  # where the first rank's ids begin among those to cut, or -1
    gaps: np.ndarray  # rows of (begin in the stream, size, number of gaps, first sequence, offset)
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset and, of rests to cut, the place in the stream (-1 of others)."""
        key = lambda a, b: a.astype(np.int64) << 40 | b
        i = np.searchsorted(key(self.length, self.first_rank), key(length, rank), side="right") - 1
        within = rank - self.first_rank[i]
        stream = np.where(self.stream[i] < 0, -1, self.stream[i] + within * length)
        return self.sequence[i] + within // self.each[i], self.offset[i] + within % self.each[i] * length, stream

    def cut(self, length: int, stream: int) -> Iterator[tuple[int, int, int, int]]:
        """(first id of the rest, how many, sequence, offset) of each piece of a rest to cut."""
        done = 0
        k = int(np.searchsorted(self.gaps[:, 0], stream, side="right")) - 1
        while done < length:
            begin, size, n, sequence, offset = self.gaps[k].tolist()
            q, used = divmod(stream + done - begin, size)
            if q >= n:
                k += 1
                continue
            take = min(size - used, length - done)
            yield done, take, sequence + q, offset + used
            done += take


def program_patterns(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 1e-3, max_pivots: int = 600) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole counts that hold the demand: the program's, rounded, and the fullest sequences of what rounding leaves."""
    if not len(lengths):
        return []
    patterns, counts = column_generation(lengths, demand.astype(float), size, gap, max_pivots)
    patterns, left, chosen = np.rint(patterns).astype(np.int64), demand.copy(), []
    whole = np.floor(counts + 1e-7).astype(np.int64)
    for up in (False, True):  # down, then up by one where the pattern still fits, the largest fractions first
        for k in np.argsort(whole - counts, kind="stable") if up else range(len(whole)):
            p = patterns[k]
            n = min(int(counts[k] - whole[k] > 1e-7) if up else int(whole[k]), int((left[p > 0] // p[p > 0]).min()))
            if n:
                chosen.append((p, n))
                left = left - n * p
    while left.any():  # at most as many rests as there are patterns and places in them, however many documents
        p = _fullest(lengths, left, size)
        n = int((left[p > 0] // p[p > 0]).min())
        chosen.append((p, n))
        left = left - n * p
    return chosen


def make_plan(histogram: dict[int, int], size: int, gap: float = 1e-3, max_pivots: int = 600) -> Plan:
    """The programs' patterns; rests of the emptiest, as many as need not have a sequence, are cut into the gaps of the others."""
    lengths = np.array(sorted(x for x in histogram if x < size), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    chosen = program_patterns(lengths, demand, size, gap, max_pivots)
    chosen.sort(key=lambda pn: -int(pn[0] @ lengths))
    keep = -(-int(lengths @ demand) // size)
    rows, gaps, used, sequence, filled, room = [], [], np.zeros(len(lengths), np.int64), 0, 0, 0
    for p, n in chosen:
        whole = min(n, keep - sequence)
        fill = int(p @ lengths)
        offset = 0
        for i in np.flatnonzero(p)[::-1]:
            if whole:
                rows.append((int(lengths[i]), int(used[i]), int(p[i]), sequence, offset, -1))
                used[i] += p[i] * whole
                offset += int(p[i] * lengths[i])
            if n > whole:
                rows.append((int(lengths[i]), int(used[i]), 1, 0, 0, filled))
                used[i] += p[i] * (n - whole)
                filled += int(p[i] * (n - whole) * lengths[i])
        if whole and fill < size:
            gaps.append((room, size - fill, whole, sequence, fill))
            room += (size - fill) * whole
        sequence += whole
    if full := histogram.get(size, 0):
        rows.append((size, 0, 1, sequence, 0, -1))
        sequence += full
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    return Plan(*columns, gaps=np.array(gaps, np.int64).reshape(-1, 5), n_sequences=sequence)


NUMBERED = "part long, local long, " + PIECES
PACKED = PIECES + ", sequence_id long, offset long"
PLACED = PACKED + ", rest_start long, rest_length long"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number a sorted partition's rows within each length."""
    part, length, n = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch["length"].to_numpy()
        at = runs(own)
        local = np.arange(len(own)) - np.repeat(at[:-1], np.diff(at))
        if own[0] == length:
            local[: at[1]] += n
        length, n = own[-1], int(local[-1]) + 1
        yield pa.record_batch([pa.array(np.full(len(own), part, np.int64)), pa.array(local.astype(np.int64)), *batch.columns], names=["part", "local", *batch.schema.names])


def pack(docs: DataFrame, size: int = 1024, end_id: int = 0, vocabulary: str = VOCABULARY, rows_per_part: int = 1 << 16, gap: float = 1e-3) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    cut, _ = materialize(pieces(docs, size, end_id, vocabulary), "pieces")
    n = buckets_for(cut.count(), rows_per_part)
    order = ["length", "doc_id", "start"]
    numbered, _ = materialize(cut.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_number, NUMBERED), "ranked-pieces")
    counts = numbered.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most n + size rows
    histogram: dict[int, int] = {}
    before = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["part"])):
        before[r["part"], r["length"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    plan = make_plan(histogram, size, gap)
    shared = docs.sparkSession.sparkContext.broadcast((plan, before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plan, first = shared.value
            if not batch.num_rows:
                continue
            part, length = batch["part"].to_numpy(), batch["length"].to_numpy()
            at = runs(part, length)
            begin = np.repeat([first[part[k], length[k]] for k in at[:-1]], np.diff(at))
            sequence, offset, stream = plan.place(length, begin + batch["local"].to_numpy())
            none = pa.nulls(batch.num_rows, pa.int64())
            names = [*batch.schema.names[2:], "sequence_id", "offset", "rest_start", "rest_length"]
            rows = pa.record_batch([*batch.columns[2:], pa.array(sequence), pa.array(offset), none, none], names=names)
            yield rows.filter(pa.array(stream < 0))
            split = []
            for k in np.flatnonzero(stream >= 0).tolist():
                doc_id, start, long, crc, tokens = (c[k].as_py() for c in batch.columns[2:])
                split += [(doc_id, start + a, m, crc, tokens, s, o, start, long) for a, m, s, o in plan.cut(long, int(stream[k]))]
            if split:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*split, strict=True)], names=names)

    placed = numbered.mapInArrow(place, PLACED)
    if not (plan.stream >= 0).any():
        return placed.drop("rest_start", "rest_length")
    whole = placed.where(F.col("rest_start").isNull()).drop("rest_start", "rest_length")
    split, _ = materialize(placed.where(F.col("rest_start").isNotNull()), "cut-rests")
    return whole.unionByName(_summed(docs, split, end_id, vocabulary))


def _summed(docs: DataFrame, split: DataFrame, end_id: int, vocabulary: str, few: int = 1 << 16) -> DataFrame:
    """Pieces of cut rests, whose ids_crc32 is that of the whole rest, with their own; equal pieces of repeated rows are summed once."""
    same = ["start", "length", "ids_crc32", "doc_tokens", "rest_start", "rest_length"]
    asked = split.groupBy("doc_id").agg(F.collect_set(F.struct(*same)).alias("asked"))
    asked, _ = materialize(asked.withColumnRenamed("doc_id", "__id"), "asked-pieces")
    texts = all_texts(docs).join(F.broadcast(asked) if asked.count() <= few else asked, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "asked")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, asked in zip(batch["doc_id"].to_pylist(), batch["text"], batch["asked"].to_pylist(), strict=True):
                raw = np.append(token_ids(text.as_py(), vocabulary), np.uint32(end_id)).astype("<u4").tobytes()
                for a in asked:
                    begin = a["rest_start"]
                    if a["doc_tokens"] * 4 == len(raw) and zlib.crc32(raw[4 * begin : 4 * (begin + a["rest_length"])]) == a["ids_crc32"]:
                        rows.append((doc_id, *(a[c] for c in same), zlib.crc32(raw[4 * a["start"] : 4 * (a["start"] + a["length"])])))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["__id", *same, "own"])

    keys = ["__id", *same]
    own = texts.mapInArrow(f, ", ".join(f"{c} long" for c in [*keys, "own"])).dropDuplicates(keys)
    met = [F.col("s.doc_id").eqNullSafe(F.col("o.__id")), *[F.col(f"s.{c}") == F.col(f"o.{c}") for c in same]]
    got = split.alias("s").join(own.alias("o"), met)
    return got.select("s.doc_id", "s.start", "s.length", F.col("o.own").alias("ids_crc32"), "s.doc_tokens", "s.sequence_id", "s.offset")
