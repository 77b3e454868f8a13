"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text (null: empty, no ids) gets the dummy prefix and its spaces become ▁; byte fallback spells what has no piece. Texts
are cut into words, a run of ▁ and what follows it, since no piece goes on with ▁ after another character (the vocabulary
is asked, not assumed). The words that a worker has not met yet are merged together in flat numpy arrays:

1. symbols are characters; a place between two characters that stand beside each other in no piece is never merged over,
   so it ends a segment;
2. each round finds the smallest pair rank of each segment and merges its occurrences from the left, as far as the library
   would without a better pair coming up in between: a merge whose new neighbours make a pair of the same or a smaller rank
   is the round's last in that segment;
3. merged symbols are compacted, segments without a pair leave; until none is left.

A segment of over LONG symbols (runs of one character, as a rule) would need as many rounds as symbols in the worst case; it
takes the same merges off a heap.

Texts of any length go through in chunks that end where nothing merges. Rows without doc_id are left out; repeated rows give
a row each; an empty table gives an empty result. Only doc_id and text are read, whatever else the columns are called.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from emberline.llm.common import slim

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 1 << 19  # characters that are worked on at once, but for a longer stretch without a place to cut
HELD = 1 << 22  # characters of words whose ids a worker remembers
LONG = 1000
NONE = np.int64(1 << 40)
_SHIFT = np.int64(21)  # a symbol is a piece's id, or the number of pieces and a code point


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


class Vocabulary:
    """A BPE model's tables: symbols of characters, ranks of pairs, neighbours within pieces, bytes of pieces."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.n)]
        normal = [i for i in range(self.n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        of = {names[i]: i for i in normal}
        levels = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        symbol = lambda x: of.get(x, self.n + ord(x) if len(x) == 1 else None)
        pairs, beside = {}, set()
        for i in normal:
            name = names[i]
            beside.update(zip(name, name[1:], strict=False))
            for k in range(1, len(name)):
                left, right = symbol(name[:k]), symbol(name[k:])
                if left is not None and right is not None:
                    pairs[left << int(_SHIFT) | right] = (levels[sp.get_score(i)], i)
        if any(b == SPACE != a for a, b in beside):
            raise ValueError("a piece has ▁ after another character: words can't be cut there")
        keys = np.array([*sorted(pairs), np.iinfo(np.int64).max], np.int64)
        self.keys, values = keys, np.array([*(pairs[k] for k in keys[:-1].tolist()), (int(NONE), 0)], np.int64)
        self.ranks, self.merged = values[:, 0], values[:, 1]
        self.beside = beside
        self.joints = np.array(sorted(ord(a) << int(_SHIFT) | ord(b) for a, b in beside), np.int64)
        self.chars = np.arange(self.n, self.n + 0x110000, dtype=np.int64)
        for name, i in of.items():
            if len(name) == 1:
                self.chars[ord(name)] = i
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        spelled = [names[i].replace(SPACE, " ").encode() for i in range(self.n)]
        for i in range(self.n):
            if sp.is_byte(i):
                spelled[i] = bytes([int(names[i][1:-1], 16)])
            elif sp.is_control(i):
                spelled[i] = b""
            elif sp.is_unknown(i):
                spelled[i] = " ⁇ ".encode()
        self.leading = np.zeros(self.n, bool)
        self.leading[[i for i in normal if names[i].startswith(SPACE)]] = True
        self.control = np.array([sp.is_control(i) for i in range(self.n)])
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.words: dict[str, bytes] = {}
        self.held = 0

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no piece) and merged symbol of pairs of symbols."""
        key = left << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.merged[at]

    def joined(self, chars: np.ndarray) -> np.ndarray:
        """Whether each character can be merged with the one before it."""
        key = chars[:-1] << _SHIFT | chars[1:]
        at = np.minimum(np.searchsorted(self.joints, key), len(self.joints) - 1)
        return np.concatenate([[False], self.joints[at] == key])


@functools.cache
def vocabulary(model: str = MODEL) -> Vocabulary:
    return Vocabulary(model)


def _chosen(v: Vocabulary, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, merged: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places whose pair is merged this round: occurrences of the segment's smallest rank from the left, the last one that a better pair follows included."""
    at = np.flatnonzero((rank == least) & (rank < NONE))
    run = np.flatnonzero(np.append(True, np.diff(at) != 1))  # pairs that overlap: every other one
    at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
    new = merged[at]
    after_other = np.append(False, np.diff(at) == 2) & np.append(False, seg[at[1:]] == seg[at[:-1]])
    left = np.where(after_other, np.roll(new, 1), sym[at - 1])
    has_left = (at > 0) & (seg[at - 1] == seg[at])
    beyond = np.minimum(at + 2, len(sym) - 1)
    has_right = (at + 2 < len(sym)) & (seg[beyond] == seg[at])
    follows = (has_left & (v.pair(left, new)[0] <= rank[at])) | (has_right & (v.pair(new, sym[beyond])[0] <= rank[at]))
    before = np.cumsum(follows) - follows
    first = np.flatnonzero(np.append(True, seg[at[1:]] != seg[at[:-1]]))
    return at[before == np.repeat(before[first], np.diff(np.append(first, len(at))))]


def merge_rounds(v: Vocabulary, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges, and their segments; both in the order of the segments."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        same = np.append(seg[1:] == seg[:-1], False)
        rank, merged = v.pair(sym, np.append(sym[1:], 0))
        rank[~same] = NONE
        starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        sizes = np.diff(np.append(starts, len(sym)))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        at = _chosen(v, sym, seg, rank, merged, least) if (least < NONE).any() else np.zeros(0, np.int64)
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        ended = keep & (least == NONE)
        done.append((seg[ended], sym[ended]))
        keep &= least < NONE
        sym, seg = sym[keep], seg[keep]
    seg, sym = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(seg, kind="stable")
    return sym[order], seg[order]


def merge_by_heap(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """The same for one segment: best rank first, of equal ranks the leftmost."""
    n = len(sym)
    own, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def ranked(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            r, m = v.pair(np.array([a], np.int64), np.array([b], np.int64))
            known[a, b] = (int(r[0]), int(m[0]))
        return known[a, b]

    heap = []

    def offer(k: int) -> None:
        if 0 <= k < n and after[k] < n and (r := ranked(own[k], own[after[k]])[0]) < NONE:
            heapq.heappush(heap, (r, k, own[k], own[after[k]]))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        if own[k] != a or after[k] >= n or own[after[k]] != b:
            continue
        own[k], gone = ranked(a, b)[1], after[k]
        own[gone], after[k] = -1, after[gone]
        if after[k] < n:
            before[after[k]] = k
        offer(k)
        offer(before[k])
    return np.array([x for x in own if x >= 0], np.int64)


def encode_words(v: Vocabulary, words: list[str]) -> list[bytes]:
    """The ids of each word, as little-endian 32-bit integers."""
    if not words:
        return []
    chars = _code_points("".join(words))
    size = np.array([len(w) for w in words], np.int64)
    new = ~v.joined(chars)
    new[np.cumsum(size)[:-1]] = True
    first = np.flatnonzero(new)
    seg = np.cumsum(new) - 1
    word = np.repeat(np.arange(len(words)), size)[first]
    sym = v.chars[chars]
    long = np.flatnonzero(np.diff(np.append(first, len(sym))) > LONG)
    apart = np.isin(seg, long)
    out, at = merge_rounds(v, sym[~apart], seg[~apart])
    if len(long):
        more = [merge_by_heap(v, sym[first[k] : first[k + 1] if k + 1 < len(first) else None]) for k in long.tolist()]
        out, at = np.concatenate([out, *more]), np.concatenate([at, np.repeat(long, [len(x) for x in more])])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    at = word[at]
    unknown = out >= v.n
    if unknown.any():  # no piece: the bytes of the character
        spelled = {c: chr(c - v.n).encode() for c in np.unique(out[unknown]).tolist()}
        n_bytes = np.ones(len(out), np.int64)
        n_bytes[unknown] = [len(spelled[c]) for c in out[unknown].tolist()]
        bytes_of = np.frombuffer(b"".join([spelled[c] for c in out[unknown].tolist()]), np.uint8)
        places = np.repeat(unknown, n_bytes)
        out, at = np.repeat(out, n_bytes), np.repeat(at, n_bytes)
        out[places] = v.byte_ids[bytes_of]
    ends = np.searchsorted(at, np.arange(1, len(words) + 1)) * 4
    flat = out.astype("<i4").tobytes()
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def chunks(v: Vocabulary, text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in pieces of about this size; nothing merges across their ends."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and (text[end - 1], text[end]) in v.beside:
            end += 1
        yield text[start:end]
        start = end


def _look_up(v: Vocabulary, parts: list[str]) -> list[bytes]:
    """The ids of parts of texts; the words among them that the worker doesn't remember are merged together."""
    words = [_WORD.findall(p) for p in parts]
    if v.held > HELD:
        v.words.clear()
        v.held = 0
    unseen = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in v.words]
    v.words.update(zip(unseen, encode_words(v, unseen), strict=True))
    v.held += sum(map(len, unseen))
    return [b"".join(map(v.words.__getitem__, x)) for x in words]


def encode_texts(v: Vocabulary, texts: Iterable[str]) -> list[np.ndarray]:
    """The ids of each text."""
    out: list[list[bytes]] = []
    parts, of, size = [], [], 0

    def flush() -> None:
        for k, ids in zip(of, _look_up(v, parts), strict=True):
            out[k].append(ids)
        parts.clear()
        of.clear()

    for k, text in enumerate(texts):
        out.append([])
        for part in chunks(v, SPACE + text.replace(" ", SPACE) if text else ""):
            parts.append(part)
            of.append(k)
            size += len(part)
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    return [np.frombuffer(b"".join(x), "<i4") for x in out]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids: pieces with ▁ as spaces, the first one without its leading space; bytes that make no character become U+FFFD each."""
    ids = np.asarray(ids, np.int64)
    sizes, starts = v.sizes[ids], v.starts[ids].copy()
    shown = np.flatnonzero(~v.control[ids])
    if len(shown) and v.leading[ids[shown[0]]]:
        sizes[shown[0]] -= 1
        starts[shown[0]] += 1
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    raw = v.blob[place].tobytes()
    cuts = [0, *ends[v.control[ids]].tolist(), len(raw)]  # bytes on both sides of a control id make no character together
    return "".join(_lenient(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�" * (e.end - e.start)]
            at += e.end
    return "".join(out)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            ids = encode_texts(v, (t.as_py() for t in batch["text"]))
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.record_batch([batch["doc_id"], pa.ListArray.from_arrays(pa.array(at), flat)], names=["doc_id", "ids"])

    return slim(docs).mapInArrow(f, "doc_id long, ids array<int>")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def decoded(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows doc_id, ids."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array([decode(v, x) for x in _lists(batch["ids"])], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(f, "doc_id long, text string")


def pieces_digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The contract's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        name = list(map(str, range(v.n)))
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            rows = [(len(x), sha(",".join([name[i] for i in x.tolist()])), sha(decode(v, x))) for x in _lists(batch["ids"])]
            yield pa.record_batch([batch["doc_id"], *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(docs, model).mapInArrow(f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
