import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from emberline.llm import pieces

SCHEMA = "doc_id long, text string, ids string, n_tokens int"
ALPHABETS = ["a b", "abcdefgh ", "=- ", "▁ ", "\t\n ", "éèñß ", "日本語の中文 ", "\U0001f600\U00010348x ", "the in er an on ing  ", "0123456789 ", "<0x>s/ ", "\x00​　 \xa0 "]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    rng = random.Random(11)
    for _ in range(4000):
        own = "".join(rng.sample(ALPHABETS, rng.randint(1, 3)))
        yield "".join(rng.choice(own) * rng.choice([1, 1, 1, 1, 2, 3, 17]) for _ in range(rng.randint(0, 60)))
    for _ in range(2000):
        yield "".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 30)))
    yield from ["a" * 5000, " " * 3000, "=" * 4000, "ab" * 3000, "日本" * 3000, "x" * 1001 + " " * 1001 + "the" * 900, "\n" * 3000]


def test_equals_the_library(sp):
    v, every = pieces.vocabulary(), list(texts())
    for text, ids in zip(every, pieces.encode_texts(v, every), strict=True):
        want = sp.encode(text)
        assert ids.tolist() == want and pieces.decode(v, ids) == sp.decode(want), repr(text)


def test_decodes_any_ids(sp):
    rng, v = random.Random(12), pieces.vocabulary()
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(3), rng.randrange(270), rng.randrange(130, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(v, np.array(ids, np.int64)) == sp.decode(ids), ids


def test_rounds_equal_the_heap():
    v, rng = pieces.vocabulary(), random.Random(13)
    for _ in range(300):
        sym = v.chars[pieces._code_points("".join(rng.choice("abtheinr▁ =") for _ in range(rng.randint(1, 40))))]
        assert pieces.merge_rounds(v, sym.copy(), np.zeros(len(sym), np.int64))[0].tolist() == pieces.merge_by_heap(v, sym).tolist()


def test_chunks_change_nothing(sp, monkeypatch):
    text = " ".join(random.Random(14).choices(["water", "日本語の", "  x", "\n", "façade", "==="], k=3000))
    monkeypatch.setattr(pieces, "CHUNK", 100)
    monkeypatch.setattr(pieces, "HELD", 50)
    v = pieces.vocabulary()
    assert len(list(pieces.chunks(v, text, 100))) > 50
    assert [x.tolist() for x in pieces.encode_texts(v, [text, "", text[:999]])] == [sp.encode(text), [], sp.encode(text[:999])]


def test_digest_against_the_library(spark, sp):
    rows = [(1, "Some text, twice."), (1, "Some text, twice."), (2, None), (3, ""), (4, " \t  日本\x00 ☃" * 50), (5, "long word " * 60_000), (None, "left out")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want += [(i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] if i is not None else []
    assert sorted(map(tuple, pieces.pieces_digest(docs).collect())) == sorted(want)
    back = pieces.decoded(pieces.encoded(docs))
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t in rows if i is not None)
    assert pieces.pieces_digest(spark.createDataFrame([], SCHEMA)).count() == 0
