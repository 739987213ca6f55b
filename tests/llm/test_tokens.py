import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from roadcut.llm import _tokens, chunk_bpe, dac_store


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(_tokens.vocabulary())


def test_chunk_reuse(docs, rows, none, library):
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = chunk_bpe.encode_decode(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert chunk_bpe.encode_decode(none).count() == 0
    kept = chunk_bpe.encode_decode(docs, keep=True).collect()
    assert {(r.doc_id, r.decoded) for r in kept} == {(k, t or "") for k, t in rows}


def test_chunk_joins_agree(library):
    rng = random.Random(5)
    reuse = chunk_bpe.Reuse(_tokens.vocabulary())
    alphabet = ["a", "b", " ", "  ", "\n", "é", "漢", "'s", "1", "<|endoftext|>", "\t", " ", "the ", "!", "?!"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    for _ in range(2):
        got = reuse.encode(data, off)
        for t, g in zip(texts, got):
            assert np.frombuffer(g, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert reuse.hits >= reuse.misses > 0


def test_words_agree(library):
    """The memo's faster merger gives the library's ids."""
    rng = random.Random(9)
    e = _tokens.Encoder(_tokens.vocabulary(), most=50)
    assert e.merger is not None
    marks = list("aeiouthnrsLMÄéßñ0179.,;:!?'\"()-%&*#$|<>=/_+@~ ") + ["'s", "'LL", "don't", "<|", "endoftext", "|>", "日", "\n"]
    for _ in range(20):
        texts = [" ".join("".join(rng.choice(marks) for _ in range(rng.randint(1, 12))) for _ in range(60)) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_codes_round_trip():
    rng = np.random.default_rng(6)
    for v in (np.zeros(0), np.array([0]), rng.integers(0, 2**32, 3000), rng.integers(0, 50257, 5000), np.full(700, 255), np.full(700, 256)):
        c = dac_store.Codes.from_bytes(dac_store.Codes.of(v.astype(np.uint32)).to_bytes())
        at = rng.permutation(len(v))
        assert (c.access(at) == v[at]).all()
        for a, b in ((0, len(v)), (len(v) // 3, len(v) // 2), (len(v), len(v)), (1, min(2, len(v)))):
            assert (c.slice(min(a, b), b) == v[min(a, b) : b]).all()


def test_store(docs, rows, none, library):
    start, want = 0, []
    for k, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = dac_store.read(dac_store.write(docs)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert dac_store.read(dac_store.write(none)).count() == 0
