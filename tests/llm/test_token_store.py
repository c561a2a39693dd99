import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import token_store
from brindle.llm.queries import tokenizer_path

TEXTS = [
    "The quick brown fox. It jumps!",
    "á ́b  x\ty\x1cz\x85w  q İI ΑΣ Σ",
    "<|endoftext|>a b<|startoftext|> don't it's 'll ’ve",
    "",
    None,
    "\n\n \t",
    "ﬁ ½ 12345 è́  x Été*** naïve, Ünï-code (see) A.B.C. x'",
    "word " * 5000,
    "가 ᆨ 각 日本語",
]

CACHE = token_store.PieceCache(tokenizer_path())


def brute(rows):
    tok = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(spark, tmp_path, rows, **kw):
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, start int")
    token_store.write_tokens(df, str(tmp_path), tokenizer_path(), end_id=2, **kw)
    return [tuple(r) for r in token_store.read_tokens(spark, str(tmp_path)).orderBy("start").collect()]


@pytest.mark.parametrize("bits", [False, True])
def test_round_trip(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(token_store, "BLOCK", 700)
    rows = [(k * 3, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (6, "again"), (6, "again")]
    random.Random(1).shuffle(rows)
    assert stored(spark, tmp_path, rows, bits=bits) == brute(rows)
    tok = Tokenizer.from_file(tokenizer_path())
    want = [i for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")) for i in [*tok.encode(text or "", add_special_tokens=False).ids, 2]]
    assert [i for r in token_store.read_ids(spark, str(tmp_path)).orderBy("start").collect() for i in r.ids] == want
    index = spark.read.parquet(f"{tmp_path}/index").orderBy("start").collect()
    assert index[0].start == 0 and all(a.start + a.n_ids == b.start for a, b in zip(index, index[1:]))
    assert all(len(r.plane_bytes) == (32 if bits else 4) for r in index)


def test_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    token_store.write_tokens(docs, str(tmp_path), tokenizer_path(), end_id=2)
    got = [tuple(r) for r in token_store.read_tokens(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark, tmp_path):
    assert stored(spark, tmp_path, []) == []


def pieces(cache, texts):
    out = []
    for ids, counts in cache.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 5)
    monkeypatch.setattr(token_store, "TOGETHER", 40)
    cache = token_store.PieceCache(tokenizer_path())
    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["a b c d", "e f g a", "", " ".join(f"w{k}x" for k in range(40))] * 2
    assert pieces(cache, texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBcZ09.,'<|>*-_ \n\t\x1c\x85\xa0éÀÿß×÷Œİıſ\u0301\u2028日ﬁ½Σ😀") | st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=5))
def test_pieces_match_the_tokenizer(texts):
    got = pieces(CACHE, texts)
    assert got == [CACHE.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_planes_and_checksums():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        for bits in (False, True):
            assert token_store.from_planes(token_store.to_planes(ids, bits), n).tolist() == ids.tolist()
    a, b = rng.bytes(1000), rng.bytes(77)
    assert token_store.crc32_join(zlib.crc32(a), zlib.crc32(b), 77) == zlib.crc32(a + b)


def thue_morse(n):
    """Two different words of ``n`` letters with equal polynomial hashes modulo 2**64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_hashes_keep_their_own_ids():
    cache = token_store.PieceCache(tokenizer_path())
    texts = [*thue_morse(1024), *thue_morse(4096), *thue_morse(64), "c " + thue_morse(1024)[1]]
    for _ in range(2):
        assert pieces(cache, texts) == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_compared_and_not_only_hashed(monkeypatch):
    """With one hash for all pieces, and with one for those of one size."""
    for hashed in (lambda starts, ends: np.zeros(len(starts), np.uint64), lambda starts, ends: (ends - starts).astype(np.uint64)):
        monkeypatch.setattr(token_store, "span_hash", lambda sums, down, starts, ends: hashed(starts, ends))
        cache = token_store.PieceCache(tokenizer_path())
        texts = ["some words of texts", "other longer wordings with extraordinarily longish words", "some words again 12 3", "", "extraordinarylike"]
        for _ in range(2):
            assert pieces(cache, texts) == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_rows_of_one_id(spark, tmp_path):
    rows = [(None, f"{chr(97 + k % 26)} text {k}") for k in range(200)] + [(7, "same")] * 20
    assert stored(spark, tmp_path, rows) == brute(rows)
