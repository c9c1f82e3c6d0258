import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapewright.llm.bpe import Merges, encode_decode
from tapewright.llm.pretokens import PartCache, as_bytes
from tapewright.llm.token_files import SELECTORS, pack, read_token_files, token_files, unpack, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def encoded(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def of_library(text):
    ids = encoded(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_codes_equal_the_library(spark, messy, messy_rows, empty, small):
    got = [tuple(r) for r in encode_decode(messy, PATH).collect()]
    assert sorted(got, key=str) == sorted(((d, *of_library(t)) for d, t in messy_rows), key=str)
    assert encode_decode(empty, PATH).collect() == []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(tuple(r) for r in encode_decode(docs, PATH).collect()) == sorted((r.doc_id, *of_library(r.text)) for r in docs.collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_rounds_equal_the_library(texts):
    from tapewright.llm.bpe import codec

    _, cache = codec(PATH)
    assert [np.frombuffer(x, np.uint32).tolist() for x in cache.encode_batch(texts)] == [encoded(t) for t in texts]


def test_a_long_word_merges_alike():
    merges = Merges(PATH)
    for word in ("ab" * 3000, "a" * 4097, "".join(chr(97 + i * i % 26) for i in range(5000))):
        assert merges.merge_words([word.encode()]) == [encoded(word)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_256) | st.integers(0, 3), max_size=400))
def test_packed_ids_come_back(ids):
    x = np.array(ids, np.uint64)
    words, escapes = pack(x)
    assert unpack(words, escapes, len(x)).tolist() == ids


def test_words_are_full():
    assert [len(pack(np.zeros(n, np.uint64))[0]) for n in (0, 1, 60, 61, 600)] == [0, 1, 1, 2, 10]
    assert len(pack(np.full(400, 2**15 - 1, np.uint64))[0]) == 100
    assert all(count * bits <= 60 for count, bits in SELECTORS)


def of_files(rows):
    """Brute force over rows in file order; null ids first, equal ids by their results."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*encoded(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_come_back(spark, messy, messy_rows, empty, small):
    got = by_id([tuple(r) for r in token_files(messy, PATH).collect()])
    assert sorted([(r[0], *r[2:]) for r in got], key=str) == sorted([(r[0], *r[2:]) for r in of_files(messy_rows)], key=str)
    at = 0
    for r in sorted(got, key=lambda r: r[1]):  # gapless, ascending, nulls first
        assert r[1] == at
        at += r[2]
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert token_files(empty, PATH).collect() == []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r) for r in token_files(docs, PATH).collect()) == sorted(of_files(rows))


def test_ids_can_be_read(spark, messy, tmp_path):
    write_token_files(messy, PATH, str(tmp_path / "files"), 2, shards=3)
    rows = read_token_files(spark, str(tmp_path / "files")).filter("doc_id = 13").collect()
    assert [list(r.ids) for r in rows] == [[*encoded("<|endoftext|> special <|endoftext|>x"), 2]]


def test_texts_with_nul_are_not_cut():
    ids = lambda text: as_bytes(list(text.encode()))
    cache = PartCache(lambda parts: list(map(ids, parts)), ids)
    for text in ("ab \0cd", "\0cd", "ab cd"):
        assert cache.encode_batch([text]) == [ids(text)]
