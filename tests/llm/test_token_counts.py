"""Prefix counts against sentencepiece, at every prefix and on whole tables."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm import token_counts
from tapewright.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


PIECES = token_counts.Pieces(MODEL, limit=500)


def counts(text):
    return np.cumsum(np.frombuffer(PIECES.steps(text), np.int8), dtype=int).tolist()


ALPHABET = st.sampled_from(list("aehlowrdtingm  \n\t.,'▁é漢字ﬁ́\x00<s>/🎉Ａ120") + ["the ", "ing", "<unk>", "   "])


@given(st.lists(ALPHABET, max_size=24).map("".join))
@settings(max_examples=300, deadline=None)
def test_every_prefix_equals_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert counts(text) == [len(library.encode(text[: i + 1])) for i in range(len(text))]


def test_long_texts_without_spaces(library):
    random.seed(3)
    for alphabet in ("ab", "漢字é", " ", "thein"):
        text = "".join(random.choice(alphabet) for _ in range(20_000))
        assert counts(text)[-1] == len(library.encode(text))


def test_whole_table_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op12_prefix_counts"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        text, mine = r["text"] or "", got[r["doc_id"]]
        n = len(library.encode(text))
        assert (mine["n_tokens"], mine["n_bytes"], mine["over_limit"]) == (n, len(text.encode()), n > 4096)


def test_questions_are_answered_from_the_table(spark, library):
    docs = spark.createDataFrame([(1, "Hello there, wide world", 7), (2, None, 7), (3, "", 7), (3, "", 7), (None, "x\ny", 7)], "doc_id long, text string, steps int")
    table = token_counts.prefix_table(docs, MODEL).cache()
    assert sorted((r["doc_id"] or 0, r["n_chars"], r["n_tokens"]) for r in table.collect()) == [(0, 3, 3), (1, 23, len(library.encode("Hello there, wide world"))), (2, 0, 0), (3, 0, 0), (3, 0, 0)]
    at = table.filter("doc_id = 1").select(*(token_counts.tokens_at("steps", F.lit(n)).alias(f"a{n}") for n in (-1, 0, 5, 99))).first()
    assert list(at) == [0, 0, len(library.encode("Hello")), len(library.encode("Hello there, wide world"))]
    cut = {r["doc_id"]: r for r in token_counts.truncated(docs.filter("doc_id < 3").drop("steps"), table, 3).collect()}
    text = "Hello there, wide world"
    best = max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= 3)
    assert (cut[1]["text"], cut[2]["n_tokens"]) == (text[:best], 0)
    assert token_counts.prefix_table(docs.limit(0), MODEL).count() == 0
