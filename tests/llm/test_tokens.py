"""BPE and token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from weftline.llm import bpe, token_file  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "\n\t", "The quick brown fox.", "<|endoftext|>hi <|startoftext|>", "<|ENDOFTEXT|>", "<|endo ftext|>", "ΣΑΣ ΟΔΟΣ.", "İstanbul ǅ ẞ", "é x y　z", "a\x1cb \x1f c",
    "it's don't I'LL we've", "'s't're", "foo%%% bar*** x!. y.", "a.b. c..", "1.5, 22", "日本語 テスト 🎉🎉 ½", "x" * 700, "a​b﻿c\x00d", "ͅa ᾼ", " ́a", "word.́ x", "각 가",
]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_encoders_equal_the_library(text):
    ids = library_ids(text)
    own = bpe.load(PATH)
    assert own.encode(text) == ids
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert own.digest(text) == (len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False))
    assert [x.tolist() for x in token_file.encoder(PATH).encode_all([text])] == [ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_encoders_equal_the_library_on_any_text(texts):
    found = [x.tolist() for x in token_file.encoder(PATH).encode_all(texts)]
    assert found == [library_ids(t) for t in texts] == [bpe.load(PATH).encode(t) for t in texts]


def test_small_caches_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "WORDS", 2)
    monkeypatch.setattr(token_file, "CACHE", 3)
    texts = ["one two three four five", "six seven one two", None, "three one eight nine ten"]
    own, enc = bpe.WordBpe(PATH), token_file.Encoder(PATH)
    for _ in range(2):
        assert [own.digest(t or "")[1] for t in texts] == [" ".join(map(str, library_ids(t))) for t in texts]
        assert [x.tolist() for x in enc.encode_all(texts)] == [library_ids(t) for t in texts]


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_codes_round_trip(values):
    ranks = np.array(values, "<u4")
    control, data = token_file.pack(ranks)
    assert len(control) == -(-len(values) // 4)
    assert token_file.unpack(control, data, len(values)).tolist() == values


SCHEMA = "doc_id long, text string, n_tokens string"  # a column that clashes with a result
ROWS = [(3, "Three words here", "x"), (1, "The first.", "x"), (None, "no id", "x"), (2, None, "x"), (2, None, "x"), (9, "long " * 5000, "x"), (4, "", None)]


def test_bpe_query(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(map(tuple, bpe.digest_documents(docs, PATH).collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((i, len(library_ids(t)), sha(" ".join(map(str, library_ids(t)))), sha(LIBRARY.decode(library_ids(t), skip_special_tokens=False))) for i, t, _ in ROWS), key=str)
    assert got == want
    full = {r["doc_id"]: r for r in bpe.encode_documents(docs, PATH).collect()}
    assert full[9]["token_ids"] == library_ids("long " * 5000) and full[2]["decoded"] == ""


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = sorted(map(tuple, token_file.token_file_roundtrip(docs, PATH).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library_ids(t), 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    empty = spark.createDataFrame([], SCHEMA)
    assert token_file.token_file_roundtrip(empty, PATH).count() == 0 == bpe.digest_documents(empty, PATH).count()


def test_ranks_follow_frequency(spark):
    docs = spark.createDataFrame([(1, "the the the cat"), (2, "cat the")], "doc_id long, text string")
    enc = token_file.encoder(PATH)
    table = token_file.rank_table(token_file.encode(docs, PATH), enc.size, enc.kind, 2)
    the, cat = library_ids("the")[0], library_ids("cat")[0]
    assert table[:3].tolist() == [the, *sorted([2, cat])]
    assert sorted(table.tolist()) == list(range(enc.size))
