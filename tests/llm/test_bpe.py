from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lintquarry.llm import bpe

from .edge import documents, edge_rows

PATH = P.path("byte_bpe_50k.tiktoken")
DATA = open(PATH, "rb").read()
RANKS = bpe.ranks_of(DATA)
CODEC = bpe.Codec(DATA, P.PATTERN)
LIBRARY = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_encodes_as_the_library_and_decodes_back(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text


@pytest.mark.parametrize("text", ["", " " * 4000, "=-" * 700, "x" * 3000, "'s's'S don't WE'LL", "a\x85b c"])
def test_odd_texts(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_letters_of_other_unicode_versions():
    strange = bpe.strange_letters()
    rng = random.Random(4)
    for k in range(0, len(strange), 97):
        text = "".join(rng.choice([strange[k], "a", "¨", " ", "1", "'s", "é"]) for _ in range(20))
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_neighbours_by_spines_agree_with_merging():
    rng, t = random.Random(1), CODEC.transducer
    ids = list(t.bytes_of)
    for _ in range(4000):
        a, b = rng.choice(ids[:3000]), rng.choice(ids)
        x, y = t.bytes_of[a], t.bytes_of[b]
        assert t._apart(a, b) == (bpe.merged(RANKS, x + y) == [x, y])


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STEPS", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 4)
    codec = bpe.Codec(DATA, P.PATTERN)
    for text in ("some words that fill the table " * 3, "zqxjk" * 60, "the the the"):
        assert codec.encode(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.lists(st.integers(1, 5), max_size=30))
def test_streaming_decoder_replaces_bad_bytes_as_python_does(data, cuts):
    bytes_of = {i: bytes((i,)) for i in range(256)}
    decoder, out, at = bpe.StreamingDecoder(bytes_of), "", 0
    for n in cuts:
        out += decoder.feed(list(data[at : at + n]))
        at += n
    out += decoder.feed(list(data[at:])) + decoder.end()
    assert out == data.decode("utf-8", "replace")


def test_operator_on_edge_cases(spark):
    rows = edge_rows()
    got = bpe.digest_texts(documents(spark, rows), PATH, P.PATTERN).collect()
    want = []
    for i, text, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digest_texts(documents(spark, []), PATH, P.PATTERN).collect() == []


def test_ids_and_decoded_columns(spark):
    docs = documents(spark, edge_rows()[:3]).select("doc_id", "text")
    out = bpe.decode_ids(bpe.encode_texts(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert all(r.decoded == (r.text or "") for r in out.collect())
