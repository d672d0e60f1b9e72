from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintquarry.llm import hilbert, tiff, token_counts

from .edge import documents, edge_rows

MODEL = P.path("word_bpe_49k.json")
COUNTER = token_counts.WordCounter(open(MODEL, encoding="utf-8").read())


def library(texts):
    return [len(x) for x in COUNTER.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_counts_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert COUNTER.count([text]) == library([text])


def test_special_strings_and_odd_letters():
    texts = ["<|endoftext|> hi <|startoftext|><|endoftext|>", "ΣΑΣ ΟΔΟΣ", "İ ẞ ǅ", "a\x1cb\x85c᠎d", "it's we'll ''s", "½ ² 123", None, ""]
    assert COUNTER.count(texts) == library(texts)


def test_characters_of_other_unicode_versions():
    strange, rng = token_counts.strange_characters(), random.Random(4)
    texts = ["".join(rng.choice([c, "a", "¨", " ", "1", "'s", "é"]) for _ in range(20)) for c in strange[::97]]
    assert COUNTER.count(texts) == library(texts)


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 2)
    texts = ["zzyzx qwrtp plmok nbvcx", "qwrtp zzyzx zzyzx"] * 3
    assert COUNTER.count(texts) == library(texts)


def test_the_table_holds_the_frequent_pretokens_of_every_partition(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "Unbelievably", "naïveté", "x1", "qzxv"], [9, 7, 5, 3, 1], k=50)) for _ in range(200)] + [None, ""]
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(5)
    model = open(MODEL, encoding="utf-8").read()
    total = Counter(w for t in texts for w in COUNTER.pretokens(t or ""))
    want = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))]
    for n in (3, 100):
        assert token_counts.frequent_words(docs, model, token_counts.Params(frequent=n)) == want[:n]
    assert max(COUNTER.lengths(want)) > 1
    few = token_counts.Params(frequent=3, sample_docs=40)
    assert [r.n_tokens for r in token_counts.count_tokens(docs, MODEL, p=few).orderBy("doc_id").collect()] == library(texts)


def test_count_operator_on_edge_cases(spark):
    rows = edge_rows()
    got = token_counts.count_tokens(documents(spark, rows), MODEL).collect()
    n = library([t for _, t, _ in rows])
    want = [(i, len((t or "").encode()), k, k > 2048) for (i, t, _), k in zip(rows, n, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(documents(spark, []), MODEL).collect() == []


# ---------------------------------------------------------------- TIFF

KINDS = [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS]


@pytest.mark.parametrize("compression", KINDS)
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 256, (37, 45), np.uint8), np.zeros((5, 70, 3), np.uint8), np.repeat(rng.integers(0, 9, (80, 64, 1), np.uint8), 2, axis=2)]
    data = tiff.encode(images, compression, predictor, rows_per_strip=7, tile=tile)
    got = list(tiff.pages(data))
    assert [p.data for p in got] == [i.tobytes() for i in images]
    assert [(p.width, p.height, p.number) for p in got] == [(45, 37, 0), (70, 5, 1), (64, 80, 2)]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_return_what_they_took(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_past_a_full_table():
    data = np.random.default_rng(3).integers(0, 256, 60_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_big_endian_and_16_bit():
    samples = np.array([[1, 2], [258, 65535]], ">u2")
    body = samples.tobytes()
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(body))]
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + b"\0\0\0\0"
    (page,) = tiff.pages(b"MM" + struct.pack(">HI", 42, 8 + len(body)) + body + ifd)
    assert np.frombuffer(page.data, np.uint16).tolist() == [1, 2, 258, 65535]


def crafted(tags, body=b""):
    """A little-endian file of one page: body at 8, then its directory."""
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in sorted(tags)) + b"\0\0\0\0"
    return b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + ifd


def hostile():
    page = lambda w, h, comp=1, body=b"x" * 40, **more: crafted([(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, comp), (273, 4, 8), (277, 3, 1), (278, 4, more.get("rows", h)), (279, 4, len(body))], body)
    tile = lambda side: crafted([(256, 4, 4), (257, 4, 4), (258, 3, 8), (259, 3, 8), (322, 4, side), (323, 4, side), (324, 4, 8), (325, 4, 40), (277, 3, 1)], b"x" * 40)
    lzw = bytes([0b10000000, 0b01000000, 0b11111111, 0xFF])  # a clear code, then one that no table has yet
    most = 2**32 - 1
    return [page(most, most), page(2**18, 2**18), page(2**18, 2**18, 8), page(8, 8, 5, lzw), tile(most), tile(0), page(4, 4, 8), page(4, 4, 99), page(8, 8, 32773, b"\x81"), page(2**13, 2**13, 5), page(4, 4, 1, rows=0)]


def test_hostile_files_fail_no_task(spark):
    good = tiff.encode([np.ones((4, 4), np.uint8)])
    files = [*hostile(), good]
    df = spark.createDataFrame(list(enumerate(files)), "file_id bigint, body binary")
    got = {r.id: r for r in tiff.decode_pages(df, "file_id", "body").collect()}
    assert len(got) == len(files) and all((r.error is None) == (i == len(files) - 1) for i, r in got.items())


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 3), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 255)), max_size=6))
def test_changed_bytes_raise_nothing_else(form, changes):
    compression, predictor, tile = tiff.FORMS[form]
    data = bytearray(tiff.encode([np.arange(300, dtype=np.uint8).reshape(10, 30)] * 2, compression, predictor, rows_per_strip=4, tile=tile))
    for at, value in changes:
        data[at % len(data)] = value
    assert all(isinstance(p, (tiff.Page, tiff.TiffError)) for _, p in tiff.walk(bytes(data), 1 << 20))


def test_one_bad_page_leaves_the_others():
    images = [np.full((6, 6), k, np.uint8) for k in range(3)]
    data = bytearray(tiff.encode(images, tiff.PLAIN, 1))
    at = data.rindex(bytes([1] * 36))  # of the second page: its strip's count, after the samples, becomes too large for the file
    second = data.index(struct.pack("<HHII", 279, 4, 1, 36), at)
    struct.pack_into("<HHII", data, second, 256, 4, 1, 4000)
    got = list(tiff.walk(bytes(data)))
    assert [n for n, _ in got] == [0, 1, 2] and [isinstance(p, tiff.TiffError) for _, p in got] == [False, True, False]


@pytest.mark.parametrize("bits", [1, 4])
def test_samples_of_few_bits(bits):
    samples = np.random.default_rng(1).integers(0, 1 << bits, (5, 11), np.uint8)
    if bits == 1:
        body = np.packbits(samples, axis=1).tobytes()
    else:
        body = (np.pad(samples, ((0, 0), (0, 1)))[:, ::2] << 4 | np.pad(samples, ((0, 0), (0, 1)))[:, 1::2]).astype(np.uint8).tobytes()
    packed = tiff.pack_bits(body)
    (page,) = tiff.pages(crafted([(256, 4, 11), (257, 4, 5), (258, 3, bits), (259, 3, 32773), (273, 4, 8), (277, 3, 1), (278, 4, 5), (279, 4, len(packed))], packed))
    assert page.data == samples.tobytes() and page.bits == bits


def test_damaged_files_give_a_reason(spark):
    good = tiff.encode([np.ones((4, 4), np.uint8)] * 2)
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0junk"), (5, good[:40]), (6, b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 0) + struct.pack("<I", 8))]
    df = spark.createDataFrame(rows, "file_id bigint, body binary")
    got = tiff.decode_pages(df, "file_id", "body").collect()
    assert Counter(r.id for r in got) == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2}  # 6: an empty page, then a circle
    assert all((r.error is None) == (r.id == 1) for r in got)
    assert tiff.decode_pages(df.limit(0), "file_id", "body").collect() == []


def test_stored_texts_on_edge_cases(spark):
    rows = edge_rows()
    got = {}
    for r in tiff.store_texts(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    for i, t, _ in rows:
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        want = (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert want in {x[:4] for x in got[i]}
    assert got[6] == got[7]
    assert {x[-1].split(";")[1] for i in got for x in got[i]} == {str(c) for c, _, _ in tiff.FORMS}
    assert max(int(x[-1].split("x")[0]) for i in got for x in got[i]) > 5
    assert tiff.store_texts(documents(spark, [])).collect() == []


# ---------------------------------------------------------------- shards


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    at = hilbert.hilbert_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [0, 5, 100])
def test_shards_are_even_and_gapless(spark, n):
    rows = (edge_rows() * 10)[:n]
    got = hilbert.shard_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    curve = [c for _, _, c in sorted((r.shard, r.slot, r.curve) for r in got)]
    assert curve == sorted(curve)


def spread_rows(n=900):
    rng = random.Random(3)
    rows = [(i, "x" * int(10 ** rng.uniform(1, 4)) + str(i), rng.choice("abcd"), f"s{rng.randrange(20):02}") for i in range(n)]
    rows += [(n + 10 * k + j, f"copy {k} " * 30, rows[k][2], rows[k][3] if k % 2 else f"s{j:02}") for k in range(12) for j in range(5)]
    return rows + [(None, None, None, None), (n + 900, "", None, "s01")]


def test_shards_are_the_cuts_of_one_sort_and_narrow_in_each_dimension(spark):
    rows = spread_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = hilbert.shard_documents(docs).collect()
    curve = hilbert.hilbert_index(np.array([[r.lang_cell, r.source_cell, r.length_cell] for r in got]), 5)
    assert all(r.curve in (-1, c) for r, c in zip(got, curve, strict=True))
    # shard and slot again, from one sorted list
    want, at = {}, 0
    order = sorted(got, key=lambda r: (r.curve, r.text_crc32, r.size, -1 if r.doc_id is None else r.doc_id))
    for k in range(16):
        size = len(rows) // 16 + (k < len(rows) % 16)
        want |= {r.doc_id: (k, s) for s, r in enumerate(order[at : at + size])}
        at += size
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want
    # equal texts: split by a cut only
    groups, meta = {}, {i: (g, s) for i, _, g, s in rows}
    for r in got:
        groups.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert sum(len(v) > 1 for v in groups.values()) <= 15 and all(max(v) - min(v) == len(v) - 1 for v in groups.values())
    # cells are in the order of their values, and files can be skipped by least and greatest value
    assert all((a.lang_cell <= b.lang_cell) == (meta[a.doc_id][0] <= meta[b.doc_id][0]) for a in got[:60] for b in got[:60] if None not in (a.doc_id, b.doc_id))
    ranges = {}
    for r in got:
        if r.doc_id is not None and meta[r.doc_id][0] is not None:
            for d, v in enumerate((*meta[r.doc_id], r.size)):
                ranges.setdefault((d, r.shard), []).append(v)
    read = lambda d, values: sum(min(v) <= x <= max(v) for x in values for (e, _), v in ranges.items() if e == d) / len(values)
    assert read(0, "abcd") < 9 and read(1, [f"s{k:02}" for k in range(20)]) < 10 and read(2, [30, 100, 300, 1000, 3000]) < 9


def test_bounds_of_a_category_come_from_all_its_values(spark):
    values = [f"v{i * 7919 % 9001:05d}" for i in range(9001)]
    rows = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "source string").repartition(5)
    assert hilbert.text_bounds(rows, "source", 5) == [sorted(values)[9001 * k // 32] for k in range(1, 32)]
    assert hilbert.text_bounds(rows.filter("source < 'v00032'"), "source", 5) == [f"v{i:05d}" for i in range(1, 32)]
    assert len(hilbert.text_bounds(rows.filter("source < 'v00033'"), "source", 5)) == 31
    assert hilbert.text_bounds(rows.filter("source IS NULL"), "source", 5) == []
