"""Benchmark decontamination by pigeonhole edit matching.

Texts are sequences of words (lower-cased runs of letters, digits and marks; single characters in scripts without spaces). An item of m words may lie in a document with up to e =
m / 5 edits of words, rounded down; cut into e + 1 pieces, one piece at least must then lie there unchanged. The pieces'
hashes are looked up at every word of every document, and around each hit Myers' bit-parallel algorithm computes the item's
least distance to any part of the document, which decides.

Items come to the driver in blocks of bounded size; one block at a time is broadcast and searched for in all documents. Where there
are several, the result of each is written to the shared folder before the next is sent, so that a benchmark of any size
works and what is broadcast doesn't grow with it.

Defined results: null and empty documents hold nothing; an item without words, or null, is not searched for; items of fewer than
five words have no allowance and must occur exactly; equal items are reported each; an empty benchmark or document table
gives no rows; rows of a repeated or null doc_id are searched each for itself; very long texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import infix, masks
from .common import Shared, kept, ship, span_hashes, words_of


@dataclass(frozen=True)
class Params:
    edits: float = 0.2
    #: Items of fewer words are not searched for.
    least_words: int = 1
    #: Characters of item texts in one broadcast block.
    block_chars: int = 16_000_000


class Index:
    """The pieces of a block of items, and the search for them."""

    def __init__(self, words: list[np.ndarray], p: Params):
        self.p = p
        self.items = words
        self.budget = [int(p.edits * len(w) + 1e-9) for w in words]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item, w in enumerate(words):
            if len(w) < max(1, p.least_words):
                continue
            cut = np.linspace(0, len(w), self.budget[item] + 2).astype(int)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                h = int(span_hashes(w, np.array([a]), np.array([b]))[0])
                pieces.setdefault(int(b - a), []).append((h, item, int(a)))
        self.tables = []
        for n, rows in sorted(pieces.items()):
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            bits = np.zeros(1 << 22, bool)
            bits[(h >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((n, h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), bits))
        self.masks: dict[int, dict] = {}

    def hits(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(document, item, word of the document where the item would begin) of each piece found in documents c[start:end]."""
        for n, h, item, offset, bits in self.tables:
            if len(c) < n:
                continue
            at = np.arange(len(c) - n + 1)
            got = span_hashes(c, at, at + n)
            at = at[bits[(got >> np.uint64(42)).astype(np.int64)]]
            got = got[at]
            lo, hi = np.searchsorted(h, got), np.searchsorted(h, got, "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[np.minimum(doc, len(ends) - 1)]
            for a, d, x, y in zip(at[inside].tolist(), doc[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), strict=True):
                for k in range(x, y):
                    yield d, int(item[k]), a - int(offset[k]) - int(starts[d])

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its (item, distance, end word), items in order; of several places of an item the nearest, then first."""
        docs = words_of(texts)
        sizes = np.array([len(w) for w in docs], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        found: dict[tuple[int, int], set[int]] = {}
        c = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        for d, item, begin in self.hits(c, starts, ends):
            found.setdefault((d, item), set()).add(begin)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (d, item), begins in sorted(found.items()):
            best = self.verified(docs[d], item, sorted(begins))
            if best:
                out[d].append((item, *best))
        return out

    def verified(self, doc: np.ndarray, item: int, begins: list[int]) -> tuple[int, int] | None:
        """The least (distance, end) of the item in the windows around the places where it may begin."""
        m, e = len(self.items[item]), self.budget[item]
        if item not in self.masks:
            if len(self.masks) > 4096:
                self.masks.clear()
            self.masks[item] = masks(self.items[item].tolist())
        windows: list[list[int]] = []
        for b in begins:
            lo, hi = max(0, b - e), min(len(doc), b + m + e)
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = max(hi, windows[-1][1])
            else:
                windows.append([lo, hi])
        best = None
        for lo, hi in windows:
            scores = infix(self.masks[item], m, doc[lo:hi].tolist())
            k = min(range(len(scores)), key=scores.__getitem__)
            if scores[k] <= e and (best is None or scores[k] < best[0]):
                best = scores[k], lo + k + 1
        return best


def _blocks(benchmark: DataFrame, p: Params):
    """The items (id, text) in blocks of bounded size, read a partition at a time."""
    block, size = [], 0
    for i, text in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        if block and size + len(text) > p.block_chars:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    if block:
        yield block


def _searcher(sent, key: str, p: Params):
    @F.arrow_udf("array<struct<item_id:bigint,distance:int,end_word:int>>")
    def search(texts: pa.Array) -> pa.Array:
        index, ids = kept("decontam", (key, p), lambda: Index(sent.value[1], p)), sent.value[0]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end_word", pa.int32())]))
        rows = []
        for k in range(0, len(texts), 128):
            for found in index.search(texts[k : k + 128].to_pylist()):
                rows.append([{"item_id": ids[i], "distance": d, "end_word": e} for i, d, e in found])
        return pa.array(rows, kind)

    return search


def _by_block(docs: DataFrame, benchmark: DataFrame, p: Params, step):
    """What step(found) gives for each block, where found is the column of a block's matches in text: an array of (item_id, distance,
    end_word). Of several blocks each step's result is written before the next block is sent."""
    spark = docs.sparkSession
    ship(spark)
    blocks, shared = _blocks(benchmark, p), None
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        sent = spark.sparkContext.broadcast(([i for i, _ in block], words_of([t for _, t in block])))
        out = step(_searcher(sent, hashlib.md5(repr(block).encode()).hexdigest(), p)("text"))
        if following is not None or shared is not None:
            shared = shared or Shared(spark, "decontam")
            out = shared.table(out)
            sent.destroy()
        yield out
        block = following


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, distance, end_word: each item that lies in a document within its edit budget."""
    found = list(_by_block(docs, benchmark, p, lambda c: docs.select("doc_id", F.explode(c).alias("m")).select("doc_id", "m.*")))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, distance int, end_word int")
    return reduce(DataFrame.unionByName, found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that hold no item, with their columns."""
    out = docs

    def clean(c):
        return out.withColumn("__lintquarry_leaks", F.size(c)).filter("__lintquarry_leaks = 0").drop("__lintquarry_leaks")

    for out in _by_block(docs, benchmark, p, clean):  # noqa: B007  each block is searched for in what the one before left
        pass
    return out
