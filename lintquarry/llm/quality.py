"""Quality classifier: supervised subword embeddings.

Each word, each character n-gram and each step from a word to the next (the same again, or another) is hashed to one of
``buckets`` learned vectors; a document is the mean of its vectors and some neutral ones; a softmax layer gives the classes. Vectors and layer are trained together by stochastic gradient descent in
numpy on a sample of labelled rows whose size is a parameter (``max_rows``). The layer is linear, so a trained model also
holds each bucket's logit contribution, and scoring a text averages those instead of whole vectors: the same sums,
taken in another order.

Defined results: null and empty texts have no features and get the score of the bias alone; equal texts have equal scores;
labels that are null or not 0 or 1 are not learned from; of several labels of a document the least counts, of several texts
the least, a null one only if there is no other; without labels
of both classes every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, char_class, chunks, held_out, joined, kept, runs, ship, span_hashes


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 16
    dim: int = 8
    orders: tuple[int, ...] = (2, 3, 4)
    #: Labelled rows learned from at most, half of them of each class.
    max_rows: int = 2000
    epochs: int = 6
    rate: float = 0.5
    #: Neutral features added to each text: a short text says little either way.
    prior: int = 64
    seed: int = 7
    threshold: float = 0.3


def _ngram_buckets(c: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each character (the last n - 1 places excepted)."""
    h = np.full(len(c) - n + 1, 0x811C9DC5 + n, np.uint32)
    for k in range(n):
        h ^= c[k : len(c) - n + 1 + k]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - buckets.bit_length() + 1)


def features(texts: list[str | None], p: Params):
    """For each run of texts: the code's feature layers, each (bucket of every feature, first and end feature of every text)."""
    for first, end in chunks(texts, CHUNK_CHARS):
        c, starts, ends = joined(texts[first:end])
        layers = []
        s, e = runs(~char_class("space")[np.minimum(c, 0x10FFFF)])
        words = (span_hashes(c, s, e) >> np.uint64(64 - p.buckets.bit_length() + 1)).astype(np.int64)
        a, b = np.searchsorted(s, starts), np.searchsorted(s, ends)
        layers.append((words, a, b))
        # two more learned vectors: this word is the one before again, or it isn't
        layers.append(((words[1:] == words[:-1]).astype(np.int64), a, b - 1))
        for n in p.orders:
            if len(c) >= n:
                layers.append((_ngram_buckets(c, n, p.buckets), starts, ends - n + 1))
        yield first, end, [_bounded(*layer) for layer in layers]


def _bounded(buckets: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts too short for a feature have an empty range within the layer."""
    a = np.minimum(a, len(buckets))
    return buckets, a, np.clip(b, a, len(buckets))


#: A name that no table of documents has.
OWN = "__lintquarry_quality_score"


class Model:
    """Trained vectors and layer; scores texts."""

    def __init__(self, p: Params, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.p, self.vectors, self.layer, self.bias = p, vectors, layer, bias
        self.logits = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
        self.bias_logit = float(bias[1] - bias[0])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of class 1 of each text."""
        sums, n = np.zeros(len(texts)), np.zeros(len(texts))
        for first, end, layers in features(texts, self.p):
            for buckets, a, b in layers:
                total = np.zeros(len(buckets) + 1)
                np.cumsum(self.logits[buckets], dtype=np.float64, out=total[1:])
                sums[first:end] += total[b] - total[a]
                n[first:end] += b - a
        z = sums / (n + self.p.prior) + self.bias_logit
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def counted(texts: list[str | None], p: Params) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and how often each occurs."""
    out = []
    for first, end, layers in features(texts, p):
        for i in range(end - first):
            every = np.concatenate([b[x[i] : y[i]].astype(np.int64) for b, x, y in layers])
            k, n = np.unique(every, return_counts=True)
            out.append((k.astype(np.uint32), n.astype(np.uint32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], p: Params) -> Model:
    """Stochastic gradient descent over (buckets, counts, class) rows, one document a step."""
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    layer, bias = np.zeros((p.dim, 2), np.float32), np.zeros(2, np.float32)
    if len({c for _, _, c in rows}) == 2:
        steps, done = p.epochs * len(rows), 0
        for _ in range(p.epochs):
            for r in rng.permutation(len(rows)):
                k, n, label = rows[r]
                rate = np.float32(p.rate * (1 - done / steps))
                done += 1
                share = (n / (n.sum() + p.prior)).astype(np.float32)
                mean = share @ vectors[k]
                z = mean @ layer + bias
                z = np.exp(z - z.max())
                g = (z / z.sum()).astype(np.float32)
                g[label] -= 1
                back = layer @ g
                layer -= rate * np.outer(mean, g)
                bias -= rate * np.float32(0.1) * g
                # a mean over many features moves each of them little: features of rare share still learn at the common rate
                vectors[k] -= (rate * np.float32(20) * share)[:, None] * back
    return Model(p, vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", p: Params = Params()) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out; texts are counted on the executors."""
    ship(docs.sparkSession)
    named = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    named = named.filter(~held_out()).withColumn("_order", F.xxhash64("doc_id", F.lit(p.seed)))
    # the first of each class by a hash: two bounded top-k selections, as one class may hold nearly all rows
    first = lambda v: named.filter(F.col("_label") == v).orderBy("_order", "doc_id").limit(p.max_rows // 2)
    sample = first(0).unionByName(first(1)).select("doc_id", "_label")

    def count(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                got = counted(part.column(2).to_pylist(), p)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0].tobytes() for x in got], pa.binary()), pa.array([x[1].tobytes() for x in got], pa.binary())], ["doc_id", "label", "buckets", "counts"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("bigint"), F.col("_label").cast("int").alias("_label"), "text")
    # one row of each identifier, however often it is there: no more than max_rows come to the driver
    rows = rows.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(count, "doc_id bigint, label int, buckets binary, counts binary").collect()
    got = sorted(got, key=lambda r: hashlib.md5(str(r[0]).encode()).digest())
    return train([(np.frombuffer(r[2], np.uint32), np.frombuffer(r[3], np.uint32), r[1]) for r in got], p)


def scorer(spark, model: Model):
    """A column function text -> score."""
    ship(spark)
    sent = spark.sparkContext.broadcast((model.p, model.logits, model.bias_logit))
    key = hashlib.md5(model.logits.tobytes() + repr((model.p, model.bias_logit)).encode()).hexdigest()

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m, out = kept("quality", key, lambda: _unpacked(*sent.value)), []
        for k in range(0, len(texts), 512):
            out.append(m.score(texts[k : k + 512].to_pylist()))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return score


def _unpacked(p: Params, logits: np.ndarray, bias: float) -> Model:
    """A model for scoring alone, from what its layers add up to."""
    m = Model.__new__(Model)
    m.p, m.logits, m.bias_logit = p, logits, bias
    return m


def score_documents(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    score = scorer(docs.sparkSession, fit(docs, labels, p=p))
    out = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    score = scorer(docs.sparkSession, fit(docs, labels, p=p))
    return docs.withColumn(OWN, score("text")).filter(F.col(OWN) >= p.threshold).drop(OWN)
