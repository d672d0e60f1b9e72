"""Language identification by nearest centroids.

A text's letters, lower-cased, with one space for everything else, give counts of hashed character n-grams; the
vector (1 + ln count) x idf, of length one, is compared by cosine with several centroids of each language, found by
spherical k-means in a sample of each language whose size is a parameter. The nearest centroid names the language; a text
further from it than nearly all texts that it was made of (and a margin more) is rejected.

Defined results: of several texts of an identifier and language the least is learned from; null texts and texts without a letter are ``und``, score 0, rejected; equal texts have equal results; of
centroids equally near the first in order of language wins; languages that are null are not learned; with nothing to learn
every text is ``und``; very long texts are counted whole; an empty table gives no rows; other columns are ignored. The model holds ``clusters`` vectors a language, so the
number of languages is bounded by a parameter (``max_langs``, the most frequent ones); a text of another language gets the nearest of
those that were learned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import char_class, chunks, held_out, joined, kept, ship
from .quality import _ngram_buckets

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    dims: int = 1 << 12
    orders: tuple[int, ...] = (1, 2, 3)
    #: Rows of each language learned from at most.
    rows_per_lang: int = 400
    clusters: int = 4
    rounds: int = 12
    #: Languages learned at most: the most frequent ones.
    max_langs: int = 1000
    #: A centroid reaches as far as this share of its own texts, and a margin further.
    within: float = 0.98
    margin: float = 0.1
    #: No text nearer than this (in cosine) is rejected, however close a centroid's own texts lie.
    near: float = 0.25
    seed: int = 11


def counts(texts: list[str | None], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of each text (rows), and which texts have a letter."""
    out, has = np.zeros((len(texts), p.dims), np.float32), np.zeros(len(texts), bool)
    letter = char_class("letter")
    for first, end in chunks(texts):
        c, starts, ends = joined([t.lower() if t else "" for t in texts[first:end]])
        isl = letter[np.minimum(c, 0x10FFFF)]
        total = np.concatenate([[0], np.cumsum(isl)])
        has[first:end] = total[ends] > total[starts]
        c = np.where(isl, c, np.uint32(32))
        keep = isl.copy()
        keep[1:] |= isl[:-1]  # the first space after a word
        keep[ends] = True  # the zero after each text, as a space
        place = np.concatenate([[0], np.cumsum(keep)])
        c = c[keep]
        a, b = place[starts], place[ends + 1]
        for n in p.orders:
            if len(c) < n:
                continue
            h = _ngram_buckets(c, n, p.dims)
            for i in range(end - first):
                if has[first + i] and b[i] - n + 1 > a[i]:
                    out[first + i] += np.bincount(h[a[i] : b[i] - n + 1], minlength=p.dims)
    return out, has


class Model:
    def __init__(self, p: Params, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, reach: np.ndarray):
        self.p, self.langs, self.idf, self.centroids, self.owner, self.reach = p, langs, idf, centroids, owner, reach

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out: list[tuple[str, float, bool]] = []
        for k in range(0, len(texts), 128):
            x, has = counts(texts[k : k + 128], self.p)
            if not self.langs:
                out += [(UNKNOWN, 0.0, True)] * len(x)
                continue
            cos = weighted(x, self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            for i, j in enumerate(best):
                score = float(min(1.0, max(0.0, cos[i, j])))
                out.append((self.langs[self.owner[j]], score, bool(1 - score > self.reach[j])) if has[i] else (UNKNOWN, 0.0, True))
        return out


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as TF-IDF vectors of length one."""
    out = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def train(texts: list[np.ndarray], langs: list[str], p: Params) -> Model:
    """texts: rows of counts; langs: the language of each."""
    names = sorted(set(langs))
    if not names:
        return Model(p, [], np.ones(p.dims, np.float32), np.zeros((0, p.dims), np.float32), np.zeros(0, int), np.zeros(0))
    x, y = np.stack(texts).astype(np.float32), np.array([names.index(v) for v in langs])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    v = weighted(x, idf)
    centroids, owner, reach = [], [], []
    for k in range(len(names)):
        own = v[y == k]
        rng = np.random.default_rng(p.seed)
        mid = own[rng.permutation(len(own))[: p.clusters]].copy()
        for _ in range(p.rounds):
            near = (own @ mid.T).argmax(axis=1)
            for j in range(len(mid)):
                if (near == j).any():
                    m = own[near == j].mean(axis=0)
                    mid[j] = m / max(1e-12, np.linalg.norm(m))
        cos = own @ mid.T
        near = cos.argmax(axis=1)
        for j in range(len(mid)):
            if (near == j).any():
                centroids.append(mid[j])
                owner.append(k)
                reach.append(max(1 - p.near, 1 - float(np.quantile(cos[near == j, j], 1 - p.within)) + p.margin))
    return Model(p, names, idf, np.stack(centroids), np.array(owner), np.array(reach))


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Learn from a bounded sample of each language among the documents that are not held out."""
    ship(docs.sparkSession)
    named = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # the first identifiers of each language by a hash, found among those below a bound that leaves about four times as many: one
    # language may hold nearly all rows, and rows above the bound never leave their task. Identifiers are counted, as rows may repeat
    # them, and to within some hundredths; a language of few is taken whole
    order = F.xxhash64("doc_id", F.lit(p.seed))
    langs = named.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.approx_count_distinct("doc_id", 0.03).alias("ids")).orderBy(F.desc("count"), "lang").limit(p.max_langs).collect()
    bound = F.lit(None).cast("double")
    if langs:
        bound = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], min(1.0, 4.0 * p.rows_per_lang / r["ids"]))])[F.col("lang")]
    named = named.withColumn("_order", order).filter(F.pmod("_order", F.lit(1 << 30)) < bound * float(1 << 30))
    first = Window.partitionBy("lang").orderBy("_order", "doc_id")
    named = named.distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= p.rows_per_lang)
    sample = named.select("doc_id", F.col("lang").alias("_lang"))

    def count(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x, has = counts(part.column(1).to_pylist(), p)
                rows = [(lang, *_sparse(row)) for lang, row, h in zip(part.column(0).to_pylist(), x, has, strict=True) if h]
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "dims", "counts"])

    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id").filter(F.col("lang") == F.col("_lang"))
    rows = rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")
    got = {(r[0], r[1], r[2]) for r in rows.mapInArrow(count, "lang string, dims binary, counts binary").collect()}
    got = sorted(got, key=lambda r: (r[0], hashlib.md5(r[1] + r[2]).digest()))
    x = []
    for _, dims, n in got:
        row = np.zeros(p.dims, np.float32)
        row[np.frombuffer(dims, np.uint32)] = np.frombuffer(n, np.float32)
        x.append(row)
    return train(x, [r[0] for r in got], p)


def _sparse(row: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(row)
    return at.astype(np.uint32).tobytes(), row[at].tobytes()


def identifier(spark, model: Model):
    """A column function text -> struct(lang_pred, score, rejected)."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    key = hashlib.md5(b"".join(a.tobytes() for a in (model.centroids, model.idf, model.owner, model.reach)) + repr((model.p, model.langs)).encode()).hexdigest()

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def identify(texts: pa.Array) -> pa.Array:
        m, rows = kept("langid", key, lambda: sent.value), []
        for k in range(0, len(texts), 512):
            rows += m.predict(texts[k : k + 512].to_pylist())
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True)], ["lang_pred", "score", "rejected"])

    return identify


def identify_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and whether the text is rejected."""
    identify = identifier(docs.sparkSession, fit(docs, p))
    return docs.select("doc_id", held_out().alias("held_out"), identify("text").alias("p")).select("doc_id", "held_out", "p.*")


def keep_known(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents in a language that was learned, with their columns."""
    identify = identifier(docs.sparkSession, fit(docs, p))
    return docs.withColumn("__lintquarry_language", identify("text")).filter(~F.col("__lintquarry_language.rejected")).drop("__lintquarry_language")
