"""Lines that many documents share, found through a store of sorted runs.

A line's key is the line without blanks at its ends and with A-Z in lower case, kept as a 128-bit hash. The store holds runs of (key, documents that hold it, largest
doc_id among them), each sorted and bucketed by the key in the shared folder, in levels: a new batch's run enters at level 0, and ``fanout`` runs of a
level are merged into one of the next, so that an entry is rewritten once a level. A batch is pre-aggregated to one entry a key, which
takes the weight out of a line that stands everywhere, and merge-anti-joined with each run: keys that a run already knows as repeated, with a
holder at least as large, add nothing; the rest becomes the batch's own run. Batches and runs are bucketed alike, so the joins move no run.

After the last batch the runs are folded into the repeated keys and their keepers; documents meet those they must lose. What is joined
is (document, key) pairs, narrow and free to be split where a key is hot, and then each document with its own list.

Defined results: a row counts as a document, whatever its doc_id; all rows of the largest doc_id keep a line; null is smaller than any doc_id, so
lines that rows without doc_id alone hold are kept by all of those; a null or empty text is one empty line; lines end at ``\\n`` alone; very
long texts are split whole; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, ship


@dataclass(frozen=True)
class Params:
    #: Shorter keys, in code points, are never dropped.
    min_chars: int = 20
    #: Documents that must hold a key.
    min_docs: int = 3
    #: Batches that the documents enter the store in, from the largest doc_id down.
    batches: int = 4
    #: Runs of a level that are merged into one of the next.
    fanout: int = 2


BLANKS = " \t\n\v\f\r"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(LOWER)


def key_hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def line_keys(text: str | None, min_chars: int) -> Iterator[tuple[str, bytes | None]]:
    """Each line with its key's hash; None for keys that are too short."""
    for line in (text or "").split("\n"):
        key = line.strip(BLANKS)
        yield line, key_hash(key.translate(LOWER)) if len(key) >= min_chars else None


# ---------------------------------------------------------------- the store

ENTRY = "h1 bigint, h2 bigint, docs bigint, keeper bigint"


class LineStore:
    """Levelled sorted runs of (h1, h2, docs, keeper).

    ``add`` takes a batch's entries of one a key; ``repeated`` folds all runs. Entries of a key may stand in several runs until these are
    merged; sums and maxima over them are the same whenever they are merged, and in whatever order batches come.
    """

    def __init__(self, shared: Shared, p: Params = Params()):
        self.shared, self.p = shared, p
        self.buckets = int(shared.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0
        self.name = f"lintquarry_lines_{uuid.uuid4().hex}"

    def _path(self, name: str) -> str:
        return f"{self.shared.root}/{name}"

    def _write(self, entries: DataFrame) -> str:
        """A run: one sorted file a bucket."""
        self.made += 1
        name = f"{self.name}_{self.made}"
        run = entries.repartition(self.buckets, "h1").sortWithinPartitions("h1", "h2").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2")
        run.format("parquet").option("path", self._path(name)).option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.shared.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.shared.remove(self._path(name))

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, entries: DataFrame) -> None:
        """A batch's entries (h1, h2, docs, keeper) without those that a run has settled."""
        for name in self.runs:
            settled = self.shared.spark.table(name).filter(F.col("docs") >= self.p.min_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("keeper").alias("kept_by"))
            known = (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("keeper").isNull() | (F.col("kept_by") >= F.col("keeper")))
            entries = entries.join(settled.hint("merge"), known, "left_anti")
        self._enter(0, self._write(entries))

    def _enter(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.p.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._folded(old))
            for run in old:
                self._drop(run)
            self._enter(level + 1, merged)

    def _folded(self, names: list[str]) -> DataFrame:
        # the files themselves, as one scan: a union of bucketed tables is taken for bucketed even where its scans aren't
        runs = self.shared.spark.read.schema(ENTRY).parquet(*[self._path(n) for n in names])
        return runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def repeated(self) -> DataFrame:
        """h1, h2, keeper of the keys that enough documents hold."""
        return self._folded(self.runs).filter(F.col("docs") >= self.p.min_docs).select("h1", "h2", "keeper")

    def close(self) -> None:
        for name in self.runs:
            self._drop(name)


# ---------------------------------------------------------------- documents


def _hash_columns(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())


def pairs(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, row, h1, h2: each document's distinct keys."""

    def split(batches):
        for batch in batches:
            ids, rows, digests = [], [], []
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {h for _, h in line_keys(text, p.min_chars) if h}
                ids += [doc_id] * len(own)
                rows += [row] * len(own)
                digests += own
                if len(ids) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), *_hash_columns(digests)], ["doc_id", "row", "h1", "h2"])
                    ids, rows, digests = [], [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), *_hash_columns(digests)], ["doc_id", "row", "h1", "h2"])

    return docs.select("doc_id", "row", "text").mapInArrow(split, "doc_id bigint, row bigint, h1 bigint, h2 bigint")


def dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, text (the kept lines), n_lines and n_dropped of each document."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, "lines")
    # equal rows share their number: what a row loses depends on its doc_id and its text alone
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    bounds = docs.select(F.percentile_approx("doc_id", [k / p.batches for k in range(1, p.batches)]).alias("b")).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    batch = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        batch = F.when(F.col("doc_id") > bounds[k], k).otherwise(batch)
    held = shared.table(pairs(docs, p).withColumn("batch", batch), by="batch")
    store = LineStore(shared, p)
    for k in range(len(bounds) + 1):
        own = held.filter(F.col("batch") == k)
        store.add(own.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")))
    repeated = shared.table(store.repeated())
    store.close()
    lost = held.select("doc_id", "row", "h1", "h2").join(repeated.hint("merge"), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lists = shared.table(lost.groupBy("row", "doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost")))
    lists = lists.select(F.col("row").alias("_row"), F.col("doc_id").alias("_doc_id"), "lost")
    rows = docs.join(lists.hint("merge"), (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left").select("doc_id", "text", "lost")

    def keep(batches):
        for batch in batches:
            texts, counts, drops = [], [], []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = {_digest(x) for x in lost or ()}
                lines = list(line_keys(text, p.min_chars)) if gone else None
                kept = [line for line, h in lines if h not in gone] if gone else None
                texts.append("\n".join(kept) if gone else text or "")
                counts.append(len(lines) if gone else (text or "").count("\n") + 1)
                drops.append(len(lines) - len(kept) if gone else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(keep, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")


def _digest(h: dict) -> bytes:
    return np.array([h["h1"], h["h2"]], "<i8").tobytes()


def dedup_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    out = dedup(docs, p)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3
), marked AS (
  SELECT rid, doc_id, line, ln, repeated.key IS NOT NULL AND keyed.doc_id IS DISTINCT FROM keeper AS dropped FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
