"""Sharding along a Hilbert curve.

Several metadata dimensions of a row are quantised to ``bits`` bits each, the cell's place on the Hilbert curve through that grid is
the sort key, and the sorted rows are cut into runs. Cells keep their dimension's order: a category's is its rank among the values,
a size's its rank among quantiles. Neighbours on the curve are neighbours in every dimension, so a run covers a narrow range of
each, and a reader that filters on a dimension skips the files whose least and greatest value don't reach its own.

Equal texts stay together: those of equal cells follow one another in their cell, and groups whose rows differ in language or source lie
in a stretch of their own before the curve (``curve`` -1). As all shards have the same number of rows, give or take one, a cut may
fall within a group: no more groups are split than there are cuts, and those are the groups across a cut.

Defined results: a null category lies in cell 0; a null text has size 1 and crc 0, and the length cell of the empty text; rows of equal
text are ordered by doc_id, nulls first, then as the table is stored; a very long text is as any other (nothing but its size and
crc is moved); an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, ship


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells, an (n, dimensions) array of integers below 2**bits.

    The axes become the curve's transposed index by undoing, from the highest bit down, the reflection and exchange
    that each sub-cube applies, then a Gray decode; the index interleaves the bits.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for d in range(dims):
            set_ = (x[d] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    out = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << one) | ((x[d] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def text_bounds(df: DataFrame, name: str, bits: int) -> list[str]:
    """Values that cut a category's distinct values, in order, into 2**bits parts at most, of nearly equal numbers. However many there are, all of
    them are ranked, where they lie; only the bounds come to the driver."""
    shared, n = Shared(df.sparkSession, "hilbert"), 1 << bits
    values = shared.table(df.select(name).filter(F.col(name).isNotNull()).distinct(), 16)
    few = [r[0] for r in values.limit(n + 1).collect()]
    if len(few) <= n:
        return sorted(few)[1:]
    ranks, total = ranked(shared, values, [name], n)
    return sorted(r[0] for r in ranks.filter(F.col("_rank").isin([total * k // n for k in range(1, n)])).select(name).collect())


def size_bounds(df: DataFrame, name: str, bits: int) -> list[float]:
    """Quantiles that cut a number's rows into 2**bits parts at most."""
    n = 1 << bits
    return sorted(set(df.approxQuantile(name, [k / n for k in range(1, n)], 1 / (8 * n))))


def cell(c: Column, bounds: list, bits: int) -> Column:
    """How many bounds a value reaches, spread over 2**bits cells; 0 for null."""
    step = (1 << bits) // (len(bounds) + 1)
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= c)) * max(1, step), F.lit(0)).cast("int")


def with_curve(df: DataFrame, dims: list[Column], bits: int, name: str = "curve") -> DataFrame:
    """df with the Hilbert index of the given columns, integers below 2**bits each."""
    @F.arrow_udf("bigint")
    def index(*cells: pa.Array) -> pa.Array:
        return pa.array(hilbert_index(np.stack([c.to_numpy(zero_copy_only=False) for c in cells], axis=1), bits))

    ship(df.sparkSession)
    return df.withColumn(name, index(*dims))


def ranked(shared: Shared, df: DataFrame, order: list[str], least_parts: int) -> tuple[DataFrame, int]:
    """df with each row's _rank in the order, from 0, and the number of rows.

    Rows are range-partitioned on the whole order, so that a cell with a third of all rows is still dealt over many
    tasks; the sorted partitions are written once, and their sizes, a row each, tell where each begins.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least_parts)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = shared.table(ranged)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # a row for each partition, so that neither the plan nor the driver grows with their number
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = shared.table(sizes.withColumn("_before", F.coalesce(before, F.lit(0))), 16)
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    ranged = ranged.withColumn("_part", part).join(F.broadcast(sizes.select("_part", "_before")), "_part")  # no more rows than the session has shuffle partitions
    return ranged.withColumn("_rank", F.col("_before") + row).drop("_at", "_part", "_before"), total


def shards(df: DataFrame, order: list[str], n_shards: int) -> DataFrame:
    """df with shard and slot: runs of the order whose row counts differ by one at most."""
    ranks, total = ranked(Shared(df.sparkSession, "hilbert"), df, order, n_shards)
    small, larger = divmod(total, n_shards)  # the first ``larger`` shards have one row more
    edge = larger * (small + 1)
    rank = F.col("_rank")
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(larger + F.floor((rank - edge) / max(small, 1)))
    start = F.least(F.col("shard"), F.lit(larger)) + F.col("shard") * small
    return ranks.withColumn("shard", shard.cast("int")).withColumn("slot", (rank - start).cast("bigint")).drop("_rank")


def shard_documents(docs: DataFrame, n_shards: int = 16, bits: int = 5) -> DataFrame:
    """Documents in shards along the curve through language, source and length, with the three cells."""
    shared = Shared(docs.sparkSession, "hilbert")
    text = F.col("text")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
    )
    narrow = shared.table(narrow, 4)
    cells = [cell(F.col(c), text_bounds(narrow, c, bits), bits) for c in ("_lang", "_source")] + [cell(F.col("size").cast("double"), size_bounds(narrow, "size", bits), bits)]
    rows = narrow.select("doc_id", "size", "text_crc32", *[c.alias(n) for c, n in zip(cells, CELLS, strict=True)], F.monotonically_increasing_id().alias("_row"))
    text_key = ["text_crc32", "size"]
    # written before the join, so that a hot text's rows can be split over tasks
    place = F.struct(*CELLS)
    mixed = rows.groupBy(*text_key).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo != hi").select(*text_key, F.lit(True).alias("_mixed"))
    mixed = shared.table(mixed, 16)
    rows = with_curve(rows.join(mixed.hint("merge"), text_key, "left"), [F.col(n) for n in CELLS], bits)
    rows = rows.withColumn("curve", F.when(F.col("_mixed"), F.lit(-1)).otherwise(F.col("curve")).cast("bigint"))
    out = shards(rows, ["curve", *text_key, "doc_id", "_row"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *CELLS)


CELLS = ["lang_cell", "source_cell", "length_cell"]
