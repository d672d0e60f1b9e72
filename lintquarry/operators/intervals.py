"""Closed line intervals: coalescing and context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesced(df: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """The least set of intervals with the same lines for each key: those that overlap or touch become one; such that begin
    before line 1 or end before they begin are dropped."""
    valid = df.filter((F.col(start) > 0) & (F.col(end) >= F.col(start)))
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    islands = valid.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def as_points(df: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """The intervals of each key as one array ``points``, in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("points"))


def context_windows(points: DataFrame, keys: list[str], context: int, total: str = "total") -> DataFrame:
    """Segments of the lines around each point: keys, s, e, gap (lines left out since the segment before; 0 for the first).

    points: keys, s, e and the file's number of lines.
    """
    context = max(0, min(500, context))
    around = points.select(*keys, F.greatest(F.lit(1), F.col("s") - context).alias("s"), F.least(F.col(total), F.col("e") + context).alias("e"))
    merged = coalesced(around, keys)
    before = F.lag("e").over(Window.partitionBy(*keys).orderBy("s"))
    return merged.withColumn("gap", F.coalesce(F.col("s") - before - 1, F.lit(0)))


def context_lines(segments: DataFrame, points: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """The numbered lines of the segments, each with the marker that its point gives it: single, start, end or null, and the gap
    before a segment's first line.

    segments: context_windows(); points: the same points; lines: keys, line_no, line.
    """
    numbers = segments.select(*keys, F.col("s").alias("_from"), "gap", F.explode(F.sequence("s", "e")).alias("line_no"))
    out = numbers.join(lines, [*keys, "line_no"], "left")
    # a sweep: each point, in order, has the lines that none before it has, so that lines and points meet once in the order of lines
    p = points.select(*keys, "s", "e").distinct()
    reach = F.max("e").over(Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    own = p.withColumn("_at", F.greatest(F.col("s"), F.coalesce(reach, F.lit(0)) + 1)).filter(F.col("_at") <= F.col("e"))
    both = out.withColumns({"_at": F.col("line_no"), "_point": F.lit(None).cast("struct<s:int,e:int>"), "_is_line": F.lit(1)})
    both = both.unionByName(own.select(*keys, "_at", F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")).alias("_point"), F.lit(0).alias("_is_line")), allowMissingColumns=True)
    last = F.last("_point", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at", "_is_line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("p", last).filter("_is_line = 1").withColumn("p", F.when(F.col("p.e") >= F.col("line_no"), F.col("p"))).drop("_at", "_point", "_is_line")
    marker = F.when(F.col("p.s") == F.col("p.e"), "single").when(F.col("line_no") == F.col("p.s"), "start").when(F.col("line_no") == F.col("p.e"), "end")
    gap = F.when(F.col("line_no") == F.col("_from"), F.col("gap")).otherwise(0)
    return out.select(*keys, "line_no", "line", F.col("p").isNotNull().alias("issue_line"), marker.alias("marker"), gap.alias("gap_before"))
