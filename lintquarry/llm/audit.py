"""What a chain of filters removes, in every order of it, and each filter's fair share.

For each part of the documents, the sets of filters that a document fails are counted: at most 2**k numbers a part. They are the
coefficients of the part's removal polynomial

    R(x) = sum over failure sets M of count(M) * (1 - product over i in M of (1 - x_i)),

which at a corner of the unit cube (x_i = 1: filter i is on) is the number of documents that those filters remove together. So survivors
after each step of an order, what a step removes, and what only one filter catches are differences of corner values. A filter's Shapley
value is the integral of its partial derivative along the cube's diagonal, taken with exact rationals; times k! it is the number that the
filter removes, summed over all orders.

Counts come from one aggregation with map-side partial sums, so a part with a third of all rows is no hot group; the polynomials are worked
out on the executors, a row a part.

Defined results: a null text is the empty text, and equal to it; a null part is the empty string; a document whose doc_id is null has no label
and no copy, as null is neither smaller nor larger than another; rows of the same doc_id and text aren't copies of one another; of
several labels of a doc_id the highest counts; a very long text is judged whole; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, ship

FILTERS = "ABCDE"
#: Of the sums of a part, in this order: all documents, those of good quality, those that are toxic.
SUMS = ("docs", "good", "toxic")
BLANK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> list[Column]:
    """The conditions A to D, which a text decides alone."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * upper > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def bits(failures: list[Column], first: int = 0) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << (first + k))).otherwise(F.lit(0)) for k, c in enumerate(failures)])


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of a part fail exactly the filters of the mask (bit i: filter i)."""
    shared = Shared(docs.sparkSession, "audit")
    text = F.coalesce(F.col("text"), F.lit(""))
    # texts are read once and never shuffled: what is kept of one is its digest and four bits
    narrow = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    narrow = narrow.select("doc_id", "part", bits(text_failures(F.col("text"))).alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    narrow = shared.table(narrow)
    # written before the join, so that the rows of a hot text can be split over tasks
    first = shared.table(narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).filter("n > 1").select("digest", "first"))
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.max("quality"), F.lit(0)).alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    marked = shared.table(marked.filter("quality = 1 or toxic = 1"))
    rows = narrow.join(first.hint("merge"), "digest", "left").select("doc_id", "part", (F.col("own") + bits([F.col("doc_id") > F.col("first")], 4)).alias("mask"))
    rows = rows.join(marked.hint("merge"), "doc_id", "left")
    one = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("docs"), one("quality").alias("good"), one("toxic").alias("toxic"))


# ---------------------------------------------------------------- polynomials


class Removal:
    """The removal polynomial of counts by mask, over ``k`` filters."""

    def __init__(self, counts: dict[int, int], k: int):
        self.counts, self.k = counts, k
        self._corner: dict[int, int] = {}

    def corner(self, on: int) -> int:
        """R where x_i is 1 for the filters in ``on``, else 0: the documents that they remove together."""
        if on not in self._corner:
            self._corner[on] = sum(n for mask, n in self.counts.items() if mask & on)
        return self._corner[on]

    def diagonal_derivative(self, i: int) -> list[int]:
        """Coefficients, in powers of s = 1 - t, of dR/dx_i at (t, ..., t): a failure set M with i in it gives count(M) * s**(|M| - 1)."""
        out = [0] * self.k
        for mask, n in self.counts.items():
            if mask >> i & 1:
                out[mask.bit_count() - 1] += n
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of the diagonal derivative from 0 to 1; s runs from 1 to 0, so a power s**p gives 1 / (p + 1)."""
        return sum((Fraction(c, p + 1) for p, c in enumerate(self.diagonal_derivative(i))), Fraction(0))


COLUMNS = {
    "part": pa.string(), "filter_order": pa.string(), "step": pa.int32(), "kept": pa.int64(), "removed": pa.int64(), "redundant": pa.int64(), "unique_fails": pa.int64(),
    "good_lost": pa.int64(), "toxic_lost": pa.int64(), "shapley": pa.int64(),
}
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def part_rows(part: str, counts: list[dict[int, int]], names: str = FILTERS) -> list[tuple]:
    """A part's rows, in the order of COLUMNS; counts: by mask, one dictionary for each of SUMS."""
    k, whole = len(names), (1 << len(names)) - 1
    docs, good, toxic = (Removal(c, k) for c in counts)
    total = sum(counts[0].values())
    share = [docs.shapley(i) * factorial(k) for i in range(k)]
    assert all(s.denominator == 1 for s in share)
    alone = [docs.corner(whole) - docs.corner(whole & ~(1 << i)) for i in range(k)]
    out = []
    for order in permutations(range(k)):
        on = 0
        for step, i in enumerate(order, 1):
            after = on | 1 << i
            removed = docs.corner(after) - docs.corner(on)
            out.append((
                part, "".join(names[j] for j in order), step, total - docs.corner(after), removed, docs.corner(1 << i) - removed, alone[i],
                good.corner(after) - good.corner(on), toxic.corner(after) - toxic.corner(on), int(share[i]),
            ))
            on = after
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step."""
    ship(docs.sparkSession)
    by_part = masks(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", *SUMS)).alias("counts"))

    def work_out(batches):
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = part_rows(part, [{c["mask"]: c[s] for c in counts} for s in SUMS])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)], list(COLUMNS))

    return by_part.mapInArrow(work_out, SCHEMA)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM d
), l AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part,
    (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL
), letters AS (
  SELECT i, substr('ABCDE', i + 1, 1) AS letter, 1 << i AS own FROM range(5) t(i)
), orders AS (
  SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.own | b.own | c.own | d.own | e.own = 31
), steps AS (
  SELECT filter_order, step, own, coalesce(sum(own) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM orders, range(1, 6) s(step), letters WHERE letter = substr(filter_order, step, 1)
), counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & own > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
  FROM steps, m GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
