"""Comparing versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(v: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.trim(v), r"^[vV]", ""), r"\+.*$", "")
    return F.split(v, r"[.\-_]")


def compare_maven(a: Column, b: Column, strict_padding: bool = False) -> Column:
    """-1, 0 or 1 as version a is before, like or after b; null if either is.

    Segment by segment, the first that differs decides: numbers as numbers; a number is after a qualifier; a missing segment
    is after a qualifier and like any number (with strict_padding: like the number 0); qualifiers by their letters,
    whatever their case. Like-any makes the order not transitive, so it is a comparison, not a sort key.
    """
    x, y = _segments(a), _segments(b)

    def one(i: Column) -> Column:
        p, q = F.get(x, i), F.get(y, i)
        np, nq = F.coalesce(p.rlike(r"^\d+$"), F.lit(False)), F.coalesce(q.rlike(r"^\d+$"), F.lit(False))
        dp, dq = F.when(np, p.cast("decimal(38,0)")), F.when(nq, q.cast("decimal(38,0)"))
        missing_number = F.signum(F.coalesce(dp, F.lit(0).cast("decimal(38,0)")) - F.coalesce(dq, F.lit(0).cast("decimal(38,0)"))).cast("int") if strict_padding else F.lit(0)
        lp, lq = F.lower(p), F.lower(q)
        return (
            F.when(np & nq, F.when(dp < dq, -1).when(dp > dq, 1).otherwise(0))
            .when((np & q.isNull()) | (nq & p.isNull()), missing_number)
            .when(np, 1)
            .when(nq, -1)
            .when(p.isNull(), 1)
            .when(q.isNull(), -1)
            .otherwise(F.when(lp < lq, -1).when(lp > lq, 1).otherwise(0))
        )

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), one)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.get(F.filter(parts, lambda s: s != 0), F.lit(0)), F.lit(0)))


def release_key(v: Column) -> Column:
    """The numbers of a version's segments, all of them: leading digits, 0 for none; sortable where the numbers of segments agree."""
    return F.transform(F.split(strip_v(v), r"[^0-9A-Za-z]+"), lambda s: F.coalesce(F.regexp_extract(s, r"^(\d{1,38})", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))


def compare_release(a: Column, b: Column) -> Column:
    """-1, 0 or 1; missing segments and such without a number count as 0."""
    zero = F.lit(0).cast("decimal(38,0)")
    order = F.zip_with(release_key(a), release_key(b), lambda x, y: F.when(F.coalesce(x, zero) < F.coalesce(y, zero), -1).when(F.coalesce(x, zero) > F.coalesce(y, zero), 1).otherwise(0))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.get(F.filter(order, lambda c: c != 0), F.lit(0)), F.lit(0)))


def strip_v(v: Column) -> Column:
    return F.regexp_replace(v, r"^[vV]", "")
