"""Dependencies against a table of advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank, trimmed
from ..functions.versions import compare_maven

#: Advisory severity to issue level (fixed values).
LEVEL_OF = {"CRITICAL": "BLOCKER", "HIGH": "CRITICAL", "MEDIUM": "MAJOR", "MODERATE": "MAJOR"}


def checkable(dependencies: DataFrame) -> DataFrame:
    """Runtime dependencies with a literal version."""
    v = F.col("version")
    return dependencies.filter(~F.coalesce(F.col("scope"), F.lit("")).isin("parent", "test") & not_blank(v) & ~F.coalesce(v.contains("${"), F.lit(False)))


def matches(dependencies: DataFrame, advisories: DataFrame, strict_padding: bool = False) -> DataFrame:
    """Dependencies with each advisory that covers their version: introduced <= version < fixed.

    The join is on the coordinates; the version range is its residual. Advisories without group, artifact or fixed version are left
    out.
    """
    key = lambda g, a: F.concat(F.lower(trimmed(F.col(g))), F.lit(":"), F.lower(trimmed(F.col(a))))
    known = advisories.dropna(subset=["group_id", "artifact_id", "fixed_version"])
    known = known.select(key("group_id", "artifact_id").alias("_key"), "id", "cve", "introduced", "fixed_version", F.col("severity").alias("cve_severity"))
    out = dependencies.withColumn("_key", key("group_id", "artifact_id")).join(known, "_key").drop("_key")
    v = F.col("version")
    since = F.col("introduced").isNull() | (compare_maven(v, F.col("introduced"), strict_padding) >= 0)
    out = out.filter(since & (compare_maven(v, F.col("fixed_version"), strict_padding) < 0))
    level = F.coalesce(*[F.when(F.upper("cve_severity") == k, F.lit(x)) for k, x in LEVEL_OF.items()], F.lit("MINOR"))
    return out.withColumn("level", level).withColumn("rule_code", F.concat(F.lit("DEP_VULN_"), F.coalesce("cve", "id")))
