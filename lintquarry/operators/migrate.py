"""Migrations of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.catalogs import MIGRATED, RANK, RULES, SUGGESTIONS, level_of, level_of_rule, lookup


def severity_levels(issues: DataFrame) -> DataFrame:
    """Issues with new_level, new_severity and outcome.

    Rows of an older level get the rule's level, or else what the level maps to; other rows whose rule is in the catalog
    by its full code are set to the catalog's level, such made by AI excepted; else only a wrong rank is put right.
    """
    level, rule = F.col("level"), F.col("rule_code")
    legacy = F.coalesce(level.isin(*MIGRATED), F.lit(False))
    from_legacy = level_of_rule(rule, lookup(MIGRATED, level))
    now = level_of(level)
    exact = lookup({k: v[0] for k, v in RULES.items()}, rule)
    realigned = F.when(~F.coalesce("ai_generated", F.lit(False)), exact)
    target = F.when(legacy, from_legacy).otherwise(F.coalesce(realigned, now))
    out = issues.withColumn("new_level", target)
    changed = F.when(legacy, F.col("new_level") != level).otherwise(F.col("new_level") != now)
    out = out.withColumn("new_severity", lookup(RANK, F.col("new_level")))
    wrong = ~F.col("severity").eqNullSafe(F.col("new_severity"))
    outcome = F.when(changed & legacy, "LEGACY").when(changed, "REALIGNED").when(wrong, "RANK_FIXED").otherwise("NONE")
    return out.withColumn("outcome", outcome)


def rule_levels(rules: DataFrame) -> DataFrame:
    """Rules whose default level is an older one, with the level that they get; wildcard imports go from MINOR to INFO."""
    name = F.upper(T.trimmed(F.col("default_level")))
    legacy = name.isin(*MIGRATED)
    new = F.when(legacy, level_of_rule(F.col("rule_code"), lookup(MIGRATED, name)))
    new = F.coalesce(new, F.when((F.col("rule_code") == "STYLE_WILDCARD_IMPORT") & (F.col("default_level") == "MINOR"), "INFO"), "default_level")
    return rules.withColumn("default_level", new)


def backfill_suggestions(issues: DataFrame) -> DataFrame:
    """Issues with a blank suggestion get their rule's."""
    return issues.withColumn("suggestion", F.coalesce(T.blank_to_null(F.col("suggestion")), lookup(SUGGESTIONS, F.col("rule_code")), "suggestion"))


def import_only(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Duplicate issues (id) of two places or more all of whose lines are package, import, comment or blank lines, one an import at
    least.

    ranges: id, task_id, file_path, s, e. lines: task_id, file_path, line_no, line.
    """
    place = ["task_id", "file_path", "line_no"]
    numbers = ranges.select("id", "task_id", "file_path", F.explode(F.sequence("s", "e")).alias("line_no"))
    t = F.trim("line")
    is_import = t.startswith("import ")
    plain = is_import | t.startswith("package ") | t.startswith("//") | t.startswith("*") | t.startswith("/*") | (t == "")
    at = numbers.join(lines.select(*place, "line"), place)
    judged = at.groupBy("id").agg(F.bool_and(plain).alias("all_plain"), F.bool_or(is_import).alias("any_import"))
    places = ranges.groupBy("id").agg(F.count(F.lit(1)).alias("places")).filter("places >= 2")
    return judged.filter("all_plain and any_import").join(places, "id").select("id")
