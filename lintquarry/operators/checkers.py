"""Checkers as functions over relations: which run, on which files, and the union of what they find."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Checker:
    """A user's rule: a function of the context's relations to hits. code names its settings; several may share one."""

    code: str
    find: Callable[[dict[str, DataFrame]], DataFrame]
    enabled: bool = True
    local: bool = True
    priority: int = 100
    params: dict = field(default_factory=dict)


def enabled(checkers: DataFrame, checker_config: DataFrame) -> DataFrame:
    """checkers (checker_code, default_enabled, ...) with is_enabled: the setting's row wins if it has a value."""
    rows = checker_config.groupBy("checker_code").agg(F.max_by("is_enabled", "sort_order").alias("_on"))
    return checkers.join(rows, "checker_code", "left").withColumn("is_enabled", F.coalesce("_on", "default_enabled", F.lit(True))).drop("_on")


def accepted(files: DataFrame, include_tests: bool = False, ai: bool = False, ai_lines: int = 1000) -> DataFrame:
    """Files that checkers take: no tests unless asked for; for AI rules Java files of a bounded number of lines."""
    rows = files if include_tests else files.filter(~T.is_test_path(F.col("file_path")))
    if ai:
        rows = rows.filter(F.col("file_path").endswith(".java") & (F.size(T.lines_of(F.col("content"))) <= ai_lines))
    return rows


def run(checkers: list[Checker], context: dict[str, DataFrame], settings: dict[str, bool | None] | None = None) -> DataFrame:
    """The hits of all enabled checkers, one union; settings: code -> switch, null leaves the checker's own."""
    settings = settings or {}
    on = [c for c in checkers if (settings.get(c.code) if settings.get(c.code) is not None else c.enabled)]
    parts = [c.find(context) for c in sorted(on, key=lambda c: c.priority)]
    if not parts:
        raise ValueError("no checker is enabled")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
