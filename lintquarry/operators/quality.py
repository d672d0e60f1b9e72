"""Quality gate: counts, score, grade, verdict and technical debt of every task at once."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogs import LEVELS, minutes_of_rule
from ..functions.text import debt_text


@dataclass(frozen=True)
class Gate:
    """Weights, limits and bands; the defaults are fixed values of the product."""

    blocker_weight: int = 25
    critical_weight: int = 15
    major_weight: int = 5
    minor_weight: int = 1
    info_weight: int = 0
    pass_score: int = 80
    blocker_limit: int = 0
    excellent_score: int = 90
    good_score: int = 75
    fair_score: int = 60

    def overlaid(self, **custom: int | None) -> Gate:
        """This gate with the settings that are given, validated: weights and scores 0 to 100, the limit 0 to 1000, bands that don't
        rise from excellent to fair."""
        out = replace(self, **{k: v for k, v in custom.items() if v is not None})
        values = asdict(out)
        if any(not 0 <= v <= (1000 if k == "blocker_limit" else 100) for k, v in values.items()) or not out.excellent_score >= out.good_score >= out.fair_score:
            raise ValueError("gate settings out of range")
        return out


def level_counts(issues: DataFrame, active_only: bool = True) -> DataFrame:
    """Rows task_id, level, n."""
    rows = issues.filter(~F.col("is_ignored")) if active_only else issues
    return rows.groupBy("task_id", "level").agg(F.count(F.lit(1)).alias("n"))


def level_pivot(issues: DataFrame, unknown_as_info: bool = True) -> DataFrame:
    """One row a task with the number of active issues of each level; levels that aren't known count as INFO."""
    active = issues.filter(~F.col("is_ignored"))
    counts = [F.count_if(_is(level, unknown_as_info)).alias(level.lower()) for level in LEVELS]
    return active.groupBy("task_id").agg(*counts)


def _is(level: str, unknown_as_info: bool) -> Column:
    own = F.col("level") == level
    return F.coalesce(own | ~F.col("level").isin(*LEVELS), F.lit(True)) if level == "INFO" and unknown_as_info else own


def evaluate(issues: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """One row a task: counts, ignored, score, grade, passed, debt_minutes, debt_text.

    A single aggregation: every figure is a conditional count or sum over the task's issues.
    """
    active = ~F.col("is_ignored")
    counts = [F.count_if(active & _is(level, False)).alias(level.lower()) for level in LEVELS]
    debt = F.sum(F.when(active, minutes_of_rule(F.col("rule_code"))).otherwise(0)).alias("debt_minutes")
    out = issues.groupBy("task_id").agg(*counts, F.count_if(~active).alias("ignored"), debt)
    return graded(out, gate)


def graded(counts: DataFrame, gate: Gate) -> DataFrame:
    lost = sum((F.col(level.lower()) * getattr(gate, f"{level.lower()}_weight") for level in LEVELS), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("int")
    grade = F.when(F.col("score") >= gate.excellent_score, "EXCELLENT").when(F.col("score") >= gate.good_score, "GOOD").when(F.col("score") >= gate.fair_score, "FAIR").otherwise("POOR")
    out = counts.withColumn("score", score).withColumn("grade", grade)
    out = out.withColumn("passed", (F.col("blocker") <= gate.blocker_limit) & (F.col("score") >= gate.pass_score))
    return out.withColumn("debt_text", debt_text(F.col("debt_minutes")))


def with_missing_tasks(verdicts: DataFrame, task_ids: DataFrame) -> DataFrame:
    """The verdict of each task asked for; a task without one has score 0, POOR, not passed."""
    out = task_ids.select("task_id").distinct().join(verdicts, "task_id", "left")
    return out.fillna({"score": 0, "grade": "POOR", "passed": False})
