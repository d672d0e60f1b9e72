"""AI answers as findings, and what hangs on when they came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.catalogs import level_of

FINDING = "array<struct<level:string,title:string,line:int,description:string,suggestion:string>>"


def findings(answers: DataFrame, rule_code: str = "AI_SEMANTIC") -> DataFrame:
    """Rows id, rule_code, level, title, line, description: one for each finding of an answer's JSON array; an answer without one is
    itself a suggestion on line 1."""
    array = T.json_array(F.col("answer"))
    rows = answers.select("id", "answer", F.from_json(array, FINDING).alias("found"))
    many = rows.filter(F.size("found") > 0).select("id", F.explode("found").alias("f"))
    many = many.select("id", F.lit(rule_code).alias("rule_code"), level_of(F.col("f.level")).alias("level"), "f.title", F.coalesce("f.line", F.lit(1)).alias("line"), "f.description")
    one = rows.filter(F.col("found").isNull() & T.not_blank(F.col("answer"))).select("id", F.lit("AI_REVIEW_SUGGESTION").alias("rule_code"), F.lit("INFO").alias("level"), F.lit("suggestion").alias("title"), F.lit(1).alias("line"), F.col("answer").alias("description"))
    return many.unionByName(one)


def prompt(lines: DataFrame, most: int = 300) -> DataFrame:
    """The first lines of each file as one text."""
    first = lines.filter(F.col("line_no") <= most)
    sorted_ = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return first.groupBy("task_id", "file_path").agg(F.array_join(F.transform(sorted_, lambda x: x["line"]), "\n").alias("prompt"))


def last_review(issues: DataFrame) -> DataFrame:
    """When each task last got an AI suggestion, and how many issues have one."""
    has = T.not_blank(F.col("ai_suggestion"))
    return issues.groupBy("task_id").agg(F.max("ai_suggestion_at").alias("last_ai"), F.count_if(has).alias("enhanced"))


def stale_reports(reports: DataFrame, issues: DataFrame) -> DataFrame:
    """Cached reports (task_id, path, modified) older than their task's last AI suggestion."""
    last = issues.groupBy("task_id").agg(F.max("ai_suggestion_at").alias("last_ai"))
    return reports.join(last, "task_id").filter(F.col("modified") < F.col("last_ai")).select("task_id", "path")


def id_list(rows: DataFrame, column: str, name: str = "id") -> DataFrame:
    """Rows with one id for each number in a comma-separated text; what isn't a number is passed over."""
    ids = F.array_distinct(F.array_compact(F.transform(F.split(column, ","), lambda s: F.trim(s).try_cast("bigint"))))
    return rows.withColumn(name, F.explode(ids))
