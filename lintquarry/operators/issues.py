"""Serving queries over issues and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogs import LEVELS, RANK, literal_map, rank_of
from ..functions.text import not_blank
from ..session import stored


def contains_any(columns: list[str], keyword: str, wildcards: bool = False) -> Column:
    """Whether one of the columns holds the keyword; wildcards: % and _ of the keyword are SQL's."""
    tests = [F.col(c).like(f"%{keyword}%") if wildcards else F.col(c).contains(keyword) for c in columns]
    return reduce(Column.__or__, tests)


def filtered(issues: DataFrame, task_id: int | None = None, level: str | None = None, checker: str | None = None, keyword: str | None = None, ignored: bool | None = False) -> DataFrame:
    """Issues that pass each filter that is given; empty texts and ALL, in any case, filter nothing."""
    given = lambda v: v is not None and v.strip() != "" and v.strip().upper() != "ALL"
    if task_id is not None:
        issues = issues.filter(F.col("task_id") == task_id)
    if ignored is not None:
        issues = issues.filter(F.col("is_ignored") == ignored)
    if given(level):
        issues = issues.filter(F.col("level") == level.strip().upper())
    if given(checker):
        issues = issues.filter(F.col("checker_type") == checker)
    if given(keyword):
        issues = issues.filter(contains_any(["title", "file_path", "description"], keyword))
    return issues


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in a total order: only the pages up to it are kept while sorting."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def paged(rows: DataFrame, order: list, number: int, size: int) -> tuple[DataFrame, int]:
    """A page and the number of rows in all."""
    return page(rows, order, number, size), rows.count()


def with_levels(issues: DataFrame, levels: list[str]) -> DataFrame:
    """Issues of the levels named; names that aren't levels are dropped, and none left means all."""
    known = [v.upper() for v in levels if v and v.upper() in LEVELS]
    return issues.filter(F.col("level").isin(known)) if known else issues


def checker_stats(issues: DataFrame) -> DataFrame:
    """Issues, ignored ones too, by checker and level, with the checker's name."""
    return issues.groupBy("task_id", "checker_type", "level").agg(F.max("checker_name").alias("checker_name"), F.count(F.lit(1)).alias("n"))


def checker_levels(issues: DataFrame) -> DataFrame:
    """Active issues: a row for each checker's name, or else its type, a column for each level."""
    name = F.coalesce("checker_name", "checker_type").alias("checker")
    return issues.filter(~F.col("is_ignored")).groupBy("task_id", name).agg(*[F.count_if(F.col("level") == v).alias(v.lower()) for v in LEVELS])


def top_issues(issues: DataFrame, n: int = 5) -> DataFrame:
    """The n worst active issues of each task: by level, file, line, rule."""
    order = [rank_of(F.col("level")).desc(), "file_path", "line_start", "rule_code"]
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(*order))
    return issues.filter(~F.col("is_ignored")).withColumn("place", rank).filter(F.col("place") <= n)


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the highest order value, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def report_order() -> list:
    """The report's order: levels by their letters, then file and line."""
    return ["level", "file_path", "line_start"]


def severity_order() -> list:
    return [F.col("severity").desc(), F.col("id").asc()]


def daily_trend(tasks: DataFrame, as_of: str, days: int = 14, most: int = 200) -> DataFrame:
    """Tasks created on each of the days up to as_of, among the newest tasks; days without any have 0. max_n is the highest
    number, at least 1."""
    spark = tasks.sparkSession
    latest = newest(tasks.filter(F.to_date("created_at") <= F.lit(as_of).cast("date")), most)
    n = latest.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = F.lit(as_of).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    out = calendar.join(F.broadcast(n), "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return out.withColumn("max_n", F.greatest(F.lit(1), F.max("n").over(Window.partitionBy(F.lit(1)))))  # one row a day: the calendar bounds the window


def newest(tasks: DataFrame, n: int = 200) -> DataFrame:
    return tasks.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def dashboard_totals(tasks: DataFrame, counts: DataFrame) -> DataFrame:
    """Sums over tasks (the newest ones): their number, those that succeeded, and their issues by level."""
    joined = tasks.join(counts.withColumnRenamed("task_id", "id"), "id", "left")
    sums = [F.sum(F.coalesce(F.col(v.lower()), F.lit(0))).alias(v.lower()) for v in LEVELS]
    return joined.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"), *sums)


def record_status(events: DataFrame, key: str, order: str) -> DataFrame:
    """The state of each record after its status events: SUCCESS once reached stays, else the last one."""
    return events.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("status") == "SUCCESS", F.col("status"))), F.max_by("status", order)).alias("status"))


def missing_rows(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The new rows whose key isn't stored yet, one for each key."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def deep_review(issues: DataFrame, most: int = 50) -> DataFrame:
    """What a deep review takes of a task: of its active issues without an AI suggestion the worst, and how many it leaves."""
    open_ = issues.filter(~F.col("is_ignored") & ~not_blank(F.col("ai_suggestion")))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("severity").desc(), "id"))
    return open_.withColumn("place", rank).groupBy("task_id").agg(F.count_if(F.col("place") <= most).alias("total"), F.count_if(F.col("place") > most).alias("skipped"))


def level_number(level: Column) -> Column:
    """0 for BLOCKER to 4 for INFO, for display; others last."""
    return F.coalesce(F.try_element_at(literal_map({v: 5 - RANK[v] for v in LEVELS}), level), F.lit(4))


def cascade_delete(task_id: int, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without a task's rows."""
    return {name: t.filter(~F.col("id" if name == "tasks" else "task_id").eqNullSafe(F.lit(task_id))) for name, t in tables.items()}


def sparse_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the values that changes give for their key; null in a change keeps the old value."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


# ---------------------------------------------------------------- look-ups and listings


def by_id(rows: DataFrame, value: int, key: str = "id") -> DataFrame:
    """The row of an identifier: none or one."""
    return rows.filter(F.col(key) == value).limit(1)


def active_config(rows: DataFrame, flag: str = "is_active", key: str = "id") -> DataFrame:
    """The setting in force: of those switched on the one of the least id."""
    return rows.filter(F.col(flag)).orderBy(key).limit(1)


def rule_page(rules: DataFrame, category: str | None = None, keyword: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """A page of rules by sort_order: of a category, unless it is empty or ALL in any case, and with a keyword in code, name or
    description."""
    if category and category.upper() != "ALL":
        rules = rules.filter(F.col("rule_category") == category)
    if keyword:
        rules = rules.filter(contains_any(["rule_code", "rule_name", "description"], keyword))
    return page(rules, ["sort_order", "rule_code"], number, size)


def listed(rows: DataFrame, *keys: str) -> DataFrame:
    """Settings in the order in which they are shown: by the first of these columns, then the next; nulls first."""
    return rows.orderBy(*[F.col(k).asc_nulls_first() for k in keys])


def placed(rows: DataFrame, *keys: str) -> DataFrame:
    """listed() with each row's place, from 0. Sorted ranges are written once; their sizes, a row each, tell where each begins, so that no
    task sees all rows."""
    ranges = stored(listed(rows, *keys).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # no more rows than the session has shuffle partitions
    out = ranges.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn("place", F.col("_before") + row)
    return listed(out.drop("_at", "_part", "_before"), "place")


# ---------------------------------------------------------------- changes


def reset_task(tasks: DataFrame, task_id: int, snapshot_path: str, now: Column | None = None) -> DataFrame:
    """Tasks where one begins anew from an archive: its state pending, its error and times null, its counts 0."""
    mine = F.col("id").eqNullSafe(F.lit(task_id))
    values = {"snapshot_path": F.lit(snapshot_path), "source_type": F.lit("ZIP"), "status": F.lit("PENDING"), "error_message": F.lit(None), "started_at": F.lit(None), "completed_at": F.lit(None)}
    values |= {f"{v.lower()}_count": F.lit(0) for v in LEVELS} | {c: F.lit(0) for c in ("total_issues", "total_files", "total_lines")} | {"updated_at": F.current_timestamp() if now is None else now}
    return tasks.select(*[F.when(mine, values[c].cast(tasks.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in tasks.columns])


def ignore_issue(issues: DataFrame, issue_id: int, kind: str | None = None, reason: str | None = None) -> DataFrame:
    """Issues where one is ignored, by itself (SINGLE) if no kind is named."""
    mine = F.col("id").eqNullSafe(F.lit(issue_id))
    values = {"is_ignored": F.lit(True), "ignore_type": F.lit(kind or "SINGLE"), "ignore_reason": F.lit(reason).cast("string")}
    return issues.withColumns({c: F.when(mine, v).otherwise(F.col(c) if c in issues.columns else F.lit(None)) for c, v in values.items()})


def toggled(rows: DataFrame, row_id: int, flag: str = "is_enabled") -> DataFrame:
    """Rows where one's switch is turned: on, unless it is on."""
    return rows.withColumn(flag, F.when(F.col("id").eqNullSafe(F.lit(row_id)), ~F.coalesce(flag, F.lit(False))).otherwise(F.col(flag)))


def sync_records(records: DataFrame, ended: DataFrame) -> DataFrame:
    """CI records with the state of their task (task_id, status), but for those that succeeded already; a null state changes nothing."""
    new = ended.filter("task_id is not null and status is not null").groupBy("task_id").agg(F.max("status").alias("_new"))
    out = records.join(new, "task_id", "left")
    guarded = F.col("_new").isNotNull() & (F.col("status") != "SUCCESS")
    return out.withColumn("status", F.when(guarded, F.col("_new")).otherwise(F.col("status"))).select(*records.columns)


def with_trigger_names(records: DataFrame, triggers: DataFrame) -> DataFrame:
    """Records with their trigger's name, null where there is none: settings are few, a join that Spark may broadcast by their size."""
    return records.join(triggers.select(F.col("id").alias("trigger_id"), F.col("name").alias("trigger_name")), "trigger_id", "left")


def task_status(tasks: DataFrame, counts: DataFrame) -> DataFrame:
    """What the status call tells of each task: its state, its message, how long it took in seconds (null while it runs) and its issues by level."""
    at = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    levels = [F.coalesce(F.col(v.lower()), F.lit(0)).cast("bigint").alias(v.lower()) for v in LEVELS]
    return tasks.join(counts.withColumnRenamed("task_id", "id"), "id", "left").select("id", "status", "error_message", (at("completed_at") - at("started_at")).alias("seconds"), *levels)


def history(tasks: DataFrame, project: str | None = None, status: str | None = None, number: int = 1, size: int = 10) -> DataFrame:
    """A page of tasks, newest first: of a project or task whose name holds a text, in a state; empty texts and ALL filter nothing."""
    if project and project.strip():
        tasks = tasks.filter(contains_any(["project_name", "task_name"], project.strip()))
    if status and status.strip() and status.strip().upper() != "ALL":
        tasks = tasks.filter(F.col("status") == status.strip().upper())
    return page(tasks, [F.col("created_at").desc(), F.col("id").desc()], number, size)
