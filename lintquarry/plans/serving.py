"""Registered queries over issues and tasks, each with its SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import text as T
from ..operators import govern, intervals, issues, migrate, quality
from ..schemas import REVIEW_RULE
from ..session import shared_dir
from ..sources import files, tables
from .registry import query

REVIEW_RULES = [
    ("NULL_CHECK", "null", "defect", "BLOCKER", None, 1),
    ("MAX_COMPLEXITY", "complexity", "quality", "critical", True, 2),
    ("MAGIC_NUMBER", "numbers", "style", "INFO", True, 3),
    ("NAMING_CONSTANT", "constants", "style", "INFO", False, 4),
]
IGNORE_RULES = [
    {"id": 1, "rule_type": "LINE_NUMBER", "file_path": "f1", "line_number": 77, "is_enabled": True},
    {"id": 2, "rule_type": "file_path", "file_path": "f2", "is_enabled": True},
    {"id": 3, "rule_type": "FILE_PATTERN", "file_pattern": "[e-g]{4,9}", "is_enabled": True},
    {"id": 4, "rule_type": "RULE_CODE", "rule_code": "sec_sql_injection", "is_enabled": True},
    {"id": 5, "rule_type": "RULE_CODE", "rule_code": "MAGIC_NUMBER", "is_enabled": False},
]


def hits(spark, d):
    return tables.raw_hits(spark, d).withColumn("is_ignored", F.col("seq") % 10 == 0)


def merged(spark, d):
    """Merged issues with ids, the input of the serving queries."""
    return govern.merge(hits(spark, d)).withColumn("id", F.xxhash64("task_id", "file_path", "rule_code"))


def flat(spark, d):
    """Hits as issues, for queries whose subject isn't merging."""
    return hits(spark, d).withColumn("id", F.col("seq"))


SUGGEST = C.sql_case("rule_code", C.SUGGESTIONS)
FLAT_SQL = "WITH " + tables.HITS_SQL + ", issues AS (SELECT *, seq % 10 = 0 AS is_ignored, seq AS id FROM hits)\n"
#: Interval coalescing as gaps and islands, over rows (k..., s, e); `pts` has each group's label and ends.
ISLANDS = """, span AS (SELECT *, max(e) OVER (PARTITION BY task_id, file_path, rule_code ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {src}),
isl AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY task_id, file_path, rule_code ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM span),
merged_iv AS (SELECT task_id, file_path, rule_code, island, min(s) AS s, max(e) AS e FROM isl GROUP BY ALL),
pts AS (SELECT task_id, file_path, rule_code, min(s) AS line_start, max(e) AS line_end,
  string_agg(CASE WHEN s = e THEN s::VARCHAR ELSE s || '-' || e END, '、' ORDER BY s) AS line_label FROM merged_iv GROUP BY ALL)"""
MERGE = (
    """, kept AS (SELECT *, greatest(1, line_start) AS s, greatest(1, line_start, line_end) AS e FROM (SELECT *, bool_and(is_ignored) OVER (PARTITION BY task_id, file_path, rule_code) AS all_ignored FROM issues) WHERE is_ignored = all_ignored)"""
    + ISLANDS.format(src="kept")
    + f""", grp AS (SELECT task_id, file_path, rule_code, is_ignored, arg_min(level, (line_start, seq)) AS level, arg_min(title, (line_start, seq)) AS title,
  arg_min(checker_type, (line_start, seq)) AS checker_type, arg_min(checker_name, (line_start, seq)) AS checker_name, max(severity) AS severity,
  bool_or(ai_generated) AS ai_generated, count(*) AS occurrence_count, arg_min(code_snippet, seq) FILTER (trim(code_snippet) <> '') AS code_snippet,
  coalesce(arg_min(suggestion, seq) FILTER (trim(suggestion) <> ''), {SUGGEST}) AS suggestion FROM kept GROUP BY task_id, file_path, rule_code, is_ignored),
merged AS (SELECT grp.*, line_start, line_end, line_label FROM grp JOIN pts USING (task_id, file_path, rule_code))"""
)
MERGED_SQL = "WITH " + tables.HITS_SQL + ", issues AS (SELECT *, seq % 10 = 0 AS is_ignored FROM hits)" + MERGE + "\n"


def counts_sql(src: str) -> str:
    return f"SELECT task_id, {', '.join(f'''count(*) FILTER (level = '{v}' AND NOT is_ignored) AS {v.lower()}''' for v in C.LEVELS)}, count(*) FILTER (is_ignored) AS ignored, sum(CASE WHEN is_ignored THEN 0 ELSE coalesce({C.sql_by_rule('rule_code', 1)}, {C.DEFAULT_MINUTES}) END)::BIGINT AS debt_minutes FROM {src} GROUP BY task_id"


DEBT_TEXT_SQL = """CASE WHEN debt_minutes <= 0 THEN '0m' WHEN debt_minutes >= 1440 THEN (debt_minutes // 1440) || 'd' || CASE WHEN debt_minutes % 1440 // 60 > 0 THEN ' ' || (debt_minutes % 1440 // 60) || 'h' ELSE '' END
  WHEN debt_minutes >= 60 THEN (debt_minutes // 60) || 'h' || CASE WHEN debt_minutes % 60 > 0 THEN ' ' || (debt_minutes % 60) || 'm' ELSE '' END ELSE debt_minutes || 'm' END"""


def gate_sql(cte: str, src: str) -> str:
    return f"""{cte}, counts AS ({counts_sql(src)}),
scored AS (SELECT *, greatest(0, least(100, 100 - (blocker * 25 + critical * 15 + major * 5 + minor * 1)))::INT AS score FROM counts)
SELECT *, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'FAIR' ELSE 'POOR' END AS grade,
  blocker <= 0 AND score >= 80 AS passed, {DEBT_TEXT_SQL} AS debt_text FROM scored"""


@query("issue_filter_page", FLAT_SQL + "SELECT task_id, file_path, line_start, id, level FROM issues WHERE NOT is_ignored AND level = 'MAJOR' ORDER BY file_path, line_start, id LIMIT 50 OFFSET 50")
def issue_filter_page(spark, d):
    rows = issues.filtered(flat(spark, d), level="major", checker="ALL", keyword="")
    return issues.page(rows.select("task_id", "file_path", "line_start", "id", "level"), ["file_path", "line_start", "id"], 2, 50)


@query("issue_keyword_search", FLAT_SQL + "SELECT id, title, description, file_path FROM issues WHERE NOT is_ignored AND (contains(title, 'purch') OR contains(file_path, 'purch') OR contains(description, 'purch'))")
def issue_keyword_search(spark, d):
    return issues.filtered(flat(spark, d), keyword="purch").select("id", "title", "description", "file_path")


@query("issue_level_in", FLAT_SQL + "SELECT id, level, severity FROM issues WHERE NOT is_ignored AND level IN ('BLOCKER', 'CRITICAL') AND suggestion IS NULL ORDER BY severity DESC, id")
def issue_level_in(spark, d):
    rows = issues.with_levels(issues.filtered(flat(spark, d)), ["critical", "Blocker", "nonsense"]).filter(F.col("suggestion").isNull())
    return rows.select("id", "level", "severity").orderBy(*issues.severity_order())


@query("level_counts", FLAT_SQL + "SELECT task_id, level, count(*) AS n FROM issues WHERE NOT is_ignored GROUP BY ALL")
def level_counts(spark, d):
    return quality.level_counts(flat(spark, d))


@query("level_pivot", FLAT_SQL + "SELECT task_id, " + ", ".join(f"count(*) FILTER (level = '{v}') AS {v.lower()}" for v in C.LEVELS) + " FROM issues WHERE NOT is_ignored GROUP BY ALL")
def level_pivot(spark, d):
    return quality.level_pivot(flat(spark, d))


@query("checker_stats", FLAT_SQL + "SELECT task_id, checker_type, level, max(checker_name) AS checker_name, count(*) AS n FROM issues GROUP BY ALL")
def checker_stats(spark, d):
    return issues.checker_stats(flat(spark, d))


@query("checker_levels", FLAT_SQL + "SELECT task_id, coalesce(checker_name, checker_type) AS checker, " + ", ".join(f"count(*) FILTER (level = '{v}') AS {v.lower()}" for v in C.LEVELS) + " FROM issues WHERE NOT is_ignored GROUP BY ALL")
def checker_levels(spark, d):
    return issues.checker_levels(flat(spark, d))


@query("gate_eval", gate_sql(MERGED_SQL, "merged"))
def gate_eval(spark, d):
    return quality.evaluate(merged(spark, d))


@query("debt_by_task", FLAT_SQL + f", counts AS ({counts_sql('issues')}) SELECT task_id, debt_minutes, {DEBT_TEXT_SQL} AS debt_text FROM counts")
def debt_by_task(spark, d):
    return quality.evaluate(flat(spark, d)).select("task_id", "debt_minutes", "debt_text")


CODES = [*C.RULES, "DEP_VULN_CVE-1", "SEC_NEW", "ARCH_NEW", "CONC_NEW", "STYLE_NEW", "NAMING_NEW", "AI_DESIGN", "OTHER"]


@query("severity_catalog", f"WITH r AS (SELECT event_id, ([{', '.join(map(C.sql_value, CODES))}])[event_id % {len(CODES)} + 1] AS rule_code FROM events), g AS (SELECT *, coalesce({C.sql_by_rule('rule_code', 0)}, 'INFO') AS level, coalesce({C.sql_by_rule('rule_code', 1)}, 10) AS minutes FROM r) SELECT *, {C.sql_case('level', C.RANK)} AS severity FROM g")
def severity_catalog(spark, d):
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("event_id") % len(CODES)).cast("int"))
    out = tables.read(spark, d, "events").select("event_id", code.alias("rule_code"))
    out = out.withColumn("level", C.level_of_rule(F.col("rule_code"))).withColumn("minutes", C.minutes_of_rule(F.col("rule_code")))
    return out.withColumn("severity", C.rank_of(F.col("level")))


@query("level_aliases", "WITH r AS (SELECT event_id, (['bug', ' Warning', 'INFO', 'MAJOR ', 'blocker', 'odd', NULL])[event_id % 7 + 1] AS code FROM events) SELECT *, CASE WHEN upper(trim(code)) IN ('BLOCKER', 'CRITICAL', 'MAJOR', 'MINOR', 'INFO') THEN upper(trim(code)) WHEN upper(trim(code)) = 'BUG' THEN 'CRITICAL' WHEN upper(trim(code)) = 'WARNING' THEN 'MAJOR' ELSE 'INFO' END AS level FROM r")
def level_aliases(spark, d):
    code = F.get(F.array(*map(F.lit, ["bug", " Warning", "INFO", "MAJOR ", "blocker", "odd", None])), (F.col("event_id") % 7).cast("int"))
    return tables.read(spark, d, "events").select("event_id", code.alias("code")).withColumn("level", C.level_of(F.col("code")))


COLUMNS = ["task_id", "file_path", "rule_code", "is_ignored", "level", "title", "checker_type", "checker_name", "severity", "ai_generated", "occurrence_count", "code_snippet", "suggestion", "line_start", "line_end", "line_label"]


@query("merge_issues", MERGED_SQL + f"SELECT {', '.join(COLUMNS)} FROM merged")
def merge_issues(spark, d):
    return merged(spark, d).select(*COLUMNS)


@query("interval_coalesce", FLAT_SQL.rstrip() + ", iv AS (SELECT task_id, file_path, rule_code, line_start - 3 AS s, line_end - 3 AS e FROM issues WHERE line_start > 3)" + ISLANDS.format(src="iv") + " SELECT task_id, file_path, rule_code, s, e FROM merged_iv")
def interval_coalesce(spark, d):
    rows = flat(spark, d).select("task_id", "file_path", "rule_code", (F.col("line_start") - 3).alias("s"), (F.col("line_end") - 3).alias("e"))
    return intervals.coalesced(rows, govern.GROUP)


@query(
    "context_windows",
    FLAT_SQL.rstrip()
    + ", iv AS (SELECT task_id, file_path, rule_code, greatest(1, line_start - 2) AS s, least(205, line_end + 2) AS e FROM issues)"
    + ISLANDS.format(src="iv")
    + " SELECT task_id, file_path, rule_code, s, e, coalesce(s - lag(e) OVER (PARTITION BY task_id, file_path, rule_code ORDER BY s) - 1, 0) AS gap FROM merged_iv",
)
def context_windows(spark, d):
    points = flat(spark, d).select(*govern.GROUP, F.col("line_start").alias("s"), F.col("line_end").alias("e"), F.lit(205).alias("total"))
    return intervals.context_windows(points, govern.GROUP, 2)


@query(
    "context_lines",
    "WITH "
    + tables.LINES_SQL
    + """, pt AS (SELECT task_id, file_path, 2 AS s, 3 AS e FROM cut WHERE len(l) >= 4), seg AS (SELECT p.task_id, p.file_path, 1 AS f, least(len(l), 5) AS t, s, e FROM pt p JOIN cut USING (task_id, file_path))
SELECT task_id, file_path, line_no, line, line_no BETWEEN s AND e AS issue_line, CASE line_no WHEN s THEN 'start' WHEN e THEN 'end' END AS marker, 0 AS gap_before FROM seg JOIN lines USING (task_id, file_path) WHERE line_no BETWEEN f AND t""",
)
def context_lines(spark, d):
    keys = ["task_id", "file_path"]
    all_lines = tables.lines(tables.files(spark, d))
    totals = all_lines.groupBy(*keys).agg(F.max("line_no").alias("total")).filter("total >= 4")
    points = totals.select(*keys, F.lit(2).alias("s"), F.lit(3).alias("e"), "total")
    return intervals.context_lines(intervals.context_windows(points, keys, 2), points, all_lines, keys)


RULES_CTE = f"rules AS (SELECT * FROM {C.sql_rows(REVIEW_RULES, 'rule_code, rule_name, rule_category, default_level, is_enabled, sort_order')})"
OVERRIDE = f"""ruled AS (SELECT h.* EXCLUDE (level, severity), CASE WHEN default_level IN ('BLOCKER', 'CRITICAL', 'MAJOR', 'MINOR', 'INFO') THEN default_level ELSE level END AS level,
  CASE WHEN default_level IN ('BLOCKER', 'CRITICAL', 'MAJOR', 'MINOR', 'INFO') THEN {C.sql_case('default_level', C.RANK)} ELSE severity END AS severity
  FROM hits h LEFT JOIN rules USING (rule_code) WHERE is_enabled IS DISTINCT FROM FALSE)"""
IGNORED = """(ends_with(file_path, 'f1') AND line_start = 77) OR ends_with(file_path, 'f2') OR regexp_full_match(file_path, '[e-g](4|9)') OR lower(rule_code) = 'sec_sql_injection'"""


def review_rules(spark):
    return spark.createDataFrame(REVIEW_RULES, REVIEW_RULE)


@query("rule_meta_override", f"WITH {tables.HITS_SQL}, {RULES_CTE}, {OVERRIDE} SELECT seq, rule_code, level, severity FROM ruled")
def rule_meta_override(spark, d):
    return govern.apply_rule_settings(tables.raw_hits(spark, d), review_rules(spark)).select("seq", "rule_code", "level", "severity")


@query("ignore_rules", f"WITH {tables.HITS_SQL} SELECT seq, {IGNORED} AS is_ignored FROM hits")
def ignore_rules(spark, d):
    return govern.mark_ignored(tables.raw_hits(spark, d), IGNORE_RULES).select("seq", "is_ignored")


@query("govern_pipeline", f"WITH {tables.HITS_SQL}, {RULES_CTE}, {OVERRIDE}, issues AS (SELECT *, {IGNORED} AS is_ignored FROM ruled){MERGE} SELECT {', '.join(COLUMNS)} FROM merged")
def govern_pipeline(spark, d):
    return govern.govern(tables.raw_hits(spark, d), review_rules(spark), IGNORE_RULES).select(*COLUMNS)


AS_OF = "1998-06-15"


@query(
    "trend_14d",
    f"WITH {tables.TASKS_SQL}, newest AS (SELECT * FROM tasks WHERE created_at::DATE <= DATE '{AS_OF}' ORDER BY created_at DESC, id DESC LIMIT 200), n AS (SELECT created_at::DATE AS day, count(*) AS n FROM newest GROUP BY 1), "
    f"cal AS (SELECT unnest(generate_series(DATE '{AS_OF}' - INTERVAL 13 DAY, DATE '{AS_OF}', INTERVAL 1 DAY))::DATE AS day), j AS (SELECT day, coalesce(n, 0)::BIGINT AS n FROM cal LEFT JOIN n USING (day)) SELECT day, n, greatest(1, max(n) OVER ()) AS max_n FROM j",
)
def trend_14d(spark, d):
    return issues.daily_trend(tables.tasks(spark, d), AS_OF)


@query(
    "dashboard_totals",
    FLAT_SQL.rstrip()
    + f", {tables.TASKS_SQL}, newest AS (SELECT * REPLACE (id % 250 AS id) FROM (SELECT * FROM tasks ORDER BY created_at DESC, id DESC LIMIT 200)), c AS ({counts_sql('issues')}) SELECT count(*) AS tasks, count(*) FILTER (status = 'SUCCESS') AS succeeded, "
    + ", ".join(f"sum(coalesce({v.lower()}, 0))::BIGINT AS {v.lower()}" for v in C.LEVELS)
    + " FROM newest LEFT JOIN c ON c.task_id = newest.id",
)
def dashboard_totals(spark, d):
    newest = issues.newest(tables.tasks(spark, d), 200).withColumn("id", F.col("id") % 250)  # numbered as the hits number theirs
    return issues.dashboard_totals(newest, quality.level_pivot(flat(spark, d)))


@query(
    "top_issues",
    MERGED_SQL.rstrip()
    + f", ranked AS (SELECT task_id, level, file_path, line_start, rule_code, row_number() OVER (PARTITION BY task_id ORDER BY {C.sql_case('level', C.RANK)} DESC, file_path, line_start, rule_code)::INT AS place FROM merged WHERE NOT is_ignored) SELECT * FROM ranked WHERE place <= 5",
)
def top_issues(spark, d):
    return issues.top_issues(merged(spark, d)).select("task_id", "level", "file_path", "line_start", "rule_code", "place")


@query("report_order", MERGED_SQL + "SELECT task_id, level, file_path, line_start FROM merged ORDER BY task_id, level, file_path, line_start")
def report_order(spark, d):
    return merged(spark, d).select("task_id", "level", "file_path", "line_start").orderBy("task_id", *issues.report_order())


@query("latest_per_task", f"WITH {tables.TASKS_SQL} SELECT owner_id, arg_max(id, (created_at, id)) AS id, arg_max(status, (created_at, id)) AS status FROM tasks GROUP BY owner_id")
def latest_per_task(spark, d):
    rows = tables.tasks(spark, d).select("owner_id", "id", "status", F.struct("created_at", "id").alias("at"))
    return issues.latest_per_key(rows, ["owner_id"], "at").select("owner_id", "id", "status")


@query("record_status", "WITH s AS (SELECT user_id AS record_id, event_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM events) SELECT record_id, CASE WHEN bool_or(status = 'SUCCESS') THEN 'SUCCESS' ELSE arg_max(status, event_id) END AS status FROM s GROUP BY 1")
def record_status(spark, d):
    status = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("FAILED")
    return issues.record_status(tables.read(spark, d, "events").select(F.col("user_id").alias("record_id"), "event_id", status.alias("status")), "record_id", "event_id")


@query("suggestion_backfill", FLAT_SQL + f"SELECT id, CASE WHEN suggestion IS NULL OR trim(suggestion) = '' THEN coalesce({SUGGEST}, suggestion) ELSE suggestion END AS suggestion FROM issues")
def suggestion_backfill(spark, d):
    return migrate.backfill_suggestions(flat(spark, d)).select("id", "suggestion")


LEGACY = "CASE event_id % 9 WHEN 0 THEN 'BUG' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INFO' ELSE level END"


@query(
    "severity_migration",
    f"""WITH {tables.HITS_SQL}, i AS (SELECT seq AS id, seq AS event_id, rule_code, ai_generated, CASE WHEN seq % 5 = 0 THEN NULL ELSE severity END AS severity, level FROM hits),
i2 AS (SELECT * REPLACE ({LEGACY} AS level, CASE WHEN event_id % 4 = 1 THEN 'OTHER_' || rule_code ELSE rule_code END AS rule_code) FROM i),
t AS (SELECT *, level IN ('BUG', 'WARNING', 'INFO') AS legacy, {C.sql_case('rule_code', {k: v[0] for k, v in C.RULES.items()})} AS exact FROM i2),
u AS (SELECT *, CASE WHEN legacy THEN coalesce({C.sql_by_rule('rule_code', 0)}, {C.sql_case('level', C.MIGRATED)}) WHEN NOT ai_generated THEN coalesce(exact, level) ELSE level END AS new_level FROM t),
v AS (SELECT *, {C.sql_case('new_level', C.RANK)} AS new_severity FROM u)
SELECT id, new_level, new_severity, CASE WHEN new_level <> level THEN CASE WHEN legacy THEN 'LEGACY' ELSE 'REALIGNED' END WHEN severity IS DISTINCT FROM new_severity THEN 'RANK_FIXED' ELSE 'NONE' END AS outcome FROM v""",
)
def severity_migration(spark, d):
    i = F.col("seq")
    h = tables.raw_hits(spark, d)
    level = F.when(i % 9 == 0, "BUG").when(i % 9 == 1, "WARNING").when(i % 9 == 2, "INFO").otherwise(F.col("level"))
    rule = F.when(i % 4 == 1, F.concat(F.lit("OTHER_"), "rule_code")).otherwise(F.col("rule_code"))
    h = h.select(i.alias("id"), rule.alias("rule_code"), level.alias("level"), "ai_generated", F.when(i % 5 != 0, F.col("severity")).alias("severity"))
    return migrate.severity_levels(h).select("id", "new_level", "new_severity", "outcome")


@query("insert_not_exists", f"WITH {tables.TASKS_SQL} SELECT DISTINCT event_id * 2 AS id FROM events WHERE NOT EXISTS (SELECT 1 FROM tasks WHERE tasks.id = event_id * 2)")
def insert_not_exists(spark, d):
    new = tables.read(spark, d, "events").select((F.col("event_id") * 2).alias("id"))
    return issues.missing_rows(new, tables.tasks(spark, d), "id")


@query("deep_review", FLAT_SQL.rstrip() + ", r AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY severity DESC, id) AS place FROM issues WHERE NOT is_ignored AND (suggestion IS NULL OR trim(suggestion) = '')) SELECT task_id, count(*) FILTER (place <= 10) AS total, count(*) FILTER (place > 10) AS skipped FROM r GROUP BY 1")
def deep_review(spark, d):
    return issues.deep_review(flat(spark, d).withColumn("ai_suggestion", F.col("suggestion")), 10)


@query("sparse_update", FLAT_SQL + "SELECT id, CASE WHEN id % 6 = 0 THEN 'new' ELSE title END AS title, CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 'fixed' ELSE level END AS level FROM issues")
def sparse_update(spark, d):
    rows = flat(spark, d).select("id", "title", "level")
    changes = rows.filter("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "new").alias("title"), F.when(F.col("id") % 2 == 1, "fixed").alias("level"))
    return issues.sparse_update(rows, changes, "id")


@query("cascade_delete", FLAT_SQL + "SELECT task_id, count(*) AS n FROM issues WHERE task_id <> 3 GROUP BY 1")
def cascade_delete(spark, d):
    left = issues.cascade_delete(3, issues=flat(spark, d))["issues"]
    return left.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


@query("line_labels", MERGED_SQL + "SELECT task_id, file_path, rule_code, line_label FROM merged WHERE occurrence_count > 1")
def line_labels(spark, d):
    return merged(spark, d).filter("occurrence_count > 1").select("task_id", "file_path", "rule_code", T.line_label(F.col("line_points")).alias("line_label"))


@query(
    "checker_enablement",
    """WITH c AS (SELECT 'c' || s_suppkey AS checker_code, CASE s_suppkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS default_enabled FROM supplier),
s AS (SELECT 'c' || (p_partkey % 120) AS checker_code, max(p_partkey) AS last FROM part GROUP BY 1)
SELECT checker_code, default_enabled, coalesce(CASE last % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END, default_enabled, TRUE) AS is_enabled FROM c LEFT JOIN s USING (checker_code)""",
)
def checker_enablement(spark, d):
    """Suppliers as checkers, parts as their settings' rows, of which the last counts."""
    from ..operators import checkers

    k, p = F.col("s_suppkey"), F.col("p_partkey")
    known = tables.read(spark, d, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("checker_code"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("default_enabled"))
    config = tables.read(spark, d, "part").select(F.concat(F.lit("c"), (p % 120).cast("string")).alias("checker_code"), F.when(p % 7 == 0, True).when(p % 7 == 1, False).alias("is_enabled"), F.lit(None).cast("string").alias("params"), p.cast("int").alias("sort_order"))
    return checkers.enabled(known, config)


@query(
    "ai_findings",
    "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'AI_REVIEW_SUGGESTION' ELSE 'AI_SEMANTIC' END AS rule_code, CASE WHEN event_id % 5 = 0 THEN 'INFO' WHEN event_id % 2 = 0 THEN 'MAJOR' ELSE 'BLOCKER' END AS level, CASE WHEN event_id % 5 = 0 THEN 'suggestion' ELSE event_type END AS title, CASE WHEN event_id % 5 = 0 THEN 1 ELSE (event_id % 70)::INT END AS line FROM events",
)
def ai_findings(spark, d):
    from ..operators import reviews

    i = F.col("event_id")
    one = F.concat(F.lit('Found: [{"level":"'), F.when(i % 2 == 0, "warning").otherwise("blocker"), F.lit('","title":"'), F.col("event_type"), F.lit('","line":'), (i % 70).cast("string"), F.lit("}] ok"))
    answers = tables.read(spark, d, "events").select(i.alias("id"), F.when(i % 5 == 0, "use fewer calls").otherwise(one).alias("answer"))
    return reviews.findings(answers).select("id", "rule_code", "level", "title", "line")


AI_SQL = "i AS (SELECT event_id // 40 AS task_id, CASE WHEN event_id % 3 < 2 THEN ts END AS ai_at, CASE WHEN event_id % 3 = 0 THEN 'do' WHEN event_id % 3 = 1 THEN ' ' END AS s FROM events)"


def reviewed(spark, d):
    i = F.col("event_id")
    return tables.read(spark, d, "events").select(F.floor(i / 40).alias("task_id"), F.when(i % 3 < 2, F.col("ts")).alias("ai_suggestion_at"), F.when(i % 3 == 0, "do").when(i % 3 == 1, " ").alias("ai_suggestion"))


@query("last_review", f"WITH {AI_SQL} SELECT task_id, max(ai_at) AS last_ai, count(*) FILTER (trim(s) <> '') AS enhanced FROM i GROUP BY 1")
def last_review(spark, d):
    from ..operators import reviews

    return reviews.last_review(reviewed(spark, d))


@query("stale_reports", f"WITH {AI_SQL}, r AS (SELECT event_id % 250 AS task_id, 'r' || event_id AS path, ts AS modified FROM events) SELECT task_id, path FROM r JOIN (SELECT task_id, max(ai_at) AS last_ai FROM i GROUP BY 1) USING (task_id) WHERE modified < last_ai")
def stale_reports(spark, d):
    from ..operators import reviews

    r = tables.read(spark, d, "events").select((F.col("event_id") % 250).alias("task_id"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modified"))
    return reviews.stale_reports(r, reviewed(spark, d))


@query("id_lists", "WITH r AS (SELECT c_custkey AS k, c_custkey || ', ' || (c_custkey + 1) || ',x,,' || c_custkey AS ids FROM customer) SELECT k, k AS id FROM r UNION ALL SELECT k, k + 1 FROM r")
def id_lists(spark, d):
    from ..operators import reviews

    k = F.col("c_custkey").cast("string")
    rows = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(k, F.lit(", "), (F.col("c_custkey") + 1).cast("string"), F.lit(",x,,"), k).alias("ids"))
    return reviews.id_list(rows, "ids").select("k", "id")


@query("prompt_lines", "WITH " + tables.LINES_SQL + " SELECT task_id, file_path, string_agg(line, chr(10) ORDER BY line_no) AS prompt FROM lines WHERE line_no <= 3 GROUP BY ALL")
def prompt_lines(spark, d):
    from ..operators import reviews

    return reviews.prompt(tables.lines(tables.files(spark, d)), 3)


@query(
    "gate_page",
    f"WITH g AS ({gate_sql(MERGED_SQL, 'merged')}), {tables.TASKS_SQL}, newest AS (SELECT id AS own_id, id % 250 AS task_id, created_at FROM tasks ORDER BY created_at DESC, id DESC LIMIT 10) SELECT own_id, task_id, created_at, coalesce(score, 0) AS score, coalesce(grade, 'POOR') AS grade, coalesce(passed, FALSE) AS passed FROM newest LEFT JOIN g USING (task_id)",
)
def gate_page(spark, d):
    newest = issues.newest(tables.tasks(spark, d), 10).select(F.col("id").alias("own_id"), (F.col("id") % 250).alias("task_id"), "created_at")
    verdicts = quality.with_missing_tasks(quality.evaluate(merged(spark, d)), newest)
    return newest.join(verdicts.select("task_id", "score", "grade", "passed"), "task_id")


# ---------------------------------------------------------------- look-ups, listings, changes


def settings(spark, d):
    """Customers as settings: switched on or not, in categories, with places to sort by."""
    k = F.col("c_custkey")
    return tables.read(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("rule_code"), F.col("c_mktsegment").alias("rule_category"), F.col("c_name").alias("rule_name"), F.concat(F.lit("about "), F.col("c_mktsegment")).alias("description"),
        (k % 7 == 3).alias("is_active"), F.when(k % 5 != 0, (k % 11).cast("int")).alias("sort_order"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_enabled"),
    )


SETTINGS_SQL = """WITH settings AS (SELECT c_custkey AS id, c_name AS rule_code, c_mktsegment AS rule_category, c_name AS rule_name, 'about ' || c_mktsegment AS description,
  c_custkey % 7 = 3 AS is_active, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 11)::INT END AS sort_order, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_enabled FROM customer)
"""


@query("active_config", SETTINGS_SQL + "SELECT id, rule_code FROM settings WHERE is_active ORDER BY id LIMIT 1")
def active_config(spark, d):
    return issues.active_config(settings(spark, d)).select("id", "rule_code")


@query("point_lookup", SETTINGS_SQL + "SELECT id, rule_code FROM settings WHERE id = 12")
def point_lookup(spark, d):
    return issues.by_id(settings(spark, d), 12).select("id", "rule_code")


@query("rule_page", SETTINGS_SQL + "SELECT rule_code, sort_order FROM settings WHERE rule_category = 'BUILDING' AND (contains(rule_code, '0') OR contains(rule_name, '0') OR contains(description, '0')) ORDER BY sort_order NULLS FIRST, rule_code LIMIT 5 OFFSET 5")
def rule_page(spark, d):
    return issues.rule_page(settings(spark, d), "BUILDING", "0", 2, 5).select("rule_code", "sort_order")


@query("settings_listed", SETTINGS_SQL + "SELECT id, sort_order, row_number() OVER (ORDER BY sort_order NULLS FIRST, id) - 1 AS place FROM settings ORDER BY sort_order NULLS FIRST, id")
def settings_listed(spark, d):
    return issues.placed(settings(spark, d).select("id", "sort_order"), "sort_order", "id").select("id", "sort_order", "place")


@query("settings_toggled", SETTINGS_SQL + "SELECT id, CASE WHEN id = 14 THEN NOT coalesce(is_enabled, false) ELSE is_enabled END AS is_enabled FROM settings")
def settings_toggled(spark, d):
    return issues.toggled(settings(spark, d), 14).select("id", "is_enabled")


@query("issue_ignored", FLAT_SQL + "SELECT id, is_ignored OR id = 21 AS is_ignored, CASE WHEN id = 21 THEN 'SINGLE' END AS ignore_type, CASE WHEN id = 21 THEN 'known' END AS ignore_reason FROM issues")
def issue_ignored(spark, d):
    return issues.ignore_issue(flat(spark, d), 21, reason="known").select("id", "is_ignored", "ignore_type", "ignore_reason")


@query("task_reset", f"WITH {tables.TASKS_SQL} SELECT id, CASE WHEN id = 33 THEN 'PENDING' ELSE status END AS status, CASE WHEN id = 33 THEN NULL ELSE 'e' || id END AS error_message, CASE WHEN id = 33 THEN 0 ELSE id % 9 END AS major_count, CASE WHEN id = 33 THEN '/new' END AS snapshot_path FROM tasks")
def task_reset(spark, d):
    t = tables.tasks(spark, d).withColumn("error_message", F.concat(F.lit("e"), F.col("id").cast("string"))).withColumn("major_count", F.col("id") % 9).withColumn("snapshot_path", F.lit(None).cast("string"))
    return issues.reset_task(t, 33, "/new").select("id", "status", "error_message", "major_count", "snapshot_path")


RECORDS_SQL = "records AS (SELECT event_id AS id, event_id % 40 AS task_id, event_id % 3 AS trigger_id, CASE event_id % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PENDING' END AS status FROM events)"


def records(spark, d):
    i = F.col("event_id")
    return tables.read(spark, d, "events").select(i.alias("id"), (i % 40).alias("task_id"), (i % 3).alias("trigger_id"), F.when(i % 4 == 0, "SUCCESS").when(i % 4 == 1, "RUNNING").when(i % 4 == 2, "PENDING").alias("status"))


@query("record_sync", f"WITH {RECORDS_SQL} SELECT id, CASE WHEN task_id < 10 AND status <> 'SUCCESS' THEN CASE WHEN task_id % 2 = 0 THEN 'FAILED' ELSE 'SUCCESS' END ELSE status END AS status FROM records")
def record_sync(spark, d):
    ended = spark.range(10).select(F.col("id").alias("task_id"), F.when(F.col("id") % 2 == 0, "FAILED").otherwise("SUCCESS").alias("status"))
    return issues.sync_records(records(spark, d), ended).select("id", "status")


@query("record_names", f"WITH {RECORDS_SQL} SELECT id, CASE trigger_id WHEN 0 THEN 'nightly' WHEN 1 THEN 'push' END AS trigger_name FROM records")
def record_names(spark, d):
    return issues.with_trigger_names(records(spark, d), spark.createDataFrame([(0, "nightly"), (1, "push")], "id bigint, name string")).select("id", "trigger_name")


@query("level_labels", FLAT_SQL + f"SELECT id, coalesce({C.sql_case('level', C.LEVEL_LABELS)}, level) AS label, coalesce({C.sql_case('level', C.LEVEL_COLORS)}, '{C.OTHER_COLOR}') AS color FROM issues")
def level_labels(spark, d):
    level = F.lower(F.col("level"))
    return flat(spark, d).select("id", C.level_label(level).alias("label"), C.level_color(level).alias("color"))


REMERGE_SQL = (
    "WITH "
    + tables.HITS_SQL
    + """, stored AS (SELECT seq AS id, task_id, file_path, rule_code, seq % 10 = 0 AS is_ignored, line_start, line_end, severity, ai_generated, CASE WHEN seq % 9 = 4 THEN 'ai ' || seq END AS ai_suggestion, title AS description,
  CASE WHEN seq % 4 <> 0 THEN 'p' || (seq % 5) END AS partner FROM hits),
g AS (SELECT * FROM (SELECT *, bool_and(is_ignored) OVER (PARTITION BY task_id, file_path, rule_code) AS a FROM stored) WHERE is_ignored = a),
issues AS (SELECT *, line_start AS s, line_end AS e FROM g)"""
    + ISLANDS.format(src="issues")
    + """, lead AS (SELECT task_id, file_path, rule_code, is_ignored, min(id) AS id, greatest(1, max(severity)) AS severity, bool_or(ai_generated) AS ai_generated, arg_min(ai_suggestion, id) FILTER (ai_suggestion IS NOT NULL) AS ai_suggestion,
  count(*) AS occurrence_count, arg_min(description, id) AS description FROM g GROUP BY ALL),
o AS (SELECT g.task_id, g.file_path, g.rule_code, g.partner, min(g.id) AS since FROM g JOIN lead USING (task_id, file_path, rule_code) WHERE g.id <> lead.id AND g.partner IS NOT NULL GROUP BY ALL),
p AS (SELECT task_id, file_path, rule_code, string_agg(partner, ',' ORDER BY since) AS others FROM o GROUP BY ALL)
SELECT lead.id, task_id, file_path, rule_code, lead.is_ignored, lead.severity, lead.ai_generated, lead.ai_suggestion, occurrence_count, lead.description, coalesce(others, '') AS others, line_start, line_end, line_label
FROM lead JOIN pts USING (task_id, file_path, rule_code) LEFT JOIN p USING (task_id, file_path, rule_code)"""
)


@query("issues_remerged", REMERGE_SQL)
def issues_remerged(spark, d):
    i = F.col("seq")
    rows = hits(spark, d).withColumn("id", i).withColumn("line_points", F.lit(None).cast("array<struct<s:int,e:int>>")).withColumn("ai_suggestion", F.when(i % 9 == 4, F.concat(F.lit("ai "), i.cast("string"))))
    rows = rows.withColumn("description", F.col("title")).withColumn("partner", F.when(i % 4 != 0, F.concat(F.lit("p"), (i % 5).cast("string"))))
    out = govern.remerge(rows)
    names = ["id", "task_id", "file_path", "rule_code", "is_ignored", "severity", "ai_generated", "ai_suggestion", "occurrence_count", "description", "line_start", "line_end", "line_label"]
    return out.select(*names, F.array_join("other_partners", ",").alias("others"))


# ---------------------------------------------------------------- settings, reports and tables as files

#: Rules of each kind for every part: endings of paths, lines, globs and codes; few of them match.
IGNORE_ROWS = """r AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'LINE_NUMBER' WHEN 1 THEN 'FILE_PATH' WHEN 2 THEN 'FILE_PATTERN' ELSE 'RULE_CODE' END AS kind, p_partkey % 9 <> 0 AS is_enabled,
  CASE WHEN p_partkey % 4 = 0 THEN 'f' || (p_partkey % 7) WHEN p_partkey % 4 = 1 THEN 'x' || p_partkey END AS own, (p_partkey % 200 + 1)::INT AS line,
  CASE WHEN p_partkey % 4 = 2 THEN CASE WHEN p_partkey % 400 = 2 THEN '[e-g]6' ELSE '**/gen' || p_partkey || '/*.java' END END AS pattern, CASE WHEN p_partkey % 4 = 3 THEN CASE WHEN p_partkey % 500 = 3 THEN 'null_CHECK' ELSE 'CODE_' || p_partkey END END AS code FROM part)"""


@query(
    "ignore_rules_table",
    f"""WITH {tables.HITS_SQL}, {IGNORE_ROWS}, e AS (SELECT * FROM r WHERE is_enabled),
lines AS (SELECT DISTINCT own AS file_path, line AS line_start, true AS by_line FROM e WHERE kind = 'LINE_NUMBER')
SELECT seq, coalesce(by_line, false) OR (EXISTS (SELECT 1 FROM e WHERE pattern = '[e-g]6') AND file_path = 'f6') OR (EXISTS (SELECT 1 FROM e WHERE code = 'null_CHECK') AND rule_code = 'NULL_CHECK') AS is_ignored
FROM hits LEFT JOIN lines USING (file_path, line_start)""",
)
def ignore_rules_table(spark, d):
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    kind = F.when(k % 4 == 0, "LINE_NUMBER").when(k % 4 == 1, "FILE_PATH").when(k % 4 == 2, "FILE_PATTERN").otherwise("RULE_CODE")
    rules = tables.read(spark, d, "part").select(
        k.alias("id"), kind.alias("rule_type"), F.when(k % 500 == 3, "null_CHECK").otherwise(text("CODE_", k)).alias("rule_code"), F.when(k % 400 == 2, "[e-g]6").otherwise(text("**/gen", k, "/*.java")).alias("file_pattern"),
        F.when(k % 4 == 0, text("f", k % 7)).when(k % 4 == 1, text("x", k)).alias("file_path"), (k % 200 + 1).cast("int").alias("line_number"), (k % 9 != 0).alias("is_enabled"),
    )
    return govern.mark_ignored(tables.raw_hits(spark, d), rules).select("seq", "is_ignored")


LEVEL_ROWS = FLAT_SQL + "SELECT task_id, level, count(*) AS n FROM issues WHERE NOT is_ignored GROUP BY ALL"


@query("report_written", LEVEL_ROWS)
def report_written(spark, d):
    """A report's rows written as JSON lines, those of some tasks twice over, and read again."""
    at = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    rows = quality.level_counts(flat(spark, d)).select("task_id", "level", "n")
    files.write_report(rows, at)
    files.write_report(rows.filter("task_id % 2 = 0"), at)
    return files.read_report(spark, at, "level string, n bigint, task_id bigint")


@query("issues_evolved", FLAT_SQL + "SELECT id, task_id, level, NULL::VARCHAR AS note FROM issues")
def issues_evolved(spark, d):
    """An older table without a column that newer ones have."""
    at = f"{shared_dir(spark)}/issues-{uuid.uuid4().hex}"
    rows = flat(spark, d).select("id", "task_id", "level")
    files.write_issues(rows, at)
    return files.read_issues(spark, at, like=rows.limit(0).withColumn("note", F.lit(None).cast("string")))


@query(
    "markdown_comments",
    FLAT_SQL.rstrip()
    + f""", t AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {C.sql_case('level', C.RANK)} DESC, file_path, line_start, rule_code, id) AS place FROM issues WHERE NOT is_ignored),
b AS (SELECT task_id, string_agg('| ' || level || ' | ' || file_path || ' | ' || line_start || ' | ' || replace(title, '|', chr(92) || '|') || ' |', chr(10) ORDER BY place) AS rows FROM t WHERE place <= 3 GROUP BY 1)
SELECT task_id, concat_ws(chr(10) || chr(10), 'Score ' || (task_id % 100) || ' (GOOD), debt ' || task_id || 'm', rows) AS comment FROM (SELECT DISTINCT task_id FROM issues) LEFT JOIN b USING (task_id)""",
)
def markdown_comments(spark, d):
    own = flat(spark, d).withColumn("line_label", F.col("line_start").cast("string")).withColumn("rule_code", F.concat("rule_code", F.lpad(F.col("id").cast("string"), 12, "0")))
    t = F.col("task_id")
    verdicts = own.select("task_id").distinct().select(t, (t % 100).alias("score"), F.lit("GOOD").alias("grade"), F.concat(t.cast("string"), F.lit("m")).alias("debt_text"))
    return files.markdown_report(own, verdicts, 3)


COUNTED = ", ".join(f"count(*) FILTER (level = '{v}') AS {v.lower()}" for v in C.LEVELS)


@query("task_status", f"WITH {tables.TASKS_SQL}, {tables.HITS_SQL}, c AS (SELECT task_id, {COUNTED} FROM hits GROUP BY 1) SELECT id, status, 'e' || id AS error_message, CASE WHEN id % 3 > 0 THEN (id % 500)::BIGINT END AS seconds, {', '.join(f'coalesce({v.lower()}, 0) AS {v.lower()}' for v in C.LEVELS)} FROM tasks LEFT JOIN c ON task_id = id")
def task_status(spark, d):
    counts = quality.level_pivot(flat(spark, d).withColumn("is_ignored", F.lit(False)))
    begin = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    t = tables.tasks(spark, d).withColumn("error_message", F.concat(F.lit("e"), F.col("id").cast("string"))).withColumn("started_at", begin)
    t = t.withColumn("completed_at", F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.unix_timestamp(begin.cast("timestamp")) + F.col("id") % 500)))
    return issues.task_status(t, counts)


@query("task_history", f"WITH {tables.TASKS_SQL} SELECT id, project_name, status FROM tasks WHERE contains(project_name, 'URGENT') AND status = 'SUCCESS' ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 10")
def task_history(spark, d):
    t = tables.tasks(spark, d).withColumn("task_name", F.lit("task"))
    return issues.history(t, " URGENT ", "success", 2, 10).select("id", "project_name", "status")
