"""Registered queries over Java sources and streams."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..operators import govern, java_rules, webhooks
from ..sources import tables
from ..streaming import events as streams
from .analysis import PARSED_SQL, TRIGGERS
from ..session import shared_dir, stored
from .registry import query

TEMPLATE = """package com.acme.{layer};
import java.io.*;
import com.acme.dao.UserDao;
public class C{k} {{
    private int bad_{k};
    public void run(String s) {{
        try {{ System.out.println(s.trim()); }} catch (Exception e) {{ }}
        int n = {number};
        {extra}
    }}
    private void unused{k}() {{ helper(); }}
    private void helper() {{ }}
}}
"""
EXTRA = ["new java.util.Random();", 'String password = "s3cr3tValue";', "for (int i = 0; i < n; i++) { if (i > 1 && n > 2 || n == 3) { n = i; } }", 'statement.executeQuery("select * from t where id = " + n);']
LAYERS = ["web", "service"]


def java_files(spark, d):
    """A Java class for each part, in variants by the key."""
    k = F.col("p_partkey")
    text = F.lit(TEMPLATE.replace("{{", "{").replace("}}", "}"))
    values = {
        "{layer}": F.when(k % 2 == 0, LAYERS[0]).otherwise(LAYERS[1]),
        "{k}": k.cast("string"),
        "{number}": F.when(k % 3 == 0, F.lit("100")).otherwise((k + 1000000).cast("string")),
        "{extra}": F.get(F.array(*map(F.lit, EXTRA)), (k % 4).cast("int")),
    }
    for name, value in values.items():
        text = F.replace(text, F.lit(name), value)
    return tables.spread(tables.read(spark, d, "part"), tables.SPREAD_ROWS).select((k % 10).alias("task_id"), F.concat(F.lit("C"), k.cast("string"), F.lit(".java")).alias("file_path"), text.alias("content"))


JAVA_SQL = """WITH p AS (SELECT p_partkey AS k, p_partkey % 10 AS task_id, 'C' || p_partkey || '.java' AS file_path FROM part), h AS (
SELECT task_id, file_path, 'STYLE_WILDCARD_IMPORT' AS rule_code, 2 AS line_start FROM p
UNION ALL SELECT task_id, file_path, 'NAMING_FIELD', 5 FROM p UNION ALL SELECT task_id, file_path, 'SYSTEM_OUT', 7 FROM p UNION ALL SELECT task_id, file_path, 'EMPTY_CATCH', 7 FROM p
UNION ALL SELECT task_id, file_path, 'MAGIC_NUMBER', 8 FROM p WHERE k % 3 <> 0
UNION ALL SELECT task_id, file_path, 'SEC_HARDCODED_SECRET', 9 FROM p WHERE k % 4 = 1 UNION ALL SELECT task_id, file_path, 'SEC_SQL_INJECTION', 9 FROM p WHERE k % 4 = 3
UNION ALL SELECT task_id, file_path, 'NULL_CHECK', 7 FROM p UNION ALL SELECT task_id, file_path, 'UNUSED_METHOD', 11 FROM p
UNION ALL SELECT task_id, file_path, 'ARCH_LAYER_SKIP', 3 FROM p WHERE k % 2 = 0)"""


def read_files(spark, d):
    return stored(java_rules.read(java_files(spark, d)), "kind")


@query("java_ast_rules", JAVA_SQL + " SELECT task_id, file_path, rule_code, line_start::INT AS line_start FROM h")
def java_ast_rules(spark, d):
    return java_rules.all_hits(read_files(spark, d)).select("task_id", "file_path", "rule_code", "line_start")


@query("java_scan_merged", JAVA_SQL + " SELECT task_id, file_path, rule_code, count(*) AS occurrence_count, min(line_start)::INT AS line_start FROM h GROUP BY ALL")
def java_scan_merged(spark, d):
    h = stored(java_rules.all_hits(read_files(spark, d)))  # merging looks at the hits twice
    h = h.withColumn("is_ignored", F.lit(False)).withColumn("description", F.col("title")).withColumn("checker_name", F.col("checker_type")).withColumn("suggestion", F.lit(None).cast("string")).withColumn("ai_generated", F.lit(False)).withColumn("seq", F.col("line_start"))
    return govern.merge(h).select("task_id", "file_path", "rule_code", "occurrence_count", "line_start")


@query(
    "complexity_methods",
    "SELECT 'C' || p_partkey || '.java' AS file_path, m AS method, CASE WHEN m = 'run' THEN CASE WHEN p_partkey % 4 = 2 THEN 6 ELSE 2 END ELSE 1 END AS complexity FROM part, (SELECT unnest(['run', 'unused', 'helper']) AS m)",
)
def complexity_methods(spark, d):
    m = java_rules.relation(java_rules.read(java_files(spark, d)), "method")
    name = F.when(F.col("method").startswith("unused"), "unused").otherwise(F.col("method"))
    return m.select("file_path", name.alias("method"), "complexity")


@query("java_unused_methods", "SELECT p_partkey % 10 AS task_id, 'com.acme.' || CASE WHEN p_partkey % 2 = 0 THEN 'web' ELSE 'service' END || '.C' || p_partkey AS class_name, 'unused' || p_partkey AS method FROM part")
def java_unused_methods(spark, d):
    from ..operators.graph import unused_methods

    read = read_files(spark, d)
    return unused_methods(java_rules.relation(read, "method"), java_rules.relation(read, "call")).select("task_id", "class_name", "method")


def _stream_dir(spark) -> str:
    """A folder of the cluster's shared storage for a stream's sink and progress."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_event_gate", PARSED_SQL + " SELECT event_id, repo_url, branch FROM parsed WHERE repo_url IS NOT NULL AND ((trigger_id = 0 AND regexp_matches(lower(repo_url), 'org0/repo0\\.git/?$') AND (branch IS NULL OR branch = 'main' OR starts_with(branch, 'release/'))) OR trigger_id = 1)")
def stream_event_gate(spark, d):
    schema = tables.read(spark, d, "events").schema
    rows = streams.event_stream(spark, f"{d}/events.parquet", schema).select("event_id", "ts", (F.col("event_id") % 3).alias("trigger_id"), *tables._webhook_columns())
    out = streams.gated_stream(rows, TRIGGERS).select("event_id", "repo_url", "branch")
    at = _stream_dir(spark)
    return streams.available_now(out, f"{at}/out", f"{at}/progress")


@query("stream_daily_trend", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts::DATE < (SELECT max(ts)::DATE FROM events) GROUP BY ALL")
def stream_daily_trend(spark, d):
    """Days that the watermark, an hour behind the newest event, has passed; the newest day isn't final."""
    schema = tables.read(spark, d, "events").schema
    rows = streams.event_stream(spark, f"{d}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.daily_counts(rows, late="1 hour").select(F.to_date("window.start").alias("day"), "event_type", "n")
    at = _stream_dir(spark)
    return streams.available_now(out, f"{at}/out", f"{at}/progress")




#: Versions of the triggers: the second ones hold from the middle day of the events on.
SETTINGS_SQL = """mid AS (SELECT date_trunc('day', min(ts)) + to_days((date_diff('day', min(ts)::DATE, max(ts)::DATE) // 2)::INT) AS middle FROM events)"""


@query(
    "stream_settings",
    PARSED_SQL
    + f""", {SETTINGS_SQL} SELECT p.event_id, repo_url, branch FROM parsed p JOIN events e USING (event_id), mid WHERE repo_url IS NOT NULL AND CASE trigger_id
  WHEN 0 THEN e.ts < middle AND regexp_matches(lower(repo_url), 'org0/repo0\\.git/?$') AND (branch IS NULL OR branch = 'main' OR starts_with(branch, 'release/'))
  WHEN 1 THEN e.ts < middle OR branch IS NULL OR branch = 'main' ELSE e.ts >= middle END""",
)
def stream_settings(spark, d):
    """A trigger that is switched off, one that gets a filter and one that is switched on, in the middle of the events."""
    at = _stream_dir(spark)
    first, last = tables.read(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    mid = datetime(first.year, first.month, first.day) + timedelta(days=(last.date() - first.date()).days // 2)
    begin = datetime(1970, 1, 1)
    versions = [(0, begin, True, "org0/repo0", "main,release/**"), (0, mid, False, None, None), (1, begin, True, None, None), (1, mid, True, "", "main"), (2, begin, False, None, None), (2, mid, True, None, " ")]
    spark.createDataFrame(versions, webhooks.SETTINGS).write.parquet(f"{at}/settings")
    schema = tables.read(spark, d, "events").schema
    rows = streams.event_stream(spark, f"{d}/events.parquet", schema).select("event_id", "ts", (F.col("event_id") % 3).alias("trigger_id"), *tables._webhook_columns())
    return streams.gated_by_table(rows, f"{at}/settings", f"{at}/out", f"{at}/progress").select("event_id", "repo_url", "branch")


STATUS_SQL = "s AS (SELECT user_id AS record_id, ts, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN 'SUCCESS' ELSE 'RUNNING' END WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM events WHERE user_id IS NOT NULL)"


@query("stream_record_states", f"WITH {STATUS_SQL} SELECT record_id, CASE WHEN bool_or(status = 'SUCCESS') THEN 'SUCCESS' ELSE arg_max(status, (ts, status)) END AS status FROM s GROUP BY 1")
def stream_record_states(spark, d):
    """The last state of each record from a stream whose batches come out of the order of their events."""
    at = _stream_dir(spark)
    won = F.when(F.col("event_id") % 7 == 0, "SUCCESS").otherwise("RUNNING")
    status = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "purchase", won).when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
    rows = tables.read(spark, d, "events").select(F.col("user_id").alias("record_id"), status.alias("status"), "ts", F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("part"))
    rows.repartition(4, "part").drop("part").write.parquet(f"{at}/events")
    events = streams.event_stream(spark, f"{at}/events", spark.read.parquet(f"{at}/events").schema, files_per_trigger=1)
    out = streams.available_now(streams.record_status_stream(events, late="3650 days"), f"{at}/out", f"{at}/progress")
    return out.groupBy("record_id").agg(F.max_by("status", "n").alias("status"))
