"""Webhook deliveries: parsing by platform, and the filters that let one start a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: What the filters need of the four platforms' payloads, read in one pass.
PAYLOAD = (
    "repository struct<clone_url string>, ref string, head_commit struct<id string, author struct<username string, name string>>, "
    "pull_request struct<number string, head struct<ref string, sha string>>, project struct<git_http_url string>, checkout_sha string, after string, "
    "user struct<username string>, object_attributes struct<iid string, source_branch string>, "
    "repoUrl string, branch string, commitId string, author string, mrId string"
)


def parsed(events: DataFrame) -> DataFrame:
    """Events with repo_url, branch, commit_id, author and request_id taken from a payload of their platform; unknown platforms read as
    GENERIC; events without a repository are dropped. Works on streams."""
    p = lambda path: F.col(f"_p.{path}")
    heads = lambda c: F.when(c.startswith("refs/heads/"), F.substring(c, F.lit(12), F.length(c)))
    in_gitlab_request = p("object_attributes.iid").isNotNull()
    #             GITHUB, GITLAB, GITEE, GENERIC
    fields = {
        "repo_url": (p("repository.clone_url"), p("project.git_http_url"), p("project.git_http_url"), p("repoUrl")),
        "branch": (
            F.coalesce(p("pull_request.head.ref"), heads(p("ref"))),
            F.when(in_gitlab_request, p("object_attributes.source_branch")).otherwise(F.coalesce(heads(p("ref")), p("ref"))),
            heads(p("ref")),
            F.coalesce(p("branch"), F.lit("main")),
        ),
        "commit_id": (F.coalesce(p("pull_request.head.sha"), p("head_commit.id")), F.coalesce(p("checkout_sha"), p("after")), p("after"), p("commitId")),
        "author": (F.coalesce(p("head_commit.author.username"), p("head_commit.author.name")), p("user.username"), F.lit(None).cast("string"), p("author")),
        "request_id": (p("pull_request.number"), p("object_attributes.iid"), p("pull_request.number"), p("mrId")),
    }
    platform = F.upper("platform")
    out = events.withColumn("_p", F.from_json("payload", PAYLOAD))
    columns = [F.when(platform == "GITHUB", a).when(platform == "GITLAB", b).when(platform == "GITEE", c).otherwise(d).alias(name) for name, (a, b, c, d) in fields.items()]
    return out.select(*events.columns, *columns).filter(F.col("repo_url").isNotNull())


def branch_matches(branch: Column, patterns: list[str], legacy_glob: bool = False) -> Column:
    """Whether the branch matches one of the patterns; no branch or no pattern always does."""
    patterns = [p.strip() for p in patterns if p.strip()]
    if not patterns:
        return F.lit(True)
    out = branch.isNull()
    for p in patterns:
        out = out | branch.rlike(T.branch_glob(p, legacy_glob))
    return F.coalesce(out, F.lit(True))


def gated(events: DataFrame, triggers: list[dict], legacy_glob: bool = False) -> DataFrame:
    """Events that may start a scan: of an enabled trigger, parsable, in its repository's scope, on a branch that it wants.

    triggers: trigger_id, is_enabled, scope, branch_filter; settings, so they become one predicate and no join, on streams too.
    """
    ok = F.lit(False)
    for t in triggers:
        if t.get("is_enabled"):
            own = F.col("trigger_id") == t["trigger_id"]
            ok = ok | (own & T.in_repo_scope(F.col("repo_url"), F.lit(t.get("scope") or "")) & branch_matches(F.col("branch"), (t.get("branch_filter") or "").split(","), legacy_glob))
    return parsed(events).filter(F.coalesce(ok, F.lit(False)))


#: Triggers as a table: the versions of each, in force from from_ts until the next one.
SETTINGS = "trigger_id bigint, from_ts timestamp_ntz, is_enabled boolean, scope string, branch_filter string"


def glob_regex(pattern: Column) -> Column:
    """branch_glob() of functions.text for patterns in a column."""
    out = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|\-])", r"\\$1")
    for sign, by in (("?", "[^/]"), ("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/]*"), ("\u0001", "(.*/)?"), ("\u0002", ".*")):
        out = F.replace(out, F.lit(sign), F.lit(by))
    return F.concat(F.lit("^"), out, F.lit("$"))


def gated_by(events: DataFrame, settings: DataFrame) -> DataFrame:
    """gated() by a table of settings: each event (with ts and trigger_id) by the version of its trigger that was in force at its time."""
    until = F.lead("from_ts").over(Window.partitionBy("trigger_id").orderBy("from_ts"))
    versions = settings.withColumn("until", until).filter("is_enabled").select(F.col("trigger_id").alias("_trigger"), "from_ts", "until", F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("branch_filter", F.lit("")).alias("branch_filter"))
    rows = parsed(events)
    at = F.col("ts").cast("timestamp_ntz")
    held = (F.col("trigger_id") == F.col("_trigger")) & (at >= F.col("from_ts")) & (F.col("until").isNull() | (at < F.col("until")))
    patterns = F.filter(F.transform(F.split("branch_filter", ","), lambda p: F.trim(p)), lambda p: p != "")
    branch = F.col("branch").isNull() | (F.size(patterns) == 0) | F.exists(patterns, lambda p: F.rlike(F.col("branch"), glob_regex(p)))
    return rows.join(versions, held).filter(T.in_repo_scope(F.col("repo_url"), F.col("scope")) & branch).select(*rows.columns)
