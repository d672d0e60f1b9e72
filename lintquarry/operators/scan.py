"""The whole scan: every checker's raw hits over a snapshot, as one union that governance takes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import lines as lines_of
from . import advisories as adv
from . import govern, java_rules, line_rules


def params_of(checker_config: DataFrame, most: int = 1000) -> dict:
    """The checkers' numbers from their settings' JSON: threshold, maxLineLength, minTokens. Settings are few; of several of a checker the
    first by sort_order counts, and what isn't JSON or a number leaves the default."""
    keys = {"complexity": "threshold", "code_style": "maxLineLength", "duplicate_code": "minTokens"}
    rows = checker_config.filter(F.col("checker_code").isin(*keys)).groupBy("checker_code").agg(F.min_by("params", F.coalesce("sort_order", F.lit(1 << 30))).alias("params"))
    value = F.coalesce(*[F.when(F.col("checker_code") == c, F.get_json_object("params", f"$.{k}")) for c, k in keys.items()]).try_cast("int")
    return {keys[r[0]]: r[1] for r in rows.select("checker_code", value).limit(most).collect() if r[1] is not None}


def line_hits(files: DataFrame, max_line_length: int = 120) -> DataFrame:
    lines = lines_of(files)
    shaped = lambda df, rule: df.select("task_id", "file_path", F.lit(rule).alias("rule_code"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.trim("line").alias("title"), F.trim("line").alias("code_snippet"))
    found = shaped(line_rules.long_lines(lines, max_line_length), "STYLE_LONG_LINE").unionByName(shaped(line_rules.todo_comments(lines), "STYLE_TODO_COMMENT"))
    return java_rules.with_rule_columns(found)


def advisory_hits(dependencies: DataFrame, advisories: DataFrame, manifest: str = "pom.xml") -> DataFrame:
    """A hit on the manifest for each dependency under an advisory, at the advisory's level."""
    found = adv.matches(adv.checkable(dependencies), advisories)
    path = F.col("file_path") if "file_path" in dependencies.columns else F.lit(manifest)
    title = F.concat_ws(":", "group_id", "artifact_id", "version")
    rows = found.select("task_id", path.alias("file_path"), "rule_code", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), title.alias("title"), F.lit(None).cast("string").alias("code_snippet"), F.col("level").alias("_level"))
    out = java_rules.with_rule_columns(rows)
    from ..functions.catalogs import rank_of

    return out.withColumn("level", F.col("_level")).withColumn("severity", rank_of(F.col("_level"))).drop("_level")


def digests(files: DataFrame) -> DataFrame:
    """task_id, file_path, digest of each file's content: what a later scan compares with."""
    return files.select("task_id", "file_path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def reread(files: DataFrame, known: DataFrame, known_read: DataFrame, params: dict | None = None) -> DataFrame:
    """java_rules.read() of a new snapshot of one source, of which only files that changed since another are parsed.

    known: the digests() of the other snapshot, known_read: its read() result, under the same rule settings. A file with the path and the content of
    a known one takes over its rows, under the new task; files that are gone leave none. Rules over all files run on the whole, as ever.
    """
    now = files.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    old = known.select("file_path", "digest").distinct()
    fresh = java_rules.read(now.join(old, ["file_path", "digest"], "left_anti").select("task_id", "file_path", "content"), params)
    same = now.join(known.select("file_path", "digest", F.col("task_id").alias("_was")), ["file_path", "digest"]).groupBy("task_id", "file_path").agg(F.min("_was").alias("_was"))
    kept = known_read.withColumnRenamed("task_id", "_was").join(same, ["file_path", "_was"]).select(*known_read.columns)
    return fresh.unionByName(kept)


def raw_hits(files: DataFrame, dependencies: DataFrame | None = None, advisories: DataFrame | None = None, params: dict | None = None, read: DataFrame | None = None) -> DataFrame:
    """Every checker's hits over Java files and their manifests' dependencies, in the columns that govern() takes, partner of a duplicate
    included. Files are parsed once, into the shared folder, a part for each relation, unless what was read of them is given (reread())."""
    params = params or {}
    if read is None:
        read = stored(java_rules.read(files, params), "kind")
    parts = [java_rules.all_hits(read, files, int(params.get("minTokens", 100))), line_hits(files, int(params.get("maxLineLength", 120)))]
    if dependencies is not None and advisories is not None:
        parts.append(advisory_hits(dependencies, advisories))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = out.withColumn("description", F.coalesce("description", "title")).withColumn("checker_name", F.col("checker_type"))
    out = out.withColumn("suggestion", F.lit(None).cast("string")).withColumn("ai_generated", F.lit(False))
    return out.withColumn("seq", F.xxhash64("rule_code", "line_start", "line_end", "title", "partner"))


def governed(files: DataFrame, review_rule: DataFrame, ignore_rules: list[dict] | DataFrame, dependencies: DataFrame | None = None, advisories: DataFrame | None = None, params: dict | None = None) -> DataFrame:
    """From a snapshot to its merged issues. The hits are stored, as merging looks at them twice and would find them twice."""
    return govern.govern(stored(raw_hits(files, dependencies, advisories, params)), review_rule, ignore_rules)
