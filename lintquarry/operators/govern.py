"""From raw hits to issues: rule settings, ignore rules, merging."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.catalogs import LEVELS, RANK, lookup, suggestion_of_rule
from ..session import checkpointed, ship
from .intervals import coalesced

GROUP = ["task_id", "file_path", "rule_code"]


def apply_rule_settings(hits: DataFrame, review_rule: DataFrame) -> DataFrame:
    """Hits of rules that aren't switched off, at the level that the rule's row asks for.

    Only ``false`` switches a rule off; only a level's exact name overrides, and then severity follows. The settings, a row for each rule, go to the
    hits: by their code the hits would stand in as many tasks as there are codes, most of them in one, and stay there for all that follows.
    """
    rules = review_rule.groupBy("rule_code").agg(F.max_by("is_enabled", "sort_order").alias("_on"), F.max_by("default_level", "sort_order").alias("_level"))
    out = hits.join(F.broadcast(rules), "rule_code", "left").filter(~F.col("_on").eqNullSafe(False))
    override = F.when(F.col("_level").isin(*LEVELS), F.col("_level"))
    return out.withColumn("severity", F.coalesce(lookup(RANK, override), "severity")).withColumn("level", F.coalesce(override, "level")).drop("_on", "_level")


def ignore_condition(rules: list[dict], path: Column, rule_code: Column, line: Column) -> Column:
    """Whether any of the enabled ignore rules matches. The rules are settings, a list on the driver: globs become regular expressions
    once, and the whole set is one predicate without a join."""
    out = F.lit(False)
    for r in rules:
        if not r.get("is_enabled"):
            continue
        kind, own = (r.get("rule_type") or "").upper(), r.get("file_path")
        at = path.endswith(own) if own is not None else F.lit(False)
        if kind == "LINE_NUMBER" and own is not None and r.get("line_number") is not None:
            out = out | (at & (line == r["line_number"]))
        elif kind == "FILE_PATH":
            out = out | at
        elif kind == "FILE_PATTERN" and r.get("file_pattern") is not None:
            out = out | path.rlike(T.path_glob(r["file_pattern"]))
        elif kind == "RULE_CODE" and r.get("rule_code") is not None:
            out = out | (F.lower(rule_code) == r["rule_code"].lower())
    return F.coalesce(out, F.lit(False))


def mark_ignored(hits: DataFrame, rules: list[dict] | DataFrame) -> DataFrame:
    """hits with is_ignored. Rules as a list become one predicate, which suits a few; as a table they are joined, however many there are."""
    if isinstance(rules, DataFrame):
        return _marked_by_table(hits, rules)
    return hits.withColumn("is_ignored", ignore_condition(rules, F.col("file_path"), F.col("rule_code"), F.col("line_start")))


#: Characters of the pieces of a glob's literal text that it is looked up by.
GRAM = 4
_SIGNS = re.compile(r"\*+|\?|\[.[^\]]*\]|\{.*\}|\\.")


def _glob_parts(pattern: str) -> tuple[str, list[str]]:
    """A glob's regular expression, and the pieces of its literal text: every path that it matches holds each of them."""
    runs = [r for r in _SIGNS.split(pattern) if r]
    longest = max(map(len, runs), default=0)
    n = min(GRAM, longest)
    return T.path_glob(pattern), sorted({r[i : i + n] for r in runs for i in range(len(r) - n + 1)} if n else {""})


def pattern_matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of the paths (file_path, each once) those that one of the patterns (pattern) matches.

    A pattern is looked up by that piece of its literal text which fewest patterns share; only paths that hold the piece meet it, and the
    regular expression decides.
    """
    @F.arrow_udf("struct<regex:string,grams:array<string>>")
    def parts(texts: pa.Array) -> pa.Array:
        made = [_glob_parts(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r for r, _ in made], pa.string()), pa.array([g for _, g in made], pa.list_(pa.string()))], ["regex", "grams"])

    ship(paths.sparkSession)
    rules = checkpointed(patterns.select("pattern").distinct().select("pattern", parts("pattern").alias("p")).select("pattern", "p.regex", F.explode("p.grams").alias("gram")))
    shared = rules.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    by_rarest = rules.join(shared, "gram").groupBy("pattern", "regex").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    by_rarest = checkpointed(by_rarest.withColumn("size", F.length("gram")))
    sizes = [r[0] for r in by_rarest.select("size").distinct().collect()]  # GRAM + 1 values at most
    path = F.col("file_path")
    grams = lambda n: F.array(F.lit("")) if n == 0 else F.when(F.length(path) >= n, F.transform(F.sequence(F.lit(1), F.length(path) - n + 1), lambda i: path.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    held = paths.select("file_path", F.explode(F.array_distinct(F.concat(*map(grams, sizes)))).alias("gram")) if sizes else paths.select("file_path", F.lit(None).cast("string").alias("gram"))
    return held.join(by_rarest, "gram").filter(F.rlike(path, F.col("regex"))).select("file_path").distinct()


def _marked_by_table(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Names and paths are equal to something that a rule asks for: a code, an ending of the path of a length that some rule has, a path and a line."""
    on = rules.filter("is_enabled").withColumn("kind", F.upper("rule_type"))
    codes = on.filter("kind = 'RULE_CODE'").select(F.lower("rule_code").alias("_code")).filter("_code IS NOT NULL").distinct().withColumn("_by_code", F.lit(True))
    ends = checkpointed(on.filter("file_path IS NOT NULL AND (kind = 'FILE_PATH' OR kind = 'LINE_NUMBER' AND line_number IS NOT NULL)").select(F.col("file_path").alias("ending"), F.when(F.col("kind") == "LINE_NUMBER", F.col("line_number")).alias("line")).distinct())
    sizes = [r[0] for r in ends.select(F.length("ending")).distinct().collect()]  # no more than a path has characters
    paths = checkpointed(hits.select("file_path").filter("file_path IS NOT NULL").distinct())
    path = F.col("file_path")
    endings = F.filter(F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: F.when(F.length(path) >= n, F.struct(F.right(path, n).alias("ending")))), lambda x: x.isNotNull())
    found = checkpointed(paths.select("file_path", F.explode(endings).alias("x")).select("file_path", "x.ending").join(ends, "ending").select("file_path", "line").distinct())
    globs = on.filter("kind = 'FILE_PATTERN' AND file_pattern IS NOT NULL").select(F.col("file_pattern").alias("pattern"))
    whole = found.filter("line IS NULL").select("file_path").union(pattern_matches(paths, globs)).distinct().withColumn("_by_path", F.lit(True))
    lines = found.filter("line IS NOT NULL").select("file_path", F.col("line").alias("line_start")).withColumn("_by_line", F.lit(True))
    out = hits.withColumn("_code", F.lower("rule_code")).join(codes, "_code", "left").join(whole, "file_path", "left").join(lines, ["file_path", "line_start"], "left")
    return out.withColumn("is_ignored", F.coalesce("_by_code", "_by_path", "_by_line", F.lit(False))).select(*hits.columns, "is_ignored")


def merge(hits: DataFrame, order: str = "seq") -> DataFrame:
    """One issue for each task, file and rule, from hits with is_ignored.

    If any hit of a group is active only the active ones count, else all do and the issue is ignored. The earliest line's hit
    gives level, title and checker; the worst severity counts; the first texts that aren't blank are kept; lines are
    merged into intervals. ``order`` numbers the hits in the order in which they were found.
    """
    some = F.min("is_ignored").over(Window.partitionBy(*GROUP))
    kept = hits.withColumn("_all", some).filter(F.col("is_ignored") == F.col("_all")).drop("_all")
    s = F.greatest(F.lit(1), F.coalesce("line_start", F.lit(0)))
    kept = kept.withColumn("s", s).withColumn("e", F.greatest(s, F.coalesce("line_end", F.lit(0))))
    first = F.struct("line_start", order)
    text = lambda c: F.min_by(c, F.when(T.not_blank(F.col(c)), F.col(order)))
    groups = kept.groupBy(*GROUP, "is_ignored").agg(
        F.min_by("level", first).alias("level"),
        F.min_by("title", first).alias("title"),
        F.min_by("description", first).alias("description"),
        F.min_by("checker_type", first).alias("checker_type"),
        F.min_by("checker_name", first).alias("checker_name"),
        F.greatest(F.lit(1), F.max("severity")).alias("severity"),
        F.coalesce(F.max("ai_generated"), F.lit(False)).alias("ai_generated"),
        F.count(F.lit(1)).alias("occurrence_count"),
        text("code_snippet").alias("code_snippet"),
        text("suggestion").alias("suggestion"),
    )
    points = coalesced(kept, GROUP).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("line_points"), F.min("s").alias("line_start"), F.max("e").alias("line_end"))
    out = groups.join(points, GROUP)
    out = out.withColumn("suggestion", F.coalesce("suggestion", suggestion_of_rule(F.col("rule_code"))))
    out = out.withColumn("ignore_type", F.when(F.col("is_ignored"), "RULE"))
    label = T.line_label(F.col("line_points"))
    return out.withColumn("line_label", label)


def remerge(issues: DataFrame) -> DataFrame:
    """Stored issues, one for each task, file and rule: groups of one stay as they are.

    Of a group the active ones count, or all if none is; the one of the least id stands for it, with the group's lines merged, their number, the
    worst severity, AI's part if any had one, the first AI suggestion by id, and for duplicates the partners of the others, each once, in
    order of their ids. issues: id, task_id, file_path, rule_code, is_ignored, line_start, line_end, line_points (array of s, e; null: the
    lines themselves), severity, ai_generated, ai_suggestion, description, partner.
    """
    some = F.min("is_ignored").over(Window.partitionBy(*GROUP))
    kept = issues.withColumn("is_ignored", F.coalesce("is_ignored", F.lit(False))).withColumn("_all", some).filter(F.col("is_ignored") == F.col("_all")).drop("_all")
    own = F.when(F.col("line_start").isNotNull(), F.array(F.struct(F.col("line_start").alias("s"), F.coalesce("line_end", "line_start").alias("e"))))
    points = kept.withColumn("_p", F.coalesce(F.when(F.size("line_points") > 0, F.col("line_points")), own)).select(*GROUP, F.explode("_p").alias("p")).select(*GROUP, "p.s", "p.e")
    merged = coalesced(points, GROUP).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("points"))
    first = lambda c: F.min_by(c, "id")
    groups = kept.groupBy(*GROUP, "is_ignored").agg(
        F.min("id").alias("id"),
        F.greatest(F.lit(1), F.max("severity")).alias("severity"),
        F.coalesce(F.max("ai_generated"), F.lit(False)).alias("ai_generated"),
        F.coalesce(first("ai_suggestion"), F.min_by("ai_suggestion", F.when(F.col("ai_suggestion").isNotNull(), F.col("id")))).alias("ai_suggestion"),
        F.count(F.lit(1)).alias("occurrence_count"),
        first("description").alias("description"),
        first("partner").alias("partner"),
    )
    # the partners of the others: each once, at the first id that names it
    lead = groups.select(*GROUP, F.col("id").alias("_lead"))
    others = kept.join(lead, GROUP).filter((F.col("id") != F.col("_lead")) & F.col("partner").isNotNull()).groupBy(*GROUP, "partner").agg(F.min("id").alias("at"))
    others = others.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "partner"))), lambda x: x["partner"]).alias("other_partners"))
    out = groups.join(merged, GROUP, "left").join(others, GROUP, "left")
    return out.select(
        "id", *GROUP, "is_ignored", "severity", "ai_generated", "ai_suggestion", "occurrence_count", "description", "partner", F.coalesce("other_partners", F.array().cast("array<string>")).alias("other_partners"),
        F.col("points")[0]["s"].alias("line_start"), F.element_at("points", -1)["e"].alias("line_end"), T.line_label(F.col("points")).alias("line_label"),
    )


def govern(hits: DataFrame, review_rule: DataFrame, ignore_rules: list[dict] | DataFrame, order: str = "seq") -> DataFrame:
    """Rule settings, ignore rules, merging: in this order."""
    return merge(mark_ignored(apply_rule_settings(hits, review_rule), ignore_rules), order)
