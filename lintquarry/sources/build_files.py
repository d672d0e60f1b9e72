"""Dependencies from build files, and counts from test output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POM = r"<groupId>\s*([^<]+?)\s*</groupId>\s*<artifactId>\s*([^<]+?)\s*</artifactId>(?:\s*<version>\s*([^<]+?)\s*</version>)?(?:\s*<scope>\s*([^<]+?)\s*</scope>)?"
#: Gradle configurations that name a dependency (fixed values).
_GRADLE = r"(implementation|api|compile|compileOnly|runtimeOnly|testImplementation)\s+[\"']([^:\"']+):([^:\"']+):?([^\"']*)[\"']"


def _group(text, pattern: str, i: int):
    found = F.regexp_extract(text, pattern, i)
    return F.when(found != "", found)


def pom_dependencies(files: DataFrame) -> DataFrame:
    """Rows task_id, group_id, artifact_id, version, scope of POM texts: elements in their usual order, the version may be
    missing; a parent comes first, with scope parent."""
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)(<(?:parent|dependency)>.*?</(?:parent|dependency)>)"), 1)
    rows = files.select("task_id", F.posexplode(blocks).alias("n", "block"))
    g = lambda i: _group(F.col("block"), _POM, i)
    scope = F.when(F.col("block").startswith("<parent>"), "parent").otherwise(F.coalesce(g(4), F.lit("compile")))
    return rows.select("task_id", g(1).alias("group_id"), g(2).alias("artifact_id"), g(3).alias("version"), scope.alias("scope")).filter(F.col("artifact_id").isNotNull())


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """Rows of Gradle texts: one configuration and coordinate a line."""
    lines = files.select("task_id", F.explode(F.split("content", r"\r?\n")).alias("line"))
    g = lambda i: _group(F.col("line"), _GRADLE, i)
    line = F.col("line")  # the scope goes by what the line holds anywhere
    scope = F.when(line.contains("test"), "test").when(line.contains("runtime"), "runtime").when(line.contains("compileOnly"), "provided").otherwise("compile")
    return lines.select("task_id", g(2).alias("group_id"), g(3).alias("artifact_id"), g(4).alias("version"), scope.alias("scope")).filter(F.col("artifact_id").isNotNull())


def nearest_build_file(files: DataFrame) -> DataFrame:
    """Each task's build file: pom.xml before Gradle's, the least deep first, then by path; no deeper than two folders."""
    name = F.substring_index("file_path", "/", -1)
    depth = F.size(F.split("file_path", "/")) - 1
    kind = F.when(name == "pom.xml", 0).when(name.isin("build.gradle", "build.gradle.kts"), 1)
    found = files.withColumn("kind", kind).withColumn("depth", depth).filter(F.col("kind").isNotNull() & (F.col("depth") <= 2))
    return found.groupBy("task_id").agg(F.min_by(F.struct("file_path", "content"), F.struct("kind", "depth", "file_path")).alias("f")).select("task_id", "f.*")


def test_counts(outputs: DataFrame) -> DataFrame:
    """Sums over all "Tests run" lines of an output: id, run, failures, errors, skipped, passed."""
    pattern = r"Tests run:\s*(\d+),\s*Failures:\s*(\d+),\s*Errors:\s*(\d+),\s*Skipped:\s*(\d+)"
    total = lambda i: F.aggregate(F.regexp_extract_all("output", F.lit(pattern), i), F.lit(0), lambda a, x: a + x.cast("int"))
    out = outputs.select("id", total(1).alias("run"), total(2).alias("failures"), total(3).alias("errors"), total(4).alias("skipped"))
    return out.withColumn("passed", F.col("run") - F.col("failures") - F.col("errors"))


def gradle_test_counts(outputs: DataFrame) -> DataFrame:
    """The first "N tests completed" of an output; where it tells of a failure, a tenth of N, at least 1, counts as failed."""
    n = F.coalesce(F.regexp_extract("output", r"(\d+) tests? completed", 1).try_cast("int"), F.lit(0))
    failed = F.when(F.col("output").rlike("FAILED|FAILURE"), F.greatest(F.lit(1), F.floor(n / 10).cast("int"))).otherwise(0)
    return outputs.select("id", n.alias("run"), failed.alias("failures")).withColumn("passed", F.greatest(F.lit(0), F.col("run") - F.col("failures")))
