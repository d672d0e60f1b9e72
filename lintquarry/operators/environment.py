"""What a project is made of: sizes, root package, frameworks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalogs import FRAMEWORKS
from ..functions.text import is_code_line


def line_stats(lines: DataFrame) -> DataFrame:
    """Files, lines and code lines of each task; files are counted from their lines by two partial aggregations."""
    files = lines.groupBy("task_id", "file_path").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_code_line(F.col("line"))).alias("c"))
    return files.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_lines"), F.sum("c").alias("n_code_lines"))


def code_stats(lines: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """line_stats() of each task with its numbers of types and methods; constructors are no methods."""
    n_types = types.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_classes"))
    n_methods = methods.filter(~F.col("is_ctor")).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_methods"))
    return line_stats(lines).join(n_types, "task_id", "left").join(n_methods, "task_id", "left").fillna(0, ["n_classes", "n_methods"])


def root_package(packages: DataFrame) -> DataFrame:
    """The longest common beginning, in whole segments, of the packages of each task.

    The least and the greatest package, as arrays of segments, have the same common beginning as all of them.
    """
    parts = F.split("pkg", r"\.")
    ends = packages.groupBy("task_id").agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), lambda i: F.slice("lo", F.lit(1), i) == F.slice("hi", F.lit(1), i))
    n = F.size(F.filter(same, lambda x: x))
    return ends.select("task_id", F.array_join(F.slice("lo", F.lit(1), n), ".").alias("root_package"))


def frameworks(dependencies: DataFrame) -> DataFrame:
    """Rows task_id, framework of the frameworks that a task's artifacts show."""
    found = F.array_compact(F.array(*[F.when(F.col("artifact_id").isin(*artifacts), F.lit(name)) for name, artifacts in FRAMEWORKS.items()]))
    return dependencies.select("task_id", F.explode(found).alias("framework")).distinct()


def package_declarations(lines: DataFrame) -> DataFrame:
    """Each file's package: of its first package line before a type's line."""
    t = F.trim("line")
    kind = F.when(t.startswith("package "), 1).when(t.rlike(r"^(public\s+|final\s+|abstract\s+)*(class|interface|enum|record|@interface)\b"), 2)
    first = lines.withColumn("kind", kind).filter(F.col("kind").isNotNull()).groupBy("task_id", "file_path").agg(F.min_by(F.struct("kind", "line"), "line_no").alias("f"))
    return first.filter("f.kind = 1").select("task_id", "file_path", F.regexp_extract("f.line", r"package\s+([\w.]+)", 1).alias("pkg"))
