"""Rules that need only the lines of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Names that suggest a secret, values that stand for one.
SECRET_NAME = r"(?i)(password|passwd|pwd|secret|apikey|api_key|accesskey|access_key|token|credential|privatekey|private_key)"
PLACEHOLDER = r"(?i)^\s*$|\$\{|^__\w+__$|^(null|none|empty|undefined|example|sample|placeholder|your[-_]?|changeme|todo|test|xxx+|\*+|<[^>]*>|\{\{).*"


def first_per_file(hits: DataFrame, n: int = 10, order: str = "line_no") -> DataFrame:
    """The first n hits of each file of a task, in document order."""
    rank = F.row_number().over(Window.partitionBy("task_id", "file_path").orderBy(order))
    return hits.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def long_lines(lines: DataFrame, limit: int = 120, per_file: int = 10) -> DataFrame:
    """Lines over the limit that stay over it with their longest literal emptied."""
    size = T.utf16_length(F.col("line"))
    over = lines.withColumn("size", size).filter(F.col("size") > limit)
    literal = T.longest_literal(F.col("line"))
    over = over.filter(F.col("size") - F.greatest(literal - 2, F.lit(0)) > limit)
    return first_per_file(over, per_file)


def todo_comments(lines: DataFrame, per_file: int = 10) -> DataFrame:
    found = F.col("line").rlike(r"//(.*[^A-Za-z0-9_])?(TODO|FIXME)([^A-Za-z0-9_]|$)|/\*+\s*(TODO|FIXME)([^A-Za-z0-9_]|$)")
    return first_per_file(lines.filter(found), per_file)


def secrets(lines: DataFrame) -> DataFrame:
    """Assignments of a literal to a name that suggests a secret: rows with name and value.

    Exempt: short values, placeholders, public addresses under an address's name, values that repeat a word of the name.
    """
    pattern = r"([A-Za-z_][A-Za-z0-9_.]*)\s*[=:]\s*[\"']([^\"']*)[\"']"
    out = lines.withColumn("name", F.regexp_extract("line", pattern, 1)).withColumn("value", F.regexp_extract("line", pattern, 2))
    return out.filter(is_secret(F.col("name"), F.col("value")))


def is_secret(name: Column, value: Column) -> Column:
    """Whether a literal under a name is a secret: of lines and of trees alike."""
    address = name.rlike("(?i)(url|uri|endpoint)") & value.rlike("(?i)^https?://") & ~value.rlike("(?i)^https?://[^/]*@")
    words = T.significant_words(value)
    echo = (F.size(words) >= 2) & F.arrays_overlap(words, T.significant_words(name))
    found = (name != "") & name.rlike(SECRET_NAME) & (T.utf16_length(value) >= 6) & ~value.rlike(PLACEHOLDER)
    return F.coalesce(found & ~address & ~F.coalesce(echo, F.lit(False)), F.lit(False))


# Naming patterns of each kind of name.
CLASS_NAME, METHOD_NAME, CONSTANT_NAME = r"^[A-Z][a-zA-Z0-9]*$", r"^[a-z][a-zA-Z0-9]*$", r"^[A-Z][A-Z0-9_]*$"


def naming(names: DataFrame) -> DataFrame:
    """Names that break their kind's pattern, with the rule: kind is class, method, field, constant or variable."""
    name, kind = F.col("name"), F.col("kind")
    rule = (
        F.when((kind == "class") & ~name.rlike(CLASS_NAME), "NAMING_CLASS")
        .when((kind == "method") & (name != "main") & ~name.rlike(METHOD_NAME), "NAMING_METHOD")
        .when((kind == "field") & ~name.rlike(METHOD_NAME), "NAMING_FIELD")
        .when((kind == "constant") & ~name.rlike(CONSTANT_NAME), "NAMING_CONSTANT")
        .when((kind == "variable") & (F.length(name) != 1) & ~name.rlike(METHOD_NAME), "NAMING_VARIABLE")
    )
    return names.withColumn("rule_code", rule).filter(F.col("rule_code").isNotNull())


# Layers by package segment, and by the end of a class's name.
LAYER_SEGMENT = {
    "controller": "controller", "controllers": "controller", "web": "controller", "rest": "controller", "endpoint": "controller", "endpoints": "controller",
    "service": "service", "services": "service",
    "mapper": "dao", "mappers": "dao", "dao": "dao", "repository": "dao", "repositories": "dao",
    "entity": "entity", "entities": "entity", "domain": "entity", "po": "entity", "model": "entity", "models": "entity",
}
LAYER_SUFFIX = {"Controller": "controller", "Resource": "controller", "Endpoint": "controller", "ServiceImpl": "service", "Service": "service", "Mapper": "dao", "Dao": "dao", "Repository": "dao"}


def layer_of(package, simple_name=None):
    """The layer of a package: that of its first segment that names one; else, with a class name, of the name's end."""
    from ..functions.catalogs import lookup

    found = F.filter(F.transform(F.split(F.lower(package), r"\."), lambda s: lookup(LAYER_SEGMENT, s)), lambda x: x.isNotNull())
    out = F.get(found, F.lit(0))
    if simple_name is not None:
        for end in sorted(LAYER_SUFFIX, key=len, reverse=True):
            out = F.coalesce(out, F.when(simple_name.endswith(end), F.lit(LAYER_SUFFIX[end])))
    return out


def layer_rules(imports: DataFrame) -> DataFrame:
    """Imports that break the layers: own_package, pkg, simple_name -> rule_code. Only imports of the same root (two segments) count."""
    root = F.concat(F.substring_index("own_package", ".", 2), F.lit("."))
    out = imports.filter(F.concat("pkg", F.lit(".")).startswith(root))
    out = out.withColumn("from_layer", layer_of(F.col("own_package"))).withColumn("to_layer", layer_of(F.col("pkg"), F.col("simple_name")))
    a, b = F.col("from_layer"), F.col("to_layer")
    rule = (
        F.when((a == "controller") & (b == "dao"), "ARCH_LAYER_SKIP")
        .when(a.isin("service", "dao") & (b == "controller"), "ARCH_LAYER_REVERSE")
        .when((a == "entity") & b.isin("controller", "service", "dao"), "ARCH_ENTITY_LEAK")
    )
    return out.withColumn("rule_code", rule).filter(F.col("rule_code").isNotNull())
