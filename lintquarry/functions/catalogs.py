"""Levels, severities, debt and advisories: the engine's constant tables and the functions that read them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Levels from the worst to the least.
LEVELS = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
RANK = {"BLOCKER": 5, "CRITICAL": 4, "MAJOR": 3, "MINOR": 2, "INFO": 1}
# What older level names stand for when a level is read, and when stored rows are migrated.
ALIASES = {"BUG": "CRITICAL", "WARNING": "MAJOR", "INFO": "INFO"}
MIGRATED = {"BUG": "CRITICAL", "WARNING": "MAJOR", "INFO": "MINOR"}

# Level and debt minutes of each rule.
RULES = {
    "SEC_HARDCODED_SECRET": ("BLOCKER", 30),
    "SEC_SQL_INJECTION": ("BLOCKER", 60),
    "SEC_COMMAND_INJECTION": ("BLOCKER", 60),
    "SEC_INSECURE_DESERIALIZATION": ("BLOCKER", 45),
    "SEC_WEAK_CRYPTO": ("CRITICAL", 30),
    "SEC_INSECURE_RANDOM": ("CRITICAL", 20),
    "SEC_PATH_TRAVERSAL": ("CRITICAL", 30),
    "SEC_XXE": ("CRITICAL", 20),
    "SEC_SSRF": ("CRITICAL", 30),
    "NULL_CHECK": ("CRITICAL", 15),
    "NULL_CHAIN_CALL": ("MAJOR", 20),
    "RESOURCE_LEAK": ("CRITICAL", 20),
    "EMPTY_CATCH": ("MAJOR", 10),
    "MAX_COMPLEXITY": ("MAJOR", 30),
    "DEPRECATED_CLASS": ("MINOR", 15),
    "DEPRECATED_METHOD_DECL": ("MINOR", 15),
    "DEPRECATED_METHOD_CALL": ("MINOR", 15),
    "UNUSED_METHOD": ("MAJOR", 20),
    "MAGIC_NUMBER": ("MINOR", 5),
    "SYSTEM_OUT": ("MAJOR", 10),
    "STYLE_WILDCARD_IMPORT": ("INFO", 5),
    "STYLE_LONG_LINE": ("MINOR", 5),
    "STYLE_TODO_COMMENT": ("INFO", 5),
    "NAMING_CLASS": ("MAJOR", 5),
    "NAMING_METHOD": ("MINOR", 5),
    "NAMING_FIELD": ("MINOR", 5),
    "NAMING_CONSTANT": ("INFO", 5),
    "NAMING_VARIABLE": ("INFO", 5),
    "CONC_SHARED_MUTABLE_STATE": ("MAJOR", 20),
    "CONC_STATIC_SDF": ("MAJOR", 15),
    "CONC_DCL_WITHOUT_VOLATILE": ("MAJOR", 20),
    "ARCH_LAYER_SKIP": ("MAJOR", 20),
    "ARCH_LAYER_REVERSE": ("MAJOR", 20),
    "ARCH_ENTITY_LEAK": ("MAJOR", 20),
    "DUP_CODE_BLOCK": ("MAJOR", 20),
}
# Level and debt minutes of rules known by their beginning alone.
PREFIXES = {
    "DEP_VULN_": ("CRITICAL", 60),
    "SEC_": ("CRITICAL", 30),
    "ARCH_": ("MAJOR", 20),
    "CONC_": ("MAJOR", 20),
    "STYLE_": ("MINOR", 5),
    "NAMING_": ("MINOR", 5),
    "AI_": ("INFO", 15),
}
DEFAULT_MINUTES = 10

#: What to do about a finding of each rule (the engine's own wording).
SUGGESTIONS = {
    "NULL_CHECK": "Check for null before the call, or require a non-null value.",
    "NULL_CHAIN_CALL": "Split the chain and check the link that may be null.",
    "RESOURCE_LEAK": "Open the resource in a try-with-resources statement.",
    "EMPTY_CATCH": "Log the exception, or say in a comment why it is ignored.",
    "MAX_COMPLEXITY": "Split the method; return early; replace branches by a table.",
    "MAGIC_NUMBER": "Give the number a name as a constant.",
    "DEPRECATED_METHOD_CALL": "Call what the deprecation note names instead.",
    "DEPRECATED_METHOD_DECL": "Say since when, whether it will go, and what to call instead.",
    "DEPRECATED_CLASS": "Use what the deprecation note names instead.",
    "NAMING_CLASS": "Name the class in upper camel case.",
    "NAMING_METHOD": "Name the method in lower camel case, a verb first.",
    "NAMING_VARIABLE": "Name the variable in lower camel case, for what it holds.",
    "NAMING_FIELD": "Name the field in lower camel case.",
    "NAMING_CONSTANT": "Name the constant in capitals with underscores.",
    "SYSTEM_OUT": "Use a logger.",
    "UNUSED_METHOD": "Delete the method, or say who calls it.",
    "DUP_CODE_BLOCK": "Move the common block into a method of its own.",
    "STYLE_WILDCARD_IMPORT": "Import each class by name.",
    "STYLE_LONG_LINE": "Break the line.",
    "STYLE_TODO_COMMENT": "Name a person and a plan, or finish the work.",
}

# Advisories (id, CVE, group, artifact, introduced, fixed, severity).
ADVISORIES = [
    ("GHSA-jfh8-c2jp-5v3q", "CVE-2021-44228", "org.apache.logging.log4j", "log4j-core", None, "2.17.1", "CRITICAL"),
    ("GHSA-2qrg-x229-3hv8", "CVE-2021-42550", "ch.qos.logback", "logback-classic", None, "1.2.9", "HIGH"),
    ("GHSA-7p7h-4mm5-8chv", "CVE-2022-25845", "com.alibaba", "fastjson", None, "1.2.83", "CRITICAL"),
    ("GHSA-57j2-w4cx-62h2", "CVE-2022-42003", "com.fasterxml.jackson.core", "jackson-databind", None, "2.13.4.2", "HIGH"),
    ("GHSA-3fjj-h79j-c9hh", "CVE-2022-42889", "org.apache.commons", "commons-text", None, "1.10.0", "CRITICAL"),
    ("GHSA-6h36-q9x5-v658", "CVE-2015-7501", "commons-collections", "commons-collections", "3.0", "3.2.2", "HIGH"),
    ("GHSA-hmmr-38wq-43m7", "CVE-2015-6420", "org.apache.commons", "commons-collections4", None, "4.1", "HIGH"),
    ("GHSA-36p3-wjmg-h94x", "CVE-2022-22965", "org.springframework", "spring-beans", None, "5.3.18", "CRITICAL"),
    ("GHSA-4w4v-5hc9-xrr2", "CVE-2023-20861", "org.springframework", "spring-core", None, "5.3.27", "MEDIUM"),
    ("GHSA-ccgv-vj62-xf9h", "CVE-2024-22243", "org.springframework", "spring-web", None, "5.3.32", "HIGH"),
    ("GHSA-q4v4-3mv2-34v2", "CVE-2022-31692", "org.springframework.security", "spring-security-core", "5.7.0", "5.7.5", "HIGH"),
    ("GHSA-6476-m2qq-7p97", "CVE-2022-22947", "org.springframework.cloud", "spring-cloud-gateway-core", None, "3.1.1", "CRITICAL"),
    ("GHSA-5aa2-6863-g98j", "CVE-2022-32532", "org.apache.shiro", "shiro-core", None, "1.9.1", "HIGH"),
    ("GHSA-r9p9-mrjm-926w", "CVE-2021-31805", "org.apache.struts", "struts2-core", None, "2.5.30", "CRITICAL"),
    ("GHSA-cf46-mg8x-h2px", "CVE-2023-50164", "org.apache.struts", "struts2-core", "6.0", "6.3.0.2", "CRITICAL"),
    ("GHSA-4w2v-qv35-vfg9", "CVE-2021-2471", "mysql", "mysql-connector-java", None, "8.0.28", "HIGH"),
    ("GHSA-mjm2-j4w8-79pq", "CVE-2022-31197", "org.postgresql", "postgresql", None, "42.4.1", "HIGH"),
    ("GHSA-2q7v-8r84-v2p4", "CVE-2022-1471", "org.yaml", "snakeyaml", None, "2.0", "CRITICAL"),
    ("GHSA-455w-c45v-86rg", "CVE-2022-41966", "com.thoughtworks.xstream", "xstream", None, "1.4.20", "HIGH"),
    ("GHSA-84q5-j2wm-63r8", "CVE-2020-10683", "org.dom4j", "dom4j", None, "2.1.4", "HIGH"),
    ("GHSA-xx46-p393-f7mg", "CVE-2021-33813", "org.jdom", "jdom2", None, "2.0.6.1", "HIGH"),
    ("GHSA-555w-45v8-j9x3", "CVE-2021-29425", "commons-io", "commons-io", None, "2.7", "MEDIUM"),
    ("GHSA-4wc3-p4gg-x2f6", "CVE-2021-35515", "org.apache.commons", "commons-compress", None, "1.21", "HIGH"),
    ("GHSA-7c9x-3w39-q4q4", "CVE-2020-13956", "org.apache.httpcomponents", "httpclient", None, "4.5.13", "MEDIUM"),
    ("GHSA-h398-4qhg-4w7x", "CVE-2023-24998", "commons-fileupload", "commons-fileupload", None, "1.5", "CRITICAL"),
    ("GHSA-9848-v4v2-4j4h", "CVE-2019-10086", "commons-beanutils", "commons-beanutils", None, "1.9.4", "HIGH"),
    ("GHSA-q2q7-5pp4-w6pg", "CVE-2021-42392", "com.h2database", "h2", None, "2.1.210", "CRITICAL"),
    ("GHSA-gpv5-7x3g-ghjv", "CVE-2020-15250", "junit", "junit", None, "4.13.1", "MEDIUM"),
    ("GHSA-5mg8-w23w-74h3", "CVE-2020-8908", "com.google.guava", "guava", None, "30.0", "MEDIUM"),
    ("GHSA-w338-52fq-683v", "CVE-2022-25647", "com.google.code.gson", "gson", None, "2.8.9", "HIGH"),
    ("GHSA-wrc8-9w32-jxj9", "CVE-2020-28052", "org.bouncycastle", "bcprov-jdk15on", None, "1.67", "HIGH"),
    ("GHSA-m9p2-j4hg-g373", "CVE-2021-0341", "com.squareup.okhttp3", "okhttp", None, "4.9.2", "MEDIUM"),
    ("GHSA-j778-564p-h24v", "CVE-2020-13936", "org.apache.velocity", "velocity-engine-core", None, "2.3", "MEDIUM"),
    ("GHSA-jgmv-499x-4m4m", "CVE-2023-1436", "org.codehaus.jettison", "jettison", None, "1.5.4", "MEDIUM"),
    ("GHSA-9q6g-hjgx-3w4m", "CVE-2023-5072", "org.json", "json", None, "20231013", "HIGH"),
    ("GHSA-6wq3-7jph-jr24", "CVE-2022-42252", "org.apache.tomcat.embed", "tomcat-embed-core", "9.0", "9.0.71", "MEDIUM"),
    ("GHSA-xr3w-3j3w-8p8p", "CVE-2022-41881", "io.netty", "netty-codec-haproxy", None, "4.1.86", "MEDIUM"),
    ("GHSA-8r6q-hj4w-9v9v", "CVE-2023-33246", "org.apache.rocketmq", "rocketmq-broker", None, "4.9.6", "CRITICAL"),
]

# Labels and colours of levels, labels of grades.
LEVEL_LABELS = {"BLOCKER": "阻断", "CRITICAL": "严重", "MAJOR": "主要", "MINOR": "次要", "INFO": "提示"}
LEVEL_COLORS = {"BLOCKER": "#b91c1c", "CRITICAL": "#ef4444", "MAJOR": "#f59e0b", "MINOR": "#0ea5e9", "INFO": "#6b7280"}
OTHER_COLOR = "#808080"
GRADE_LABELS = {"EXCELLENT": "优秀", "GOOD": "良好", "FAIR": "一般", "POOR": "较差"}

# Frameworks by the artifacts that show them.
FRAMEWORKS = {
    "Spring Boot": ("spring-boot-starter", "spring-boot", "spring-boot-starter-parent"),
    "Spring Web": ("spring-web", "spring-boot-starter-web"),
    "MyBatis": ("mybatis", "mybatis-spring-boot-starter"),
    "JPA / Hibernate": ("spring-data-jpa", "hibernate-core", "spring-boot-starter-data-jpa"),
    "Redis": ("spring-boot-starter-data-redis", "jedis"),
    "Kafka": ("spring-kafka", "kafka-clients"),
    "JUnit": ("junit", "junit-jupiter", "spring-boot-starter-test"),
    "Mockito": ("mockito-core", "mockito"),
}


def literal_map(values: dict) -> Column:
    """A constant map expression; small tables become part of the plan instead of a join."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def lookup(values: dict, key: Column) -> Column:
    """values[key], null for other keys and for null."""
    return F.try_element_at(literal_map(values), key)


def level_of(code: Column) -> Column:
    """The level that a code names: trimmed, upper-cased, older names mapped; INFO for all else."""
    name = F.upper(F.regexp_replace(code, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.coalesce(F.when(name.isin(*LEVELS), name), lookup(ALIASES, name), F.lit("INFO"))


def rank_of(level: Column) -> Column:
    return F.coalesce(lookup(RANK, level), F.lit(1))


def _by_rule(rule: Column, exact: dict, prefix: dict) -> Column:
    """A rule's own value, else that of its longest known beginning."""
    out = lookup(exact, rule)
    for start in sorted(prefix, key=len, reverse=True):
        out = F.coalesce(out, F.when(rule.startswith(start), F.lit(prefix[start])))
    return out


def level_of_rule(rule: Column, fallback: Column | None = None) -> Column:
    found = _by_rule(rule, {k: v[0] for k, v in RULES.items()}, {k: v[0] for k, v in PREFIXES.items()})
    return F.coalesce(found, *([] if fallback is None else [fallback]), F.lit("INFO"))


def minutes_of_rule(rule: Column) -> Column:
    return F.coalesce(_by_rule(rule, {k: v[1] for k, v in RULES.items()}, {k: v[1] for k, v in PREFIXES.items()}), F.lit(DEFAULT_MINUTES))


def suggestion_of_rule(rule: Column) -> Column:
    return lookup(SUGGESTIONS, rule)


def level_label(level: Column) -> Column:
    """A level's label, whatever its case; other texts as they are, INFO's for null."""
    return F.when(level.isNull(), LEVEL_LABELS["INFO"]).otherwise(F.coalesce(lookup(LEVEL_LABELS, F.upper(level)), level))


def level_color(level: Column) -> Column:
    return F.coalesce(lookup(LEVEL_COLORS, F.upper(level)), F.lit(OTHER_COLOR))


def grade_label(grade: Column) -> Column:
    return F.when(grade.isNull(), "-").otherwise(F.coalesce(lookup(GRADE_LABELS, grade), grade))


def advisories(spark: SparkSession) -> DataFrame:
    from ..schemas import ADVISORIES as SCHEMA

    return spark.createDataFrame(ADVISORIES, SCHEMA)


# ---------------------------------------------------------------- the same tables as SQL


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def sql_rows(rows: list[tuple], columns: str) -> str:
    """(VALUES ...) AS t(columns) for an SQL text."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows) + f") AS t({columns})"


def sql_case(key: str, values: dict) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {sql_value(k)} THEN {sql_value(v)}" for k, v in values.items()) + " END"


def sql_by_rule(rule: str, at: int) -> str:
    """SQL for level_of_rule (at 0) or minutes_of_rule (at 1), without the default."""
    exact = sql_case(rule, {k: v[at] for k, v in RULES.items()})
    starts = " ".join(f"WHEN starts_with({rule}, '{p}') THEN {sql_value(PREFIXES[p][at])}" for p in sorted(PREFIXES, key=len, reverse=True))
    return f"coalesce({exact}, CASE {starts} END)"
