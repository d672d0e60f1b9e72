"""Registered queries over snapshots' paths, build files, declarations and checkers, each with its SQL counterpart."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import text as T
from ..operators import checkers, environment, graph, issues
from ..session import shared_dir
from ..sources import build_files, files, tables
from .registry import query

PATHS = ["src/main/A.java", "src/test/B.java", "test/C.java", "a/BTest.java", "a/BTests.java", "a\\test\\D.java", "__MACOSX/E.java", "a/.DS_Store", "a/._F.java", "atest/G.java", "a/test", "a/b_.java"]


def parts(spark, d):
    return tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"))


def chosen(values: list, key=None):
    """The value that a part's number chooses."""
    key = F.col("id") if key is None else key
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def chosen_sql(values: list, key: str = "p_partkey") -> str:
    return f"([{', '.join(map(C.sql_value, values))}])[{key} % {len(values)} + 1]"


TEST_SQL = "(contains(path, '/test/') OR {extra} OR ends_with(path, 'Test.java') OR ends_with(path, 'Tests.java'))"


@query(
    "path_flags",
    f"WITH p AS (SELECT p_partkey AS id, {chosen_sql(PATHS)} AS path FROM part) SELECT id, path, "
    + TEST_SQL.format(extra="starts_with(path, 'test/')")
    + " AS test_file, "
    + TEST_SQL.format(extra="contains(path, '\\test\\')")
    + " AS test_path, len(list_filter(string_split(path, '/'), lambda s: s = '__MACOSX' OR s = '.DS_Store' OR starts_with(s, '._'))) > 0 AS junk FROM p",
)
def path_flags(spark, d):
    path = F.col("path")
    return parts(spark, d).withColumn("path", chosen(PATHS)).select("id", "path", T.is_test_file(path).alias("test_file"), T.is_test_path(path).alias("test_path"), T.is_system_junk(path).alias("junk"))


@query(
    "accepted_files",
    f"WITH p AS (SELECT p_partkey AS id, {chosen_sql(PATHS)} AS path FROM part) SELECT id, path FROM p WHERE NOT {TEST_SQL.format(extra=chr(39).join(['contains(path, ', chr(92) + 'test' + chr(92), ')']))} AND ends_with(path, '.java') AND id % 9 <= 5",
)
def accepted_files(spark, d):
    """What an AI checker takes: no tests, Java, of at most five lines."""
    rows = parts(spark, d).select("id", chosen(PATHS).alias("file_path"), F.repeat(F.lit("x;\n"), (F.col("id") % 9).cast("int")).alias("content"))
    return checkers.accepted(rows, ai=True, ai_lines=5).select("id", F.col("file_path").alias("path"))


BUILDS = ["pom.xml", "a/pom.xml", "build.gradle", "a/b/build.gradle.kts", "a/b/c/pom.xml", "a/build.gradle", "README"]


@query(
    "nearest_build_files",
    f"""WITH f AS (SELECT p_partkey // 3 AS task_id, {chosen_sql(BUILDS)} AS file_path, p_partkey::VARCHAR AS content FROM part),
k AS (SELECT *, CASE WHEN string_split(file_path, '/')[-1] = 'pom.xml' THEN 0 WHEN string_split(file_path, '/')[-1] IN ('build.gradle', 'build.gradle.kts') THEN 1 END AS kind, len(string_split(file_path, '/')) - 1 AS depth FROM f)
SELECT task_id, arg_min(file_path, (kind, depth, file_path)) AS file_path, arg_min(content, (kind, depth, file_path)) AS content FROM k WHERE kind IS NOT NULL AND depth <= 2 GROUP BY 1""",
)
def nearest_build_files(spark, d):
    rows = parts(spark, d).select(F.floor(F.col("id") / 3).alias("task_id"), chosen(BUILDS).alias("file_path"), F.col("id").cast("string").alias("content"))
    return build_files.nearest_build_file(rows)


@query("gradle_test_parse", "SELECT p_partkey AS id, (p_partkey % 50)::INT AS run, CASE WHEN p_partkey % 3 = 0 THEN greatest(1, p_partkey % 50 // 10) ELSE 0 END::INT AS failures, greatest(0, p_partkey % 50 - CASE WHEN p_partkey % 3 = 0 THEN greatest(1, p_partkey % 50 // 10) ELSE 0 END)::INT AS passed FROM part")
def gradle_test_parse(spark, d):
    k = F.col("id")
    text = F.concat(F.lit("noise\n"), (k % 50).cast("string"), F.when(k % 50 == 1, " test completed").otherwise(" tests completed"), F.when(k % 3 == 0, "\nBUILD FAILED").otherwise("\nBUILD SUCCESSFUL"))
    return build_files.gradle_test_counts(parts(spark, d).select("id", text.alias("output")))


HEADS = ["package a.b;", "// package no;", "public class X {", "final class Y {", "import z;", "package late.one;"]


@query(
    "package_names",
    f"""WITH l AS (SELECT p_partkey // 4 % 7 AS task_id, 'f' || (p_partkey // 4) AS file_path, p_partkey % 4 AS line_no, {chosen_sql(HEADS, '(p_partkey * 7 // 3)')} AS line FROM part),
k AS (SELECT *, CASE WHEN starts_with(line, 'package ') THEN 1 WHEN regexp_matches(line, '^(public |final )*class') THEN 2 END AS kind FROM l),
f AS (SELECT task_id, file_path, arg_min(kind, line_no) AS kind, arg_min(line, line_no) AS line FROM k WHERE kind IS NOT NULL GROUP BY ALL)
SELECT task_id, file_path, regexp_extract(line, 'package ([a-z.]+)', 1) AS pkg FROM f WHERE kind = 1""",
)
def package_names(spark, d):
    k = F.col("id")
    rows = parts(spark, d).select((F.floor(k / 4) % 7).alias("task_id"), F.concat(F.lit("f"), F.floor(k / 4).cast("string")).alias("file_path"), (k % 4).alias("line_no"), chosen(HEADS, F.floor(k * 7 / 3)).alias("line"))
    return environment.package_declarations(rows)


@query("class_releases", "SELECT 'C' || p_partkey AS file_path, (p_partkey % 20 + 1)::INT AS release FROM part")
def class_releases(spark, d):
    k = F.col("id")
    content = F.unhex(F.concat(F.lit("CAFEBABE0000"), F.lpad(F.hex(k % 20 + 45), 4, "0"), F.lit("0010")))
    return files.class_release(parts(spark, d).select(F.concat(F.lit("C"), k.cast("string")).alias("file_path"), content.alias("content")))


@query("ambiguous_types", "WITH t AS (SELECT 'n' || (p_partkey % 300) AS name, CASE WHEN p_partkey % 300 < 100 THEN 'T' || (p_partkey // 300 % 2) ELSE 'T' END AS type FROM part) SELECT name, CASE WHEN count(DISTINCT type) = 1 THEN min(type) END AS type FROM t GROUP BY 1")
def ambiguous_types(spark, d):
    k = F.col("id")
    kind = F.when(k % 300 < 100, F.concat(F.lit("T"), (F.floor(k / 300) % 2).cast("string"))).otherwise("T")
    return graph.ambiguous_names(parts(spark, d).select(F.concat(F.lit("n"), (k % 300).cast("string")).alias("name"), kind.alias("type")))


URLS = ["jdbc:h2:mem", "JDBC:MySQL://h/d", "jdbc:mariadb://h", "jdbc:oracle:thin", "jdbc:postgresql://h", "jdbc:kingbase8://h", "jdbc:dm://h", "jdbc:sqlserver://h", "jdbc:gbasedbt-sqli://h", "jdbc:unknown://h", "http://h"]
KINDS = ["H2", "MYSQL", "MARIADB", "ORACLE", "POSTGRESQL", "KINGBASE", "DM", "SQLSERVER", "GBASE8S", "CUSTOM", "CUSTOM"]
IDS = ["abc1", "ABCDEF0123", "abc", "xyz1", "12345678901", "42", ""]


@query(
    "identifiers",
    f"WITH p AS (SELECT p_partkey AS id, {chosen_sql(KINDS)} AS database, {chosen_sql(IDS)} AS t FROM part) SELECT id, database, CASE WHEN t IN ('abc1', 'ABCDEF0123', '12345678901') THEN t END AS commit_id, CASE WHEN t = '42' THEN t END AS request_id FROM p",
)
def identifiers(spark, d):
    t = chosen(IDS)
    return parts(spark, d).select("id", T.database_type(chosen(URLS)).alias("database"), T.commit_id(t).alias("commit_id"), T.request_id(t).alias("request_id"))


@query(
    "line_snippets",
    """WITH p AS (SELECT p_partkey AS id, (p_partkey % 6)::INT AS s, (p_partkey % 4 + 1)::INT AS e FROM part)
SELECT id, CASE WHEN s < 1 OR e < s OR s > 3 THEN '' ELSE trim(array_to_string((['  one', 'two ', 'three'])[s:e], chr(10)), ' ') END AS snippet FROM p""",
)
def line_snippets(spark, d):
    k = F.col("id")
    return parts(spark, d).select("id", T.lines_between(F.lit("  one\r\ntwo \nthree\n"), (k % 6).cast("int"), (k % 4 + 1).cast("int")).alias("snippet"))


@query("level_numbers", "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END::INT AS place FROM part")
def level_numbers(spark, d):
    return parts(spark, d).select("id", issues.level_number(chosen([*C.LEVELS, "?"])).cast("int").alias("place"))


@query("pasted_source", "SELECT doc_id AS task_id, 'PastedCode.java' AS file_path, text AS content FROM documents")
def pasted_source(spark, d):
    return files.pasted_rows(tables.read(spark, d, "documents").select(F.col("doc_id").alias("task_id"), F.col("text").alias("content")))


@query(
    "archive_files",
    """WITH d AS (SELECT doc_id AS task_id, 'x' || coalesce(text, '') AS body FROM documents), e AS (SELECT task_id, 'src/A.java' AS file_path, body FROM d UNION ALL SELECT task_id, 'src/B.java', 'class B {}' FROM d)
SELECT task_id, CASE WHEN task_id % 11 <> 4 THEN file_path END AS file_path, CASE WHEN task_id % 11 = 4 THEN 'archive: BadZipFile' WHEN strlen(body) > 4000 THEN 'entry: too large' WHEN task_id % 7 = 3 AND file_path = 'src/A.java' THEN 'entry: BadZipFile' END AS error,
  CASE WHEN task_id % 11 = 4 OR strlen(body) > 4000 OR task_id % 7 = 3 AND file_path = 'src/A.java' THEN NULL ELSE sha256(body) END AS digest FROM e WHERE task_id % 11 <> 4 OR file_path = 'src/A.java'""",
)
def archive_files(spark, d):
    """A ZIP archive of each document, beside a second file; some of them with a damaged entry, some cut off, some with more in a file than is
    allowed."""
    @F.arrow_udf("binary")
    def packed(keys: pa.Array, bodies: pa.Array) -> pa.Array:
        out = []
        for key, body in zip(keys.to_pylist(), bodies.to_pylist(), strict=True):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("src/A.java", body)
                z.writestr("src/B.java", "class B {}")
                z.writestr("../C.java", "class C {}")
            data = bytearray(data.getvalue())
            if key % 7 == 3:
                data[data.index(b"PK\x01\x02") + 16] ^= 0xFF  # the checksum in the list of entries
            out.append(bytes(data[: len(data) // 2]) if key % 11 == 4 else bytes(data))
        return pa.array(out, pa.binary())

    docs = tables.spread(tables.read(spark, d, "documents")).select(F.col("doc_id").alias("task_id"), F.concat(F.lit("x"), F.coalesce("text", F.lit(""))).alias("body"))
    found = files.archive_entries(docs.select("task_id", packed("task_id", "body").alias("content")), entry_bytes=4000)
    return found.select("task_id", "file_path", "error", F.sha2("content", 256).alias("digest"))


@query("json_advisories", "SELECT p_partkey::VARCHAR AS id, p_brand AS group_id, p_name AS artifact_id, CASE WHEN p_size % 3 > 0 THEN p_size::VARCHAR END AS introduced, p_partkey || '.0' AS fixed_version FROM part WHERE p_partkey % 5 > 0")
def json_advisories(spark, d):
    """Documents of up to 500 advisories, of which some lack what they must have."""
    k = F.col("p_partkey")
    at = f"{shared_dir(spark)}/advisories-{uuid.uuid4().hex}"
    rows = tables.read(spark, d, "part").select(
        F.floor(k / 500).alias("file"),
        F.struct(
            k.cast("string").alias("id"), F.when(k % 15 != 0, F.col("p_brand")).alias("groupId"), F.when(k % 15 != 5, F.col("p_name")).alias("artifactId"),
            F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).alias("introduced"), F.when(k % 15 != 10, F.concat(k.cast("string"), F.lit(".0"))).alias("fixedVersion"),
        ).alias("row"),
    )
    rows.groupBy("file").agg(F.to_json(F.collect_list("row")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(at)
    return files.json_advisories(spark, at).select("id", "group_id", "artifact_id", "introduced", "fixed_version")


@query("json_paths", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN (event_id % 9)::VARCHAR END AS nested, 't' || event_id AS top, user_id::VARCHAR AS first, NULL::VARCHAR AS none FROM events")
def json_paths(spark, d):
    k = F.col("event_id")
    doc = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(k % 5 > 0, k % 9).alias("c")).alias("b"))).alias("a"), F.concat(F.lit("t"), k.cast("string")).alias("t"), F.array("user_id").alias("u")))
    at = lambda path: T.json_path(F.col("doc"), path)
    return tables.read(spark, d, "events").select("event_id", doc.alias("doc")).select("event_id", at("a[0].b.c").alias("nested"), at("t").alias("top"), at("u[0]").alias("first"), at("a[1].b").alias("none"))


@query("partner_locations", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 THEN 'src/F' || p_partkey || '.java:' || p_size || '-' || (p_size + 9) END AS partner FROM part")
def partner_locations(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    there = F.concat(F.lit("src/F"), k.cast("string"), F.lit(".java:"), n.cast("string"), F.lit("-"), (n + 9).cast("string"))
    text = F.concat(F.lit("blocks\n  位置一：a:1-2\n  "), F.when(k % 4 > 0, F.lit("位置二：")).otherwise(F.lit("at ")), there, F.lit("\nend"))
    return tables.read(spark, d, "part").select(k.alias("id"), T.partner_location(text).alias("partner"))


@query(
    "checkers_run",
    "SELECT 'first' AS rule_code, p_partkey AS id, NULL::VARCHAR AS note FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'second', p_partkey, 'n' || p_partkey FROM part WHERE p_partkey % 7 = 0",
)
def checkers_run(spark, d):
    """Rules of a user's own, the switched-off ones left out; hits need not have the same columns."""
    rule = lambda code, n, *more, **given: checkers.Checker(code, lambda c: c["parts"].filter(F.col("id") % n == 0).select(F.lit(code).alias("rule_code"), "id", *more), **given)
    own = [rule("second", 7, F.concat(F.lit("n"), F.col("id").cast("string")).alias("note"), priority=20), rule("first", 5, priority=10, enabled=False), rule("off", 2)]
    return checkers.run(own, {"parts": parts(spark, d)}, {"first": True, "off": False, "second": None})
