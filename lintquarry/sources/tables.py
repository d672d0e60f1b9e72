"""The engine's relations, read from the tables of a test directory; every derivation is deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.catalogs import RANK, lookup

# One rule of each level, for hits made from events.
RULE_OF = {"BLOCKER": "SEC_SQL_INJECTION", "CRITICAL": "NULL_CHECK", "MAJOR": "MAX_COMPLEXITY", "MINOR": "MAGIC_NUMBER", "INFO": "NAMING_CONSTANT"}
CHECKER_OF = {"BLOCKER": "security", "CRITICAL": "nullpointer", "MAJOR": "complexity", "MINOR": "code_style", "INFO": "naming"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that one task takes where each of them becomes a file of its own with many rows.
SPREAD_ROWS = 5_000


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """A plain scan dealt out to all cores where it has fewer files than those, for work that costs far more than reading. most: rows of a narrow table
    that a task takes, or some more, as what a task holds and sorts grows with them."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if most is not None:
        n = max(n, -(-df.count() // most))
    return df.repartition(n) if len(df.inputFiles()) < n else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a task: the number in the source's name."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("task_id"),
        F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/doc_"), F.col("doc_id").cast("string")).alias("file_path"),
        F.coalesce("text", F.lit("")).alias("content"),
    )


FILES_SQL = """files AS (SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS task_id,
  source || '/' || lang || '/doc_' || doc_id AS file_path, text AS content FROM documents)"""


def lines(files: DataFrame) -> DataFrame:
    """Lines, numbered from 1; a final line break makes no line."""
    split = F.posexplode(T.lines_of(F.col("content"))).alias("n", "line")
    return files.select("task_id", "file_path", split).select("task_id", "file_path", (F.col("n") + 1).alias("line_no"), "line")


LINES_SQL = (
    FILES_SQL
    + """, split AS (SELECT task_id, file_path, string_split(content, chr(10)) AS l FROM files),
cut AS (SELECT task_id, file_path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM split),
lines AS (SELECT task_id, file_path, unnest(range(1, len(l) + 1))::INT AS line_no, unnest(l) AS line FROM cut)"""
)


def tokens(files: DataFrame) -> DataFrame:
    """Tokens cut at white space, numbered from 0."""
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    return files.select("task_id", "file_path", F.posexplode(words).alias("idx", "text"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("PENDING")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project_name"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("owner_id"))


TASKS_SQL = """tasks AS (SELECT o_orderkey AS id, o_orderpriority AS project_name,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS status, o_orderdate AS created_at, o_custkey AS owner_id FROM orders)"""


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw hits; a residue of the id gives all levels, grades and verdicts."""
    e = read(spark, sf_dir, "events")
    i, u = F.col("event_id") % 997, F.col("user_id") % 997
    r = (17 * i * i + 31 * i + 13 * u) % 997
    level = F.when(r < 4, "BLOCKER").when(r < 15, "CRITICAL").when(r < 70, "MAJOR").when(r < 400, "MINOR").otherwise("INFO")
    start = (F.col("event_id") % 200 + 1).cast("int")
    return e.select(
        F.floor(F.col("event_id") / 40).cast("bigint").alias("task_id"),
        F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("file_path"),
        level.alias("level"),
        start.alias("line_start"),
        (start + F.col("event_id") % 3).cast("int").alias("line_end"),
        F.concat("event_type", F.lit(" by user")).alias("title"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("description"),
        F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("code_snippet"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("see "), F.col("event_type"))).alias("suggestion"),
        (F.col("event_id") % 50 == 0).alias("ai_generated"),
        F.col("event_id").alias("seq"),
    ).select(
        "*",
        lookup(RULE_OF, F.col("level")).alias("rule_code"),
        lookup(CHECKER_OF, F.col("level")).alias("checker_type"),
        F.concat(lookup(CHECKER_OF, F.col("level")), F.lit(" checker")).alias("checker_name"),
        lookup(RANK, F.col("level")).alias("severity"),
    )


def _case(values: dict) -> str:
    return "CASE level " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


HITS_SQL = f"""ev AS (SELECT *, (17 * (event_id % 997) * (event_id % 997) + 31 * (event_id % 997) + 13 * (user_id % 997)) % 997 AS r FROM events),
lv AS (SELECT *, CASE WHEN r < 4 THEN 'BLOCKER' WHEN r < 15 THEN 'CRITICAL' WHEN r < 70 THEN 'MAJOR' WHEN r < 400 THEN 'MINOR' ELSE 'INFO' END AS level FROM ev),
hits AS (SELECT event_id // 40 AS task_id, 'f' || (event_id % 7) AS file_path, level, (event_id % 200 + 1)::INT AS line_start,
  (event_id % 200 + 1 + event_id % 3)::INT AS line_end, event_type || ' by user' AS title, 'user ' || user_id AS description,
  CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'u' || user_id END AS code_snippet, CASE WHEN event_id % 4 = 0 THEN 'see ' || event_type END AS suggestion,
  event_id % 50 = 0 AS ai_generated, event_id AS seq, {_case(RULE_OF)} AS rule_code, {_case(CHECKER_OF)} AS checker_type,
  {_case(CHECKER_OF)} || ' checker' AS checker_name, {_case(RANK)} AS severity FROM lv)"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dependencies on the advisories' artifacts, at versions made of size and key."""
    from ..functions.catalogs import ADVISORIES

    p = read(spark, sf_dir, "part")
    coordinates = F.array(*[F.struct(F.lit(a[2]).alias("g"), F.lit(a[3]).alias("a")) for a in ADVISORIES])
    at = F.get(coordinates, (F.col("p_partkey") % len(ADVISORIES)).cast("int"))
    dotted = lambda *c: F.concat_ws(".", *[x.cast("string") for x in c])
    k, s = F.col("p_partkey"), F.col("p_size")
    version = (
        F.when(k % 11 == 0, F.lit("${project.version}"))
        .when(k % 13 == 0, F.lit(None).cast("string"))
        .when(k % 5 == 0, F.concat(dotted(s % 7, k % 17), F.lit("-RC1")))
        .when(k % 5 == 1, dotted(s % 7, k % 17))
        .otherwise(dotted(s % 7, k % 17, k % 23))
    )
    scope = F.when(k % 9 == 0, "test").when(k % 10 == 0, "parent").otherwise("compile")
    return p.select((k % 50).alias("task_id"), k.alias("dep_id"), F.when(k % 4 == 0, F.upper(at["g"])).otherwise(at["g"]).alias("group_id"), at["a"].alias("artifact_id"), version.alias("version"), scope.alias("scope"))


def dependencies_sql() -> str:
    from ..functions.catalogs import ADVISORIES, sql_rows

    rows = sql_rows([(i, a[2], a[3]) for i, a in enumerate(ADVISORIES)], "i, g, a")
    return f"""coords AS (SELECT * FROM {rows}),
dependencies AS (SELECT p_partkey % 50 AS task_id, p_partkey AS dep_id, CASE WHEN p_partkey % 4 = 0 THEN upper(g) ELSE g END AS group_id, a AS artifact_id,
  CASE WHEN p_partkey % 11 = 0 THEN '${{project.version}}' WHEN p_partkey % 13 = 0 THEN NULL
  WHEN p_partkey % 5 = 0 THEN (p_size % 7) || '.' || (p_partkey % 17) || '-RC1' WHEN p_partkey % 5 = 1 THEN (p_size % 7) || '.' || (p_partkey % 17)
  ELSE (p_size % 7) || '.' || (p_partkey % 17) || '.' || (p_partkey % 23) END AS version,
  CASE WHEN p_partkey % 9 = 0 THEN 'test' WHEN p_partkey % 10 = 0 THEN 'parent' ELSE 'compile' END AS scope
  FROM part JOIN coords ON i = p_partkey % {len(ADVISORIES)})"""


def call_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as methods, line items as calls from suppliers to parts."""
    p, li = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    k = F.col("p_partkey")
    methods = p.select(
        (k % 5).cast("bigint").alias("task_id"),
        F.concat(F.when(k % 50 == 7, "java.util.C").otherwise("com.acme.C"), (k % 100).cast("string")).alias("class_name"),
        F.concat(F.lit("m"), k.cast("string")).alias("method"),
        (k % 4).cast("int").alias("arity"),
        (k % 10 == 0).alias("is_public"),
        (k % 21 == 0).alias("is_override"),
        (k % 33 == 0).alias("is_ctor"),
        (k % 35 == 0).alias("is_abstract"),
        F.lit(False).alias("is_native"),
        (k % 6 == 0).alias("is_deprecated"),
        F.concat(F.lit("F"), (k % 40).cast("string")).alias("file_path"),
    )
    to = F.col("l_partkey") - F.col("l_partkey") % 3  # so that two methods of three are never called
    edges = li.select(
        (F.col("l_orderkey") % 4).cast("bigint").alias("task_id"),  # of task 4 there are no calls
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("caller"),
        F.concat(F.lit("com.acme.C"), (to % 100).cast("string")).alias("callee_class"),
        F.concat(F.lit("m"), to.cast("string")).alias("callee"),
        F.concat(F.lit("F"), (to % 40).cast("string")).alias("file_path"),
        (F.col("l_orderkey") % 500 + 1).cast("int").alias("line"),
    )
    return methods, edges


GRAPH_SQL = """methods AS (SELECT p_partkey % 5 AS task_id, CASE WHEN p_partkey % 50 = 7 THEN 'java.util.C' ELSE 'com.acme.C' END || (p_partkey % 100) AS class_name, 'm' || p_partkey AS method, (p_partkey % 4)::INT AS arity,
  p_partkey % 10 = 0 AS is_public, p_partkey % 21 = 0 AS is_override, p_partkey % 33 = 0 AS is_ctor, p_partkey % 35 = 0 AS is_abstract, p_partkey % 6 = 0 AS is_deprecated,
  'F' || (p_partkey % 40) AS file_path FROM part),
edges AS (SELECT l_orderkey % 4 AS task_id, 's' || l_suppkey AS caller, 'com.acme.C' || ((l_partkey - l_partkey % 3) % 100) AS callee_class, 'm' || (l_partkey - l_partkey % 3) AS callee,
  'F' || ((l_partkey - l_partkey % 3) % 40) AS file_path, (l_orderkey % 500 + 1)::INT AS line FROM lineitem)"""


def webhook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as webhook deliveries, in the shapes of four platforms."""
    return read(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_id") % 3).alias("trigger_id"), *_webhook_columns())


def _webhook_columns() -> list[Column]:
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    platform = F.when(i % 5 == 0, "GITHUB").when(i % 5 == 1, "gitlab").when(i % 5 == 2, "GITEE").when(i % 5 == 3, "GENERIC").otherwise("other")
    branch = F.when(i % 6 < 3, "main").when(i % 6 < 5, F.concat(F.lit("release/"), (i % 4).cast("string"))).otherwise(F.concat(F.lit("feature/a/"), (i % 4).cast("string")))
    url = F.concat(F.lit("https://git.example.com/Org"), (i % 3).cast("string"), F.lit("/repo"), (i % 2).cast("string"), F.when(i % 7 == 0, ".git/").otherwise(".git"))
    sha = F.lower(F.lpad(F.hex(i), 8, "0"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    github = F.concat(F.lit('{"repository":{"clone_url":'), q(url), F.lit('},"ref":"refs/heads/'), branch, F.lit('","head_commit":{"id":'), q(sha), F.lit(',"author":{"name":"u'), u, F.lit('"}}}'))
    gitlab = F.concat(F.lit('{"project":{"git_http_url":'), q(url), F.lit('},"ref":"refs/heads/'), branch, F.lit('","after":'), q(sha), F.lit(',"object_attributes":{"iid":'), (i % 9).cast("string"), F.lit(',"source_branch":'), q(branch), F.lit("}}"))
    gitee = F.concat(F.lit('{"project":{"git_http_url":'), q(url), F.lit('},"ref":"refs/tags/'), branch, F.lit('","after":'), q(sha), F.lit("}"))
    generic = F.concat(F.lit("{"), F.when(i % 8 == 3, F.lit("")).otherwise(F.concat(F.lit('"repoUrl":'), q(url), F.lit(","))), F.lit('"commitId":'), q(sha), F.lit(',"author":"u'), u, F.lit('"}'))
    payload = F.when(i % 5 == 0, github).when(i % 5 == 1, gitlab).when(i % 5 == 2, gitee).otherwise(generic)
    return [platform.alias("platform"), payload.alias("payload")]


WEBHOOK_SQL = """src AS (SELECT event_id, event_id % 3 AS trigger_id, user_id,
  CASE event_id % 5 WHEN 0 THEN 'GITHUB' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'GITEE' WHEN 3 THEN 'GENERIC' ELSE 'other' END AS platform,
  CASE WHEN event_id % 6 < 3 THEN 'main' WHEN event_id % 6 < 5 THEN 'release/' || (event_id % 4) ELSE 'feature/a/' || (event_id % 4) END AS b,
  'https://git.example.com/Org' || (event_id % 3) || '/repo' || (event_id % 2) || CASE WHEN event_id % 7 = 0 THEN '.git/' ELSE '.git' END AS url,
  lower(lpad(to_hex(event_id), 8, '0')) AS sha FROM events),
webhooks AS (SELECT event_id, trigger_id, platform, CASE event_id % 5
  WHEN 0 THEN '{"repository":{"clone_url":"' || url || '"},"ref":"refs/heads/' || b || '","head_commit":{"id":"' || sha || '","author":{"name":"u' || user_id || '"}}}'
  WHEN 1 THEN '{"project":{"git_http_url":"' || url || '"},"ref":"refs/heads/' || b || '","after":"' || sha || '","object_attributes":{"iid":' || (event_id % 9) || ',"source_branch":"' || b || '"}}'
  WHEN 2 THEN '{"project":{"git_http_url":"' || url || '"},"ref":"refs/tags/' || b || '","after":"' || sha || '"}'
  ELSE '{' || CASE WHEN event_id % 8 = 3 THEN '' ELSE '"repoUrl":"' || url || '",' END || '"commitId":"' || sha || '","author":"u' || user_id || '"}' END AS payload FROM src)"""
