"""Registered queries over sources, dependencies, graphs and events, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import text as T
from ..functions import versions as V
from ..operators import advisories, duplicates, environment, graph, line_rules, migrate, webhooks
from ..sources import build_files, tables
from ..session import stored
from .registry import query

N = 100  # tokens of a window

WINDOWS_SQL = (
    "WITH "
    + tables.FILES_SQL
    + f""", tok AS (SELECT task_id, file_path, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS t FROM files),
st AS (SELECT task_id, file_path, t, unnest(range(0, len(t) - {N} + 1)) AS idx FROM tok WHERE len(t) >= {N}),
w AS (SELECT task_id, file_path, idx::INT AS idx, md5(array_to_string(t[idx + 1:idx + {N}], ' ') || ' ') AS fingerprint FROM st)"""
)
#: Windows by a hash of their words; those whose fingerprint stands in several places of a task, with their neighbours' hashes.
HASHED_SQL = (
    "WITH "
    + tables.FILES_SQL
    + f""", tok AS (SELECT task_id, file_path, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS t FROM files),
u AS (SELECT task_id, file_path, hash(unnest(t)) AS x, generate_subscripts(t, 1) AS i FROM tok WHERE len(t) >= {N}),
w AS (SELECT task_id, file_path, (i - 1)::INT AS idx, hash(list(x) OVER (PARTITION BY task_id, file_path ORDER BY i ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING)) AS h FROM u
  QUALIFY i + {N - 1} <= max(i) OVER (PARTITION BY task_id, file_path)),
n AS (SELECT *, lag(h) OVER f AS before, lead(h) OVER f AS after FROM w WINDOW f AS (PARTITION BY task_id, file_path ORDER BY idx)),
again AS (SELECT task_id, h, count(*) AS places, min((file_path, idx)) AS of, count(before) = count(*) AND min(before) = max(before) AS one_before, count(after) = count(*) AND min(after) = max(after) AS one_after
  FROM n GROUP BY task_id, h HAVING count(*) > 1),
e AS (SELECT n.* FROM n SEMI JOIN again USING (task_id, h))"""
)
#: Pairs of places with one fingerprint that begin (side before) or end (side after) a run.
MEET_SQL = f"""{{name}} AS (SELECT a.task_id, a.file_path AS file_a, a.idx AS idx_a, b.file_path AS file_b, b.idx AS idx_b FROM e a JOIN e b USING (task_id, h)
  WHERE (a.file_path < b.file_path OR (a.file_path = b.file_path AND b.idx - a.idx >= {N})) AND (a.{{side}} = b.{{side}}) IS NOT TRUE)"""
RUNS_SQL = (
    HASHED_SQL
    + ", "
    + MEET_SQL.format(name="heads", side="before")
    + ", "
    + MEET_SQL.format(name="tails", side="after")
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY task_id, file_a, file_b, idx_b - idx_a ORDER BY idx_a) AS k FROM heads),
l AS (SELECT *, row_number() OVER (PARTITION BY task_id, file_a, file_b, idx_b - idx_a ORDER BY idx_a) AS k FROM tails)"""
)


def chained_windows(spark, d):
    return stored(duplicates.repeated(duplicates.words(tables.spread(tables.files(spark, d))), N))


@query("dup_windows", WINDOWS_SQL + " SELECT task_id, file_path, idx, fingerprint FROM w")
def dup_windows(spark, d):
    return duplicates.windows(tables.spread(tables.files(spark, d)), N)


@query("dup_runs", RUNS_SQL + " SELECT k.task_id, k.file_a, k.idx_a, k.file_b, k.idx_b, l.idx_a - k.idx_a + 1 AS length FROM k JOIN l ON (k.task_id, k.file_a, k.file_b, k.idx_b - k.idx_a, k.k) = (l.task_id, l.file_a, l.file_b, l.idx_b - l.idx_a, l.k)")
def dup_runs(spark, d):
    return duplicates.runs(chained_windows(spark, d), N)


@query("dup_chain_heads", HASHED_SQL + ", " + MEET_SQL.format(name="heads", side="before") + " SELECT * FROM heads")
def dup_chain_heads(spark, d):
    return duplicates.chain_heads(chained_windows(spark, d), N)


@query(
    "dup_blocks",
    HASHED_SQL
    + f""", j AS (SELECT *, of[1] AS f, of[2] AS i FROM again),
c AS (SELECT *, (lag(i) OVER p = i - 1 AND lag(one_after) OVER p AND one_before) IS NOT TRUE AS starts FROM j WINDOW p AS (PARTITION BY task_id, f ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY task_id, f ORDER BY i) AS island FROM c),
b AS (SELECT task_id, f AS file_of, min(i) AS idx_of, count(*) AS length, any_value(places) AS places, arg_min(h, i) AS h FROM g GROUP BY task_id, f, island),
m AS (SELECT b.task_id, file_of, idx_of, length, places, e.file_path, e.idx FROM b JOIN e USING (task_id, h)),
o AS (SELECT *, count(*) OVER (PARTITION BY task_id, file_of, idx_of, file_path ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND {N - 1} FOLLOWING) AS near FROM m)
SELECT task_id, file_of, idx_of, length, places, file_path, idx, (places * (places - 1) // 2 - sum(near) OVER (PARTITION BY task_id, file_of, idx_of))::BIGINT AS pairs FROM o
QUALIFY places * (places - 1) // 2 > sum(near) OVER (PARTITION BY task_id, file_of, idx_of)""",
)
def dup_blocks(spark, d):
    return duplicates.blocks(chained_windows(spark, d), N).drop("before")


@query(
    "dup_classes",
    WINDOWS_SQL
    + """, f AS (SELECT task_id, fingerprint, min((file_path, idx)) AS first, count(*) AS places FROM w GROUP BY ALL HAVING count(*) > 1),
l AS (SELECT w.task_id, w.file_path, w.idx, first[1] AS file_of, first[2] AS idx_of, places FROM w JOIN f USING (task_id, fingerprint) WHERE (w.file_path, w.idx) <> first),
i AS (SELECT *, idx - row_number() OVER (PARTITION BY task_id, file_path, file_of, idx - idx_of ORDER BY idx) AS island FROM l)
SELECT task_id, file_path, file_of, min(idx)::INT AS idx, count(*) AS length, min(idx_of)::INT AS idx_of, max(places) AS places FROM i GROUP BY task_id, file_path, file_of, idx - idx_of, island""",
)
def dup_classes(spark, d):
    return duplicates.classes(chained_windows(spark, d))


# ---------------------------------------------------------------- versions and advisories

#: The comparison as SQL: one list comprehension over the segments' numbers.
SEGMENTS = "regexp_split_to_array(regexp_replace(regexp_replace(trim({v}), '^[vV]', ''), '\\+.*$', ''), '[.\\-_]')"


def compare_sql(a: str, b: str) -> str:
    x, y = SEGMENTS.format(v=a), SEGMENTS.format(v=b)
    num = "regexp_full_match({0}, '[0-9]+')"
    p, q = f"({x})[i]", f"({y})[i]"
    np, nq = num.format(p), num.format(q)
    one = f"""CASE WHEN coalesce({np}, false) AND coalesce({nq}, false) THEN sign({p}::HUGEINT - {q}::HUGEINT)
      WHEN (coalesce({np}, false) AND {q} IS NULL) OR (coalesce({nq}, false) AND {p} IS NULL) THEN 0 WHEN coalesce({np}, false) THEN 1 WHEN coalesce({nq}, false) THEN -1
      WHEN {p} IS NULL THEN 1 WHEN {q} IS NULL THEN -1 WHEN lower({p}) < lower({q}) THEN -1 WHEN lower({p}) > lower({q}) THEN 1 ELSE 0 END"""
    every = f"list_transform(range(1, greatest(len({x}), len({y})) + 1), lambda i: {one})"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE coalesce(list_filter({every}, lambda s: s <> 0)[1], 0)::INT END"


PAIR_SQL = "WITH " + tables.dependencies_sql() + ", p AS (SELECT a.dep_id, a.version AS a, b.version AS b FROM dependencies a JOIN dependencies b ON b.dep_id = a.dep_id + 1)"


def version_pairs(spark, d):
    deps = tables.dependencies(spark, d)
    a = deps.select("dep_id", F.col("version").alias("a"))
    b = deps.select((F.col("dep_id") - 1).alias("dep_id"), F.col("version").alias("b"))
    return a.join(b, "dep_id")


@query("version_compare", PAIR_SQL + f" SELECT dep_id, a, b, {compare_sql('a', 'b')} AS c FROM p")
def version_compare(spark, d):
    return version_pairs(spark, d).withColumn("c", V.compare_maven(F.col("a"), F.col("b")))


KEY_SQL = "list_transform(string_split_regex(regexp_replace({v}, '^[vV]', ''), '[^0-9A-Za-z]+'), lambda s: coalesce(TRY_CAST(regexp_extract(s, '^([0-9]+)', 1) AS HUGEINT), 0))"
#: Versions of many segments, and of many digits.
LONG_SQL = PAIR_SQL + ", q AS (SELECT dep_id, CASE WHEN dep_id % 2 = 0 THEN a || '.1.2.3.4.5.6.' || (dep_id % 3) ELSE a END AS a, CASE dep_id % 4 WHEN 0 THEN a || '.1.2.3.4.5.6.1' WHEN 2 THEN a || '.1.2.3.4.5.6.12345678901' ELSE b END AS b FROM p)"


@query("release_compare", LONG_SQL + f", x AS (SELECT *, {KEY_SQL.format(v='a')} AS ka, {KEY_SQL.format(v='b')} AS kb FROM q) SELECT dep_id, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN coalesce(list_filter(list_transform(range(1, greatest(len(ka), len(kb)) + 1), lambda i: sign(coalesce(ka[i], 0) - coalesce(kb[i], 0))), lambda s: s <> 0)[1], 0)::INT END AS c FROM x")
def release_compare(spark, d):
    k = F.col("dep_id")
    pairs = version_pairs(spark, d)
    longer = F.concat("a", F.lit(".1.2.3.4.5.6."))
    a, b = F.when(k % 2 == 0, F.concat(longer, (k % 3).cast("string"))).otherwise(F.col("a")), F.when(k % 4 == 0, F.concat(longer, F.lit("1"))).when(k % 4 == 2, F.concat(longer, F.lit("12345678901"))).otherwise(F.col("b"))
    pairs = pairs.select("dep_id", a.alias("a"), b.alias("b"))
    return pairs.withColumn("c", V.compare_release(F.col("a"), F.col("b")))


ADV = "adv AS (SELECT * FROM " + C.sql_rows(C.ADVISORIES, "id, cve, g, a, introduced, fixed, severity") + ")"
CHECKABLE = "scope NOT IN ('parent', 'test') AND version IS NOT NULL AND trim(version) <> '' AND NOT contains(version, '${')"


@query(
    "advisory_match",
    f"WITH {tables.dependencies_sql()}, {ADV}, c AS (SELECT dep_id, task_id, version, cve, severity, introduced, fixed FROM dependencies JOIN adv ON lower(group_id) = lower(g) AND lower(artifact_id) = lower(a) WHERE {CHECKABLE}) "
    f"SELECT dep_id, task_id, version, 'DEP_VULN_' || cve AS rule_code, CASE severity WHEN 'CRITICAL' THEN 'BLOCKER' WHEN 'HIGH' THEN 'CRITICAL' WHEN 'MEDIUM' THEN 'MAJOR' ELSE 'MINOR' END AS level FROM c "
    f"WHERE (introduced IS NULL OR {compare_sql('version', 'introduced')} >= 0) AND {compare_sql('version', 'fixed')} < 0",
)
def advisory_match(spark, d):
    out = advisories.matches(advisories.checkable(tables.dependencies(spark, d)), C.advisories(spark))
    return out.select("dep_id", "task_id", "version", "rule_code", "level")


# ---------------------------------------------------------------- call graph


@query("unused_methods", "WITH " + tables.GRAPH_SQL + " SELECT task_id, class_name, method, arity FROM methods m WHERE NOT (is_public OR is_override OR is_ctor OR is_abstract) AND NOT starts_with(class_name, 'java.') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.task_id = m.task_id AND e.callee = m.method)")
def unused_methods(spark, d):
    return graph.unused_methods(*tables.call_graph(spark, d)).select("task_id", "class_name", "method", "arity")


@query("callers_of", "WITH " + tables.GRAPH_SQL + " SELECT task_id, callee_class, callee, count(DISTINCT caller) AS callers, count(*) AS calls, min(caller) AS first_caller FROM edges GROUP BY ALL")
def callers_of(spark, d):
    return graph.callers_of(tables.call_graph(spark, d)[1])


@query("graph_stats", "WITH " + tables.GRAPH_SQL + ", e AS (SELECT task_id, count(*) AS n_edges, count(DISTINCT callee) AS n_called FROM edges GROUP BY 1) SELECT m.task_id, count(*) AS n_methods, count(DISTINCT class_name) AS n_classes, coalesce(any_value(n_edges), 0) AS n_edges, coalesce(any_value(n_called), 0) AS n_called FROM methods m LEFT JOIN e USING (task_id) GROUP BY 1")
def graph_stats(spark, d):
    return graph.graph_stats(*tables.call_graph(spark, d))


@query("deprecated_calls", "WITH " + tables.GRAPH_SQL + " SELECT e.task_id, e.file_path, e.callee, e.line, e.caller, m.arity FROM edges e JOIN methods m ON m.task_id = e.task_id AND m.file_path = e.file_path AND m.method = e.callee WHERE m.is_deprecated")
def deprecated_calls(spark, d):
    return graph.deprecated_calls(*tables.call_graph(spark, d)).select("task_id", "file_path", "callee", "line", "caller", "arity")


@query(
    "fixpoint_nonnull",
    """WITH RECURSIVE m AS (SELECT p_partkey AS k, t AS task_id FROM part, (SELECT unnest([1, 2]) AS t)), seeds AS (SELECT task_id, 'm' || k AS method FROM m WHERE k % (6 + task_id) = 0),
dep AS (SELECT task_id, 'm' || k AS method, 'm' || (k + 1) AS "on" FROM m WHERE k % (6 + task_id) <> 0),
r AS (SELECT task_id, method, 0 AS n FROM seeds UNION ALL SELECT dep.task_id, dep.method, n + 1 FROM r JOIN dep ON dep.task_id = r.task_id AND dep."on" = r.method WHERE n < 4) SELECT DISTINCT task_id, method FROM r""",
)
def fixpoint_nonnull(spark, d):
    """Two tasks with the same method names, and other seeds."""
    p = tables.read(spark, d, "part").select("p_partkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("task_id"))
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    k, t = F.col("p_partkey"), F.col("task_id")
    depends = p.filter(k % (6 + t) != 0).select("task_id", name(k).alias("method"), name(k + 1).alias("on"))
    return graph.nonnull_returns(p.filter(k % (6 + t) == 0).select("task_id", name(k).alias("method")), depends, rounds=4)


PROOF_SQL = """WITH p AS (SELECT p_partkey AS param, t AS task_id FROM part, (SELECT unnest([0, 1]) AS t)),
sites AS (SELECT task_id, param, CASE WHEN param % 5 = 1 THEN 'self' WHEN param % 35 = 2 + task_id THEN 'none' ELSE 'param' END AS arg_kind, param - 1 AS arg FROM p WHERE param % 5 <> 0),
ev AS (SELECT task_id, param, bool_and(arg_kind IN ('self', 'param')) AS ok FROM sites GROUP BY ALL), h AS (SELECT DISTINCT task_id, param, arg FROM sites WHERE arg_kind = 'param'),
s0 AS (SELECT task_id, param, coalesce(ok, false) AS proven FROM p LEFT JOIN ev USING (task_id, param))""" + "".join(
    f""",
m{i} AS (SELECT h.task_id, h.param, bool_and(coalesce(s.proven, false)) AS ok FROM h LEFT JOIN s{i} s ON s.task_id = h.task_id AND s.param = h.arg GROUP BY ALL),
s{i + 1} AS (SELECT s.task_id, s.param, s.proven AND coalesce(m.ok, true) AS proven FROM s{i} s LEFT JOIN m{i} m USING (task_id, param))"""
    for i in range(6)
)


SITES_SQL = """c AS (SELECT DISTINCT p_partkey % 3 AS task_id, 'C' || (p_partkey % 50) AS class_name, p_partkey % 4 = 0 AS is_private, 'm' || (p_partkey % 7) || '/1#0' AS param FROM part),
s AS (SELECT l_orderkey % 3 AS task_id, 'm' || (l_partkey % 7) || '/1#0' AS param, CASE WHEN l_orderkey % 997 = 0 THEN 'none' WHEN l_partkey % 5 = 0 THEN 'param' ELSE 'self' END AS kind,
  'm' || ((l_partkey + 1) % 7) || '/1#0' AS arg, 'C' || (l_suppkey % 50) AS arg_class, l_suppkey % 3 = 0 AS arg_private, CASE WHEN l_linenumber % 3 > 0 THEN 'C' || (l_partkey % 50) END AS scope_type, 'C' || (l_suppkey % 50) AS around FROM lineitem),
n AS (SELECT * FROM c UNION SELECT task_id, arg_class, arg_private, arg FROM s WHERE kind = 'param'),
own AS (SELECT DISTINCT n.*, kind, arg_class, arg_private AS ap, arg FROM n JOIN s USING (task_id, param) WHERE CASE WHEN scope_type IS NOT NULL THEN scope_type = class_name ELSE NOT is_private OR around = class_name END),
fell AS (SELECT task_id, class_name, is_private, param FROM n WHERE NOT EXISTS (SELECT 1 FROM own o WHERE (o.task_id, o.class_name, o.is_private, o.param) = (n.task_id, n.class_name, n.is_private, n.param)) OR
  EXISTS (SELECT 1 FROM own o WHERE (o.task_id, o.class_name, o.is_private, o.param) = (n.task_id, n.class_name, n.is_private, n.param) AND kind = 'none')
  UNION SELECT o.task_id, o.class_name, o.is_private, o.param FROM own o JOIN fell f ON o.kind = 'param' AND (o.task_id, o.arg_class, o.ap, o.arg) = (f.task_id, f.class_name, f.is_private, f.param))"""


@query("null_attributed", f"WITH RECURSIVE {SITES_SQL} SELECT c.*, NOT EXISTS (SELECT 1 FROM fell f WHERE (f.task_id, f.class_name, f.is_private, f.param) = (c.task_id, c.class_name, c.is_private, c.param)) AS proven FROM c")
def null_attributed(spark, d):
    """Seven names of methods over fifty classes: every candidate has sites in its own class, in others and in none that is told."""
    k, o, p, s = F.col("p_partkey"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    cls = lambda c: F.concat(F.lit("C"), (c % 50).cast("string"))
    param = lambda c: F.concat(F.lit("m"), (c % 7).cast("string"), F.lit("/1#0"))
    candidates = tables.read(spark, d, "part").select((k % 3).alias("task_id"), cls(k).alias("class_name"), (k % 4 == 0).alias("is_private"), param(k).alias("param")).distinct()
    kind = F.when(o % 997 == 0, "none").when(p % 5 == 0, "param").otherwise("self")
    sites = tables.read(spark, d, "lineitem").select(
        (o % 3).alias("task_id"), param(p).alias("param"), kind.alias("arg_kind"), param(p + 1).alias("arg"), cls(s).alias("arg_class"), (s % 3 == 0).alias("arg_private"),
        F.when(F.col("l_linenumber") % 3 > 0, cls(p)).alias("scope_type"), F.array(cls(s)).alias("caller_types"),
    )
    return graph.attributed_proof(candidates, sites)


@query("null_proof", PROOF_SQL + " SELECT task_id, param, proven FROM s6")
def null_proof(spark, d):
    """Two tasks with the same parameters, and other sites."""
    p = tables.read(spark, d, "part").select(F.col("p_partkey").alias("param"), F.explode(F.array(F.lit(0), F.lit(1))).alias("task_id"))
    k = F.col("param")
    sites = p.filter(k % 5 != 0).select("task_id", "param", F.when(k % 5 == 1, "self").when(k % 35 == 2 + F.col("task_id"), "none").otherwise("param").alias("arg_kind"), (k - 1).alias("arg"))
    return graph.null_proof(p, sites)


# ---------------------------------------------------------------- rules on lines and names

LONGEST = "coalesce(list_max(list_transform(regexp_extract_all(line, '(\"(\\\\.|[^\"\\\\])*\"?|''(\\\\.|[^''\\\\])*''?)', 1), lambda x: length(x))), 0)"


@query(
    "line_length_rule",
    "WITH "
    + tables.LINES_SQL
    + f", o AS (SELECT task_id, file_path, line_no, length(line) AS size, {LONGEST} AS lit FROM lines WHERE length(line) > 120), k AS (SELECT *, row_number() OVER (PARTITION BY task_id, file_path ORDER BY line_no) AS n FROM o WHERE size - greatest(lit - 2, 0) > 120) SELECT task_id, file_path, line_no, size FROM k WHERE n <= 10",
)
def line_length_rule(spark, d):
    return line_rules.long_lines(tables.lines(tables.files(spark, d))).select("task_id", "file_path", "line_no", "size")


TODO_SQL = "t AS (SELECT event_id % 3 AS task_id, 'f' || (event_id % 50) AS file_path, event_id AS line_no, CASE event_id % 6 WHEN 0 THEN 'x = ' || event_id || ' // TODO ' || event_type WHEN 1 THEN '/* FIXME ' || event_type WHEN 2 THEN '// noTODO' WHEN 3 THEN '// TODOS' ELSE 'TODO = 1' END AS line FROM events)"


@query("todo_rule", f"WITH {TODO_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY task_id, file_path ORDER BY line_no) AS n FROM t WHERE regexp_matches(line, '//(.*[^A-Za-z0-9_])?(TODO|FIXME)([^A-Za-z0-9_]|$)|/\\*+\\s*(TODO|FIXME)([^A-Za-z0-9_]|$)')) SELECT task_id, file_path, line_no, line FROM k WHERE n <= 10")
def todo_rule(spark, d):
    i = F.col("event_id")
    line = F.when(i % 6 == 0, F.concat(F.lit("x = "), i.cast("string"), F.lit(" // TODO "), F.col("event_type"))).when(i % 6 == 1, F.concat(F.lit("/* FIXME "), F.col("event_type")))
    line = line.when(i % 6 == 2, "// noTODO").when(i % 6 == 3, "// TODOS").otherwise("TODO = 1")
    rows = tables.read(spark, d, "events").select((i % 3).alias("task_id"), F.concat(F.lit("f"), (i % 50).cast("string")).alias("file_path"), i.alias("line_no"), line.alias("line"))
    return line_rules.todo_comments(rows).select("task_id", "file_path", "line_no", "line")


SECRET_LINES = [
    "String apiKey = \"abcdef123\";", "password: 'hunter2xyz'", "token = \"changeme\"", "tokenUrl = \"https://host/path\"", "tokenUrl = \"https://user@host/path\"",
    "secretName = \"secret-name-value\"", "pwd = \"abc\"", "count = \"longvalue\"", "db.password = \"p4ssw0rd!\"",
]


@query(
    "secret_rule",
    f"""WITH l AS (SELECT event_id, ([{', '.join(map(C.sql_value, SECRET_LINES))}])[event_id % {len(SECRET_LINES)} + 1] AS line FROM events),
x AS (SELECT *, regexp_extract(line, '([A-Za-z_][A-Za-z0-9_.]*)\\s*[=:]\\s*["'']([^"'']*)["'']', 1) AS name, regexp_extract(line, '([A-Za-z_][A-Za-z0-9_.]*)\\s*[=:]\\s*["'']([^"'']*)["'']', 2) AS value FROM l),
y AS (SELECT *, list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(value, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda s: lower(s)), lambda s: length(s) >= 4)) AS vw,
  list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda s: lower(s)), lambda s: length(s) >= 4)) AS nw FROM x)
SELECT event_id, name, value FROM y WHERE name <> '' AND regexp_matches(name, '(?i)(password|passwd|pwd|secret|apikey|api_key|accesskey|access_key|token|credential|privatekey|private_key)') AND length(value) >= 6
  AND NOT regexp_matches(value, {C.sql_value(line_rules.PLACEHOLDER)}) AND NOT (regexp_matches(name, '(?i)(url|uri|endpoint)') AND regexp_matches(value, '(?i)^https?://') AND NOT regexp_matches(value, '(?i)^https?://[^/]*@'))
  AND NOT (len(vw) >= 2 AND list_has_any(vw, nw))""",
)
def secret_rule(spark, d):
    line = F.get(F.array(*map(F.lit, SECRET_LINES)), (F.col("event_id") % len(SECRET_LINES)).cast("int"))
    return line_rules.secrets(tables.read(spark, d, "events").select("event_id", line.alias("line"))).select("event_id", "name", "value")


KINDS = ["class", "method", "field", "constant", "variable"]
NAME_SQL = f"n AS (SELECT p_partkey AS id, ([{', '.join(map(C.sql_value, KINDS))}])[p_partkey % 5 + 1] AS kind, CASE p_partkey % 7 WHEN 0 THEN 'Foo' WHEN 1 THEN 'fooBar' WHEN 2 THEN 'FOO_BAR' WHEN 3 THEN 'x' WHEN 4 THEN 'main' WHEN 5 THEN 'foo_bar' ELSE '9x' END AS name FROM part)"


@query(
    "naming_rules",
    f"""WITH {NAME_SQL}, r AS (SELECT *, CASE WHEN kind = 'class' AND NOT regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'NAMING_CLASS' WHEN kind = 'method' AND name <> 'main' AND NOT regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'NAMING_METHOD'
  WHEN kind = 'field' AND NOT regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'NAMING_FIELD' WHEN kind = 'constant' AND NOT regexp_matches(name, '^[A-Z][A-Z0-9_]*$') THEN 'NAMING_CONSTANT'
  WHEN kind = 'variable' AND length(name) <> 1 AND NOT regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'NAMING_VARIABLE' END AS rule_code FROM n) SELECT id, name, rule_code FROM r WHERE rule_code IS NOT NULL""",
)
def naming_rules(spark, d):
    k = F.col("p_partkey")
    names = F.get(F.array(*map(F.lit, ["Foo", "fooBar", "FOO_BAR", "x", "main", "foo_bar", "9x"])), (k % 7).cast("int"))
    kinds = F.get(F.array(*map(F.lit, KINDS)), (k % 5).cast("int"))
    return line_rules.naming(tables.read(spark, d, "part").select(k.alias("id"), kinds.alias("kind"), names.alias("name"))).select("id", "name", "rule_code")


PACKAGES = ["com.acme.web", "com.acme.service.impl", "com.acme.dao", "com.acme.entity", "com.acme.util", "org.other.dao", "com.acme.a.controllers"]
LAYER_SQL = "coalesce(list_filter(list_transform(string_split(lower({p}), '.'), lambda s: " + C.sql_case("s", line_rules.LAYER_SEGMENT) + "), lambda x: x IS NOT NULL)[1], {s})"


@query(
    "layer_rules",
    f"""WITH i AS (SELECT p_partkey AS id, ([{', '.join(map(C.sql_value, PACKAGES))}])[p_partkey % 7 + 1] AS own_package, ([{', '.join(map(C.sql_value, PACKAGES))}])[p_partkey // 7 % 7 + 1] AS pkg,
  CASE p_partkey % 3 WHEN 0 THEN 'UserDao' WHEN 1 THEN 'UserController' ELSE 'Helper' END AS simple_name FROM part),
j AS (SELECT *, {LAYER_SQL.format(p='own_package', s='NULL')} AS a, {LAYER_SQL.format(p='pkg', s="CASE WHEN ends_with(simple_name, 'Dao') THEN 'dao' WHEN ends_with(simple_name, 'Controller') THEN 'controller' END")} AS b
  FROM i WHERE starts_with(pkg || '.', regexp_extract(own_package, '^[^.]+\\.[^.]+') || '.')),
r AS (SELECT *, CASE WHEN a = 'controller' AND b = 'dao' THEN 'ARCH_LAYER_SKIP' WHEN a IN ('service', 'dao') AND b = 'controller' THEN 'ARCH_LAYER_REVERSE' WHEN a = 'entity' AND b IN ('controller', 'service', 'dao') THEN 'ARCH_ENTITY_LEAK' END AS rule_code FROM j)
SELECT id, own_package, pkg, simple_name, rule_code FROM r WHERE rule_code IS NOT NULL""",
)
def layer_rules(spark, d):
    k = F.col("p_partkey")
    package = lambda i: F.get(F.array(*map(F.lit, PACKAGES)), i.cast("int"))
    name = F.when(k % 3 == 0, "UserDao").when(k % 3 == 1, "UserController").otherwise("Helper")
    rows = tables.read(spark, d, "part").select(k.alias("id"), package(k % 7).alias("own_package"), package(F.floor(k / 7) % 7).alias("pkg"), name.alias("simple_name"))
    return line_rules.layer_rules(rows).select("id", "own_package", "pkg", "simple_name", "rule_code")


# ---------------------------------------------------------------- sources

POM = "<project><parent><groupId>org.p</groupId><artifactId>parent</artifactId><version>1.0</version></parent><dependencies><dependency>\n<groupId>{0}</groupId> <artifactId>lib{1}</artifactId>\n<version>{2}.0</version></dependency><dependency><groupId>g</groupId><artifactId>plain</artifactId></dependency><dependency><groupId>t</groupId><artifactId>junit</artifactId><version>4</version><scope>test</scope></dependency></dependencies></project>"


@query(
    "pom_dependencies",
    r"""WITH p AS (SELECT p_partkey AS task_id, lower(p_brand) AS b FROM part)
SELECT task_id, 'org.p' AS group_id, 'parent' AS artifact_id, '1.0' AS version, 'parent' AS scope FROM p
UNION ALL SELECT task_id, b, 'lib' || task_id, (task_id % 9) || '.0', 'compile' FROM p
UNION ALL SELECT task_id, 'g', 'plain', NULL, 'compile' FROM p UNION ALL SELECT task_id, 't', 'junit', '4', 'test' FROM p""",
)
def pom_dependencies(spark, d):
    k = F.col("p_partkey")
    parts = POM.replace("{0}", "\x00").replace("{1}", "\x00").replace("{2}", "\x00").split("\x00")
    content = F.concat(F.lit(parts[0]), F.lower("p_brand"), F.lit(parts[1]), k.cast("string"), F.lit(parts[2]), (k % 9).cast("string"), F.lit(parts[3]))
    return build_files.pom_dependencies(tables.read(spark, d, "part").select(k.alias("task_id"), content.alias("content")))


@query(
    "gradle_dependencies",
    "WITH p AS (SELECT p_partkey AS task_id FROM part) SELECT task_id, 'org.a' AS group_id, 'x' || task_id AS artifact_id, '1.' || (task_id % 5) AS version, 'compile' AS scope FROM p UNION ALL SELECT task_id, 'junit', 'junit', '4.12', 'test' FROM p UNION ALL SELECT task_id, 'org.r', 'rt', '2', 'runtime' FROM p",
)
def gradle_dependencies(spark, d):
    k = F.col("p_partkey")
    content = F.concat(F.lit("plugins {}\ndependencies {\n  implementation 'org.a:x"), k.cast("string"), F.lit(":1."), (k % 5).cast("string"), F.lit("'\n  testImplementation \"junit:junit:4.12\"\n  runtimeOnly 'org.r:rt:2'\n  // done\n}"))
    return build_files.gradle_dependencies(tables.read(spark, d, "part").select(k.alias("task_id"), content.alias("content")))


@query(
    "test_output_parse",
    "SELECT p_partkey AS id, (2 * (p_partkey % 9) + 3)::INT AS run, (p_partkey % 4 + 1)::INT AS failures, 1 AS errors, 2 AS skipped, (2 * (p_partkey % 9) + 3 - (p_partkey % 4 + 1) - 1)::INT AS passed FROM part",
)
def test_output_parse(spark, d):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("noise\nTests run: "), s(k % 9), F.lit(", Failures: "), s(k % 4), F.lit(", Errors: 0, Skipped: 1\nmore\nTests run: "), s(k % 9 + 3), F.lit(", Failures: 1, Errors: 1, Skipped: 1\n"))
    return build_files.test_counts(tables.read(spark, d, "part").select(k.alias("id"), text.alias("output")))


@query(
    "env_stats",
    "WITH "
    + tables.LINES_SQL
    + """, s AS (SELECT task_id, count(DISTINCT file_path) AS n_files, count(*) AS n_lines, count(*) FILTER (trim(line) <> '' AND NOT starts_with(trim(line), '//') AND NOT starts_with(trim(line), '*')) AS n_code_lines FROM lines GROUP BY 1) SELECT * FROM s""",
)
def env_stats(spark, d):
    return environment.line_stats(tables.lines(tables.files(spark, d)))


@query("root_packages", "WITH p AS (SELECT p_partkey % 20 AS task_id, 'com.acme' || CASE WHEN p_partkey % 20 < 10 THEN '.app' ELSE '' END || '.m' || (p_partkey % 3) AS pkg FROM part) SELECT task_id, CASE WHEN task_id < 10 THEN 'com.acme.app' ELSE 'com.acme' END AS root_package FROM p GROUP BY task_id HAVING count(DISTINCT pkg) > 1 UNION ALL SELECT task_id, min(pkg) FROM p GROUP BY task_id HAVING count(DISTINCT pkg) = 1")
def root_packages(spark, d):
    k = F.col("p_partkey")
    pkg = F.concat(F.lit("com.acme"), F.when(k % 20 < 10, ".app").otherwise(""), F.lit(".m"), (k % 3).cast("string"))
    return environment.root_package(tables.read(spark, d, "part").select((k % 20).alias("task_id"), pkg.alias("pkg")))


@query(
    "frameworks",
    f"WITH {tables.dependencies_sql()}, f AS (SELECT * FROM {C.sql_rows([(k, a) for k, v in C.FRAMEWORKS.items() for a in v], 'framework, a')}) SELECT DISTINCT task_id, framework FROM dependencies JOIN f ON artifact_id = a",
)
def frameworks(spark, d):
    return environment.frameworks(tables.dependencies(spark, d))


# ---------------------------------------------------------------- events, templates, JSON

TRIGGERS = [
    {"trigger_id": 0, "is_enabled": True, "scope": "org0/repo0", "branch_filter": "main, release/**"},
    {"trigger_id": 1, "is_enabled": True, "scope": None, "branch_filter": ""},
    {"trigger_id": 2, "is_enabled": False, "scope": "", "branch_filter": "main"},
]
PARSED_SQL = (
    "WITH "
    + tables.WEBHOOK_SQL
    + """, parsed AS (SELECT event_id, trigger_id, platform,
  json_extract_string(payload, CASE upper(platform) WHEN 'GITHUB' THEN '$.repository.clone_url' WHEN 'GITLAB' THEN '$.project.git_http_url' WHEN 'GITEE' THEN '$.project.git_http_url' ELSE '$.repoUrl' END) AS repo_url,
  CASE upper(platform) WHEN 'GITHUB' THEN regexp_replace(json_extract_string(payload, '$.ref'), '^refs/heads/', '') WHEN 'GITLAB' THEN json_extract_string(payload, '$.object_attributes.source_branch') WHEN 'GITEE' THEN NULL ELSE 'main' END AS branch,
  json_extract_string(payload, CASE upper(platform) WHEN 'GITHUB' THEN '$.head_commit.id' WHEN 'GITLAB' THEN '$.after' WHEN 'GITEE' THEN '$.after' ELSE '$.commitId' END) AS commit_id,
  json_extract_string(payload, CASE upper(platform) WHEN 'GITHUB' THEN '$.head_commit.author.name' WHEN 'GITLAB' THEN '$.user.username' WHEN 'GITEE' THEN '$.none' ELSE '$.author' END) AS author,
  CASE WHEN upper(platform) = 'GITLAB' THEN json_extract_string(payload, '$.object_attributes.iid') END AS request_id FROM webhooks)"""
)
FIELDS = ["event_id", "trigger_id", "repo_url", "branch", "commit_id", "author", "request_id"]


@query("webhook_parse", PARSED_SQL + f" SELECT {', '.join(FIELDS)} FROM parsed WHERE repo_url IS NOT NULL")
def webhook_parse(spark, d):
    return webhooks.parsed(tables.webhook_events(spark, d)).select(*FIELDS)


@query(
    "webhook_parse_filter",
    PARSED_SQL
    + f""" SELECT {', '.join(FIELDS)} FROM parsed WHERE repo_url IS NOT NULL AND ((trigger_id = 0 AND regexp_matches(lower(repo_url), 'org0/repo0\\.git/?$') AND (branch IS NULL OR branch = 'main' OR starts_with(branch, 'release/'))) OR trigger_id = 1)""",
)
def webhook_parse_filter(spark, d):
    return webhooks.gated(tables.webhook_events(spark, d), TRIGGERS).select(*FIELDS)


@query("owner_repo", "WITH " + tables.WEBHOOK_SQL + " SELECT event_id, regexp_replace(regexp_replace(url, '^https://git.example.com/', ''), '\\.git/?$', '') AS repo FROM src")
def owner_repo(spark, d):
    parsed = tables.webhook_events(spark, d).select("event_id", F.regexp_extract("payload", r'"(https://[^"]*)"', 1).alias("url"), (F.col("event_id") % 3).alias("o"), (F.col("event_id") % 2).alias("r"))
    url = F.when(F.col("url") != "", F.col("url")).otherwise(F.concat(F.lit("https://git.example.com/Org"), F.col("o").cast("string"), F.lit("/repo"), F.col("r").cast("string"), F.lit(".git")))
    return parsed.select("event_id", T.owner_repo(url).alias("repo"))


@query("template_render", "SELECT conv_id, turn, 'Hi ' || role || ', turn ' || turn || ' of ${unknown} at ${x}, then ${turn} ' || role AS rendered FROM conversations")
def template_render(spark, d):
    c = tables.read(spark, d, "conversations")
    values = F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"), F.lit("again"), F.lit("${turn}"))
    return c.select("conv_id", "turn", T.render(F.lit("Hi ${role}, turn ${turn} of ${unknown} at \\${x}, then ${again} ${ role }"), values).alias("rendered"))


@query("json_extract", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'BUG' WHEN 1 THEN 'minor' ELSE 'x' END AS level_code, CASE event_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MINOR' ELSE 'INFO' END AS level, (event_id % 100)::INT AS line, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k FROM events")
def json_extract(spark, d):
    i = F.col("event_id")
    code = F.when(i % 3 == 0, "BUG").when(i % 3 == 1, "minor").otherwise("x")
    answer = F.concat(F.lit('Here: [{"level":"'), code, F.lit('","line":'), (i % 100).cast("string"), F.lit("}] done"))
    e = tables.read(spark, d, "events").select("event_id", "props", answer.alias("answer"))
    rows = e.select("event_id", "props", F.explode(F.from_json(T.json_array(F.col("answer")), "array<struct<level:string,line:int>>")).alias("f"))
    return rows.select("event_id", F.col("f.level").alias("level_code"), C.level_of(F.col("f.level")).alias("level"), F.col("f.line").alias("line"), T.json_int(F.col("props"), "k", -1).alias("k"))


@query("path_functions", "SELECT page_id, CASE WHEN contains(url, '/') AND length(url) > 40 THEN '...' || right(url, 37) ELSE url END AS short, string_split(url, '/')[-1] AS file, CASE WHEN length(html) <= 30 THEN html ELSE left(html, 29) || '…' END AS cut, replace(replace(left(html, 200), '|', '\\|'), chr(10), ' ') AS cell FROM pages")
def path_functions(spark, d):
    p = tables.read(spark, d, "pages")
    return p.select("page_id", T.short_path(F.col("url")).alias("short"), T.file_name(F.col("url")).alias("file"), T.truncated(F.col("html"), 30).alias("cut"), T.markdown_cell(F.left("html", F.lit(200))).alias("cell"))


IMPORT_LINE = "CASE event_id % 4 WHEN 0 THEN 'import a.b' || event_id WHEN 1 THEN '// note' WHEN 2 THEN '' ELSE CASE WHEN event_id % 3 = 0 THEN 'int x;' ELSE 'package p;' END END"


@query(
    "import_only_purge",
    f"""WITH l AS (SELECT event_id // 100 % 2 AS task_id, 'f' || (event_id // 200) AS file_path, (event_id % 100 + 1)::INT AS line_no, {IMPORT_LINE} AS line FROM events),
r AS (SELECT event_id // 2 AS id, event_id // 100 % 2 AS task_id, 'f' || (event_id // 200) AS file_path, (event_id % 90 + 1)::INT AS s, (event_id % 90 + 3)::INT AS e FROM events),
j AS (SELECT id, line FROM r JOIN l ON l.task_id = r.task_id AND l.file_path = r.file_path AND line_no BETWEEN s AND e),
g AS (SELECT id, bool_and(line = '' OR starts_with(line, 'import ') OR starts_with(line, 'package ') OR starts_with(line, '//')) AS p, bool_or(starts_with(line, 'import ')) AS i FROM j GROUP BY 1)
SELECT id FROM g WHERE p AND i AND id IN (SELECT id FROM r GROUP BY 1 HAVING count(*) >= 2)""",
)
def import_only_purge(spark, d):
    i = F.col("event_id")
    e = tables.read(spark, d, "events")
    line = F.when(i % 4 == 0, F.concat(F.lit("import a.b"), i.cast("string"))).when(i % 4 == 1, "// note").when(i % 4 == 2, "").when(i % 3 == 0, "int x;").otherwise("package p;")
    task, path = (F.floor(i / 100) % 2).alias("task_id"), F.concat(F.lit("f"), F.floor(i / 200).cast("string"))
    lines = e.select(task, path.alias("file_path"), (i % 100 + 1).cast("int").alias("line_no"), line.alias("line"))
    ranges = e.select(F.floor(i / 2).alias("id"), task, path.alias("file_path"), (i % 90 + 1).cast("int").alias("s"), (i % 90 + 3).cast("int").alias("e"))
    return migrate.import_only(ranges, lines)


MIGRATED_RULES = [*sorted(C.RULES)[:8], "STYLE_WILDCARD_IMPORT", "OTHER", "X"]
MIGRATED_LEVELS = ["BUG", " info ", "WARNING", "MINOR", "MAJOR", None, "Bug", "CRITICAL"]
PICKED = "([{values}])[p_partkey % {n} + 1]"
MIGRATED_SQL = f"""WITH r AS (SELECT p_partkey AS id, {PICKED.format(values=', '.join(map(C.sql_value, MIGRATED_RULES)), n=len(MIGRATED_RULES))} AS rule_code, {PICKED.format(values=', '.join(map(C.sql_value, MIGRATED_LEVELS)), n=len(MIGRATED_LEVELS))} AS default_level FROM part)
SELECT id, rule_code, CASE WHEN upper(trim(default_level)) IN ('BUG', 'WARNING', 'INFO') THEN coalesce({C.sql_by_rule('rule_code', 0)}, {C.sql_case('upper(trim(default_level))', C.MIGRATED)}) WHEN rule_code = 'STYLE_WILDCARD_IMPORT' AND default_level = 'MINOR' THEN 'INFO' ELSE default_level END AS default_level FROM r"""


@query("rule_level_migration", MIGRATED_SQL)
def rule_level_migration(spark, d):
    k = F.col("p_partkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    return migrate.rule_levels(tables.read(spark, d, "part").select(k.alias("id"), pick(MIGRATED_RULES).alias("rule_code"), pick(MIGRATED_LEVELS).alias("default_level")))
