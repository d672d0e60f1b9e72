"""Operators on small hand-made tables."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lintquarry.operators import duplicates, govern, graph, intervals, issues, java_rules, line_rules, migrate, quality, webhooks
from lintquarry.schemas import REVIEW_RULE
from lintquarry.sources import build_files, files

HIT = "task_id bigint, file_path string, rule_code string, level string, severity int, line_start int, line_end int, title string, description string, checker_type string, checker_name string, code_snippet string, suggestion string, ai_generated boolean, seq bigint"


def hit(line, seq, level="MAJOR", rule="R", file="f", severity=3, snippet=None, suggestion=None):
    return (1, file, rule, level, severity, line, line, f"t{seq}", "d", "c", "C", snippet, suggestion, False, seq)


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), HIT)


def test_active_hits_hide_ignored_ones(spark):
    h = hits(spark, hit(5, 1), hit(9, 2), hit(6, 3), hit(1, 4, rule="S"), hit(2, 5, rule="S"))
    some = govern.govern(h, spark.createDataFrame([], REVIEW_RULE), [{"rule_type": "LINE_NUMBER", "file_path": "f", "line_number": 9, "is_enabled": True}, {"rule_type": "RULE_CODE", "rule_code": "s", "is_enabled": True}])
    got = {r.rule_code: r for r in some.collect()}
    assert (got["R"].is_ignored, got["R"].occurrence_count, got["R"].line_label) == (False, 2, "5-6")
    assert (got["S"].is_ignored, got["S"].occurrence_count, got["S"].ignore_type) == (True, 2, "RULE")


def test_merge_takes_earliest_worst_and_first_text(spark):
    h = hits(spark, hit(9, 1, "MINOR", severity=2, snippet=" "), hit(3, 2, "MAJOR", snippet="b", suggestion="s2"), hit(3, 3, "BLOCKER", severity=5, snippet="c"), hit(0, 4, file="g"))
    got = {r.file_path: r for r in govern.merge(h.withColumn("is_ignored", F.lit(False))).collect()}
    r = got["f"]
    assert (r.level, r.title, r.severity, r.code_snippet, r.suggestion, r.line_start, r.line_end) == ("MAJOR", "t2", 5, "b", "s2", 3, 9)
    assert (got["g"].line_start, got["g"].line_end) == (1, 1)


@pytest.mark.parametrize(("level", "enabled", "want"), [("critical", None, "MAJOR"), ("BUG", True, "MAJOR"), ("CRITICAL", True, "CRITICAL"), ("CRITICAL", False, None), (None, None, "MAJOR")])
def test_rule_settings(spark, level, enabled, want):
    rules = spark.createDataFrame([("R", "n", "c", level, enabled, 1)], REVIEW_RULE)
    got = govern.apply_rule_settings(hits(spark, hit(1, 1)), rules).collect()
    assert [r.level for r in got] == ([want] if want else [])
    assert not got or got[0].severity == (4 if want == "CRITICAL" else 3)


def verdict(spark, blocker=0, critical=0, major=0, minor=0, gate=quality.Gate()):
    row = spark.createDataFrame([(1, blocker, critical, major, minor, 0, 0, 43)], "task_id int, blocker int, critical int, major int, minor int, info int, ignored int, debt_minutes int")
    r = quality.graded(row, gate).collect()[0]
    return r.score, r.grade, r.passed


def test_hits_of_one_rule_stay_in_many_tasks(spark):
    hits = spark.range(0, 4000, 1, 4).selectExpr("id AS task_id", "'f' AS file_path", "'MAGIC_NUMBER' AS rule_code", "'MINOR' AS level", "2 AS severity")
    out = govern.apply_rule_settings(hits, spark.createDataFrame([("MAGIC_NUMBER", None, None, "BLOCKER", None, 1)], REVIEW_RULE))
    places = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("level")).collect()
    assert len(places) == 4 and all(r.n == 1000 and r.level == "BLOCKER" for r in places)


def test_gate(spark):
    assert verdict(spark, critical=2, major=2, minor=3) == (57, "POOR", False)
    assert verdict(spark, major=4) == (80, "GOOD", True)
    assert verdict(spark, blocker=1) == (75, "GOOD", False)
    assert verdict(spark, blocker=9) == (0, "POOR", False)
    assert verdict(spark, blocker=1, gate=quality.Gate().overlaid(blocker_limit=1, pass_score=70)) == (75, "GOOD", True)
    scores = [verdict(spark, major=n)[0] for n in range(4)]
    assert scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError):
        quality.Gate().overlaid(excellent_score=50)
    with pytest.raises(ValueError):
        quality.Gate().overlaid(major_weight=101)
    none = quality.with_missing_tasks(quality.graded(spark.createDataFrame([], "task_id int, blocker int, critical int, major int, minor int, info int, ignored int, debt_minutes int"), quality.Gate()), spark.createDataFrame([(7,)], "task_id int"))
    assert [(r.score, r.grade, r.passed) for r in none.collect()] == [(0, "POOR", False)]


def test_context(spark):
    points = spark.createDataFrame([("f", 5, 5, 20), ("f", 9, 9, 20)], "file_path string, s int, e int, total int")
    seg = intervals.context_windows(points, ["file_path"], 1)
    assert sorted((r.s, r.e, r.gap) for r in seg.collect()) == [(4, 6, 0), (8, 10, 1)]
    lines = spark.createDataFrame([("f", n, f"l{n}") for n in range(1, 21)], "file_path string, line_no int, line string")
    got = sorted((r.line_no, r.line, r.issue_line, r.marker, r.gap_before) for r in intervals.context_lines(seg, points, lines, ["file_path"]).collect())
    assert [g[0] for g in got] == [4, 5, 6, 8, 9, 10]
    assert got[1] == (5, "l5", True, "single", 0) and got[3] == (8, "l8", False, None, 1)


def walked_runs(files, n, counts=lambda path, i: True):
    """Runs of equal windows by comparing all places: (task, file_a, idx_a, file_b, idx_b, length)."""
    out = {}
    for (t, p, a), (u, q, b) in ((x, y) for x in files for y in files if x[0] == y[0] and x[1] <= y[1]):
        pair = lambda i, j: 0 <= i <= len(a) - n and 0 <= j <= len(b) - n and (p < q or j - i >= n) and a[i : i + n] == b[j : j + n] and counts(p, i) and counts(q, j)
        for i in range(len(a)):
            for j in range(len(b)):
                if pair(i, j) and not pair(i - 1, j - 1):
                    k = 1
                    while pair(i + k, j + k):
                        k += 1
                    out[t, p, i, q, j] = k
    return out


def test_duplicate_runs_are_those_of_comparing_all_places(spark):
    rng = random.Random(1)
    block = [rng.choice("abcd") for _ in range(14)]
    files = [(t, f"f{k}", [rng.choice("ab") for _ in range(rng.randint(0, 12))] + block[rng.randint(0, 3) :] + [rng.choice("ab") for _ in range(9)] + block) for t in (1, 2) for k in range(4)] + [(1, "short", ["a"])]
    df = spark.createDataFrame([(t, p, " ".join(w)) for t, p, w in files], "task_id int, file_path string, content string")
    windows = duplicates.chained(duplicates.words(df), 4)
    want = walked_runs(files, 4)
    assert {(r.task_id, r.file_a, r.idx_a, r.file_b, r.idx_b): r.length for r in duplicates.runs(windows, 4).collect()} == want and len(want) > 50
    assert {tuple(r) for r in duplicates.chain_heads(windows, 4).collect()} == set(want)
    # only windows that reach into a range of lines: one token a line, ranges at lines 3-6 and 20-22
    ranges = [(3, 6), (20, 22)]
    rows = [(t, p, w, list(range(1, len(w) + 1)), ranges) for t, p, w in files]
    tokens = spark.createDataFrame(rows, "task_id int, file_path string, t array<string>, lines array<int>, controls array<struct<s:int,e:int>>")
    controlled = duplicates.runs(duplicates.chained(tokens, 4, control=True), 4).collect()
    reach = lambda p, i: any(s <= i + 4 and e >= i + 1 for s, e in ranges)
    assert {(r.task_id, r.file_a, r.idx_a, r.file_b, r.idx_b): r.length for r in controlled} == walked_runs(files, 4, reach)
    assert all((r.s_a, r.e_a) == (r.idx_a + 1, r.idx_a + 4) for r in controlled)


def test_duplicate_blocks(spark):
    body = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, "a", f"x {body} y"), (1, "b", f"{body}"), (1, "c", "short"), (2, "d", body)], "task_id bigint, file_path string, content string")
    for windows in (duplicates.windows(df, 5), duplicates.chained(duplicates.words(df), 5)):
        got = [tuple(r) for r in duplicates.classes(windows).select("file_path", "file_of", "idx", "length", "idx_of", "places").collect()]
        assert got == [("b", "a", 0, 8, 1, 2)]


def test_null_proof(spark):
    sites = [("a", "self", None), ("b", "param", "a"), ("c", "none", None), ("d", "param", "c"), ("e", "param", "f"), ("f", "param", "e"), ("g", "self", None), ("g", "none", None)]
    c = spark.createDataFrame([(t, x) for x in "abcdefgh" for t in (1, 2)], "task_id bigint, param string")
    rows = [(1, *s) for s in sites] + [(2, "a", "none", None), (2, "b", "param", "a")]
    got = {(r.task_id, r.param): r.proven for r in graph.null_proof(c, spark.createDataFrame(rows, "task_id bigint, param string, arg_kind string, arg string")).collect()}
    assert {p: v for (t, p), v in got.items() if t == 1} == {"a": True, "b": True, "c": False, "d": False, "e": True, "f": True, "g": False, "h": False}
    assert not any(v for (t, _), v in got.items() if t == 2)
    # a chain as long as the depth is followed to its end
    chain = [(1, f"p{k}", "param", f"p{k + 1}") for k in range(9)] + [(1, "p9", "none", None)]
    long = graph.null_proof(spark.createDataFrame([(1, f"p{k}") for k in range(10)], "task_id bigint, param string"), spark.createDataFrame(chain, "task_id bigint, param string, arg_kind string, arg string"), depth=20)
    assert not any(r.proven for r in long.collect())


def test_null_proofs_count_a_class_own_call_sites(spark):
    one = "class One { private void m(String s) { s.trim(); } public void n(String s) { s.trim(); } void a() { m(\"x\"); } }"
    two = "class Two { private void m(String s) { s.trim(); } void b(One o, Two t) { m(null); o.n(\"x\"); t.n(null); } public void n(String q) { q.trim(); } }"
    rows = [(1, "One.java", one), (1, "Two.java", two), (2, "Two.java", two)]
    read = java_rules.read(spark.createDataFrame(rows, "task_id bigint, file_path string, content string"))
    proof = graph.attributed_proof(java_rules.relation(read, "null_candidate"), java_rules.relation(read, "null_site")).collect()
    got = {(r.task_id, r.class_name, r.param): r.proven for r in proof}
    mine = {k: v for k, v in got.items() if k[2] != "b/2#0" and k[2] != "b/2#1"}
    assert mine == {(1, "One", "m/1#0"): True, (1, "One", "n/1#0"): True, (1, "Two", "m/1#0"): False, (1, "Two", "n/1#0"): False, (2, "Two", "m/1#0"): False, (2, "Two", "n/1#0"): False}


def test_tasks_with_the_same_names_stay_apart(spark):
    methods = spark.createDataFrame([(t, "a.C", "m", False) for t in (1, 2)], "task_id bigint, class_name string, method string, is_public boolean")
    methods = methods.selectExpr("*", *[f"false AS {c}" for c in ("is_override", "is_ctor", "is_abstract", "is_native")])
    edges = spark.createDataFrame([(2, "m")], "task_id bigint, callee string")
    assert [r.task_id for r in graph.unused_methods(methods, edges).collect()] == [1]
    lines = spark.createDataFrame([(t, "f", n, "// TODO x") for t in (1, 2, 3) for n in range(8)], "task_id bigint, file_path string, line_no int, line string")
    assert line_rules.todo_comments(lines).count() == 24
    ranges = spark.createDataFrame([(1, 1, "f", 1, 1), (1, 1, "f", 2, 2)], "id int, task_id bigint, file_path string, s int, e int")
    code = spark.createDataFrame([(1, "f", 1, "import a;"), (1, "f", 2, ""), (2, "f", 1, "int x;")], "task_id bigint, file_path string, line_no int, line string")
    assert [r.id for r in migrate.import_only(ranges, code).collect()] == [1]
    seen = spark.createDataFrame([(1, "C", "m", "()", 1, "old"), (1, "C", "m", "()", 2, "new"), (2, "C", "m", "()", 0, "other")], "task_id bigint, class_name string, method string, descriptor string, seq int, file_path string")
    assert sorted(r.file_path for r in graph.deduplicated(seen, "seq").collect()) == ["new", "other"]


def test_latest_and_status(spark):
    rows = spark.createDataFrame([(1, 1, "PENDING"), (1, 2, "SUCCESS"), (1, 3, "RUNNING"), (2, 1, "PENDING"), (2, 2, "FAILED")], "k int, seq int, status string")
    assert {r.k: r.status for r in issues.record_status(rows, "k", "seq").collect()} == {1: "SUCCESS", 2: "FAILED"}
    assert {r.k: r.seq for r in issues.latest_per_key(rows, ["k"], "seq").collect()} == {1: 3, 2: 2}


def test_migration(spark):
    rows = [(1, "BUG", "SEC_XXE", False, None), (2, "INFO", "OTHER", False, 1), (3, "MAJOR", "NULL_CHECK", False, 3), (4, "MAJOR", "NULL_CHECK", True, 3), (5, "MAJOR", "OTHER", False, None)]
    df = spark.createDataFrame(rows, "id int, level string, rule_code string, ai_generated boolean, severity int")
    got = {r.id: (r.new_level, r.new_severity, r.outcome) for r in migrate.severity_levels(df).collect()}
    assert got == {1: ("CRITICAL", 4, "LEGACY"), 2: ("MINOR", 2, "LEGACY"), 3: ("CRITICAL", 4, "REALIGNED"), 4: ("MAJOR", 3, "NONE"), 5: ("MAJOR", 3, "RANK_FIXED")}


def test_webhook_branches(spark):
    rows = spark.createDataFrame([("main",), ("release/a/b",), (None,), ("dev",)], "b string")
    got = [r[0] for r in rows.select(webhooks.branch_matches(F.col("b"), ["main", " release/** "])).collect()]
    assert got == [True, True, True, False]
    assert [r[0] for r in rows.select(webhooks.branch_matches(F.col("b"), [""])).collect()] == [True] * 4


def test_test_output(spark):
    one = "Tests run: 3, Failures: 1, Errors: 0, Skipped: 1\n"
    got = build_files.test_counts(spark.createDataFrame([(1, one + one), (2, "nothing")], "id int, output string")).collect()
    assert {r.id: tuple(r)[1:] for r in got} == {1: (6, 2, 0, 2, 4), 2: (0, 0, 0, 0, 0)}
    g = build_files.gradle_test_counts(spark.createDataFrame([(1, "25 tests completed, 3 failed\nBUILD FAILED"), (2, "8 tests completed")], "id int, output string")).collect()
    assert {r.id: tuple(r)[1:] for r in g} == {1: (25, 2, 23), 2: (8, 0, 8)}


def test_gradle_lines(spark):
    text = "implementation 'a:bc:1.0'\n  api \"g:nov\"\n compileOnly 'x:y:2'\n // implementation a:b:c\ntestImplementation 'j:j:4'"
    got = {tuple(r)[1:] for r in build_files.gradle_dependencies(spark.createDataFrame([(1, text)], "task_id int, content string")).collect()}
    assert got == {("a", "bc", "1.0", "compile"), ("g", "nov", None, "compile"), ("x", "y", "2", "provided"), ("j", "j", "4", "test")}


def test_archives_and_folders(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in (("src/A.java", "class A {}"), ("../evil.java", "x"), ("__MACOSX/B.java", "x"), ("src/test/T.java", "x"), ("a.txt", "x"), ("bad.java", b"\xff\xfe")):
            z.writestr(name, text)
    got = files.archives(spark.createDataFrame([(1, buffer.getvalue()), (2, b"junk"), (3, None)], "task_id bigint, content binary")).collect()
    assert [tuple(r) for r in got] == [(1, "src/A.java", "class A {}")]
    root = tmp_path / "test" / "snapshot"  # a folder above the snapshot says nothing of its files
    (root / "p" / "test").mkdir(parents=True)
    (root / "p" / "A.java").write_text("class A {}")
    (root / "p" / "ATest.java").write_text("class T {}")
    (root / "p" / "test" / "B.java").write_text("class B {}")
    assert [r.file_path for r in files.folder(spark, str(root), 4).collect()] == ["p/A.java"]
    assert sorted(r.file_path for r in files.folder(spark, str(root) + "/", 4, include_tests=True).collect()) == ["p/A.java", "p/ATest.java", "p/test/B.java"]


def test_streams_read_tables_of_either_form(spark, tmp_path):
    from lintquarry.streaming import events

    rows = spark.range(40).selectExpr("id AS event_id")
    rows.repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    rows.toPandas().to_parquet(tmp_path / "file.parquet")
    rows.limit(7).toPandas().to_parquet(tmp_path / "other.parquet")
    for name in ("folder", "file"):
        stream = events.event_stream(spark, f"{tmp_path}/{name}.parquet", rows.schema)
        assert events.available_now(stream, f"{tmp_path}/out-{name}", f"{tmp_path}/at-{name}").count() == 40
    states = events.event_stream(spark, f"{tmp_path}/folder.parquet", rows.schema).selectExpr("event_id AS record_id", "CASE event_id % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE 'RUNNING' END AS status")
    events.write_back(states, f"{tmp_path}/sink", f"{tmp_path}/at-sink", "record ${record_id} ended: ${status}")
    told = spark.read.parquet(f"{tmp_path}/sink")
    assert told.count() == 20 and told.filter("record_id = 5").select("comment").collect()[0][0] == "record 5 ended: FAILED"


def test_issue_table_replaces_only_its_tasks(spark, tmp_path):
    path = str(tmp_path / "issues")
    table = lambda *rows: spark.createDataFrame(list(rows), "task_id int, id int")
    files.write_issues(table((1, 1), (2, 2)), path)
    files.write_issues(table((2, 3)), path)
    assert sorted(tuple(r) for r in files.read_issues(spark, path).select("task_id", "id").collect()) == [(1, 1), (2, 3)]


def test_reports_and_issues_of_many_tasks_are_few_files(spark, tmp_path):
    """Tasks are replaced without a folder for each."""
    rows = spark.range(4000).selectExpr("id AS task_id", "'old' AS level", "id AS n").unionByName(spark.sql("SELECT CAST(null AS BIGINT) AS task_id, 'old' AS level, 7L AS n"))
    new = rows.filter("task_id % 2 = 0 OR task_id IS NULL").withColumn("level", F.lit("new"))
    for kind in ("json", "parquet"):
        at = str(tmp_path / kind)
        files.write_report(rows, at, kind)
        files.write_report(new, at, kind)
        got = {r.task_id: r.level for r in files.read_report(spark, at, "task_id bigint, level string, n bigint", kind).collect()}
        assert got == {k: "new" if k is None or k % 2 == 0 else "old" for k in [None, *range(4000)]}
        assert len([p for p in (tmp_path / kind).rglob("*") if p.is_dir()]) < 10
    files.write_issues(rows, str(tmp_path / "issues"))
    files.write_issues(new.withColumn("note", F.lit("x")), str(tmp_path / "issues"))
    got = files.read_issues(spark, str(tmp_path / "issues"))
    assert got.columns == ["task_id", "level", "n", "note"] and got.count() == 4001 and got.filter("note = 'x'").count() == 2001
    assert len([p for p in (tmp_path / "issues").rglob("*") if p.is_dir()]) < 10


def test_tables_are_spread_by_their_rows(spark, tmp_path):
    from lintquarry.sources import tables

    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    got = tables.spread(tables.read(spark, str(tmp_path), "t"), 30)
    sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 34 and max(sizes) <= 40 and sum(sizes) == 1000


def test_places_of_settings(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 5 <> 0 THEN id % 11 END AS k").repartition(7)
    got = issues.placed(rows, "k", "id").collect()
    want = sorted(((r.k, r.id) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.id, r.place) for r in got] == [(*w, i) for i, w in enumerate(want)]


# ---------------------------------------------------------------- Java

SOURCE = '''package com.acme.web;
import java.io.*;
import java.util.List;
import com.acme.dao.UserDao;
/** doc */
@Controller
public class users {
    private static final int max = 7;
    private List<String> names;
    private static SimpleDateFormat f;
    @Deprecated public void old() { }
    public String go(Request request, User u, String q) throws IOException {
        String token = "abcdef-12345";
        InputStream in = new FileInputStream(request.getParameter("p"));
        try (Reader r = new StringReader("")) { r.read(); } catch (IOException ignored) { }
        if (q != null && q.length() > 5) { old(); }
        String sql = "select a from b where c = " + q;
        st.executeQuery("select a from b where c = " + q);
        Object o = map.get("k").toString();
        int x = (int) 42L; int[] ys = {5, 6}; x = x * 60 + -77;
        Runtime.getRuntime().exec(q);
        MessageDigest.getInstance("MD5"); Cipher.getInstance("AES/ECB/PKCS5Padding");
        Random rnd = new Random();
        synchronized (this) { if (names == null) { names = null; } }
        Runnable l = () -> { System.err.println(u.name()); };
        for (String s : List.<String>of()) { switch (s) { case "a" -> x++; default -> { x--; } } }
        return x > 3 ? "y" : a < b ? "n" : names.stream().map(String::trim).toString();
    }
    private int getPriority() { return 55; }
    private void lonely() { try { } catch (Exception e) { } }
}
'''


def rules():
    out = {}
    for kind, row in java_rules.facts("users.java", SOURCE):
        assert kind != "error", row
        if kind == "hit":
            out.setdefault(row["rule_code"], []).append(row["line_start"])
    return out


def test_java_rules():
    got = rules()
    assert got == {
        "SEC_PATH_TRAVERSAL": [14], "SEC_SQL_INJECTION": [18], "SEC_COMMAND_INJECTION": [21], "SEC_WEAK_CRYPTO": [22, 22],
        "NULL_CHAIN_CALL": [19], "SYSTEM_OUT": [25], "RESOURCE_LEAK": [14], "EMPTY_CATCH": [30], "DEPRECATED_METHOD_DECL": [11], "DEPRECATED_METHOD_CALL": [16], "MAGIC_NUMBER": [16, 20],
        "STYLE_WILDCARD_IMPORT": [2], "CONC_STATIC_SDF": [10], "CONC_SHARED_MUTABLE_STATE": [9], "CONC_DCL_WITHOUT_VOLATILE": [24],
    }


def complexity(body):
    rows = [r for k, r in java_rules.facts("A.java", f"class A {{ void m(String s) {{ {body} }} }}") if k == "method"]
    return rows[0]["complexity"]


def test_complexity():
    assert complexity("") == 1
    assert complexity("if (a && b || c) {} for (;;) {} while (x) {} do {} while (y); for (int i : z) {}") == 8
    assert complexity("switch (s) { case 1: break; case 2: break; default: }") == 2
    assert complexity("try {} catch (E e) {} int x = a ? 1 : 2;") == 3
    assert complexity("if (s.is(1)) return; if (s.is(2)) return; if (s.is(3)) return; if (s.is(4)) return;") == 2
    assert complexity("if (s.is(1)) return; if (s.is(2)) return;") == 3


def test_java_that_cannot_be_read_gives_an_error_row(spark):
    rows = [(1, "a", "class A { void m( }"), (1, "b", None), (1, "c", "class B {}"), (1, "d", "(" * 5000)]
    read = java_rules.read(spark.createDataFrame(rows, "task_id bigint, file_path string, content string"))
    assert {r.file_path for r in java_rules.relation(read, "error").collect()} == {"a", "d"}
    assert [r.simple_name for r in java_rules.relation(read, "type").collect()] == ["B"]


def left_out(body):
    return sorted(java_rules.File("A.java", body)._left_out())


def test_lines_that_no_duplicate_counts():
    assert left_out("package a;\nimport b.\nC;\nclass A {\nint x;\nA() {\n}\nint getX() { return x; }\nvoid setX(int y) { x = y; }\nA setZ(int y) { x = y; return this; }\nint getY() { x(); return x; }\n}") == [1, 2, 3, 6, 7, 8, 9, 10]
    assert left_out("class A { void m() {\na.put(1);\na.put(2);\na.put(3);\nb.put(1);\nb.put(2);\n} }") == [2, 3, 4]
    assert left_out("class A { Object m() {\nreturn Map.of(\nP.e(1),\nP.e(2),\nP.e(3));\n} }") == [2, 3, 4, 5]
    assert left_out("class A { void m() {\nf(1);\nif (f(2)) {\nf(3);\n}\nswitch (f(4)) { case 1:\nf(5);\n}\ng(1);\nif (x) {\ng(1);\n}\n} }") == [4, 7]


def test_a_scan_takes_its_numbers_from_settings(spark):
    from lintquarry.operators import scan
    from lintquarry.schemas import CHECKER_CONFIG

    rows = [("complexity", True, '{"threshold": 3}', 2), ("complexity", True, '{"threshold": 9}', 5), ("code_style", True, '{"maxLineLength": 40}', 1), ("duplicate_code", None, "junk", 1), ("naming", True, None, 1)]
    assert scan.params_of(spark.createDataFrame(rows, CHECKER_CONFIG)) == {"threshold": 3, "maxLineLength": 40}
    code = "class A {\npublic void m(int a) { if (a > 1) { } if (a > 2) { } if (a > 3) { } }\n}"
    df = spark.createDataFrame([(1, "A.java", code)], "task_id bigint, file_path string, content string")
    codes = lambda params: sorted(r.rule_code for r in scan.raw_hits(df, params=params).collect())
    assert codes({}) == [] and codes({"threshold": 3, "maxLineLength": 40}) == ["MAX_COMPLEXITY", "STYLE_LONG_LINE"]


def test_java_that_is_odd_is_read():
    kinds = [k for k, _ in java_rules.facts("A.java", "class A { double a = 0x1.8p3, b = 0x.8P-2f, c = 0xFFL; }")]
    assert "error" not in kinds and kinds.count("variable") == 3


def test_hits_over_files(spark):
    other = "package com.acme.dao; public class UserDao { void use(users u) { u.go(null, new User(), \"x\"); } }"
    read = java_rules.read(spark.createDataFrame([(1, "users.java", SOURCE), (1, "UserDao.java", other)], "task_id bigint, file_path string, content string")).cache()
    got = {}
    for r in java_rules.all_hits(read).collect():
        got.setdefault(r.rule_code, set()).add((r.file_path, r.title))
    assert got["UNUSED_METHOD"] == {("users.java", "getPriority"), ("users.java", "lonely"), ("UserDao.java", "use")}
    assert got["NULL_CHECK"] == {("users.java", "request"), ("UserDao.java", "u")}
    assert got["ARCH_LAYER_SKIP"] == {("users.java", "com.acme.dao.UserDao")}
    assert got["SEC_HARDCODED_SECRET"] == {("users.java", "literal in token")} and got["NAMING_CLASS"] == {("users.java", "users")} and got["NAMING_CONSTANT"] == {("users.java", "max")}
    level = {r.rule_code: (r.level, r.severity, r.checker_type) for r in java_rules.all_hits(read).collect()}
    assert level["UNUSED_METHOD"] == ("MAJOR", 0, "other") and level["SEC_SQL_INJECTION"] == ("BLOCKER", 5, "security")


def test_windows_are_stretches_of_a_file_put_together_once(spark, monkeypatch):
    from hashlib import md5

    monkeypatch.setattr(duplicates, "BATCH_WINDOWS", 7)
    words = [f"w{k % 13}é" for k in range(60)]
    odd = " \t\x0b".join(words) + "\f\r\n"
    rows = [(1, "a", odd), (None, "b", "x\u00a0y " * 5), (1, "c", "one two"), (2, "d", None), (2, "e", " ".join(words[:5]))]
    df = spark.createDataFrame(rows, "task_id long, file_path string, content string").coalesce(1)
    found = duplicates.windows(df, 5)
    assert "transform" not in found._jdf.queryExecution().executedPlan().toString()  # no array of words is cut for each window
    expected = {(1, "a", i, md5((" ".join(words[i : i + 5]) + " ").encode()).hexdigest()) for i in range(56)} | {(None, "b", 0, md5(("x\u00a0y " * 5).encode()).hexdigest()), (2, "e", 0, md5((" ".join(words[:5]) + " ").encode()).hexdigest())}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert [r.file_path for r in duplicates.windows(df, 5, max_bytes=50).select("file_path").distinct().orderBy("file_path").collect()] == ["b", "e"]


def test_wanted_relations_are_those_of_a_whole_reading(spark):
    text = "class A { int total = 1; void m(String s) { " + "if (s.length() > 5) { total = total + 5 / 2; } " * 12 + "} }"
    files = spark.createDataFrame([(1, "A.java", text), (1, "B.java", "class {"), (2, "C.java", None)], "task_id long, file_path string, content string")
    whole = java_rules.read(files).persist()
    for kinds in (["tokens"], ["null_candidate", "guard"], ["hit", "method"]):
        some = java_rules.read(files, kinds=kinds)
        assert set(some.columns) == {"task_id", "file_path", "kind", "error", *kinds}
        for kind in (*kinds, "error"):
            assert sorted(map(str, java_rules.relation(some, kind).collect())) == sorted(map(str, java_rules.relation(whole, kind).collect()))
    whole.unpersist()
    with pytest.raises(ValueError):
        java_rules.read(files, kinds=["token"])


def test_java_tokens_with_spaces_comments_and_signs():
    from lintquarry.sources.java_ast import tokenize

    tokens, comments = tokenize("a  /= .5 /* x\n*/ + b.c(...) // end\n\t'\\n' \"\"\"\n q\"\"\" >>>= 1 ")
    assert [(t.kind, t.text, t.line) for t in tokens] == [
        ("name", "a", 1), ("op", "/=", 1), ("number", ".5", 1), ("op", "+", 2), ("name", "b", 2), ("op", ".", 2), ("name", "c", 2), ("op", "(", 2), ("op", "...", 2), ("op", ")", 2),
        ("char", "'\\n'", 3), ("text", '"""\n q"""', 3), ("op", ">>>=", 4), ("number", "1", 4), ("end", "", 4),
    ]
    assert [(c.text, c.start) for c in comments] == [("/* x\n*/", 9), ("// end", 28)]
    with pytest.raises(SyntaxError, match="line 2: '#'"):
        tokenize("a\n # b")


def test_a_file_that_is_read_leaves_no_tree(monkeypatch):
    import gc

    from lintquarry.operators import java_rules
    from lintquarry.sources.java_ast import Node

    gc.collect()
    before = sum(isinstance(x, Node) for x in gc.get_objects())
    gc.disable()
    try:
        rows = [java_rules.facts("A.java", "class A { int f(String s) { if (s != null) { return s.length(); } int n = 4711; return n; } }") for _ in range(5)]
        left = sum(isinstance(x, Node) for x in gc.get_objects()) - before
    finally:
        gc.enable()
    assert left == 0 and all(r == rows[0] and any(k == "hit" for k, _ in r) for r in rows)


def test_duplicates_of_many_small_files_are_handed_over_together(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import DataFrame

    from lintquarry.operators import duplicates

    made, was = [], spark.range(1).__class__.mapInArrow
    monkeypatch.setattr(spark.range(1).__class__, "mapInArrow", lambda self, f, schema: made.append(f) or was(self, f, schema))
    tokens = spark.createDataFrame([(1, f"f{k}", [f"w{i + k % 2}" for i in range(30)]) for k in range(50)], "task_id bigint, file_path string, t array<string>")
    assert isinstance(tokens, DataFrame) and duplicates.repeated(tokens, 10).count() == 50 * 21
    h = pa.array([list(range(k, k + 30)) for k in range(50)], pa.list_(pa.int64()))
    given = [pa.array([1] * 50), pa.array([f"f{k}" for k in range(50)]), h]
    for f, more, names in ((made[0], [], []), (made[1], [h], ["marks"])):
        assert len([*f([pa.RecordBatch.from_arrays([*given, *more], ["task_id", "file_path", "h", *names])])]) <= 1


def test_java_files_take_time_in_proportion_to_their_size():
    """Every rule over a generated class: many methods, chains of calls, guards and locals in one."""
    import time

    def code(n):
        method = 'public String m{0}(String a, Map<String, String> b) {{ String c = b.get("k").trim(); if (a != null && c.isEmpty()) {{ return a.trim(); }} return m{0}(c, b) + x.y(a); }}\n'
        chain = "Object o = f" + ".g(1)" * n + ";"
        long = "".join(f'String v{k} = "a"; if (v{k} == null || q == null) {{ use(v{k}); }}\n' for k in range(n))
        return "class A {\n" + "".join(method.format(k) for k in range(n)) + f"void all(String q) {{ {chain}\n{long} }} }}"

    def a_byte(n):
        text, best = code(n), 9e9
        for _ in range(2):
            began = time.process_time()
            rows = java_rules.facts("A.java", text)
            best = min(best, time.process_time() - began)
        assert rows[0][0] != "error", rows
        return best / len(text)

    a_byte(50)
    assert a_byte(1200) < 3 * a_byte(100)


def test_duplicate_blocks_are_those_of_comparing_all_places(spark):
    """Every pair of places of one text that don't overlap lies in one block, and no block joins places of different texts."""
    import random

    n, rng = 4, random.Random(7)
    shared = [[f"s{k}_{i}" for i in range(rng.randrange(4, 12))] for k in range(5)] + [["r"] * 9]
    texts = {}
    for f in range(14):
        words = []
        for _ in range(4):
            words += rng.choice(shared) + [f"own{f}_{len(words)}"] * rng.randrange(2)
        texts[f"f{f:02d}"] = words
    df = spark.createDataFrame([(1, f, w) for f, w in texts.items()] + [(2, "f00", texts["f00"])], "task_id bigint, file_path string, t array<string>")
    got = duplicates.blocks(duplicates.chained(df, n), n).collect()
    assert {r.task_id for r in got} <= {1, 2}
    places = {}
    for f, w in texts.items():
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i : i + n]), []).append((f, i))
    want = {(a, b) for at in places.values() for a in at for b in at if a < b and (a[0] != b[0] or b[1] - a[1] >= n)}
    members, pairs = {}, {}
    for r in got:
        if r.task_id == 1:
            members.setdefault((r.file_of, r.idx_of, r.length), []).append((r.file_path, r.idx))
            pairs[r.file_of, r.idx_of, r.length] = r.pairs
    found = []
    for (_, _, length), at in members.items():
        own = [((a[0], a[1] + k), (b[0], b[1] + k)) for a in at for b in at for k in range(length) if a < b and (a[0] != b[0] or b[1] - a[1] >= n)]
        found += own
    assert len(found) == len(set(found)) and set(found) == want
    assert sum(pairs[k] * k[2] for k in pairs) == len(want)


def test_many_copies_of_a_body_cost_their_places(spark):
    copies = spark.range(10_000).select(F.lit(1).cast("bigint").alias("task_id"), F.concat(F.lit("f"), F.lpad("id", 5, "0")).alias("file_path"), F.split(F.concat(F.lit("x y z a b c d e "), F.col("id")), " ").alias("t"))
    got = duplicates.blocks(duplicates.chained(copies, 5), 5)
    assert [tuple(r) for r in got.groupBy("length", "places", "pairs").count().collect()] == [(4, 10_000, 49_995_000, 10_000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_archives_entry_by_entry(spark):
    def packed(entries, method=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            for name, data in entries:
                z.writestr(name, data)
        return out.getvalue()

    good = packed([("a/A.java", "class A {}"), ("a/B.java", "class B {}"), ("../C.java", "class C {}"), ("note.txt", "x"), ("__MACOSX/D.java", "class D {}")])
    at = good.index(b"a/A.java") + len("a/A.java")
    damaged = good[:at] + bytes(b ^ 0xFF for b in good[at : at + 6]) + good[at + 6 :]
    twice = packed([("A.java", "old"), ("A.java", "new")])
    bomb = packed([("Big.java", b"0" * (8 << 20)), ("Small.java", "class S {}")])
    zips = spark.createDataFrame([(1, good), (2, damaged), (3, twice), (4, bomb), (5, b"no archive"), (6, good[: len(good) // 2]), (7, None)], "task_id bigint, content binary")
    got = {}
    for r in files.archive_entries(zips).collect():
        got.setdefault(r.task_id, {})[r.file_path] = r.error or bytes(r.content).decode()
    assert got[1] == {"a/A.java": "class A {}", "a/B.java": "class B {}"}
    assert got[2]["a/B.java"] == "class B {}" and got[2]["a/A.java"].startswith("entry: ")
    assert got[3] == {"A.java": "new"} and got[4] == {"Big.java": "entry: too large", "Small.java": "class S {}"}
    assert all(list(got[k]) == [None] and got[k][None].startswith("archive: ") for k in (5, 6, 7))
    assert files.archive_entries(zips.filter("task_id = 1"), entry_bytes=5).filter("error IS NULL").count() == 0
    assert files.archive_entries(zips.filter("task_id = 1"), archive_bytes=15).filter("error IS NULL").count() == 1
    assert {(r.task_id, r.file_path) for r in files.archives(zips).collect()} == {(1, "a/A.java"), (1, "a/B.java"), (2, "a/B.java"), (3, "A.java"), (4, "Small.java")}


def test_archive_entries_too_large_and_damaged_are_too_large(spark):
    """Whatever part of it had to be read: a few bytes beyond the bound, the whole entry is inflated and its checksum met."""
    def damaged(size: int) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("A.java", "x" * size)
        data = bytearray(out.getvalue())
        data[data.index(b"PK\x01\x02") + 16] ^= 0xFF
        return bytes(data)

    sizes = [3999, 4000, 4001, 4050, 4096, 4097, 9000]
    zips = spark.createDataFrame([(n, damaged(n)) for n in sizes], "task_id bigint, content binary")
    got = {r.task_id: r.error for r in files.archive_entries(zips, entry_bytes=4000).collect()}
    assert got == {n: "entry: BadZipFile" if n <= 4000 else "entry: too large" for n in sizes}


def test_ignore_rules_as_a_table_are_those_of_a_list(spark):
    rng = random.Random(4)
    names = ["src/main/A.java", "src/test/ATest.java", "gen/deep/er/B.java", "C.java", "x/C.java", "a[1]/D.java", "é/ü.java", "m1/m2/m3/E.kt", "", "/"]
    hits = [(k, rng.choice(names), rng.choice(["SEC_A", "sec_b", "STYLE_C", None]), rng.choice([1, 2, 7, None])) for k in range(300)]
    hits.append((999, None, "SEC_A", 1))
    df = spark.createDataFrame(hits, "seq bigint, file_path string, rule_code string, line_start int")
    globs = ["**/*.java", "*.java", "src/**", "**/gen/**", "gen/**/B.java", "?.java", "x/{C,D}.java", "a\\[1\\]/*", "[C-E].java", "**", "é/*", "m*/m?/**", "**/nothing/**", "*", "{src,gen}/**", ""]
    every = [{"id": k, "rule_type": "FILE_PATTERN", "file_pattern": g, "is_enabled": True} for k, g in enumerate(globs)]
    every += [{"id": 50 + k, "rule_type": "file_path", "file_path": p, "is_enabled": True} for k, p in enumerate(["C.java", "n/A.java", "", "src/main/A.java"])]
    every += [{"id": 60 + k, "rule_type": "LINE_NUMBER", "file_path": p, "line_number": n, "is_enabled": True} for k, (p, n) in enumerate([("B.java", 7), ("E.kt", None), (None, 2), ("java", 1)])]
    every += [{"id": 70, "rule_type": "RULE_CODE", "rule_code": "Sec_A", "is_enabled": True}, {"id": 71, "rule_type": "RULE_CODE", "rule_code": "STYLE_C", "is_enabled": False}, {"id": 72, "rule_type": None, "is_enabled": True}, {"id": 73, "rule_type": "RULE_CODE", "rule_code": "STYLE_C", "is_enabled": None}]
    schema = "id bigint, rule_type string, rule_code string, file_pattern string, file_path string, line_number int, is_enabled boolean"
    names_of = [c.split()[0] for c in schema.split(", ")]
    for rules in (every[1:9:3], every[10:14] + every[24:], every[3:5] + every[19:22], [], every):
        table = spark.createDataFrame([[r.get(c) for c in names_of] for r in rules], schema)
        got = {r.seq: r.is_ignored for r in govern.mark_ignored(df, table).collect()}
        assert got == {r.seq: r.is_ignored for r in govern.mark_ignored(df, rules).collect()}, rules


def test_fifty_thousand_ignore_rules(spark):
    n = 50_000
    rules = spark.range(n).select(
        "id", F.when(F.col("id") % 5 < 3, "FILE_PATTERN").when(F.col("id") % 5 == 3, "FILE_PATH").otherwise("LINE_NUMBER").alias("rule_type"), F.lit(None).cast("string").alias("rule_code"),
        F.concat(F.lit("src/main/**/Foo"), F.lpad("id", 6, "0"), F.lit("*.java")).alias("file_pattern"), F.concat(F.lit("Foo"), F.lpad("id", 6, "0"), F.lit(".java")).alias("file_path"), F.lit(3).alias("line_number"), F.lit(True).alias("is_enabled"),
    )
    hits = spark.range(0, 2 * n, 7).select(F.col("id").alias("seq"), F.concat(F.lit("src/main/x/Foo"), F.lpad("id", 6, "0"), F.lit(".java")).alias("file_path"), F.lit("A").alias("rule_code"), (F.col("id") % 2 + 2).cast("int").alias("line_start"))
    got = govern.mark_ignored(hits, rules)
    assert got._jdf.queryExecution().executedPlan().toString().count("\n") < 120
    want = sum(1 for k in range(0, n, 7) if k % 5 < 4 or k % 2 + 2 == 3)
    assert got.filter("is_ignored").count() == want


def test_context_lines_of_many_points_and_of_overlapping_ones(spark):
    rng = random.Random(3)
    points = [(f, s, s + rng.randrange(6)) for f in "ab" for s in (rng.randrange(1, 90) for _ in range(25))]
    lines = [(f, n, f"{f}{n}") for f in "ab" for n in range(1, 101)]
    p = spark.createDataFrame([(*x, 100) for x in points], "file_path string, s int, e int, total int")
    ln = spark.createDataFrame(lines, "file_path string, line_no int, line string")
    got = {(r.file_path, r.line_no): (r.issue_line, r.marker) for r in intervals.context_lines(intervals.context_windows(p, ["file_path"], 2), p, ln, ["file_path"]).collect()}
    assert len(got) > 100
    for (f, n), (issue, marker) in got.items():
        first = min(((s, e) for g, s, e in points if g == f and s <= n <= e), default=None)
        assert issue == (first is not None)
        assert marker == (None if first is None else "single" if first[0] == first[1] else "start" if n == first[0] else "end" if n == first[1] else None)
    many = spark.range(100_000).select(F.lit("f").alias("file_path"), (F.col("id") + 1).cast("int").alias("s"), (F.col("id") + 1).cast("int").alias("e"), F.lit(100_000).alias("total"))
    text = many.select("file_path", F.col("s").alias("line_no"), F.lit("x").alias("line"))
    rows = intervals.context_lines(intervals.context_windows(many, ["file_path"], 3), many, text, ["file_path"])
    assert rows.filter("marker = 'single'").count() == 100_000


def test_a_trigger_disabled_between_two_batches(spark, tmp_path):
    from datetime import datetime

    from lintquarry.streaming import events

    payload = '{"repoUrl": "https://h/o/r.git", "branch": "%s"}'
    schema = "event_id bigint, ts timestamp_ntz, trigger_id bigint, platform string, payload string"
    day = lambda n: datetime(2026, 1, n)

    def arrive(name, rows):
        spark.createDataFrame([(i, t, 1, "GENERIC", payload % b) for i, t, b in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        return {r.event_id for r in events.gated_by_table(stream, f"{tmp_path}/settings", f"{tmp_path}/out", f"{tmp_path}/progress").collect()}

    spark.createDataFrame([(1, day(1), True, "o/r", "main,release/**,fix-?")], webhooks.SETTINGS).write.parquet(f"{tmp_path}/settings")
    arrive("a", [(1, day(2), "main"), (2, day(2), "dev"), (3, day(2), "release/1/2"), (4, day(2), "fix-1"), (5, day(2), "fix-12")])
    assert run() == {1, 3, 4}
    spark.createDataFrame([(1, day(5), False, None, None)], webhooks.SETTINGS).write.mode("append").parquet(f"{tmp_path}/settings")
    arrive("b", [(6, day(6), "main"), (7, day(4), "main")])
    assert run() == {1, 3, 4, 7}


@pytest.mark.parametrize("pattern", ["release/**", "**/main", "*", "**", "a.b/?", "x[1]", "feature/*/y", "a+b", "**/x/**"])
def test_globs_in_a_column_are_those_of_a_list(spark, pattern):
    branches = ["release/1", "release/1/2", "main", "a/main", "x/y/main", "a.b/c", "aXb/c", "x[1]", "x1", "feature/z/y", "feature/z/w/y", "a+b", "aab", "x/q", "a/x/b", ""]
    df = spark.createDataFrame([(b, pattern) for b in branches], "b string, p string")
    got = [r.b for r in df.filter(F.rlike(F.col("b"), webhooks.glob_regex(F.col("p")))).collect()]
    assert got == [r.b for r in df.filter(webhooks.branch_matches(F.col("b"), [pattern])).collect()]


def test_record_states_of_a_stream_with_late_events_and_expiry(spark, tmp_path):
    from datetime import datetime

    from lintquarry.streaming import events

    schema = "record_id bigint, status string, ts timestamp"
    at = lambda d, h=0: datetime(2026, 1, d, h)

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = events.available_now(events.record_status_stream(stream, "2 days", expire_ms=5 * 86_400_000), f"{tmp_path}/out", f"{tmp_path}/progress")
        return {r.record_id: r.status for r in out.groupBy("record_id").agg(F.max_by("status", "n").alias("status")).collect()}

    assert run("a", [(1, "PENDING", at(1)), (1, "RUNNING", at(1, 5)), (2, "SUCCESS", at(1)), (2, "FAILED", at(1, 9)), (3, "RUNNING", at(1)), (4, "FAILED", at(1, 8))]) == {1: "RUNNING", 2: "SUCCESS", 3: "RUNNING", 4: "FAILED"}
    # a late event doesn't undo a newer one, but a success always counts
    assert run("b", [(1, "PENDING", at(1, 2)), (4, "SUCCESS", at(1, 2)), (2, "RUNNING", at(1, 20)), (3, "RUNNING", at(1, 3))]) == {1: "RUNNING", 2: "SUCCESS", 3: "RUNNING", 4: "SUCCESS"}
    # the watermark passes what record 1 and 3 are given
    assert run("c", [(5, "PENDING", at(20))]) == {1: "EXPIRED", 2: "SUCCESS", 3: "EXPIRED", 4: "SUCCESS", 5: "PENDING"}


@pytest.mark.parametrize("buckets", [1, 1024])
def test_records_of_one_bucket_have_states_of_their_own(spark, tmp_path, buckets):
    from datetime import datetime

    from lintquarry.streaming import events

    schema = "record_id bigint, status string, ts timestamp"
    at = lambda d, h=0: datetime(2026, 1, d, h, 0, 0, 123456)

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = events.available_now(events.record_status_stream(stream, "2 days", 5 * 86_400_000, buckets), f"{tmp_path}/out", f"{tmp_path}/progress")
        last = F.max_by(F.struct("status", "ts", "n"), "n").alias("x")
        return {r.record_id: tuple(r.x) for r in out.groupBy("record_id").agg(last).collect()}

    run("a", [(1, "PENDING", at(1)), (2, "RUNNING", at(1)), (3, "SUCCESS", at(1)), (4, "RUNNING", at(4))])
    # the watermark comes to the seventh: record 1 lives on by what it was given, 2 is given up, 3 has ended
    want = {1: ("RUNNING", at(3), 2), 2: ("EXPIRED", at(1), 2), 3: ("SUCCESS", at(1), 1), 4: ("RUNNING", at(4), 1), 5: ("PENDING", at(9), 1)}
    assert run("b", [(1, "RUNNING", at(3)), (4, "PENDING", at(3)), (5, "PENDING", at(9))]) == want
    # at the 28th the rest is given up
    assert run("c", [(6, "PENDING", at(30))]) == want | {1: ("EXPIRED", at(3), 3), 4: ("EXPIRED", at(4), 2), 5: ("EXPIRED", at(9), 2), 6: ("PENDING", at(30), 1)}


def test_a_stream_of_many_records_keeps_few_states(spark, tmp_path):
    from lintquarry.streaming import events

    spark.range(9000).selectExpr("id AS record_id", "'RUNNING' AS status", "TIMESTAMP '2026-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/in")
    out = events.record_status_stream(events.event_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema))
    query = out.writeStream.format("memory").queryName("many_records").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("many_records").agg(F.count_distinct("record_id")).first()[0] == 9000
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024


def test_only_changed_files_are_parsed_again(spark):
    from lintquarry.operators import scan

    schema = "task_id bigint, file_path string, content string"
    old = spark.createDataFrame([(1, "A.java", "class a { }"), (1, "B.java", "class b { }"), (1, "C.java", "class c { }"), (1, "N.java", None)], schema)
    # rows that no parser makes show which files weren't parsed again
    read = java_rules.read(old).withColumn("type", F.when(F.col("type").isNotNull(), F.col("type").withField("simple_name", F.concat(F.lit("kept_"), F.col("type.simple_name")))))
    now = spark.createDataFrame([(2, "A.java", "class a { }"), (2, "B.java", "class b2 { }"), (2, "D.java", "class c { }"), (2, "N.java", None)], schema)
    got = java_rules.relation(scan.reread(now, scan.digests(old), read), "type")
    assert {(r.task_id, r.file_path, r.simple_name) for r in got.collect()} == {(2, "A.java", "kept_a"), (2, "B.java", "b2"), (2, "D.java", "c")}


def test_jdbc_reads_in_ranges(spark):
    from lintquarry.sources import files as sources

    url, driver = "jdbc:derby:memory:lintquarry;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(1000).select((F.col("id") * 3).alias("id"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    rows.write.format("jdbc").options(url=url, driver=driver, dbtable="issue").save()
    whole = sources.jdbc(spark, url, "issue", driver=driver)
    split = sources.jdbc(spark, url, "issue", split="id", parts=8, driver=driver)
    assert (whole.rdd.getNumPartitions(), split.rdd.getNumPartitions()) == (1, 8)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, rows.collect()))
    sizes = [len(p) for p in split.rdd.glom().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 130
    rows.limit(0).write.format("jdbc").options(url=url, driver=driver, dbtable="nothing").save()
    assert sources.jdbc(spark, url, "nothing", split="id", driver=driver).count() == 0
    assert sources.jdbc_url("jdbc:mysql://h/d?x=1") == "jdbc:mysql://h/d?x=1&useCursorFetch=true" and sources.jdbc_url("jdbc:mariadb://h/d").endswith("?useCursorFetch=true") and sources.jdbc_url("jdbc:h2:mem") == "jdbc:h2:mem"


def test_a_page_comes_with_the_number_of_rows(spark):
    rows, n = issues.paged(spark.range(25).withColumn("x", F.col("id") % 2), ["x", "id"], 2, 10)
    assert n == 25 and [r.id for r in rows.collect()] == [20, 22, 24, 1, 3, 5, 7, 9, 11, 13]


def test_proofs_of_a_common_name_meet_no_site_with_a_candidate(spark):
    n = 100_000
    candidates = spark.range(n).select(F.lit(1).cast("bigint").alias("task_id"), F.concat(F.lit("C"), "id").alias("class_name"), (F.col("id") % 2 == 0).alias("is_private"), F.lit("get/1#0").alias("param"))
    sites = spark.range(n).select(
        F.lit(1).cast("bigint").alias("task_id"), F.lit("get/1#0").alias("param"), F.when(F.col("id") % 1000 == 0, "none").otherwise("self").alias("arg_kind"), F.lit(None).cast("string").alias("arg"), F.lit(None).cast("string").alias("arg_class"),
        F.lit(None).cast("boolean").alias("arg_private"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("C"), "id")).alias("scope_type"), F.array(F.concat(F.lit("C"), "id")).alias("caller_types"),
    )
    got = graph.attributed_proof(candidates, sites)
    # public ones also hear of every site whose type isn't told, some of which pass what isn't provable; private ones hear of their own class
    assert got.filter("proven").count() == sum(1 for k in range(n) if k % 2 == 0 and k % 1000 > 0)


@pytest.mark.parametrize("n,control", [(8, False), (9, False), (9, True), (2, False), (1, False)])
def test_windows_that_may_be_repeated(spark, n, control):
    """Every window that stands in several places is kept as it was, and of files that share nothing none is."""
    rng = random.Random(n)
    fresh = lambda size: [f"w{rng.randrange(10**9)}" for _ in range(size)]
    common, loop = fresh(30), fresh(3)
    texts = [fresh(40) + common + fresh(40), common[5:] + fresh(20), fresh(10) + common + fresh(30) + common, loop * 12, ["x"] * 40, fresh(5) + common, fresh(n), [], None]
    files = [(1, f"f{i}", t, None if t is None else list(range(1, len(t) + 1)), [{"s": 3, "e": 60}]) for i, t in enumerate(texts)]
    files += [(t, f"own{i}", w, list(range(1, 301)), [{"s": 1, "e": 300}]) for t in (1, 2) for i in range(20) for w in [fresh(300)]]
    schema = "task_id bigint, file_path string, t array<string>, lines array<int>, controls array<struct<s:int,e:int>>"
    tokens = spark.createDataFrame(files, schema)
    again = lambda w: w.join(w.groupBy("task_id", "fingerprint").count().filter("count > 1").drop("count"), ["task_id", "fingerprint"])
    rows = lambda w: sorted(str(sorted(r.asDict(True).items())) for r in w.collect())
    every, some = duplicates.chained(tokens, n, control), duplicates.repeated(tokens, n, control)
    assert rows(again(every)) and rows(again(some)) == rows(again(every))
    assert some.filter("file_path LIKE 'own%'").count() == 0 and every.filter("file_path LIKE 'own%'").count() > 40 * 280


@pytest.mark.parametrize("n,control,tokens_of_slice", [(9, True, 1 << 16), (20, False, 500), (2, True, 1)])
def test_stretches_of_windows_give_the_blocks_of_single_windows(spark, monkeypatch, n, control, tokens_of_slice):
    """A row for windows that go on alike: blocks and hits are those of a row a window, with far fewer rows."""
    from lintquarry.session import stored

    monkeypatch.setattr(duplicates, "SLICE_TOKENS", tokens_of_slice)
    rng = random.Random(n)
    fresh = lambda size: [f"w{rng.randrange(10**9)}" for _ in range(size)]
    common, loop, other = fresh(150), fresh(3), fresh(60)
    texts = [fresh(40) + common + fresh(40), common[25:] + fresh(20), fresh(10) + common + fresh(30) + common, loop * 12, ["x"] * 40, fresh(5) + loop * 9, ["x"] * 30 + common[:70] + ["x"] * 30, fresh(n), other + other, other[7:] + fresh(9), [], None]
    texts += [rng.choice([common, other])[rng.randrange(30) :][: rng.randrange(60)] + rng.choice([loop * 5, fresh(7), []]) + rng.choice([common, other])[: rng.randrange(60)] for _ in range(25)]
    flow = lambda w: [{"s": s, "e": s + rng.randrange(40)} for s in sorted(rng.randrange(1, 1 + len(w or "x")) for _ in range(rng.randrange(4)))]
    files = [(1 + (i % 3 == 2), f"f{i:02d}", t, None if t is None else [1 + k // 2 for k in range(len(t))], flow(t)) for i, t in enumerate(texts)]
    files += [(2, f, t, lines, ranges) for task, f, t, lines, ranges in files if task == 1 and t][:6]
    tokens = spark.createDataFrame(files, "task_id bigint, file_path string, t array<string>, lines array<int>, controls array<struct<s:int,e:int>>")
    rows = lambda df: sorted(str(sorted(r.asDict(True).items())) for r in df.collect())
    every, some = stored(duplicates.chained(tokens, n, control)), stored(duplicates.stretched(tokens, n, control))
    want, got = stored(duplicates.blocks(every, n)), stored(duplicates.blocks(some, n))
    assert rows(want) and rows(got) == rows(want)
    assert rows(duplicates.hits(got, n)) == rows(duplicates.hits(want, n))
    assert rows(duplicates.blocks(duplicates.stretched(tokens.drop("lines", "controls"), n), n)) == rows(duplicates.blocks(duplicates.chained(tokens.drop("lines", "controls"), n), n))
    # copies of whole files are alike everywhere, and what stands once has no row
    copies = spark.createDataFrame([(1, f"c{k}", common) for k in range(20)] + [(1, f"own{k}", fresh(150)) for k in range(20)], "task_id bigint, file_path string, t array<string>")
    once = stored(duplicates.stretched(copies, n)).groupBy(F.substring("file_path", 1, 3)).agg(F.count("m"), F.sum("m")).collect() if n >= 8 else []
    assert all(r[0] != "own" for r in once) and sum(r[2] for r in once) == (20 * (150 - n + 1) if once else 0) and (n < 20 or sum(r[1] for r in once) < 20 * 70)


def test_dup_hits_reads_only_tokens(spark, monkeypatch):
    from lintquarry.plans import java_cases

    asked, was = [], java_rules.read
    monkeypatch.setattr(java_rules, "read", lambda files, params=None, kinds=None: asked.append(kinds) or was(files, params, kinds))
    monkeypatch.setattr(java_cases, "twin_files", lambda spark, d: spark.range(10).select(F.lit(1).alias("task_id"), F.concat(F.lit("T"), "id").alias("file_path"), F.replace(F.replace(F.lit(java_cases.TWINS), F.lit("@"), F.col("id").cast("string")), F.lit("#"), (F.col("id") % 5).cast("string")).alias("content")))
    assert java_cases.dup_hits(spark, None).count() == 5 and asked == [["tokens"]]
