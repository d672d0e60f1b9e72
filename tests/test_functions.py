"""Scalar functions against tables of cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lintquarry.functions import catalogs as C
from lintquarry.functions import text as T
from lintquarry.functions import versions as V
from lintquarry.operators import intervals


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


VERSIONS = [
    ("1.0", "1.0.0", 0), ("1.0", "1.0.1", 0), ("2.13.4", "2.13.4.2", 0), ("1.0", "1.0-beta", 1), ("1.2.10", "1.2.9", 1), ("30.0-jre", "30.0", -1), ("v1.2", "1.2+b5", 0),
    ("1.0-RC1", "1.0-rc2", -1), ("2", "10", -1), ("1.a", "1.1", -1), (None, "1", None), ("1", None, None),
]


def test_versions(spark):
    got = values(spark, VERSIONS, "a string, b string, want int", V.compare_maven(F.col("a"), F.col("b")), "want")
    assert all(a == b for a, b in got)
    strict = values(spark, [("1.0", "1.0.1"), ("1.0", "1.0.0")], "a string, b string", V.compare_maven(F.col("a"), F.col("b"), strict_padding=True))
    assert strict == [(-1,), (0,)]
    release = [("v1.2", "1.2.0", 0), ("1.10", "1.9", 1), ("1.2b3", "1.2", 0), ("1.x", "1.0", 0), ("1.2.3.4.5.6.7", "1.2.3.4.5.6.8", -1), ("1.0.0.0.0.0.0.0", "1", 0), ("1.12345678901", "1.2345678901", 1), ("", "0", 0)]
    assert all(a == b for a, b in values(spark, release, "a string, b string, want int", V.compare_release(F.col("a"), F.col("b")), "want"))


@pytest.mark.parametrize(("minutes", "text"), [(0, "0m"), (45, "45m"), (205, "3h 25m"), (2900, "2d"), (1500, "1d 1h"), (120, "2h"), (-3, "0m")])
def test_debt_text(spark, minutes, text):
    assert values(spark, [(minutes,)], "m int", T.debt_text(F.col("m"))) == [(text,)]


GLOBS = [
    ("*.java", "A.java", True), ("*.java", "a/A.java", False), ("**/*.java", "a/b/A.java", True), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("{a,b}.txt", "b.txt", True), ("{a,b}.txt", "c.txt", False), ("a.b", "axb", False),
]


@pytest.mark.parametrize(("pattern", "path", "want"), GLOBS)
def test_path_globs(pattern, path, want):
    assert bool(re.match(T.path_glob(pattern), path)) == want


def test_branch_globs():
    hit = lambda p, b, legacy=False: bool(re.fullmatch(T.branch_glob(p, legacy), b))
    assert hit("release/**", "release/a/b") and hit("release/*", "release/1.0") and not hit("release/*", "release/a/b") and hit("**/main", "x/main") and hit("**/main", "main")
    assert hit("release/**", "release/1.0", True) and not hit("release/**", "release/a/b", True)
    assert not hit("**/main", "x/main", True) and not hit("**/main", "main", True)


def test_repositories(spark):
    rows = [("https://h/o/r.git", "o/r"), ("https://h/g/o/r/", "g/o/r"), ("git@h:o/r.git", None), ("ssh://git@h/o/r.git", "o/r")]
    assert all(a == b for a, b in values(spark, rows, "u string, want string", T.owner_repo(F.col("u")), "want"))
    scope = [("https://h/Org/Repo.git", "org/repo", True), ("https://h/g/org/repo", "org/repo/", True), ("https://h/xorg/repo", "org/repo", False), ("https://h/a/b", "", True), ("https://h/a/b", None, True)]
    assert all(a == b for a, b in values(spark, scope, "u string, s string, want boolean", T.in_repo_scope(F.col("u"), F.col("s")), "want"))


def test_texts(spark):
    rows = [("a\r\nb\rc\n", ["a", "b", "c"]), ("", []), ("x", ["x"]), ("\n\n", ["", ""])]
    assert all(a == b for a, b in values(spark, rows, "t string, want array<string>", T.lines_of(F.col("t")), "want"))
    assert values(spark, [("\U0001f600a",)], "t string", T.utf16_length(F.col("t"))) == [(3,)]
    words = values(spark, [("secretName my-TokenValue abc",)], "t string", T.significant_words(F.col("t")))
    assert sorted(words[0][0]) == ["name", "secret", "token", "value"]
    literals = [('x = "abc" + \'d\'', 5), ('say "a\\"b"', 6), ('open "rest', 5), ("none", 0)]
    assert all(a == b for a, b in values(spark, literals, "t string, want int", T.longest_literal(F.col("t")), "want"))
    paths = [("a/test/B.java", True, True), ("test/B.java", True, False), ("a/BTest.java", True, True), ("a/B.java", False, False), ("a\\test\\B.java", False, True)]
    assert all(r[0] == r[2] and r[1] == r[3] for r in values(spark, paths, "p string, a boolean, b boolean", T.is_test_file(F.col("p")), T.is_test_path(F.col("p")), "a", "b"))
    junk = [("__MACOSX/a", True), ("a/._b", True), ("a/.DS_Store", True), ("a/b_.c", False)]
    assert all(a == b for a, b in values(spark, junk, "p string, want boolean", T.is_system_junk(F.col("p")), "want"))
    assert values(spark, [("jdbc:mysql://h/d",), ("jdbc:h2:mem",), ("x",)], "u string", T.database_type(F.col("u"))) == [("MYSQL",), ("H2",), ("CUSTOM",)]
    made = values(spark, [("${a}-${b} \\${a} ${a}",)], "t string", T.render(F.col("t"), F.create_map(F.lit("a"), F.lit("1"))))
    assert made == [("1-${b} ${a} 1",)]
    nested = F.create_map(F.lit("a"), F.lit("${b}"), F.lit("b"), F.lit("SECRET"))
    templates = [("x ${a} ${ b }", "x ${b} SECRET"), ("}${b}}${", "}SECRET}${"), ("\x01${a}\x01", "\x01${b}\x01"), ("", ""), ("${}${c}", "${}${c}"), (None, None)]
    assert all(a == b for a, b in values(spark, templates, "t string, want string", T.render(F.col("t"), nested), "want"))
    answer = '{"choices":[{"message":{"content":"hi","n":[1,2]}}],"a":null}'
    for path, want in (("choices[0].message.content", "hi"), ("choices[0].message.n[1]", "2"), ("choices[3].message", None), ("a", None), ("a.b", None), ("", None), (None, None)):
        assert values(spark, [(answer,)], "t string", T.json_path(F.col("t"), path)) == [(want,)]
    assert values(spark, [("x\n  位置二：a/B.java:3-9\ny",), ("none",)], "t string", T.partner_location(F.col("t"))) == [("a/B.java:3-9",), (None,)]
    assert values(spark, [("say [1, [2]] end",), ("none",)], "t string", T.json_array(F.col("t"))) == [("[1, [2]]",), (None,)]
    assert values(spark, [("abc",), ("xyz1",), (None,)], "t string", T.commit_id(F.col("t"))) == [(None,), (None,), (None,)]


def test_catalogs(spark):
    codes = [("SEC_XXE", "CRITICAL", 20), ("SEC_ELSE", "CRITICAL", 30), ("DEP_VULN_X", "CRITICAL", 60), ("OTHER", "INFO", 10), (None, "INFO", 10)]
    got = values(spark, codes, "c string, l string, m int", C.level_of_rule(F.col("c")), C.minutes_of_rule(F.col("c")), "l", "m")
    assert all(r[:2] == r[2:] for r in got)
    names = [("bug", "CRITICAL"), (" warning ", "MAJOR"), ("minor", "MINOR"), ("?", "INFO"), (None, "INFO")]
    assert all(a == b for a, b in values(spark, names, "c string, l string", C.level_of(F.col("c")), "l"))


def merged(rows):
    out = []
    for s, e in sorted(r for r in rows if r[0] > 0 and r[1] >= r[0]):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_intervals_merge_as_one_by_one(spark):
    rng = random.Random(0)
    sets = {0: [(3, 3), (4, 6), (5, 5), (9, 9), (11, 12)], 1: [(0, 4), (5, 3)]}
    sets |= {k: [(s := rng.randint(-1, 40), s + rng.randint(-1, 5)) for _ in range(rng.randint(1, 12))] for k in range(2, 60)}
    df = spark.createDataFrame([(k, s, e) for k, v in sets.items() for s, e in v], "k int, s int, e int")
    once = intervals.coalesced(df, ["k"])
    got = {}
    for r in intervals.coalesced(once, ["k"]).collect():
        got.setdefault(r.k, []).append((r.s, r.e))
    assert {k: sorted(v) for k, v in got.items()} == {k: merged(v) for k, v in sets.items() if merged(v)}
    label = intervals.as_points(once.filter("k = 0"), ["k"]).select(T.line_label(F.col("points"))).collect()
    assert label[0][0] == "3-6、9、11-12"
