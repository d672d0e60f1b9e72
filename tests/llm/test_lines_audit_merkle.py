"""Line dedup, the filter audit and the Merkle manifest against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lintquarry.llm import audit, line_dedup, merkle
from lintquarry.llm.common import Shared

from .edge import documents, edge_rows

SAME = "a line that very many documents hold"


def key_order(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward(spark):
    rows = edge_rows()
    rows += [(100 + i, f"{SAME}\n \t{SAME.upper()}\x0b\nonly here, number {i}, nowhere else", "en") for i in range(40)]
    rows += [(200, f"İ{SAME}", "en"), (201, f"i̇{SAME}", "en"), (202, "x" * 19, "en"), (203, "x" * 19, "en"), (204, "x" * 19, "en")]
    rows += [(None, "a line of rows without identifier", "en")] * 3 + [(300, "twice one doc_id, the same long line\nb", "en")] * 2 + [(299, "twice one doc_id, the same long line", "en")]
    return documents(spark, rows), rows


# ---------------------------------------------------------------- lines


def plain_lines(rows):
    blanks = " \t\n\v\f\r"
    split = [(i, (t or "").split("\n")) for i, t, _ in rows]
    holders = defaultdict(list)
    for i, lines in split:
        for k in {lower(x.strip(blanks)) for x in lines}:
            if len(k) >= 20:
                holders[k].append(i)
    out = []
    for i, lines in split:
        kept = []
        for x in lines:
            own = holders.get(lower(x.strip(blanks)), [])
            if len(own) < 3 or i == max((d for d in own if d is not None), default=None):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=key_order)


@pytest.mark.parametrize("params", [line_dedup.Params(), line_dedup.Params(batches=7, fanout=3), line_dedup.Params(batches=1)])
def test_lines_as_the_plain_version(spark, params):
    docs, rows = awkward(spark)
    got = line_dedup.dedup_documents(docs, params)
    assert sorted(map(tuple, got.collect()), key=key_order) == plain_lines(rows)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_documents(documents(spark, [])).collect() == []


def test_kept_text_is_returned(spark):
    docs = documents(spark, [(i, f"head {i}\n{SAME}\n\ntail", "en") for i in range(3)])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == {0: "head 0\n\ntail", 1: "head 1\n\ntail", 2: f"head 2\n{SAME}\n\ntail"}


@pytest.mark.parametrize("fanout", [2, 3])
def test_store_folds_to_the_same_whatever_the_order_of_batches(spark, fanout):
    rng = random.Random(fanout)
    held = [(rng.randrange(30), d) for d in range(300)]
    total = defaultdict(list)
    for k, d in held:
        total[k].append(d)
    want = sorted((k, -k, max(v)) for k, v in total.items() if len(v) >= 3)
    for falling in (True, False):
        batches = [[x for x in held if x[1] // 50 == b] for b in range(6)]
        rng.shuffle(batches)
        if falling:
            batches.sort(key=lambda b: -b[0][1])
        store = line_dedup.LineStore(Shared(spark, "test"), line_dedup.Params(fanout=fanout))
        for b in batches:
            entries = spark.createDataFrame([(k, -k, d) for k, d in b], "h1 bigint, h2 bigint, d bigint")
            store.add(entries.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("d").alias("keeper")))
            assert all(len(level) < fanout for level in store.levels)
        if falling:  # keys that the first runs have settled aren't written again
            assert sum(spark.table(n).count() for n in store.runs) < sum(len({k for k, _ in b}) for b in batches)
        assert sorted(map(tuple, store.repeated().collect())) == want
        names = store.runs
        store.close()
        assert not any(spark.catalog.tableExists(n) for n in names)


def test_runs_are_joined_without_being_moved(spark):
    store = line_dedup.LineStore(Shared(spark, "test"))
    entries = spark.createDataFrame([(k, k, 5, 9) for k in range(100)], "h1 bigint, h2 bigint, docs bigint, keeper bigint")
    store.add(entries)
    run = spark.table(store.runs[0])
    plan = entries.join(run.select(F.col("h1").alias("r1")).hint("merge"), F.col("h1") == F.col("r1"), "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    store.close()


# ---------------------------------------------------------------- audit


def plain_audit(rows, labels):
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marked = {}
    for i, q, t in labels:
        a, b = marked.get(i, (0, 0))
        marked[i] = max(a, q or 0), max(b, t or 0)
    parts = defaultdict(list)
    for i, t, _, s in rows:
        t = t or ""
        words = t.encode().split()
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and first[t] < i:
            fails.add("E")
        parts[s or ""].append((fails, *(marked.get(i, (0, 0)) if i is not None else (0, 0))))
    out = []
    for part, docs in parts.items():
        steps, share = [], Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[f] += len(gone)
                steps.append(("".join(order), k, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] == 1 for d in gone), sum(d[2] == 1 for d in gone)))
        out += [(part, *s, share[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


def test_audit_as_filtering_in_every_order(spark):
    rng = random.Random(1)
    texts = [None, "", "SHOUTED " * 60, "cheap $$ " * 20, " ".join(f"w{k}" for k in range(80)), "w1 " * 80, "ÄÖÜ\x85 ß", "Copy of a text | with a bar", " \x0b\x1c ", " ".join(f"W{k}" for k in range(60))]
    rows = [(i, rng.choice(texts), "en", rng.choice(["a", "b", "", None])) for i in range(150)] + [(None, texts[7], "en", "a"), (3, texts[7], "en", "b"), (3, texts[7], "en", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, lang string, source string, part string, mask string")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    assert sorted(map(tuple, audit.audit(docs, marks).collect())) == plain_audit(rows, labels)


def test_audit_of_awkward_rows_and_of_empty_tables(spark):
    docs, rows = awkward(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    sourced = [(i, t, g, None if i is None else f"src{i % 3}") for i, t, g in rows]
    assert sorted(map(tuple, audit.audit(docs, none).collect())) == plain_audit(sourced, [])
    assert audit.audit(documents(spark, []), none).collect() == []


def test_shapley_values_are_the_mean_over_orders():
    rng = random.Random(5)
    counts = {m: rng.randrange(50) for m in range(32)}
    r = audit.Removal(counts, 5)
    for i in range(5):
        gained = Fraction(0)
        for order in permutations(range(5)):
            on = sum(1 << j for j in order[: order.index(i)])
            gained += r.corner(on | 1 << i) - r.corner(on)
        assert r.shapley(i) == gained / 120
    assert sum(r.shapley(i) for i in range(5)) == r.corner(31)


# ---------------------------------------------------------------- Merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part_of(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars)"""

    def leaf(r, text):
        return digest(*map(part_of, (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            x = levels[-1]
            levels.append([digest(*x[i : i + 16]) for i in range(0, len(x), 16)])
        return levels

    def way(levels, p):
        out = []
        for x in levels[:-1]:
            s = p // 16 * 16
            out.append(("".join(x[s:p]), "".join(x[p + 1 : s + 16])))
            p //= 16
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {g: tree([leaf(r, r[1]) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for p, r in enumerate(groups[g]):
            steps = way(trees[g], p) + way(top, k)
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, lower(r[1]) if forged and r[1] is not None else r[1])
            for b, a in steps:
                node = digest(b, node, a)
            out.append((r[0], trees[g][0][p], trees[g][-1][0], top[-1][0], digest("".join(b + a for b, a in steps)), node, node == top[-1][0]))
    return sorted(out, key=key_order)


def check_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, pos string, node string").repartition(5)
    got = sorted(map(tuple, merkle.manifest_documents(docs).collect()), key=key_order)
    assert got == plain_manifest(rows)
    return got


def test_manifest_of_deep_and_shallow_groups(spark):
    """One group of five levels, of which two tiers of blocks, others at the edges of a level, and more groups than a node's children."""
    rows = [(7 * i, f"Text {i}", "en", "big", i) for i in range(4200)]
    rows += [(100_000 + 1000 * k + i, f"T {i}", None, f"g{k}", i) for k, n in enumerate([1, 2, 15, 16, 17, 255, 256, 257, *[3] * 20]) for i in range(n)]
    rows += [(90_000, "Ünder É ASCII", "de", None, None), (90_001, None, None, "Ü", 3), (90_002, "", "de", "", 0)]
    random.Random(3).shuffle(rows)
    got = check_manifest(spark, rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_one_row_and_of_an_empty_table(spark):
    only = check_manifest(spark, [(5, "One row", "en", "s", 7)])[0]
    assert only[1] == only[2] == only[3] and only[4] == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest_documents(documents(spark, [])).collect() == []


def test_manifest_of_awkward_rows(spark):
    """Equal rows stand side by side; either may come first, so the leaves, roots and verdicts are compared."""
    docs, rows = awkward(spark)
    full = [(i, t, g, None if i is None else f"src{i % 3}", None if t is None else len(t)) for i, t, g in rows]
    got = [tuple(r) for r in merkle.manifest_documents(docs).collect()]
    assert sorted((*r[:4], r[5], r[6]) for r in got if r[0] is not None) == sorted((*r[:4], r[5], r[6]) for r in plain_manifest(full) if r[0] is not None)
    assert sorted(got, key=key_order) == plain_manifest(full)


def test_any_other_text_breaks_the_proof(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = merkle.manifest(docs, F.when(F.col("doc_id") == 7, F.lit("text 8"))).collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [7]
