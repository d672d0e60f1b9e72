from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintquarry.llm import align, decontam, neardup
from lintquarry.llm.common import words_of

from .edge import documents, edge_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


symbols = st.lists(st.integers(0, 3), max_size=25)


@settings(max_examples=500, deadline=None)
@given(symbols, symbols, st.integers(0, 12))
def test_band_is_the_distance_up_to_its_width(a, b, most):
    assert align.within(np.array(a, np.int32), np.array(b, np.int32), most) == min(distance(a, b), most + 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), symbols)
def test_infix_is_the_least_distance_of_any_part(p, t):
    got = align.infix(align.masks(p), len(p), t)
    assert got == [min(distance(p, t[i : e + 1]) for i in range(e + 2)) for e in range(len(t))]


def families(seed=2, n=30):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(800)]
    rows, i = [], 0
    shared = [rng.choice(vocabulary) for _ in range(120)]
    for f in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        if f % 5 == 0:
            base = shared + base[:40]  # a passage that several families share
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            words = [rng.choice(vocabulary) if rng.random() < 0.04 else w for w in base]
            rows.append((i, " ".join(words), "en"))
            i += 1
    return rows


def brute(rows, similarity=0.8):
    w = words_of([t for _, t, _ in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            most = int((1 - similarity) * max(len(w[a]), len(w[b])) + 1e-9)
            if len(w[a]) and len(w[b]) and align.within(w[a], w[b], most) <= most:
                parent[find(a)] = find(b)
    out = {}
    for k, (i, _, _) in enumerate(rows):
        out.setdefault(find(k), set()).add(i)
    return {frozenset(v) for v in out.values()}


def grouped(got):
    out = {}
    for r in got:
        out.setdefault(r.class_id, set()).add(r.doc_id)
    assert all(min(v) == k for k, v in out.items())
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("params", [neardup.Params(), neardup.Params(few_nodes=2), neardup.Params(few_nodes=0, block_words=300, broadcast_rows=0)])
def test_classes_are_those_of_brute_force(spark, params):
    rows = families()
    got = neardup.near_duplicates(documents(spark, rows), params).collect()
    assert len(got) == len(rows)
    assert grouped(got) == brute(rows)


def test_classes_on_edge_cases(spark):
    rows = edge_rows()
    got = neardup.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add((r.class_id, r.class_size))
    assert of[6] == of[7] == {(6, 3)}
    assert of[2] == {(2, 1)} and of[3] == {(3, 1)} and of[4] == {(4, 1)}
    assert of[None] == {(None, 1)}
    assert neardup.near_duplicates(documents(spark, [])).collect() == []


def test_one_of_each_class_stays_with_its_columns(spark):
    rows = [*families(n=8), (500, None, "en"), (501, None, "en"), (502, "", "en")]
    docs = documents(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len(brute(rows[:-3])) + 3
    assert all(len(c & set(ids)) == 1 for c in brute(rows[:-3]))


def edited(rng, words, e):
    words = list(words)
    for _ in range(e):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [rng.randrange(1 << 40)], [rng.randrange(1 << 40)], [words[at], rng.randrange(1 << 40)]])
    return np.array(words, np.uint64)


def spread(rng, words, e):
    """Words replaced at even distances: what sketches see least of."""
    words = list(words)
    for k in range(e):
        words[(2 * k + 1) * len(words) // (2 * e)] = rng.randrange(1 << 40)
    return np.array(words, np.uint64)


@pytest.mark.parametrize("edit", [edited, spread])
@pytest.mark.parametrize("similarity", [0.8, 0.81, 0.85, 0.9, 0.95])
@pytest.mark.parametrize("sizes, least", [((5, 30), 1), ((31, 60), 0.96), ((61, 200), 0.96), ((201, 600), 0.96)])
def test_candidates_reach_down_to_the_threshold(similarity, sizes, least, edit):
    rng, p = random.Random(int(similarity * 100)), neardup.Params()
    true = met = 0
    for _ in range(400 if sizes[1] <= 200 else 160):
        a = np.array([rng.randrange(1 << 40) for _ in range(rng.randint(*sizes))], np.uint64)
        b = edit(rng, a, int((1 - similarity) * len(a) + 1e-9))
        longer = max(len(a), len(b))
        most = int(0.2 * longer + 1e-9)
        if longer > sizes[1] or align.within(a, b, most) > most:
            continue
        true += 1
        # exact copies are one node without any sketch
        met += np.array_equal(a, b) or len(np.intersect1d(neardup.candidate_keys(a, p), neardup.candidate_keys(b, p))) > 0
    assert true > 100 and met >= least * true


@pytest.mark.parametrize("rate", [0.08, 0.12, 0.16, 0.19])
def test_pairs_of_any_edit_rate_fall_in_one_class(spark, rate):
    rng, rows = random.Random(int(rate * 100)), []
    for k in range(60):
        words = [f"v{rng.randrange(40_000)}" for _ in range(rng.choice([40, 200, 600]))]
        e = int(rate * len(words))
        places = rng.sample(range(len(words)), e) if k % 2 else [(2 * j + 1) * len(words) // (2 * e) for j in range(e)]
        other = [f"n{k}x{j}" if j in set(places) else w for j, w in enumerate(words)]
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(other), "en")]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    together = sum(got[2 * k] == got[2 * k + 1] for k in range(60))
    assert together >= 58 and len(set(got.values())) == 120 - together


@pytest.mark.parametrize("few_nodes", [32, 0])
def test_copies_that_agree_once_behind_a_foreign_first_are_found(spark, few_nodes):
    draw = lambda name, n: [f"{name}{k}" for k in range(n)]
    passage = draw("p", 40)
    texts = [" ".join(w) for w in (draw("f", 40) + passage, draw("a", 36) + passage + ["x"], draw("a", 36) + passage + ["y"])]
    words = words_of(texts)
    for seed in range(1000):
        p = neardup.Params(sketches=1, few_nodes=few_nodes, seed=seed)
        if len({int(neardup.sketch(w, p)[0]) for w in words}) == 1:
            break
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    assert len({int(neardup.sketch(w, p)[0]) for w in words}) == 1
    assert grouped(neardup.near_duplicates(documents(spark, rows), p).collect()) == brute(rows) == {frozenset({0}), frozenset({1, 2})}


def test_short_classes_are_those_of_brute_force(spark):
    rng = random.Random(5)
    rows = [(0, "one two three four five six seven", "en"), (1, "one two three four five six eight", "en")]
    for _ in range(60):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 34))]
        for _ in range(rng.randint(1, 3)):
            words = [rng.choice(["x", "y z", ""]) if rng.random() < 0.12 else w for w in base]
            rows.append((len(rows), " ".join(words), "en"))
    assert grouped(neardup.near_duplicates(documents(spark, rows)).collect()) == brute(rows)


def test_sketches_tell_order_apart():
    p = neardup.Params()
    rng = random.Random(0)
    parts = [[f"a{rng.randrange(500)}" for _ in range(60)] for _ in range(4)]
    flat = lambda order: " ".join(w for k in order for w in parts[k])
    a, same, turned = (neardup.sketch(w, p) for w in words_of([flat([0, 1, 2, 3]), flat([0, 1, 2, 3]) + " end", flat([3, 2, 1, 0])]))
    assert (a == same).sum() > 25 > 12 > (a == turned).sum()
    long = np.arange(300_000, dtype=np.uint64)
    assert len(neardup.sketch(long, p)) == p.sketches


def test_components_of_a_long_path(spark):
    from lintquarry.llm.common import Shared

    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.comp for r in neardup.components(Shared(spark, "test"), edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


# ---------------------------------------------------------------- benchmark


def leak_rows(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, draw(rng.randint(5, 60))) for k in range(25)]
    docs = []
    for i in range(120):
        words = draw(rng.randint(0, 120))
        if i % 4 == 0:
            _, item = rng.choice(items)
            part = list(item)
            for _ in range(rng.randint(0, len(part) // 4)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [part[at], "extra"]])
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((i, " ".join(words).capitalize(), "en"))
    return docs, [(k, ", ".join(w)) for k, w in items]


def leaks(docs, items, edits=0.2):
    """Every item's least distance to a part of a document, by the plain recurrence, within a share of the item's words."""
    out = set()
    texts = list(zip(docs, words_of([t for _, t, _ in docs]), strict=True))
    for (k, _), item in zip(items, words_of([t for _, t in items]), strict=True):
        for (i, _, _), w in texts:
            row = list(range(len(item) + 1))
            best = row[-1]
            for x in w.tolist():
                new = [0]
                for j, y in enumerate(item.tolist(), 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
                best = min(best, row[-1])
            if len(item) and best <= len(item) * 2 // 10 * (edits > 0):
                out.add((i, k, best))
    return out


def test_matches_are_those_of_brute_force(spark):
    docs, items = leak_rows()
    items += [(100 + n, " ".join(f"w{7 * n + j}" for j in range(n))) for n in range(1, 16)]
    rng = random.Random(9)
    for n in range(1, 16):  # each short item whole, and with as many words changed as it allows and one more
        for changed in range(n // 5 + 2):
            words = items[-16 + n][1].split()
            for at in rng.sample(range(n), min(n, changed)):
                words[at] = f"x{at}"
            docs.append((1000 + 10 * n + changed, " ".join(["q"] * 9 + words + ["q"] * 9), "en"))
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    want = leaks(docs, items)
    assert len(want) > 60
    found = lambda p: {(r.doc_id, r.item_id, r.distance) for r in decontam.matches(documents(spark, docs), frame, p).collect()}
    assert found(decontam.Params()) == want
    assert found(decontam.Params(edits=0.0)) == leaks(docs, items, 0.0) != want  # the workers' index is made anew
    assert found(decontam.Params(block_chars=400)) == want
    for p in (decontam.Params(), decontam.Params(block_chars=400)):
        clean = decontam.keep_clean(documents(spark, docs), frame, p)
        assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _, _ in docs} - {i for i, _, _ in want})


def test_matches_on_edge_cases(spark):
    items = spark.createDataFrame([(1, "the lazy dog near the river bank today"), (2, None), (3, "?!"), (4, "cat"), (None, "words enough to count here"), (5, "the lazy dog near the river bank today")], "item_id bigint, text string")
    got = decontam.matches(documents(spark, edge_rows()), items).collect()
    assert {(r.doc_id, r.item_id, r.distance, r.end_word) for r in got} == {(1, 1, 0, 14), (1, 5, 0, 14), (None, None, 1, 11)}
    assert decontam.matches(documents(spark, edge_rows()), items.limit(0)).collect() == []
    assert decontam.matches(documents(spark, []), items).collect() == []
    assert decontam.keep_clean(documents(spark, edge_rows()), items).count() == len(edge_rows()) - 2


UNSPACED_TEXTS = {
    "zh": "今天的天气非常好我们一起去公园散步然后在湖边的茶馆里喝了一杯热茶并且谈论了许多关于未来的计划",
    "ja": "きょうはとてもよい天気なので友達と一緒に公園を散歩してそれから湖のそばの茶店で温かいお茶を飲みながら将来について話しました",
    "th": "วันนี้อากาศดีมากเราจึงไปเดินเล่นที่สวนสาธารณะด้วยกันแล้วดื่มชาร้อนที่ร้านริมทะเลสาบและพูดคุยเรื่องแผนการในอนาคต",
}


def changed(text, share, seed):
    rng = random.Random(seed)
    return "".join(chr(ord(c) + 1) if rng.random() < share and ord(c) > 0x0E2F else c for c in text)


def test_scripts_without_spaces_are_cut_into_characters():
    assert [len(w) for w in words_of(["今天 abc def天", "カタカナ12", "ภาษาไทย", "naïve café", ""])] == [5, 5, 7, 2, 0]
    a, b = words_of(["天abc天", "天 abc 天"])
    assert (a == b).all()


@pytest.mark.parametrize("lang", sorted(UNSPACED_TEXTS))
def test_near_copies_and_leaks_in_scripts_without_spaces(spark, lang):
    base = UNSPACED_TEXTS[lang]
    rows = [(0, base, lang), (1, changed(base, 0.08, 1), lang), (2, changed(base, 0.08, 2), lang), (3, base[::-1], lang), (4, "".join(random.Random(5).sample(base, len(base))), lang)]
    got = grouped(neardup.near_duplicates(documents(spark, rows)).collect())
    assert got == brute(rows) and any({0, 1, 2} <= g for g in got)
    item = base[5:30]
    docs = documents(spark, [(0, f"前{changed(item, 0.1, 3)}后" if lang != "th" else f"ก{changed(item, 0.1, 3)}ข", lang), (1, base[::-1], lang)])
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontam.matches(docs, bench).collect()} == {0}
