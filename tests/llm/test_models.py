from __future__ import annotations

import random
import zlib

import numpy as np

from lintquarry.llm import langid, quality

from .edge import documents, edge_rows

SMALL = quality.Params(max_rows=200, epochs=8)
WORDS = {"en": "the of and to in is that for with was this river stone".split(), "de": "der die und nicht ein ist das auf für über straße schön".split(), "fr": "le la les et des une est dans pour très être déjà".split()}


def corpus(n=240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(20, 60))]
        good = i % 2
        kind = i % 3
        if not good:
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "$$$" for w in words] if kind == 1 else [w for w in words for _ in range(9)]
        rows.append((100 + i, " ".join(words), lang))
        labels.append((100 + i, good, 0))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out_rows_and_edge_cases(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame([*labels, (101, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, rows + edge_rows())
    got = quality.score_documents(docs, lab, SMALL).collect()
    assert len(got) == len(rows) + len(edge_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    truth = {i: q for i, q, _ in labels}
    judged = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(judged) > 30 and np.mean(judged) > 0.95
    same = {r.score for r in got if r.doc_id in (6, 7)}
    assert len(same) == 1
    again = quality.score_documents(docs, lab, SMALL).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_quality_without_labels_or_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.score_documents(documents(spark, edge_rows()), empty, SMALL).collect()} == {0.5}
    assert quality.score_documents(documents(spark, []), empty, SMALL).collect() == []


def test_scoring_is_the_mean_of_vectors_through_the_softmax():
    p = quality.Params(buckets=1 << 8, dim=4, prior=3)
    rng = np.random.default_rng(0)
    m = quality.Model(p, rng.normal(size=(p.buckets, p.dim)).astype(np.float32), rng.normal(size=(p.dim, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    text = "Some words, some words again and again."
    ((k, n),) = quality.counted([text], p)
    mean = (n[:, None] * m.vectors[k]).sum(axis=0) / (n.sum() + p.prior)
    z = np.exp(mean @ m.layer + m.bias)
    assert abs(m.score([text])[0] - z[1] / z.sum()) < 1e-5


def test_language_on_held_out_rows_and_edge_cases(spark):
    rows, _ = corpus()
    clean = [r for r in rows if "$" not in r[1]]
    docs = documents(spark, clean + edge_rows())
    got = langid.identify_documents(docs).collect()
    truth = {i: g for i, _, g in clean}
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(judged) > 15 and np.mean(judged) > 0.95
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i in (2, 3, 4, 8):
        assert [(r.lang_pred, r.score, r.rejected) for r in by[i]] == [("und", 0.0, True)]
    assert all(0 <= r.score <= 1 for r in got)
    assert by[5][0].lang_pred in {"la", "en", "de", "fr"}


def test_language_rejects_by_distance_and_learns_from_nothing(spark):
    rows, _ = corpus()
    x, _ = langid.counts([t for _, t, _ in rows], langid.Params())
    m = langid.train(list(x), [g for _, _, g in rows], langid.Params())
    assert m.predict(["щука плавает в реке и никого не боится"])[0][2]
    assert not m.predict(["the river and the stone is in this"])[0][2]
    unlearned = ["W Szczebrzeszynie chrząszcz brzmi w trzcinie", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina", "qxz wvk jjp zzq kkw vvx qpl mnb xcv lkj hgf"]
    assert all(rejected for _, _, rejected in m.predict(unlearned))
    assert {r.lang_pred for r in langid.identify_documents(documents(spark, [(1, "some text", None)])).collect()} == {"und"}
    assert langid.identify_documents(documents(spark, [])).collect() == []


def test_cosines_are_those_of_a_dense_loop():
    rows, _ = corpus(60)
    p = langid.Params(dims=256, clusters=2)
    x, _ = langid.counts([t for _, t, _ in rows], p)
    m = langid.train(list(x), [g for _, _, g in rows], p)
    for (_, text, _), row, (lang, score, rejected) in zip(rows, x, m.predict([t for _, t, _ in rows]), strict=True):
        v = [(1 + np.log(n)) * w if n else 0.0 for n, w in zip(row, m.idf, strict=True)]
        size = sum(a * a for a in v) ** 0.5
        cos = [sum(a * b for a, b in zip(v, c, strict=True)) / size for c in m.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert abs(score - cos[best]) < 1e-4 and lang == m.langs[m.owner[best]] and rejected == (1 - score > m.reach[best]), text


def test_one_repeated_identifier_is_one_row_of_the_samples(spark):
    rows, labels = corpus(40)
    repeated = [(100, f"text number {k} of one identifier", "en") for k in range(300)]
    docs = documents(spark, rows + repeated)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    seen = []
    train, quality.train = quality.train, lambda got, p: seen.append(len(got)) or train(got, p)
    try:
        quality.fit(docs, lab, p=SMALL)
    finally:
        quality.train = train
    learn, langid.train = langid.train, lambda texts, langs, p: seen.append(len(langs)) or learn(texts, langs, p)
    try:
        langid.fit(docs)
    finally:
        langid.train = learn
    learned = sum(not held(i) for i, _, _ in rows)
    assert seen[0] == learned and learned / 2 < seen[1] <= learned + 1  # one text of it in either language


def test_languages_of_few_repeated_identifiers_are_learned(spark):
    """Six languages of one identifier, which many rows repeat, beside one of many."""
    letter = {"l1": "p", "l2": "q", "l3": "r", "l4": "s", "l5": "t", "l6": "v", "en": "n"}
    words = {g: [f"{a}{b}{c}" for a in f"b{c}kl" for b in "aeiou"] for g, c in letter.items()}
    ids = [i for i in range(1000) if not held(i)]
    rows = [(ids[k], " ".join(words["en"]), "en") for k in range(50)]
    rows += [(ids[100 + k], " ".join(words[f"l{k}"]), f"l{k}") for k in range(1, 7) for _ in range(3000)]
    model = langid.fit(documents(spark, rows))
    assert model.langs == ["en", "l1", "l2", "l3", "l4", "l5", "l6"]
    got = [m[0] for m in model.predict([" ".join(words[g]) for g in sorted(words)])]
    assert got == sorted(words)
