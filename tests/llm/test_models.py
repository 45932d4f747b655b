import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from edilake.llm import lang_id, mixing, quality, toxicity
from edilake.llm.common import slabs

WORDS = {"aa": ["der", "und", "ung", "schein", "keit"], "bb": ["the", "and", "tion", "with", "ing"]}


def texts(lang, n, seed):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choices(WORDS[lang], k=rnd.choice([1, 1, 2]))) for _ in range(12)) for _ in range(n)]


def test_language_model():
    train = texts("aa", 60, 1) + texts("bb", 60, 2)
    model = lang_id.Model.fit(train, ["aa"] * 60 + ["bb"] * 60)
    own = texts("aa", 20, 3) + texts("bb", 20, 4) + ["", "123 .", "ungschein", "日", "UND"]
    (s,) = slabs(pa.array(own))
    langs, score = model.score(s)
    assert langs[:40] == ["aa"] * 20 + ["bb"] * 20 and langs[40:43] == ["und", "und", "aa"] and langs[43] != "und" and langs[44] == "aa"
    assert (score[40:42] == 0).all() and (score[:40] > 0.9).all()
    assert lang_id.Model.fit([], []).score(s)[0] == ["und"] * len(own)


def test_language_rows(spark):
    df = spark.createDataFrame([(1, None, "aa"), (2, "der und", "aa"), (2, "der und", "aa"), (None, "the and", "bb"), (3, "", None)], "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    model = lang_id.train(df)
    got = lang_id.identify(df, model).collect()
    assert len(got) == 5 and sum(r.lang_pred == "und" for r in got) == 2
    assert lang_id.keep_identified(df, model).count() == 3
    assert lang_id.identify(df.limit(0), model).count() == 0


def test_swaps_pull_identity_terms_together():
    rnd = random.Random(1)
    filler = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(600):
        bad = k % 2
        w = rnd.choices(filler, k=8) + (["vile"] if bad else [])
        # A spurious link: one term mostly in toxic texts, the other mostly in clean ones.
        w.append("women" if (bad and rnd.random() < 0.9) or (not bad and rnd.random() < 0.1) else "men")
        rnd.shuffle(w)
        rows.append((" ".join(w), bad))
    x, y = [t for t, _ in rows], np.array([b for _, b in rows])
    effect = {}
    for weight in (0.0, 4.0):
        w, b = toxicity.fit(x, y, weight_swaps=weight)
        effect[weight] = abs(w[toxicity._one("women")].sum() - w[toxicity._one("men")].sum())
    assert effect[4.0] < 0.5 * effect[0.0]
    (s,) = slabs(pa.array(["w1 w2 women w3", "w1 vile w2 men", ""]))
    p = toxicity.score_slab(s, w, b)
    assert p[0] < 0.5 < p[1] and p[2] < 0.7


def test_toxicity_without_labels():
    w, b = toxicity.fit([], np.zeros(0))
    (s,) = slabs(pa.array(["any", ""]))
    assert (toxicity.score_slab(s, w, b) < 0.01).all()


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    n, truth = 20_000, rng.random(20_000) < 0.8
    v = np.full((n, 6), -1, np.int8)
    for j, (hit, false) in enumerate([(0.7, 0.01), (0.6, 0.02), (0.5, 0.01), (0.8, 0.03), (0.4, 0.01), (0.6, 0.01)]):
        says = rng.random(n) < np.where(truth, false, hit)
        v[says, j] = 0
    pattern, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, right, prior = quality.em(pattern, counts)
    assert abs(prior - 0.8) < 0.03
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.97
    assert quality.em(np.zeros((0, 6), np.int8), np.zeros(0))[2] == 0.8


def test_quality_rows(spark):
    good = " ".join(["several", "ordinary", "words", "stand", "here", "in", "varied", "order", "today", "again"] * 3)
    df = spark.createDataFrame([(1, None), (2, ""), (3, good), (3, good), (4, "### $$$ %%% " * 30), (5, "spam " * 200)], "doc_id long, text string").selectExpr("*", "1 as score")
    got = quality.score(df, quality.train(df)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(df.limit(0), quality.train(df.limit(0))).count() == 0


def brute_share(budget, children):
    out, live, left = {c[0]: 0 for c in children}, [c for c in children if c[1] > 0], budget
    while live:
        weight = sum(c[1] for c in live)
        full = [c for c in live if c[2] * weight <= left * c[1]]
        if not full:
            return out | {n: left * w // weight for n, w, _ in live}
        for n, _, cap in full:
            out[n] = cap
        left -= sum(c[2] for c in full)
        live = [c for c in live if c not in full]
    return out


def test_budgets(spark):
    rnd = random.Random(2)
    names = ["a", "b", "c"]
    weights = {"a": {"a0": 0, "a1": 5}, "b": {"b0": 3}, "c": {}}

    def down(rows, k, amount):
        if k == 3:
            return {rows[0][:3]: amount}
        below = {}
        for r in rows:
            below.setdefault(r[k], []).append(r)
        got = brute_share(amount, [(n, weights[names[k]].get(n, 1), 2 * sum(r[3] for r in x)) for n, x in sorted(below.items())])
        return {leaf: v for n, x in below.items() for leaf, v in down(x, k + 1, got[n]).items()}

    for share in (0.3, 1.0, 1.7):
        rows = [(f"a{i}", f"b{j}", f"c{k}", rnd.choice([0, 5, 40, 300])) for i in range(3) for j in range(3) for k in range(3)]
        leaves = spark.createDataFrame(rows, "a string, b string, c string, t long")
        total = sum(r[3] for r in rows)
        got = {(r.a, r.b, r.c): r.budget for r in mixing.budgets(leaves, share, weights, names, 2).collect()}
        assert got == down(rows, 0, int(total * share))
    # A short leaf's rest goes to its sibling before another domain gains.
    leaves = spark.createDataFrame([("x", "en", "a", 10), ("x", "en", "b", 100), ("y", "en", "c", 200)], "a string, b string, c string, t long")
    assert sorted(r.budget for r in mixing.budgets(leaves, 100, {}, names, 1).collect()) == [10, 40, 50]


def test_mixing_rows(spark):
    """Nulls, empty texts, repeated rows at the end of a budget, clashing names, an empty table."""
    rows = [(1, "a b c", "s1"), (1, "a b c", "s1"), (1, "a b c", "s1"), (1, "a b c", "s1"), (2, None, None), (3, "", "s1"), (None, "x y", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 as epoch", "8 as key_", "9 as origin_", "'t' as t")
    levels = {"origin": F.col("source")}
    edge, _ = mixing.plan(df.where("doc_id = 1"), levels, {}, 7, max_epochs=1)
    assert mixing.select(df.where("doc_id = 1"), edge, levels).count() == 0  # four equal rows of 12 tokens don't fit in 7
    edge, _ = mixing.plan(df, levels, {}, 1.0, max_epochs=1)
    got = mixing.select(df, edge, levels)
    assert got.columns == [*df.columns, "epoch_"]
    out = got.collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 1, 1, 1, 2, 3] and {(r.epoch, r.key_, r.origin_, r.epoch_) for r in out} == {(7, 8, 9, 0)}
    edge, _ = mixing.plan(df.limit(0), levels, {}, 1.0)
    assert mixing.select(df.limit(0), edge, levels).count() == 0


def test_toxicity_rows_and_swaps(spark):
    """Planted mentions: toxic texts name one group; swaps keep the mere mention from counting, without them it counts."""
    rnd = random.Random(9)
    plain = [f"w{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        words = [rnd.choice(plain) for _ in range(12)] + (["vile"] if bad and rnd.random() < 0.6 else [])
        words += ["muslims"] if rnd.random() < (0.7 if bad else 0.05) else []
        texts.append(" ".join(words))
        labels.append(int(bad))
    (neutral,) = slabs(pa.array(["the muslims w1 w2 w3 w4", "the w9 w1 w2 w3 w4"]))
    gap = {}
    for strength in (0.0, 40.0):
        a, b = toxicity.score_slab(neutral, *toxicity.fit(texts, np.array(labels), weight_swaps=strength))
        gap[strength] = a - b
    assert gap[0.0] > 0.1 and abs(gap[40.0]) < gap[0.0] / 3
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, "vile " * 50_000), (902, "vile " * 50_000), (None, "w1")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as y")
    marks = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(0, 0), (1, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[900] == by[901] == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), marks)).count() == 0
