import random

from edilake.llm import jaccard
from edilake.llm.components import components


def brute(rows, n=5, percent=75):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def make(seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 9, 14, 25, 60, 200]))]
        if g % 3 == 0:
            base[2:2] = passage
        for _ in range(rnd.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                k = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[k] = rnd.choice(vocab)
                elif rnd.random() < 0.5:
                    w.insert(k, rnd.choice(vocab))
                elif len(w) > 1:
                    del w[k]
            rows.append(rnd.choice([" ", "\n", " \t"]).join(w))
    rnd.shuffle(rows)
    rows += [None, "", "  \n", "one", "ONE", "one two", "One\vTwo", "é a b", "É a b"]
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sig", "2 as n").repartition(3)
        got = sorted(tuple(r) for r in jaccard.join(df).collect())
        assert got == brute(rows)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.join(df).collect()) == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 0, 9)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_salted_lists_very_long_texts_and_ids_with_two_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    rows = make(3)
    long = " ".join(f"x{k % 9000} y{k}" for k in range(40_000))
    rows += [(5_000, long), (5_001, long + " end"), (5_002, long.replace("x7 ", "z "))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as of", "3 as t").repartition(3)
    assert sorted(tuple(r) for r in jaccard.join(df).collect()) == brute(rows)
    twice = [(7, "a b c d e f g h"), (7, "p q r s t u v w"), (3, "a b c d e f g h"), (9, "p q r s t u v w"), (None, "p q r s t u v w")]
    got = sorted((tuple(r) for r in jaccard.join(spark.createDataFrame(twice, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 4, 3), (7, 4, 7), (3, 4, 3), (9, 4, 7), (None, 4, 7)], key=str)


def test_bitmaps_never_refuse_similar_sets():
    import numpy as np

    rnd = np.random.default_rng(8)
    for size in (1, 5, 70, 900):
        for _ in range(50):
            a = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
            b = np.unique(np.concatenate((a[rnd.random(len(a)) < 0.8], rnd.integers(0, 2**63, rnd.integers(0, 4 * size)).astype(np.uint64))))
            apart = len(np.setxor1d(a, b))
            assert jaccard._differ(jaccard._bitmap(a), jaccard._bitmap(b)) <= apart


def test_light_prefixes_lose_no_pair():
    rnd = random.Random(4)
    import numpy as np

    for _ in range(3000):
        a = rnd.sample(range(60), rnd.randint(3, 24))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.5 and len(b) > 3:
                b.pop(rnd.randrange(len(b)))
            else:
                b.append(rnd.randrange(60))
        x, y = (np.unique(np.array(v, np.uint64)) for v in (a, b))
        o = len(set(x.tolist()) & set(y.tolist()))
        if 100 * o >= 75 * (len(x) + len(y) - o) and len(x) != o:
            for light in (0, 12, 30):
                hot = np.array([3, 5, 9], np.uint64), np.array([7, 2, 7])
                kx = jaccard._postings(x, light, 75, *hot)[0]
                ky = jaccard._postings(y, light, 75, *hot)[0]
                assert set(kx.tolist()) & set(ky.tolist())


def test_components(spark):
    rnd = random.Random(6)
    edges = [(k, k + 1) for k in range(40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, 300 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
