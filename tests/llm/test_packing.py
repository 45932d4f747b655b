import random
from collections import Counter
from functools import lru_cache

import pytest

from edilake.llm import packing


def check(patterns, counts, capacity):
    held = Counter()
    for n, items in patterns:
        assert n > 0 and sum(k * m for k, m in items) <= capacity
        for k, m in items:
            held[k] += n * m
    assert held == Counter(counts)
    return sum(n for n, _ in patterns)


def optimum(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @lru_cache(None)
    def go(left, rooms):
        if not left:
            return 0
        best = go(left[1:], tuple(sorted((*rooms, capacity - left[0])))) + 1
        for k, r in enumerate(rooms):
            if r >= left[0] and (k == 0 or rooms[k - 1] != r):
                best = min(best, go(left[1:], tuple(sorted((*rooms[:k], r - left[0], *rooms[k + 1 :])))))
        return best

    return go(items, ())


@pytest.mark.parametrize("seed", range(60))
def test_small_packings_are_optimal(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 20, 30])
    items = [rnd.randint(1, capacity) if rnd.random() < 0.4 else rnd.randint(capacity // 4, capacity // 2) for _ in range(rnd.randint(1, 9))]
    counts = Counter(items)
    assert check(packing.plan(counts, capacity), counts, capacity) == optimum(items, capacity)


def test_branch_and_bound_beats_best_fit():
    beaten = 0
    for seed in range(400):
        rnd = random.Random(1000 + seed)
        items = [rnd.randint(5, 16) for _ in range(9)]
        counts = Counter(items)
        first = check(packing.best_fit(counts, 30), counts, 30)
        best = check(packing.plan(counts, 30), counts, 30)
        assert best <= first
        if best < first:
            beaten += 1
            assert best == optimum(items, 30)
    assert beaten >= 3


@pytest.mark.parametrize("seed", range(5))
def test_large_histograms_stay_close_to_the_bound(seed):
    rnd = random.Random(seed)
    counts = Counter(min(4096, max(1, int(rnd.lognormvariate(6, 1.2)))) for _ in range(20_000))
    n = check(packing.plan(counts), counts, 4096)
    assert n <= packing.lower_bound(counts, 4096) * 1.002 + 1


def test_pieces_and_places(spark):
    rows = [(k, "word " * (k * 13 % 50)) for k in range(200)] + [(900, None), (901, ""), (902, "long " * 300), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length").repartition(5)
    out = packing.pack(df, capacity=64).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 902)
    assert long == [(0, 0, 64), (1, 64, 64), (2, 128, 64), (3, 192, 64), (4, 256, 45)]
    assert len(out) == 208 and [r.length for r in out if r.doc_id in (900, 901)] == [1, 1]
    assert len(by) == packing.lower_bound(Counter(r.length for r in out), 64)
    assert packing.pack(df.limit(0), capacity=64).count() == 0
