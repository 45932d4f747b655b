"""Links in buckets against all pairs of each bucket."""

import random

from pyspark.sql import functions as F

from edilake.llm.linking import link


def test_against_all_pairs(spark):
    rnd = random.Random(5)
    spots = {n: rnd.randint(0, 400) for n in range(1, 90)}
    rows = sorted({(rnd.randint(0, 8), n) for n in spots for _ in range(2)} | {(99, n) for n in spots})
    parent = {n: n for n in spots}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in {k for k, _ in rows}:
        own = [n for b, n in rows if b == k]
        for a in own:
            for b in own:
                if abs(spots[a] - spots[b]) <= 2:
                    parent[find(a)] = find(b)
    least = {}
    for n in spots:
        least[find(n)] = min(least.get(find(n), n), n)
    want = {n: least[find(n)] for n in spots if sum(find(m) == find(n) for m in spots) > 1}
    members = spark.createDataFrame([(k, n, spots[n]) for k, n in rows], "key long, node long, spot int")
    made = []

    def test(pairs):
        made.append(pairs.count())
        at = members.select("node", "spot").distinct()
        both = pairs.join(at.withColumnsRenamed({"node": "a", "spot": "sa"}), "a").join(at.withColumnsRenamed({"node": "b", "spot": "sb"}), "b")
        return both.where("abs(sa - sb) <= 2").select(*pairs.columns)

    fits = lambda a, b: F.abs(F.col(f"{a}spot") - F.col(f"{b}spot")) <= 50
    got = {r.node: r.component for r in link(members, ["spot"], fits, test).collect()}
    assert got == want and len(want) > 20
    assert made[0] <= len(spots)


def test_no_links(spark):
    members = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 3, 0)], "key long, node long, spot int")
    assert link(members, ["spot"], lambda a, b: F.lit(True), lambda p: p.where("false")).count() == 0
