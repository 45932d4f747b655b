"""Components of links between members of buckets, without making the pairs of a bucket.

Members of a bucket may be linked; a test says which are. In each pass every
bucket that holds several components draws one member, its pivot, and tests the
others of other components against it. A member drawn is settled in its bucket
and leaves it, so the passes end; pairs inside a component need no test. The
draw goes by a hash of the member, so buckets with much the same members draw
the same one and their pairs fall together.

In the first pass each member is tested against one pivot only, the least of
all its buckets, which makes as many pairs as there are members at most and
joins nearly all that belong together. Later passes draw more members of a bucket
at once, FASTER times as many in each.

Every step is a table in the shared folder: lost executors cost one step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .components import components

#: From the second pass on, a bucket draws about so many pivots, and so many times as many in each later one.
FASTER = 16


def _relabel(rows: DataFrame, grown: DataFrame) -> DataFrame:
    """rows with c replaced by the component it has become part of."""
    name = grown.select(F.col("node").alias("g_"), F.col("component").alias("top_"))
    return rows.join(name, F.col("c") == F.col("g_"), "left").withColumn("c", F.coalesce("top_", "c")).drop("g_", "top_")


def link(members: DataFrame, attributes: list[str], fits: Callable[[str, str], Column], test: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of the nodes that have links; component is the least node.

    members: (key, node long, attributes), each once. fits(a, b): a condition
    that linked members meet, over attributes prefixed a and b. test: of pairs
    (a, b, ca, cb), those that are links.
    """
    own = ["node", *attributes]
    now = cut(members.select("key", *own, F.col("node").alias("c")), "members")
    at = None
    step = 0
    while True:
        draw = F.xxhash64("node", F.lit(max(step, 1)))
        # Column by column, as a struct's least one would need a sort; the draw has no ties.
        first = [F.min_by(x, draw).alias(x) for x in (*own, "c")]
        spans = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), *first).where("lo <> hi")
        spans = cut(spans.select("key", "m", F.struct(*own, "c").alias("p")), "spans")
        if spans.isEmpty():
            drop_cut(spans)
            break
        picked = None
        if step == 0:
            of = now.join(spans.select("key", "p"), "key")
        else:
            # Some more of each bucket, by the hash of the draw; the least always is one.
            every = F.greatest(F.lit(1), F.col("m") / FASTER**step)
            near = now.join(spans.select("key", "m", F.col("p.node").alias("first")), "key")
            more = near.where((F.col("node") == F.col("first")) | (F.pmod(draw, F.lit(1 << 20)) < F.lit(1 << 20) / every))
            picked = cut(more.select("key", F.struct(*own, "c").alias("p")), "picked")
            of = now.join(picked, "key")
        pairs = of.where((F.col("c") != F.col("p.c")) & fits("", "p.")).select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.col("p.c").alias("ca"), F.col("c").alias("cb"))
        if step == 0:
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a_"), F.min_by("ca", "a").alias("ca"), F.min("cb").alias("cb")).select(F.col("a_").alias("a"), "b", "ca", "cb")
        else:
            # Two pivots of a bucket meet once.
            turn = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
            pairs = pairs.select(turn("a", "b").alias("a"), turn("b", "a").alias("b"), turn("ca", "cb").alias("ca"), turn("cb", "ca").alias("cb")).distinct()
        pairs = cut(pairs, "pairs")
        links = None if pairs.isEmpty() else cut(test(pairs).select(F.col("ca").alias("u"), F.col("cb").alias("v")), "links")
        grown = None if links is None or links.isEmpty() else components(links)
        left = now.join(spans.select("key"), "key")
        if step:
            gone = picked.select("key", F.col("p.node").alias("node"))
            left = left.join(gone, ["key", "node"], "left_anti")
        left = left.select("key", *own, "c")
        after = cut(left if grown is None else _relabel(left, grown), "members")
        if grown is not None and at is None:
            at = cut(grown.select("node", F.col("component").alias("c")), "label")
        elif grown is not None:
            # Nodes that were alone until now are components of their own in what has grown.
            fresh = grown.join(at.select(F.col("node").alias("k_")), F.col("node") == F.col("k_"), "left_anti").select("node", F.col("component").alias("c"))
            both = cut(_relabel(at, grown).select("node", "c").union(fresh), "label")
            drop_cut(at)
            at = both
        for x in (now, spans, pairs, links, grown, picked):
            drop_cut(x)
        now, step = after, step + 1
    drop_cut(now)
    if at is None:
        return members.select("node", F.col("node").alias("component")).limit(0)
    return at.select("node", F.col("c").alias("component"))
