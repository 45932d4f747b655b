"""Exact top-k by inner product: an impact-ordered index, processed score-at-a-time.

Vectors become integers, floor(1024 x). Within a block of vectors each
dimension's postings are shifted to be non-negative for a query's sign and cut
into segments by value (their quantised impact). A query takes segments by
descending impact |q_d| * upper bound, adding exact contributions to its
accumulators. What is still open adds at most the sum, over dimensions, of
|q_d| times the bound of the next segment. Processing stops only when this
proves that all but a few vectors can't reach the k-th best accumulator; those
that still can are scored exactly. Blocks of vectors meet blocks of queries,
and each query's k best of every block are ranked once more.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part, as queries or candidates; vectors of different lengths
don't meet; ties go to the smaller id, so equal vectors rank by id; rows that
repeat an id (with the same vector) count once; a query with fewer candidates
than k gets all; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, table

K, SCALE = 10, 1024
BLOCK, QUERIES = 8192, 1024
LEVELS = 8


class Index:
    """Segments of a block's vectors: for each dimension ids by ascending value, cut at quantised levels."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.low, self.high = x.min(0), x.max(0)
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        n, dims = x.shape
        self.values = np.take_along_axis(x.T, self.order, 1)  # ascending, as order has the ids
        self.cuts = []
        for d in range(dims):
            v = self.values[d]
            edges = self.low[d] + (self.high[d] - self.low[d]) * np.arange(1, LEVELS) // LEVELS
            inner = np.searchsorted(v, edges, "right")
            self.cuts.append(np.unique(np.concatenate(([0], inner, [n]))))

    def search(self, q: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of every vector that may be among the k best (but the own place); all k are among them."""
        x, n = self.x, len(self.x)
        steps = []  # (impact, dimension, from, to, bound of the dimension's next segment)
        for d in np.flatnonzero(q):
            cuts, w = self.cuts[d], abs(int(q[d]))
            v = self.values[d]
            if q[d] > 0:
                bounds = v[cuts[1:] - 1] - self.low[d]  # a segment's largest shifted value
                spans = list(zip(cuts[:-1], cuts[1:], bounds))[::-1]
            else:
                bounds = self.high[d] - v[cuts[:-1]]
                spans = list(zip(cuts[:-1], cuts[1:], bounds))
            for i, (lo, hi, b) in enumerate(spans):
                steps.append((w * int(b), d, lo, hi, w * int(spans[i + 1][2]) if i + 1 < len(spans) else 0))
        steps.sort(key=lambda s: (-s[0], s[1]))
        score = np.zeros(n, np.int64)
        first: dict[int, int] = {}
        for impact, d, *_ in steps:
            first.setdefault(d, impact)
        open_ = sum(first.values())
        now = dict(first)
        if own >= 0:
            score[own] = -(1 << 60)
        take = min(k, n)
        check = max(16, len(steps) // 24)
        live = np.arange(n)
        for i, (_, d, lo, hi, after) in enumerate(steps):
            ids = self.order[d, lo:hi]
            v = self.values[d, lo:hi]
            score[ids] += int(q[d]) * (v - (self.low[d] if q[d] > 0 else self.high[d]))
            open_ += after - now[d]
            now[d] = after
            if (i + 1) % check == 0:
                best = np.partition(score, n - take)[n - take]
                live = np.flatnonzero(score + open_ >= best)
                # Exact scores of the rest cost less than going on.
                if len(live) * len(q) <= sum(s[3] - s[2] for s in steps[i + 1 :]):
                    break
        else:
            best = np.partition(score, n - take)[n - take]
            live = np.flatnonzero(score >= best)
        live = live[live != own]
        return live, x[live] @ q


def _prepare(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, dims, data): whole vectors as integers."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and size(v) > 0").groupBy("id").agg(F.min("v").alias("v"))

    def run(batches):
        for b in batches:
            v = b.column(1)
            offs = np.asarray(v.offsets) - v.offsets[0].as_py() if len(v) else np.zeros(1, np.int64)
            flat = v.flatten()
            x = np.asarray(flat.fill_null(float("nan")), np.float64)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            ok = np.flatnonzero(bad[offs[1:]] == bad[offs[:-1]])
            whole = np.floor(np.where(np.isfinite(x), x, 0) * SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(np.diff(offs)[ok].astype(np.int64)), pa.array([whole[offs[i] : offs[i + 1]].tobytes() for i in ok.tolist()], pa.binary())], ["id", "dims", "data"])

    return rows.mapInArrow(run, "id long, dims long, data binary")


def search(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best of all other vectors for each vector that is_query (a condition on id) holds for."""
    own = cut(_prepare(vectors, key, column).withColumn("q", is_query), "vectors")
    sizes = own.groupBy("dims").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("m"))
    of = sizes.select("dims", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("m") / QUERIES).alias("parts")).where("parts > 0")
    placed = own.join(of, "dims")
    h = F.xxhash64("id")
    left = placed.select("dims", F.pmod(h, F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "data")
    right = placed.where("q").select((F.col("dims") + 0).alias("dims"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(h, F.col("parts")).alias("part"), (F.col("id") + 0).alias("id"), F.concat("data", F.lit(b"")).alias("data"))

    def run(rows, queries):
        names = ["query_id", "id", "score"]
        empty = pa.table({n: pa.array([], pa.int64()) for n in names})
        if not rows.num_rows or not queries.num_rows:
            return empty
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        matrix = lambda t: np.stack([np.frombuffer(d.as_py(), np.int64) for d in t.column("data")])
        index = Index(matrix(rows)[order])
        out = []
        for q, v in zip(queries.column("id").to_numpy(), matrix(queries)):
            at = int(np.searchsorted(ids, q))
            at = at if at < len(ids) and ids[at] == q else -1
            live, score = index.search(v, k + (at >= 0), at)
            top = np.lexsort((ids[live], -score))[:k]
            out.append((np.full(len(top), q), ids[live[top]], score[top]))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i, n in enumerate(names)})

    keys = ["dims", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
        from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
