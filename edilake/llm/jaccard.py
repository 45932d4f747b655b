"""Near-duplicate documents: an exact Jaccard join of word n-gram sets, size-aware and heavy-light.

Sets are put in one global order of tokens (rare before frequent, as far as
each task sees frequent ones; any order is right). Two sets with Jaccard
similarity t or more share a token among the first ``n - ceil(t n) + 1`` of
each, and two tokens among the first ``n - ceil(t n) + 2``. So

* light sets (at most B tokens) enumerate all 2-subsets of the longer prefix:
  two light sets are candidates when they have a subset in common;
* heavy sets are looked up by scanning the inverted lists of the shorter
  prefix, in which all heavy sets and those light ones stand that are large
  enough to be similar to a heavy one.

B is the size with the least cost: subsets emitted by the light, postings
emitted and scanned for the heavy.

Lists are not expanded into pairs: members of a list meet pivots (linking.py), pass
by pass, until none holds two components, so the components are exact. A pair is
first held against parity bitmaps of both sets: the bits in which they differ are
no more than the tokens in which the sets do. What that leaves is compared by the
texts. Lists of very frequent tokens are salted over tasks. Sets that are equal are
one node throughout.

Defined cases: words are runs of bytes other than space and tab to carriage
return, with A-Z lower-cased; a text with fewer words than n is one shingle of
all; null, empty and blank texts have no shingles and link with nothing, not
even each other; repeated rows are in one component, rows that repeat an id with
another text go by their texts; an empty table gives none; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slab, cut, drop_cut, lower, maybe_in, mix, slabs, table, words
from .linking import link

WORDS, PERCENT = 5, 75
#: Frequent tokens put last in the order: so many at most. More or fewer change the cost, never the result.
HOT_TOKENS = 1 << 19
#: A task counts so many tokens at a time, and reports those it met so often.
SEEN_TOKENS, OFTEN = 6_000_000, 3
#: A posting scanned costs so many subsets emitted.
SCAN_COST = 4.0
#: Lists of tokens in so many rows at least are dealt out over SALTS tasks.
HOT_ROWS, SALTS = 5_000, 64
#: A set's bitmap has twice as many bits as tokens, up to so many.
MOST_BITS = 1 << 16
POSTINGS = np.dtype([("key", "<u4"), ("n", "<u4"), ("pos", "<u2"), ("node", "<i8")])


def shingle_sets(slab: Slab, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = words(slab, data=lower(slab.data))
    h = w.hashes()
    mult = np.uint64(0xD6E8FEB86659FD93)
    grams = np.zeros(0, np.uint64)
    if len(h) >= n:
        acc = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            acc = acc * mult + h[k : len(h) - n + 1 + k]
        grams = mix(acc)
    out = []
    for lo, hi in zip(w.rows[:-1].tolist(), w.rows[1:].tolist()):
        if hi - lo >= n:
            g = np.sort(grams[lo : hi - n + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif hi > lo:
            acc = h[lo : lo + 1]
            for k in range(lo + 1, hi):
                acc = acc * mult + h[k : k + 1]
            out.append(mix(acc + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> int:
    """One id for equal sets, as a signed long."""
    with np.errstate(over="ignore"):
        v = int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15)
    v &= 2**64 - 1
    return v - 2**64 if v >= 2**63 else v


def _floor(n, percent: int):
    """The least overlap of a set of n with a similar one."""
    return -(-percent * n // 100)


def _bitmap(s: np.ndarray) -> bytes:
    """The parity of the tokens in each of 2**k places, twice as many places as tokens at least."""
    bits = min(MOST_BITS, 1 << max(6, int(2 * len(s) - 1).bit_length())) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Places in which two bitmaps differ, the larger one folded: no more than tokens that only one set has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def profile(docs: DataFrame, n: int) -> DataFrame:
    """Of docs (id, of, t), kind 0: (id, of, set size, signature, bitmap) of each row; kind 1: (token, rows with it) of tokens a task met often."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["kind", "id", "of", "n", "token", "bitmap"]

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def often(like):
            seen = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1])))
            count = np.diff(np.concatenate((at, [len(seen)])))
            at, count = at[count >= OFTEN], count[count >= OFTEN]
            m = len(at)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, like), pa.nulls(m, pa.int64()), pa.array(count), pa.array(seen[at].view(np.int64)), pa.nulls(m, pa.binary())], names)

        for b in batches:
            for s in slabs(b.column(2)):
                sets = shingle_sets(s, n)
                rows = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(rows, np.int32)), b.column(0).slice(s.lo, rows), b.column(1).slice(s.lo, rows), pa.array([len(x) for x in sets], pa.int64()), pa.array([_signature(x) for x in sets], pa.int64()), pa.array([_bitmap(x) for x in sets], pa.binary())],
                    names,
                )
                held += sets
                size += sum(map(len, sets))
                if size > SEEN_TOKENS:
                    yield often(b.column(0).type)
                    held, size = [], 0
        if size:
            yield often(b.column(0).type)

    return docs.mapInArrow(run, f"kind int, id {kind}, of long, n long, token long, bitmap binary")


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The light size with the least cost over the histogram of set sizes; 0 if none are light."""
    s = np.array(sorted(sizes), np.int64)
    many = np.array([sizes[x] for x in s.tolist()], float)
    prefix = s - _floor(s, percent) + 1
    pairs = np.minimum(prefix + 1, s)
    upto = lambda x: np.concatenate(([0.0], np.cumsum(x)))
    light, posted = upto(many * pairs * (pairs - 1) / 2), upto(many * prefix)
    bounds = np.concatenate(([0], s))
    k = np.searchsorted(s, bounds, "right")
    # Light sets that may be similar to a heavy one are posted too.
    least = np.searchsorted(100 * s, percent * (bounds + 1))
    cost = light[k] + np.where(k > least, posted[k] - posted[np.minimum(least, k)], 0) + (posted[-1] - posted[k]) * (1 + SCAN_COST)
    return int(bounds[np.argmin(cost)])


def _postings(s: np.ndarray, light: int, percent: int, hot: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set in the join, the place in its order that each stands for, and whether its list may be long."""
    size = len(s)
    p1 = size - _floor(size, percent) + 1
    rows = np.zeros(size, np.int64)
    if len(hot):
        k = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[k] == s
        if is_hot.any():
            own = np.flatnonzero(is_hot)
            own = own[np.lexsort((s[own], weight[k[own]]))]
            rows = np.concatenate((np.zeros(size - len(own), np.int64), weight[k[own]]))
            s = np.concatenate((s[~is_hot], s[own]))
    keys, pos, long = [], [], []
    if size <= light:
        pre = s[: min(p1 + 1, size)]
        i, j = np.triu_indices(len(pre), 1)
        keys.append(mix(pre[i] * np.uint64(3) + mix(pre[j])))
        pos.append(i)
        long.append(rows[i] >= HOT_ROWS)  # the order is by rows: the first token has the fewest
    if 100 * size >= percent * (light + 1):
        keys.append(mix(s[:p1]))
        pos.append(np.arange(p1))
        long.append(rows[:p1] >= HOT_ROWS)
    none = np.zeros(0, np.int64)
    return (np.concatenate(keys), np.concatenate(pos), np.concatenate(long)) if keys else (none.astype(np.uint64), none, none.astype(bool))


def lists(docs: DataFrame, n: int, percent: int, light: int, hot: tuple, buckets: int) -> DataFrame:
    """(key, node, n, rest): members of the join's lists that have two or more; lists with the same members are one."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches):
        tokens, weight = shared.value
        done: set[int] = set()
        held, size = [], 0

        def flush():
            every, rec, salted = (np.concatenate([x[i] for x in held]) for i in range(3))
            bucket = np.where(salted, buckets + (mix(np.ascontiguousarray(rec["node"]).view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), ((every >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            bucket, rec = bucket[order], rec[order]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.concatenate((at[1:], [len(bucket)]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([rec[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], ["bucket", "data"])

        for b in batches:
            for s in slabs(b.column(0)):
                for x in shingle_sets(s, n):
                    if not len(x):
                        continue
                    node = _signature(x)
                    if node in done:
                        continue  # a copy that this task has met
                    if len(done) >= 1_000_000:
                        done.clear()
                    done.add(node)
                    keys, pos, long = _postings(x, light, percent, tokens, weight)
                    rec = np.empty(len(keys), POSTINGS)
                    rec["key"] = keys & np.uint64(0xFFFFFFFF)
                    rec["n"], rec["pos"], rec["node"] = len(x), np.minimum(pos, 65_535), node
                    held.append((keys, rec, long))
                    size += rec.nbytes
                if size > 16 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def scan(group):
        bucket = group.column("bucket")[0].as_py()
        salted = bucket >= buckets
        rec = np.concatenate([np.frombuffer(x.as_py(), POSTINGS) for x in group.column("data")])
        rec = rec[np.argsort(rec["key"], kind="stable")]
        if not salted:
            same = rec["key"][1:] == rec["key"][:-1]
            rec = rec[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        rec = rec[np.lexsort((rec["pos"], rec["node"], rec["key"]))]
        new = np.ones(len(rec), bool)
        new[1:] = (rec["key"][1:] != rec["key"][:-1]) | (rec["node"][1:] != rec["node"][:-1])
        rec = rec[new]
        rest = rec["n"].astype(np.int64) - rec["pos"]
        at = np.flatnonzero(np.concatenate(([True], rec["key"][1:] != rec["key"][:-1]))) if len(rec) else np.zeros(0, np.int64)
        ends = np.concatenate((at[1:], [len(rec)]))
        node = np.ascontiguousarray(rec["node"])
        found: dict[int, list] = {}
        for lo, hi in zip(at.tolist(), ends.tolist()):
            if salted:  # the rest of the list is in other buckets: named by its token
                found[int(rec["key"][lo]) | 1 << 62] = [node[lo:hi], rec["n"][lo:hi], rest[lo:hi]]
            elif hi - lo >= 2:  # named by its members
                name = _signature(node[lo:hi].view(np.uint64)) & ~(1 << 62)
                if name in found:
                    found[name][2] = np.maximum(found[name][2], rest[lo:hi])
                else:
                    found[name] = [node[lo:hi], rec["n"][lo:hi], rest[lo:hi]]
        join = lambda i, t: np.concatenate([x[i] for x in found.values()]).astype(t) if found else np.zeros(0, t)
        names = np.repeat(np.array(list(found), np.int64), [len(x[0]) for x in found.values()])
        return pa.table({"key": pa.array(names), "node": pa.array(join(0, np.int64)), "n": pa.array(join(1, np.int64)), "rest": pa.array(join(2, np.int64))})

    posted = docs.select("t").mapInArrow(emit, "bucket long, data binary")
    out = posted.groupBy("bucket").applyInArrow(scan, "key long, node long, n long, rest long")
    return out.groupBy("key", "node").agg(F.max("n").alias("n"), F.max("rest").alias("rest"))


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) whose bitmaps leave it open that the sets are similar: all similar ones, and few others."""
    names = pairs.columns
    own = maybe_in(sets, "sig", pairs.select(F.explode(F.array("a", "b")).alias("sig")))
    of = lambda x: own.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select(*names, (F.col("na") + F.col("nb")).alias("n"), "ma", "mb")

    def run(batches):
        for b in batches:
            total = b.column(4).to_numpy()
            apart = np.array([_differ(x.as_py(), y.as_py()) for x, y in zip(b.column(5), b.column(6))], np.int64)
            yield pa.RecordBatch.from_arrays(b.columns[:4], names).filter(pa.array(apart * (100 + percent) <= total * (100 - percent)))

    return both.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) of signatures whose sets are similar, compared exactly."""
    names = pairs.columns
    texts = maybe_in(texts, "sig", pairs.select(F.explode(F.array("a", "b")).alias("sig")))
    left = pairs.join(texts.select(F.col("sig").alias("b"), F.col("t").alias("tb")), "b")
    both = left.join(texts.select(F.col("sig").alias("a"), F.col("t").alias("ta")), "a").select(*names, "ta", "tb")

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            step = 200
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                one = [x for s in slabs(part.column(4)) for x in shingle_sets(s, n)]
                two = [x for s in slabs(part.column(5)) for x in shingle_sets(s, n)]
                for k, (x, y) in enumerate(zip(one, two)):
                    if len(x) > len(y):
                        x, y = y, x
                    if not len(x):
                        continue
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    o = int((y[at] == x).sum())
                    keep[lo + k] = 100 * o >= percent * (len(x) + len(y) - o)
            yield pa.RecordBatch.from_arrays(b.columns[:4], names).filter(pa.array(keep))

    return both.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that repeat an id with another text are told apart by this key.
    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("of"), F.col(text).alias("t"))
    known = cut(profile(own, n), "profile")
    rows = known.where("kind = 0").select("id", "of", "n", F.col("token").alias("sig"), "bitmap")
    often = known.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toArrow()
    tokens = often.column(0).to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    hot = tokens[order], often.column(1).to_numpy()[order]
    # One row for each set size: as many as the longest text has words, at most.
    sizes = {r.n: r.m for r in rows.where("n > 0").groupBy("n").agg(F.count_distinct("sig").alias("m")).collect()}
    light = boundary(sizes, percent)
    total = sum(m * (s - _floor(s, percent) + 1) for s, m in sizes.items())
    buckets = max(4 * parts, total // 500_000)
    members = cut(lists(own, n, percent, light, hot, buckets), "lists")
    involved = cut(members.select(F.col("node").alias("sig")).distinct(), "involved")
    first = maybe_in(rows.where("n > 0").select("sig", "of", "n", "bitmap"), "sig", involved).join(involved, "sig")
    first = first.groupBy("sig").agg(F.min(F.struct("of", "n", "bitmap")).alias("x")).select("sig", "x.*")
    sets = cut(first, "sets")
    drop_cut(involved)
    whole = maybe_in(own.select("of", "t"), "of", sets.select("of"))
    texts = cut(sets.select("sig", "of").join(whole, "of").groupBy("sig").agg(F.min("t").alias("t")), "texts")

    def fits(a: str, b: str) -> Column:
        least, most = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
        return (F.least(f"{a}rest", f"{b}rest") * (100 + percent) >= (least + most) * percent) & (least * 100 >= most * percent)

    def test(pairs: DataFrame) -> DataFrame:
        return verify(cut(likely(pairs, sets, percent), "likely"), texts, n, percent)

    label = link(members, ["n", "rest"], fits, test)
    for x in (members, sets, texts):
        drop_cut(x)
    ids = rows.where("n > 0").select("id", "sig").join(label, F.col("sig") == F.col("node"))
    least = ids.groupBy("component").agg(F.min("id").alias("least"))
    lone = rows.where("n > 0").groupBy(F.col("sig").alias("s")).agg(F.min("id").alias("own"))
    named = lone.join(label, F.col("s") == F.col("node"), "left").join(least, "component", "left")
    final = cut(named.select("s", F.coalesce("least", "own").alias("component_id")), "final")
    out = rows.where("n > 0").select("id", "n", "sig").join(final, F.col("sig") == F.col("s")).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.union(empty)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
