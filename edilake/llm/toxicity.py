"""Toxicity: a linear classifier regularised by counterfactual identity swaps.

A text's features are its lower-cased words and the words' first 4 to 8 bytes,
hashed into ``2**BITS`` weights; the logit is the sum of the weights of all
words over (number of words)**LENGTH_POWER, plus a bias. Besides the weighted log loss and
L2 the objective has, for each labelled sentence that holds an identity term,
``LAMBDA * (logit(text) - logit(text with the term swapped))**2`` over swaps to
other terms of its group, and a pull of neutral mentions towards no effect: a
swap to no term at all counts as a swap too. So a mere mention of a group
can't carry the score.

Defined cases: null, empty and wordless texts get the score of the bias alone,
capped below the decision threshold; repeated rows score alike, an id with two labels has the lesser; no labelled
rows, or a single class, give score 0 everywhere; other columns don't matter.
"""

from __future__ import annotations

import logging
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_LETTER, Slab, lower, mix, slabs, table, words
from .lang_id import _factor, held_out

log = logging.getLogger(__name__)
BITS = 18
LENGTH_POWER = 0.5
LAMBDA = 4.0
#: Learning reads so many labelled rows at most: of the toxic ones up to a third, by a hash of the id.
TRAIN_ROWS = 12_000
THRESHOLD = 0.7
#: Features whose presence says less about the label than this G statistic get no weight.
EVIDENCE = 24.0
#: Features are shares of words; this brings them to the size of the bias.
SCALE = 8.0
RIDGE = 2e-4
#: Identity terms by group; any list can be given instead.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "blind", "deaf", "autistic"),
)
PREFIXES = (4, 5, 6, 7, 8)


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Feature numbers of each word: the word, then its prefixes (-1: none as long)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))[start]
    size = end - start
    shift = np.uint64(64 - BITS)
    out = np.full((len(start), 1 + len(PREFIXES)), -1, np.int64)
    out[:, 0] = h >> shift
    for k, n in enumerate(PREFIXES, 1):
        ok = size > n
        mask = np.uint64((1 << 8 * n) - 1)
        out[ok, k] = mix((eight[ok] & mask) + np.uint64(n)) >> shift
    return out


def _one(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    s, e = np.array([0]), np.array([len(data)])
    from .common import hash_ranges

    f = word_features(data, s, e, hash_ranges(data, s, e))[0]
    return f[f >= 0]


def _rows(slab: Slab):
    w = words(slab, NON_LETTER, lower(slab.data))
    h = w.hashes()
    codes, first = _factor(h)
    return w, codes, first, word_features(w.data, w.start[first], w.end[first], h[first]) if len(first) else np.zeros((0, 1 + len(PREFIXES)), np.int64)


def evidence(rows: np.ndarray, feats: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The G statistic of each feature's presence against the label: what chance alone hardly gives."""
    pair = np.unique(rows.astype(np.int64) * size + feats)
    r, f = np.divmod(pair, size)
    a = np.bincount(f, y[r], size)
    n = np.bincount(f, minlength=size).astype(float)
    g = np.zeros(size)
    for have, rate in ((a, y.mean()), (n - a, 1 - y.mean())):
        some = have > 0
        g[some] += 2 * have[some] * np.log(have[some] / (n[some] * rate))
    return g


def fit(texts: list[str], labels: np.ndarray, groups=IDENTITY, weight_swaps: float = LAMBDA, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam."""
    size = 1 << BITS
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(size, np.float32), -20.0
    owner: dict[bytes, tuple[int, int]] = {t.encode(): (g, k) for g, group in enumerate(groups) for k, t in enumerate(group)}
    R, C, V, mentions, base = [], [], [], [], 0
    for s in slabs(pa.array(texts, pa.string())):
        w, codes, first, feats = _rows(s)
        n = s.hi - s.lo
        row = np.repeat(np.arange(n), np.diff(w.rows))
        scale = SCALE / np.maximum(np.diff(w.rows), 1) ** LENGTH_POWER
        pair, count = np.unique(row * np.int64(max(len(first), 1)) + codes, return_counts=True)
        r, c = np.divmod(pair, max(len(first), 1))
        f = feats[c]
        keep = f >= 0
        R.append((np.broadcast_to(r[:, None], f.shape)[keep] + base))
        C.append(f[keep])
        V.append(np.broadcast_to((count * scale[r])[:, None], f.shape)[keep])
        term = {k: owner[x] for k, i in enumerate(first) if (x := w.word(i)) in owner}
        for rr, cc, nn in zip(r, c, count):
            if cc in term:
                mentions.append((base + rr, *term[cc], nn * scale[rr]))
        base += n
    R, C, V = np.concatenate(R), np.concatenate(C), np.concatenate(V)
    # Identity features stay whatever their evidence: the swaps act on their weights.
    own_terms = np.unique(np.concatenate([_one(t) for group in groups for t in group])) if owner else np.zeros(0, np.int64)
    keep = (evidence(R, C, y, size)[C] >= EVIDENCE) | np.isin(C, own_terms)
    log.info("%d mentions of identity terms in %d texts", len(mentions), len(y))
    R, C, V = R[keep], C[keep], V[keep]
    used, C = np.unique(C, return_inverse=True)
    place = {int(u): i for i, u in enumerate(used)}
    # A swap's effect on the logit: the difference of two terms' weights, times the mention's share.
    swaps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for g, group in enumerate(groups):
        for k, t in enumerate(group):
            share = sum(v * v for _, a, b, v in mentions if (a, b) == (g, k))
            if not share:
                continue
            own = np.array([place[x] for x in _one(t).tolist() if x in place], np.int64)
            others = [np.array([place[x] for x in _one(o).tolist() if x in place], np.int64) for o in group if o != t]
            swaps += [(own, o, share) for o in [*others, np.zeros(0, np.int64)]]
    pos = y.mean()
    importance = np.where(y == 1, 0.5 / pos, 0.5 / (1 - pos)) / len(y)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(R, w[C] * V, len(y)) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * importance
        grad = np.bincount(C, gap[R] * V, len(w)) + RIDGE * w
        for own, other, share in swaps:
            d = (w[own].sum() - w[other].sum()) * 2 * weight_swaps * share / len(y)
            grad[own] += d
            grad[other] -= d
        gb = gap.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.15 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    full = np.zeros(size, np.float32)
    full[used] = w
    return full, float(b)


def score_slab(slab: Slab, w: np.ndarray, b: float) -> np.ndarray:
    n = slab.hi - slab.lo
    own, codes, first, feats = _rows(slab)
    per = np.where(feats >= 0, w[np.maximum(feats, 0)], 0).sum(1) if len(first) else np.zeros(0)
    counts = np.diff(own.rows)
    z = np.bincount(np.repeat(np.arange(n), counts), per[codes], n) * SCALE / np.maximum(counts, 1) ** LENGTH_POWER + b
    z = np.where(counts == 0, np.minimum(z, -1.0), z)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, groups=IDENTITY, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Fits on a bounded sample; its ids are few, so the texts come by a broadcast join of checked size."""
    own = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.min("y").alias("y"))
    order = [F.xxhash64("i"), F.col("i")]
    picked = own.where("y = 1").orderBy(*order).limit(rows // 3).union(own.where("y = 0").orderBy(*order).limit(rows - rows // 3))
    ids = picked.collect()  # rows at most
    spark = docs.sparkSession
    small = spark.createDataFrame([(r[0], int(r[1])) for r in ids], f"i {labels.schema[doc_id].dataType.simpleString()}, y int")
    got = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(small), "i").select("i", "t", "y")

    def run(batches):
        ids, texts, y = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += [x or "" for x in b.column(1).to_pylist()]
            y += b.column(2).to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        out = fit([texts[i] for i in order], np.array([y[i] for i in order]), groups)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["model"])

    blobs = got.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(blobs[0][0]) if blobs else fit([], np.zeros(0))


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        w, b = shared.value
        for batch in batches:
            for s in slabs(batch.column(1)):
                p = score_slab(s, w, b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], ["id", "score", "predicted"])

    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", doc_id)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
