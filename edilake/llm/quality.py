"""Quality from weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer.

Each labeller votes good (1), bad (0) or abstains (-1) on a text. Over the
counts of all vote patterns (at most 3**labellers, whatever the corpus) EM
estimates the share of good texts and each labeller's accuracy on either
class; a pattern's posterior is its texts' soft label. Soft labels of a bounded
sample train a linear scorer on hashed word shapes and bucketed measures,
which scores every whole text.

Defined cases: null and empty texts make all labellers abstain and get the
score of the bare bias and their buckets; repeated rows score alike; with no
rows there are no patterns and no result rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Slab, lower, mix, slabs, table, words
from .lang_id import _factor

BITS = 16
#: So many texts at most, by a hash of the id, train the scorer; EM sees all.
TRAIN_ROWS = 8_000
LABELLERS = ("word_length", "length", "symbols", "symbol_words", "capitals", "shouting", "repeats", "variety")
#: Labellers that only know bad texts: the measure each looks at, and from where on it votes; else it abstains.
BAD_FROM = {"symbols": (1, 0.04), "symbol_words": (7, 0.15), "capitals": (2, 0.35), "shouting": (5, 0.12), "repeats": (4, 0.08)}

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|{}<>@^~\\_+=[]"]] = True
_BANG = np.zeros(256, bool)
_BANG[ord("!")] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offs[1:]] - total[offs[:-1]]


def measures(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight numbers per text, and each word's row and shape hash."""
    low = lower(slab.data)
    w = words(slab, SPACE, low)
    n = slab.hi - slab.lo
    count = np.diff(w.rows)
    some = np.maximum(count, 1)
    row = np.repeat(np.arange(n), count)
    h = w.hashes()
    out = np.zeros((n, 8))
    out[:, 0] = np.bincount(row, w.end - w.start, n) / some
    bytes_ = np.maximum(np.diff(slab.offs), 1)
    out[:, 1] = _per_row(_SYMBOL[slab.data], slab.offs) / bytes_
    out[:, 2] = _per_row(_UPPER[slab.data], slab.offs) / np.maximum(_per_row(_LETTER[slab.data], slab.offs), 1)
    codes, first = _factor(h)
    if len(codes):
        pair = np.sort(row * np.int64(len(first)) + codes)
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        out[:, 3] = np.bincount(pair[fresh] // len(first), minlength=n) / some
        same = np.concatenate(([False], (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])))
        out[:, 4] = np.bincount(row[same], minlength=n) / some
    else:
        out[:, 3] = 1.0
    out[:, 5] = _per_row(_BANG[slab.data], slab.offs) / some
    out[:, 6] = count
    odd = np.concatenate(([0], np.cumsum(_SYMBOL[slab.data])))
    out[:, 7] = np.bincount(row[odd[w.end] > odd[w.start]], minlength=n) / some
    cls = _SHAPE[slab.data]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[w.start] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    from .common import hash_ranges

    shape = hash_ranges(cls[keep], at[w.start], at[w.end]) if len(w.start) else h
    return out, row, shape


def votes(m: np.ndarray) -> np.ndarray:
    """The labellers' votes on each text, in the order of LABELLERS."""
    v = np.full((len(m), len(LABELLERS)), -1, np.int8)
    n = m[:, 6]
    v[:, 0] = np.where(n < 3, -1, np.where((m[:, 0] < 2.5) | (m[:, 0] > 14), 0, 1))
    v[:, 1] = np.where(n < 3, -1, np.where(n >= 20, 1, -1))
    for k, (column, bound) in enumerate(BAD_FROM.values(), 2):
        v[:, k] = np.where((n > 0) & (m[:, column] >= bound), 0, -1)
    # Long texts repeat words in any language, so the bound on variety falls with the root of the length.
    v[:, -1] = np.where((n >= 20) & (m[:, 3] < np.minimum(0.4, 2.5 / np.sqrt(np.maximum(n, 1)))), 0, -1)
    return v


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern, accuracies[labeller, class] among its votes, the share of good texts.

    theta[labeller, class] is the distribution over abstaining, bad and good. It
    starts from labellers that seldom call a good text bad, which also fixes
    which class is which; a weak Dirichlet prior of that shape keeps it so.
    """
    k = patterns.shape[1]
    theta = np.empty((k, 2, 3))
    theta[:, 1], theta[:, 0] = (0.60, 0.02, 0.38), (0.45, 0.35, 0.20)
    prior_mass, prior = 20.0 * theta, 0.8
    post = np.zeros(len(patterns))
    if len(patterns):
        said = patterns.astype(np.int64) + 1
        for _ in range(rounds):
            odds = np.full(len(patterns), np.log(prior / (1 - prior)))
            for j in range(k):
                odds += np.log(theta[j, 1, said[:, j]] / theta[j, 0, said[:, j]])
            new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            for j in range(k):
                for c, p in ((1, new), (0, 1 - new)):
                    mass = np.bincount(said[:, j], p * counts, 3) + prior_mass[j, c]
                    theta[j, c] = mass / mass.sum()
            prior = float(np.clip((new * counts).sum() / counts.sum(), 0.01, 0.99))
            done, post = np.abs(new - post).max() < 1e-9, new
            if done:
                break
    right = np.column_stack([theta[:, 0, 1] / theta[:, 0, 1:].sum(1), theta[:, 1, 2] / theta[:, 1, 1:].sum(1)])
    return post, right, prior


def _buckets(m: np.ndarray) -> np.ndarray:
    q = np.column_stack([np.round(m[:, 0]), np.round(np.sqrt(m[:, 1]) * 20), np.round(np.sqrt(m[:, 2]) * 10), np.round(m[:, 3] * 10), np.round(np.sqrt(m[:, 4]) * 10), np.round(np.sqrt(m[:, 5]) * 10), np.round(np.log2(m[:, 6] + 1))])
    h = mix(np.minimum(q, 1000).astype(np.uint64) + np.arange(7, dtype=np.uint64)[None, :] * np.uint64(100_003))
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def fit(texts: list[str], target: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer under log loss against soft labels, by full-batch Adam."""
    size = 1 << BITS
    R, C, V, base = [], [], [], 0
    for s in slabs(pa.array(texts, pa.string())):
        m, row, shape = measures(s)
        n = s.hi - s.lo
        some = np.maximum(m[:, 6], 1)
        R += [row + base, np.repeat(np.arange(n), 7) + base]
        C += [(shape >> np.uint64(64 - BITS)).astype(np.int64), _buckets(m).ravel()]
        V += [4.0 / some[row], np.ones(7 * n)]
        base += n
    w, b = np.zeros(size), 0.0
    if not base:
        return w.astype(np.float32), b
    R, C, V = map(np.concatenate, (R, C, V))
    pair, inv = np.unique(R.astype(np.int64) * size + C, return_inverse=True)
    R, C, V = pair // size, pair % size, np.bincount(inv, V)
    m1, v1, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(R, w[C] * V, base) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / base
        grad, gb = np.bincount(C, gap[R] * V, size) + 1e-5 * w, gap.sum()
        m1, v1 = 0.9 * m1 + 0.1 * grad, 0.99 * v1 + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.99**t)) + 1e-7)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return w.astype(np.float32), float(b)


def score_measures(m, row, shape, w, b) -> np.ndarray:
    some = np.maximum(m[:, 6], 1)
    z = np.bincount(row, w[(shape >> np.uint64(64 - BITS)).astype(np.int64)] * (4.0 / some[row]), len(m)) + w[_buckets(m)].sum(1) + b
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def _unpattern(p: np.ndarray) -> np.ndarray:
    return (p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def vote_counts(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All vote patterns with the number of texts of each."""

    def run(batches):
        for b in batches:
            for s in slabs(b.column(0)):
                p, n = np.unique(_pattern(votes(measures(s)[0])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["p", "n"])

    got = docs.select(F.col(text).alias("t")).mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    got.sort()
    return _unpattern(np.array([r[0] for r in got], np.int64)), np.array([r[1] for r in got], np.int64)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> dict:
    patterns, counts = vote_counts(docs, text)
    post, acc, prior = em(patterns, counts)
    soft = dict(zip(_pattern(patterns).tolist(), post.tolist())) if len(patterns) else {}
    ids = docs.select(F.col(doc_id).alias("i")).where("i is not null").orderBy(F.xxhash64("i"), "i").limit(rows)
    picked = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(ids), "i", "left_semi")

    def run(batches):
        got = [(i, t or "") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        got.sort()
        texts = [t for _, t in got]
        target = [soft[p] for s in slabs(pa.array(texts, pa.string())) for p in _pattern(votes(measures(s)[0])).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(target)))], pa.binary())], ["model"])

    blobs = picked.repartition(1).mapInArrow(run, "model binary").collect()
    w, b = pickle.loads(blobs[0][0]) if blobs else fit([], np.zeros(0))
    return {"w": w, "b": b, "soft": soft, "accuracy": acc, "prior": prior}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), weak_label (the posterior of its votes) and votes of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        own = shared.value
        sign = np.array(["-", "0", "1"])
        for b in batches:
            for s in slabs(b.column(1)):
                m, row, shape = measures(s)
                v = votes(m)
                p = score_measures(m, row, shape, own["w"], own["b"])
                weak = [own["soft"].get(x, own["prior"]) for x in _pattern(v).tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.hi - s.lo), pa.array(p), pa.array(weak, pa.float64()), pa.array(["".join(x) for x in sign[v + 1]], pa.string())], ["id", "score", "weak_label", "votes"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, score double, weak_label double, votes string").withColumnRenamed("id", doc_id)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs))
    return found.select("doc_id", "score", "weak_label", "votes", (F.col("score") >= 0.5).cast("int").alias("predicted"))
