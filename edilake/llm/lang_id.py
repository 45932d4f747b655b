"""Language identification by words first, then by shorter and shorter character n-grams.

Model: for each language the log-frequency of known words, and of character
n-grams of 5 down to 1 characters (words are framed by ``_``). A text's score
for a language is the sum over its words: a known word gives its own
log-frequency; an unseen word gives, at each of its characters, the
log-frequency of the longest known n-gram that starts there, each step down
costing ``BACKOFF``. Words are runs of bytes that are not ASCII non-letters,
with A-Z lower-cased.

Defined cases: null, empty or letterless texts give ``und`` with score 0;
ties go to the alphabetically first language; repeated rows are scored alike;
an empty training table gives a model without languages (all ``und``);
columns other than the id and text of the scored table never matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NON_LETTER, Slab, lower, mix, slabs, table, words

ORDERS = (5, 4, 3, 2, 1)
BACKOFF = -1.2
#: Learning needs few labelled texts; so many at most, by a hash of the text, are read for it.
TRAIN_ROWS = 12_000
KNOWN_WORDS = 60_000
KNOWN_NGRAMS = 40_000


def _ngrams(run: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n code points from each place on; 0 where a word's frame is crossed."""
    size = len(run) - n + 1
    if size <= 0:
        return np.zeros(len(run), np.uint64)
    h = np.full(size, n, np.uint64)
    ok = np.ones(size, bool)
    for k in range(n):
        part = run[k : k + size]
        h = mix(h ^ (part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)))
        ok &= part != 32
    out = np.zeros(len(run), np.uint64)
    out[:size] = np.where(ok, h | np.uint64(1), 0)
    return out


def _codes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words as `` _word_ _word_ ``, and the word each belongs to."""
    text = " ".join(f"_{p.decode('utf-8', 'replace')}_" for p in parts)
    run = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return run, np.cumsum(run == 32)


class Model:
    """Sorted hash tables with one log-frequency per language and entry."""

    def __init__(self, langs, tables):
        self.langs, self.tables = list(langs), tables

    @staticmethod
    def fit(texts: list[str], langs: list[str]) -> "Model":
        names = sorted(set(langs))
        index = {x: i for i, x in enumerate(names)}
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if not names:
            return Model([], {n: (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)) for n in (0, *ORDERS)})
        parts: dict[int, list] = {n: [] for n in (0, *ORDERS)}
        order = np.argsort([index[x] for x in langs], kind="stable")
        for lang in range(len(names)):
            own = [texts[i] for i in order if index[langs[i]] == lang]
            seen: dict[bytes, int] = {}
            for s in slabs(pa.array(own, pa.string())):
                w = words(s, NON_LETTER, lower(s.data))
                codes, first = _factor(w.hashes())
                for k, n in zip(first, np.bincount(codes, minlength=len(first))):
                    word = w.word(k)
                    seen[word] = seen.get(word, 0) + int(n)
            keys = list(seen)
            counts = np.array([seen[k] for k in keys], np.int64)
            blob = np.frombuffer(b"".join(keys), np.uint8)
            ends = np.cumsum([len(k) for k in keys], dtype=np.int64) if keys else np.zeros(0, np.int64)
            from .common import hash_ranges

            parts[0].append((hash_ranges(blob, np.concatenate(([0], ends[:-1])).astype(np.int64), ends) if keys else np.zeros(0, np.uint64), counts))
            run, owner = _codes(keys)
            for n in ORDERS:
                h = _ngrams(run, n) if keys else np.zeros(0, np.uint64)
                keep = h != 0
                u, inv = np.unique(h[keep], return_inverse=True)
                parts[n].append((u, np.bincount(inv, weights=counts[owner[keep]], minlength=len(u)).astype(np.int64)))
        for n, own in parts.items():
            every = np.unique(np.concatenate([h for h, _ in own]))
            counts = np.zeros((len(every), len(names)))
            for lang, (h, c) in enumerate(own):
                np.add.at(counts[:, lang], np.searchsorted(every, h), c)
            limit = KNOWN_NGRAMS if n else KNOWN_WORDS
            total = counts.sum(0) + 1.0
            keep = np.flatnonzero(counts.sum(1) >= 2)
            keep = np.sort(keep[np.argsort(-counts[keep].sum(1), kind="stable")[:limit]])
            smooth = 0.05 if n == 0 else 0.5
            tables[n] = every[keep], np.log((counts[keep] + smooth) / (total + smooth * len(keep))).astype(np.float32)
        return Model(names, tables)

    def unseen(self, parts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(parts), len(self.langs)), np.float32)
        if not parts:
            return out
        run, owner = _codes(parts)
        todo = run != 32
        for down, n in enumerate(ORDERS):
            known, logs = self.tables[n]
            if not len(known):
                continue
            h = _ngrams(run, n)
            at = np.flatnonzero(todo & (h != 0))
            where = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            hit = known[where] == h[at]
            at, where = at[hit], where[hit]
            gain = logs[where] / n + BACKOFF * down
            for lang in range(len(self.langs)):
                out[:, lang] += np.bincount(owner[at], gain[:, lang], len(parts))
            todo[at] = False
        return out

    def score(self, slab: Slab) -> tuple[list[str], np.ndarray]:
        n = slab.hi - slab.lo
        w = words(slab, NON_LETTER, lower(slab.data))
        codes, first = _factor(w.hashes())
        total = np.zeros((n, len(self.langs)))
        if len(first) and self.langs:
            h = w.hashes()[first]
            known, logs = self.tables[0]
            per = np.zeros((len(first), len(self.langs)), np.float32)
            new = np.ones(len(first), bool)
            if len(known):
                where = np.minimum(np.searchsorted(known, h), len(known) - 1)
                new = known[where] != h
                per[~new] = logs[where[~new]]
            per[new] = self.unseen([w.word(k) for k in first[new]])
            row = np.repeat(np.arange(n), np.diff(w.rows))
            for lang in range(len(self.langs)):
                total[:, lang] = np.bincount(row, per[codes, lang], n)
        letters = np.zeros(n, bool)
        ascii_letters = np.concatenate(([0], np.cumsum(~NON_LETTER[slab.data] & (slab.data < 128))))
        letters = ascii_letters[slab.offs[1:]] > ascii_letters[slab.offs[:-1]]
        for i in np.flatnonzero(~letters & (np.diff(slab.offs) > 0)):
            letters[i] = any(c.isalpha() for c in slab.text(i))
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        best = total.argmax(1)
        odds = np.exp(total - total.max(1, keepdims=True))
        sure = np.where(letters, 1.0 / odds.sum(1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], sure


def _factor(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's number, and where each number first occurs."""
    codes, unique = pd.factorize(h)
    first = np.full(len(unique), -1, np.int64)
    first[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return codes, first


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fits a model on at most ``rows`` different texts, by a hash of the text, of each language as many as of the others while it has more."""
    sample = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null").withColumn("h", F.xxhash64("t"))
    # Hashes first, so that no text is moved that isn't learnt from.
    place = F.row_number().over(W.partitionBy("l").orderBy("h"))
    picked = sample.select("l", "h").distinct().withColumn("r", place).where(F.col("r") <= rows).orderBy("r", "l").limit(rows).select("l", "h")
    small = labelled.sparkSession.createDataFrame(picked.collect(), "l string, h long")  # rows at most
    got = sample.withColumn("l", F.col("l").cast("string")).join(F.broadcast(small), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t")).select("t", "l")

    def fit(batches):
        import pickle

        data = sorted((l, t) for b in batches for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        m = Model.fit([t for _, t in data], [l for l, _ in data])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((m.langs, m.tables))], pa.binary())], ["model"])

    import pickle

    blobs = got.coalesce(1).mapInArrow(fit, "model binary").collect()
    return Model(*(pickle.loads(blobs[0][0]) if blobs else ([], Model.fit([], []).tables)))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))
    kind = docs.schema[doc_id].dataType

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            for s in slabs(b.column(1)):
                langs, sure = own.score(s)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.hi - s.lo), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["id", "lang_pred", "score"])

    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", doc_id)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is not ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))
    place = docs.columns.index(text)

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            keep = [x != "und" for s in slabs(b.column(place)) for x in own.score(s)[0]]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
