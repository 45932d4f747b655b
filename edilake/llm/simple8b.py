"""Token ids in a word-aligned binary format: Simple-8b blocks with escapes and block offsets.

A container holds the ids of consecutive documents:

    b"S8BF", version, documents, ids, blocks, words    six little-endian u32
    document ids                                        i64 each
    documents' lengths                                  u32 each
    first word of each block, and the end               u32 each
    words                                               u64 each

A block is BLOCK ids (the last one fewer). Each word has its selector in the
top four bits: how many ids of how many bits follow from the low end. Selector
15 is an escape: the next whole word is one id too wide for 60 bits. A block
decodes by itself; all words of a container decode together, selector by
selector. Files are written by Spark, one container a row, so they can be in
any shared store; rows are in ascending document order within and across files.

Defined cases: null and empty texts hold the end id only; repeated ids stay
apart, in any order among themselves; rows without an id are left out; an empty table gives no containers; columns
besides the id and the text don't matter.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slabs, table
from .tokens import END_ID, encoder

BLOCK = 128
CONTAINER_IDS = 1 << 18
#: Fixed values: (ids in a word, bits of each) by selector, as published for Simple-8b without its runs of zeros.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15


#: What stands in a file for a null id; such documents come first.
NO_ID = -(2**63)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and each block's first word (with the end): all blocks advance together, word by word."""
    v = np.asarray(ids, np.uint64)
    n = len(v)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    stop = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    at = np.arange(blocks) * BLOCK
    # Per selector: the first place from each id on whose value is too wide.
    wide = []
    for _, bits in SELECTORS:
        over = np.where(v >> np.uint64(bits) != 0, np.arange(n), n)
        wide.append(np.minimum.accumulate(over[::-1])[::-1])
    # The selector each place would get is the first whose ids all fit; independent of the block's course.
    place = np.arange(n)
    ends = stop[place // BLOCK]
    choice = np.full(n, ESCAPE, np.int64)
    for s in range(len(SELECTORS) - 1, -1, -1):
        choice[wide[s] >= np.minimum(place + SELECTORS[s][0], ends)] = s
    took = np.array([c for c, _ in SELECTORS] + [1, 1])[choice]
    rounds = []
    live = np.arange(blocks)
    while len(live):
        here = at[live]
        rounds.append(here)
        at[live] = here + took[here]
        live = live[at[live] < stop[live]]
    starts = np.sort(np.concatenate(rounds))
    kind = choice[starts]
    cost = np.where(kind == ESCAPE, 2, 1)
    where = np.cumsum(cost) - cost
    words = np.zeros(int(cost.sum()), np.uint64)
    padded = np.concatenate((v, np.zeros(60, np.uint64)))
    for s, (count, bits) in enumerate(SELECTORS):
        own = starts[kind == s]
        if not len(own):
            continue
        left = stop[own // BLOCK] - own
        word = np.full(len(own), s << 60, np.uint64)
        for k in range(count):
            word |= np.where(k < left, padded[own + k], 0).astype(np.uint64) << np.uint64(k * bits)
        words[where[kind == s]] = word
    esc = kind == ESCAPE
    words[where[esc]] = np.uint64(ESCAPE << 60)
    words[where[esc] + 1] = v[starts[esc]]
    first = where[np.searchsorted(starts, np.arange(blocks) * BLOCK)]
    return words, np.concatenate((first, [len(words)])).astype(np.uint32)


def unpack(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ids, all words at once; raw words behind escapes are found from the blocks' starts."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel >= ESCAPE - 1).any():
        raw = np.zeros(len(words), bool)
        for k in np.flatnonzero(sel == ESCAPE):  # in order, as a raw word may look like an escape
            if not raw[k]:
                raw[k + 1] = True
        sel = np.where(raw, -1, sel)
    counts = np.array([c for c, _ in SELECTORS] + [0, 1, 0])[sel]
    block = np.searchsorted(first, np.arange(len(words)), "right") - 1
    before = np.concatenate(([0], np.cumsum(counts)))
    # A block's last word may hold fewer ids than its selector says.
    place = before[:-1] - before[first[block]] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            ok = place[own] + k < stop[own]
            out[place[own[ok]] + k] = words[own[ok]] >> np.uint64(k * bits) & mask
    esc = np.flatnonzero(sel == ESCAPE)
    out[place[esc]] = words[esc + 1]
    return out


def unpack_block(words: np.ndarray, first: np.ndarray, n: int, block: int) -> np.ndarray:
    """One block alone, by its offset."""
    part = words[first[block] : first[block + 1]]
    return unpack(part, np.array([0, len(part)], np.uint32), min(BLOCK, n - block * BLOCK))


def write_container(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = pack(ids)
    head = struct.pack("<4s5I", b"S8BF", 1, len(doc_ids), len(ids), len(first) - 1, len(words))
    return head + np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes() + first.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def read_container(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids."""
    magic, version, docs, n, blocks, count = struct.unpack_from("<4s5I", data)
    if magic != b"S8BF" or version != 1:
        raise ValueError("not a container")
    at = 24
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    first = np.frombuffer(data, "<u4", blocks + 1, at + 12 * docs)
    words = np.frombuffer(data, "<u8", count, at + 12 * docs + 4 * (blocks + 1))
    return doc_ids, lengths, unpack(words, first, n)


def containers(docs: DataFrame, path: str | None = None, parts: int | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(shard, block, ids, data) rows: shards are ranges of doc_id, containers ascend within them."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("t")).repartitionByRange(parts, "id").sortWithinPartitions("id")

    def run(batches):
        enc = encoder(path)
        shard = TaskContext.get().partitionId()
        number, who, sizes, parts_, held, base = 0, [], [], [], 0, 0

        def flush():
            data = write_container(np.concatenate(who), np.concatenate(sizes), np.concatenate(parts_))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, number, base, held)] + [pa.array([data], pa.binary())], ["shard", "number", "base", "n_ids", "data"])

        for b in batches:
            for s in slabs(b.column(1)):
                ids, offs = enc.encode(s, end_id)
                key = b.column(0).slice(s.lo, s.hi - s.lo).to_numpy()
                # Cut at documents, near CONTAINER_IDS.
                lo = 0
                while lo < len(key):
                    hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CONTAINER_IDS - held, "right")) - 1)
                    who.append(key[lo:hi])
                    sizes.append(np.diff(offs[lo : hi + 1]))
                    parts_.append(ids[offs[lo] : offs[hi]])
                    held += int(offs[hi] - offs[lo])
                    lo = hi
                    if held >= CONTAINER_IDS or lo < len(key):
                        yield flush()
                        number, who, sizes, parts_, held, base = number + 1, [], [], [], 0, base + held
        if who:
            yield flush()

    return ordered.mapInArrow(run, "shard long, number long, base long, n_ids long, data binary")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the container files."""
    # A container knows the ids before it in its shard; a row for each shard, of which there are as many as partitions, has the rest.
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    upto = np.concatenate(([0], np.cumsum([r.n for r in totals]))) if totals else np.zeros(1)
    shared = files.sparkSession.sparkContext.broadcast({r.shard: int(upto[k]) for k, r in enumerate(totals)})

    def run(batches):
        base = shared.value
        for b in batches:
            for k in range(b.num_rows):
                who, sizes, ids = read_container(b.column(2)[k].as_py())
                upto = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist())]
                start = upto[:-1] + base[b.column(0)[k].as_py()] + b.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(who, mask=who == NO_ID), pa.array(start), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "base", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(cut(containers(table(spark, sf_dir, "documents")), "ids"))
