"""Packing documents into sequences: bin completion branch and bound over lengths.

Pieces of one length are interchangeable, so the search works on the histogram
of piece lengths: at most ``capacity`` numbers, whatever the corpus. A packing
is a list of patterns (lengths with counts, and how many sequences are filled
so). Best-fit decreasing gives the first incumbent. While it has more
sequences than the lower bound, bin completion looks for a better one: it fills
the sequence of the longest piece left with undominated sets of other pieces,
least waste first, and gives up a branch as soon as its waste exceeds what an
improvement may waste. NODES bounds the search; the incumbent is always whole.

The patterns then give each piece its place by its rank among the pieces of its
length. Ranks come from each task's own counts and their sums over earlier
tasks, so no length, however frequent, meets in one task.

Defined cases: null and empty texts are the end id alone; only documents longer
than the capacity are cut; repeated rows are packed once each; an empty table
gives no pieces; columns besides the id and the text don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, slabs, table
from .tokens import END_ID, encoder

CAPACITY = 4096
#: The search looks at so many nodes, and more by so many for each length that occurs, so that several whole completions fit in.
NODES, NODES_EACH = 2_000, 2
#: Fillings tried for one sequence in the search.
FILLINGS = 24

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # sequences, ((length, pieces in each), ...)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing; runs of equal pieces and of equal sequences move together."""
    groups: dict[int, list[list]] = {}  # room left -> [sequences, items]
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(room: int, n: int, items: tuple) -> None:
        if not n:
            return
        if not room:
            done.append((n, items))
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([n, items])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                n, items = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, n, items = capacity, left, ()
            each = room // length
            full = min(n, left // each)
            put(room - each * length, full, (*items, (length, each)))
            left -= full * each
            n -= full
            if left and n:  # fewer than one sequence takes
                put(room - left * length, 1, (*items, (length, left)))
                left, n = 0, n - 1
            if items:
                put(room, n, items)
    for room, own in groups.items():
        done += [(n, items) for n, items in own]
    return done


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Whole sequences the tokens need, and those that pieces over half a sequence need."""
    lengths = sorted(counts)
    pieces = [0, *accumulate(counts[k] for k in lengths)]
    tokens = [0, *accumulate(k * counts[k] for k in lengths)]
    best = -(-tokens[-1] // capacity)
    half = bisect_right(lengths, capacity // 2)
    for at, cutoff in enumerate([0, *lengths[:half]]):
        # Pieces over capacity - cutoff take a sequence alone, as no counted piece fits beside them.
        top = max(half, bisect_right(lengths, capacity - cutoff))
        over = pieces[-1] - pieces[half]
        room = (pieces[top] - pieces[half]) * capacity - (tokens[top] - tokens[half])
        rest = tokens[half] - tokens[max(0, at - 1)]
        best = max(best, over + max(0, -(-(rest - room) // capacity)))
    return best


def fillings(counts: dict[int, int], room: int, most_waste: int, limit: int = FILLINGS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(waste, pieces) of undominated sets that fit the room, least waste first."""
    lengths = sorted((k for k, n in counts.items() if n and k <= room), reverse=True)
    if not lengths:
        return [(room, ())] if room <= most_waste else []
    found: list[tuple[int, tuple]] = []
    steps = 0

    def dominated(items: tuple, waste: int) -> bool:
        used = dict(items)
        for k in ascending:
            if k > waste:
                break
            if counts[k] > used.get(k, 0):
                return True  # another piece still fits
        for have, _ in items:
            k = bisect_left(ascending, have + waste + 1) - 1
            while k >= 0 and ascending[k] > have:
                if counts[ascending[k]] > used.get(ascending[k], 0):
                    return True  # a longer piece fits in one's place
                k -= 1
        return False

    ascending = lengths[::-1]
    smallest = ascending[0]

    def go(i: int, left: int, items: tuple) -> None:
        nonlocal steps
        steps += 1
        if steps > 30 * limit or len(found) >= limit:
            return
        if left < smallest or i >= len(lengths):
            if left <= most_waste and not dominated(items, left):
                found.append((left, items))
            return
        while i < len(lengths) and lengths[i] > left:
            j = len(lengths) - bisect_left(ascending, left + 1)
            i = max(i + 1, j)
        if i >= len(lengths):
            if left <= most_waste and not dominated(items, left):
                found.append((left, items))
            return
        k = lengths[i]
        for n in range(min(counts[k], left // k), -1, -1):
            go(i + 1, left - n * k, (*items, (k, n)) if n else items)

    go(0, room, ())
    # A piece that fills the room exactly dominates all else.
    return sorted(set(found))


def complete(counts: dict[int, int], capacity: int, incumbent: list[Pattern], nodes: int | None = None) -> list[Pattern]:
    """Branch and bound; the incumbent if nothing better is found in time."""
    best, most = incumbent, sum(n for n, _ in incumbent)
    total = sum(k * n for k, n in counts.items())
    bound = lower_bound(counts, capacity)
    nodes = NODES + NODES_EACH * len(counts) if nodes is None else nodes
    left = dict(counts)
    stack: list = []
    seen = 0

    def choices(waste: int) -> list:
        top = max(k for k, n in left.items() if n)
        left[top] -= 1
        got = fillings(left, capacity - top, (most - 1) * capacity - total - waste)
        left[top] += 1
        # A filling as often as it goes is tried first, once after that: the search may mix them in any way.
        out = []
        for w, items in reversed(got):
            times = fits(top, items)[1]
            out += [(w, top, items, 1)] if times > 1 else []
            out.append((w, top, items, times))
        return out

    def fits(top: int, items: tuple) -> tuple[dict[int, int], int]:
        need = dict(items)
        need[top] = need.get(top, 0) + 1
        return need, min(left[k] // n for k, n in need.items())

    def apply(top: int, items: tuple, times: int) -> tuple[int, tuple]:
        need = fits(top, items)[0]
        for k, n in need.items():
            left[k] -= n * times
        return times, tuple(sorted(need.items(), reverse=True))

    if most <= bound:
        return best
    stack.append((choices(0), None, 0))
    path: list[Pattern] = []
    while stack and seen < nodes and most > bound:
        options, _, waste = stack[-1]
        if not options:
            _, undo, _ = stack.pop()
            if undo:
                times, items = path.pop()
                for k, n in items:
                    left[k] += n * times
            continue
        seen += 1
        w, top, items, times = options.pop()
        times, need = apply(top, items, times)
        path.append((times, need))
        spent = waste + w * times
        if not any(left.values()):
            n = sum(t for t, _ in path)
            if n < most:
                best, most = list(path), n
            stack.append(([], True, spent))
        elif spent > (most - 1) * capacity - total:
            stack.append(([], True, spent))
        else:
            stack.append((choices(spent), True, spent))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> list[Pattern]:
    """Patterns that hold each length exactly counts times."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    return complete(counts, capacity, best_fit(counts, capacity), nodes)


def places(patterns: list[Pattern], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ranks: rows (length, first rank, first sequence, pieces in each sequence, offset), and where each length's rows begin."""
    next_rank = np.zeros(capacity + 2, np.int64)
    rows, sequence = [], 0
    for n, items in patterns:
        offset = 0
        for length, each in items:
            rows.append((length, next_rank[length], sequence, each, offset))
            next_rank[length] += n * each
            offset += length * each
        sequence += n
    out = np.array(rows, np.int64).reshape(-1, 5)
    out = out[np.lexsort((out[:, 1], out[:, 0]))]
    return out, np.searchsorted(out[:, 0], np.arange(capacity + 2))


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Each document's pieces, and each piece's rank among the pieces of its length in its task."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]

    def run(batches):
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for s in slabs(b.column(1)):
                ids, offs = enc.encode(s, end_id)
                size = np.diff(offs)
                many = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(size[doc] - piece * capacity, capacity)
                begin = offs[doc] + piece * capacity
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                of = length[order]
                run_start = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1)) if len(of) else np.zeros(0, np.int64)
                rank = np.empty(len(of), np.int64)
                rank[order] = np.arange(len(of)) - np.repeat(run_start, np.diff(np.concatenate((run_start, [len(of)])))) + met[of]
                met += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.hi - s.lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int64)), pa.array(rank)], names
                )

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long").withColumnRenamed("id", doc_id)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    cut_up = cut(pieces(docs, capacity, path, doc_id, text), "pieces")
    counts = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut_up.join(base, ["part", "length"]).select(doc_id, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        rows, first = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            if not len(length):
                continue
            # A length's runs ascend by rank, so one search over (length, rank) finds a piece's run.
            big = int(max(rank.max(), rows[:, 1].max())) + 1
            k = np.searchsorted(rows[:, 0] * big + rows[:, 1], length * big + rank, "right") - 1
            _, rank0, seq, each, offset = rows[k].T
            into = rank - rank0
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq + into // each), pa.array(offset + into % each * length)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.withColumnRenamed(doc_id, "id").mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
