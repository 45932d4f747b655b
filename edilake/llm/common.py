"""What the corpus operators share: reading tables, shared-folder tables and slabs of text.

A *slab* is a run of rows of an Arrow batch with a few MB of text, seen as one
byte array plus row offsets. All vectorised text work goes slab by slab, so a
task's memory depends on the slab limit and on its longest single text, never
on the number of rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLAB_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be in any store Spark reads."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, as rows may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, spark.checkpoint.dir; an own one only where all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/corpus-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Deletes a table made by cut() that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Slab:
    """Rows lo..hi of a batch: their text as bytes, and the offsets of each row in them."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes().decode("utf-8", "replace")


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """Cuts a string column (null: empty) into slabs of at most limit bytes, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, what = column.buffers()
    offs = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Slab(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


#: The bytes that end a word in the join and budget contracts: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For models of words: every ASCII byte but letters ends a word.
NON_LETTER = np.zeros(256, bool)
NON_LETTER[:128] = True
NON_LETTER[65:91] = NON_LETTER[97:123] = False

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


@dataclass
class Words:
    """The words of a slab: byte ranges, hashes, and for each row its range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray  # words of row i: rows[i]..rows[i + 1]

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.start, self.end)

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def words(slab: Slab, ends: np.ndarray = SPACE, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that end no word; no word goes over a row's end."""
    data = slab.data if data is None else data
    if not len(data):
        zero = np.zeros(0, np.int64)
        return Words(data, zero, zero, np.zeros(len(slab.offs), np.int64))
    inside = ~ends[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cutpoints = slab.offs[1:-1]
    before[cutpoints[cutpoints < len(data)]] = False
    after[cutpoints[cutpoints > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, slab.offs))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time over all ranges at once."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = end - start
    h = left.astype(np.uint64) * _M1
    at, todo = start.copy(), np.flatnonzero(left > 0)
    while len(todo):
        v = (h[todo] ^ (eight[at[todo]] & _MASK[np.minimum(left[todo], 8)])) * _M1
        h[todo] = (v ^ (v >> np.uint64(29))) * _M2
        left[todo] -= 8
        at[todo] += 8
        todo = todo[left[todo] > 0]
    return mix(h)


def fold(doc_id) -> "np.ndarray":
    """crc32 of the id as text, mod 3; 1 is held out."""
    import zlib

    return np.array([zlib.crc32(str(i).encode()) % 3 for i in doc_id], np.int64)


def free(name: str, columns: list[str]) -> str:
    """name, with underscores until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def marked_in(rows: DataFrame, key: str, ids: DataFrame, mark: str) -> DataFrame:
    """rows with the new column mark: whether the key may be among the ids (one column).

    The ids set bits of a bitmap of 2**23 by hash: 131,072 rows of one long each at
    most, however many ids, so it may be broadcast. It errs only by saying maybe.
    """

    def spot(c: str) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 23))
        return F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")

    word, at = spot(ids.columns[0])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at)
    maps = ids.groupBy(word.alias("in_word_")).agg(F.bit_or(one).alias("in_map_"))
    word, at = spot(key)
    found = rows.withColumn("in_place_", word).withColumn("in_at_", at)
    found = found.join(F.broadcast(maps), F.col("in_place_") == F.col("in_word_"), "left")
    bit = F.call_function("shiftright", F.col("in_map_"), F.col("in_at_")).bitwiseAND(F.lit(1).cast("long"))
    return found.select(*rows.columns, (F.col(key).isNotNull() & F.coalesce(bit == 1, F.lit(False))).alias(mark))


def maybe_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key may be among the ids: a filter before a join, to shuffle less."""
    mark = free("maybe_", rows.columns)
    return marked_in(rows, key, ids, mark).where(F.col(mark)).drop(mark)


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is not among the ids; only rows that may be are shuffled for it."""
    mark, other = free("maybe_", rows.columns), free("key_", rows.columns)
    marked = marked_in(rows, key, ids, mark)
    doubtful = marked.where(F.col(mark)).drop(mark)
    gone = ids.select(F.col(ids.columns[0]).alias(other))
    return marked.where(~F.col(mark)).drop(mark).union(doubtful.join(gone, F.col(key) == F.col(other), "left_anti"))
