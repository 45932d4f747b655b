"""Media columns: GIF. A codec for GIF89a files held in binary columns.

Writing packs 8-bit samples as colour indices of grey frames with LZW. Reading
decodes any GIF: LZW streams of any code size with deferred clear codes, local
and global palettes, interlaced rows, disposal and transparency rules, timed
frames. ``frames`` gives one row per frame with its time, and a histogram over
64 colours (2 bits of red, green and blue each) of the composed canvas.

Defined cases: a null or empty text is stored as 64 zero bytes; long payloads
are split over frames of at most 65,535 rows; null media give no frames; a
broken file raises ``ValueError`` in strict mode and gives no frames otherwise;
equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH, MAX_ROWS, DELAY_CS = 64, 65_535, 10
_FULL = 4096


@lru_cache(maxsize=32)
def _widths(size: int, count: int) -> np.ndarray:
    """Bits of each code since a clear code: a reader's table gains one entry a code, from the second on."""
    entries = (1 << size) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1, 12)


@lru_cache(maxsize=32)
def _ends(size: int, count: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(_widths(size, count))))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = (codes[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12)[None, :] < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """LZW with a clear code whenever the table is full."""
    clear = 1 << size
    out: list[int] = [clear]
    spans: list[int] = [1]  # codes from each clear code to the next one, which it includes
    start = 1
    known: dict[int, int] = {}
    free = clear + 2
    put, get = out.append, known.get
    if data:
        it = iter(data)
        cur = next(it)
        for b in it:
            key = cur << 8 | b
            got = get(key)
            if got is not None:
                cur = got
                continue
            put(cur)
            known[key] = free
            free += 1
            cur = b
            if free == _FULL:
                put(clear)
                spans.append(len(out) - start)
                start = len(out)
                known.clear()
                free = clear + 2
        put(cur)
    put(clear + 1)
    spans.append(len(out) - start)
    widths = np.concatenate([[size + 1]] + [_widths(size, _FULL)[:n] for n in spans[1:]])
    return _pack(np.array(out, np.int64), widths)


def _segments(raw: bytes, size: int):
    """The stream's codes, as one list for each clear code."""
    clear, end = 1 << size, (1 << size) + 1
    padded = np.frombuffer(raw + bytes(4), np.uint8)
    four = np.ndarray((len(raw) + 1,), "<u4", padded, 0, (1,))
    total, at, count = len(raw) * 8, 0, _FULL
    while True:
        ends = _ends(size, count) + at
        fit = int(np.searchsorted(ends, total, "right")) - 1
        if fit <= 0:
            return
        widths = _widths(size, count)[:fit]
        codes = (four[ends[:fit] >> 3] >> (ends[:fit] & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and fit == count:
            count *= 4  # a clear code put off beyond a full table
            continue
        n = int(stop[0]) if len(stop) else fit
        if n:
            yield codes[:n].tolist()
        if not len(stop) or codes[n] == end:
            return
        at, count = int(ends[n + 1]), _FULL


def lzw_decode(raw: bytes, size: int, limit: int) -> bytes:
    """At most limit samples of a stream with the given minimum code size."""
    base: list[bytes] = [bytes([i]) for i in range(1 << size)] + [b"", b""]
    out: list[bytes] = []
    for codes in _segments(raw, size):
        known = base.copy()
        if codes[0] >= 1 << size:
            raise ValueError("LZW: a segment starts with an unknown code")
        prev = known[codes[0]]
        out.append(prev)
        put, add = out.append, known.append
        room = _FULL - len(known)
        for c in codes[1 : room + 1]:
            n = len(known)
            if c < n:
                got = known[c]
            elif c == n:
                got = prev + prev[:1]
            else:
                raise ValueError("LZW: unknown code")
            put(got)
            add(prev + got[:1])
            prev = got
        for c in codes[room + 1 :]:
            put(known[c])
    data = b"".join(out)
    if len(data) < limit:
        raise ValueError("LZW: too few samples")
    return data[:limit]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: bytes
    interlaced: bool = False

    def indices(self) -> np.ndarray:
        """Rows in screen order."""
        a = np.frombuffer(self.samples, np.uint8).reshape(self.height, self.width)
        if self.interlaced:
            order = np.concatenate([np.arange(s, self.height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            out = np.empty_like(a)
            out[order] = a
            return out
        return a


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)

    def canvases(self):
        """RGBA canvas of each frame after transparency, with disposal applied between frames."""
        canvas = np.zeros((self.height, self.width, 4), np.uint8)
        for f in self.frames:
            saved = canvas.copy() if f.disposal == 3 else None
            hi, wi = max(0, min(self.height - f.top, f.height)), max(0, min(self.width - f.left, f.width))
            idx = f.indices()[:hi, :wi]
            area = canvas[f.top : f.top + hi, f.left : f.left + wi]
            colours = np.concatenate((f.palette, np.zeros((256 - len(f.palette), 3), np.uint8)))
            seen = np.ones(idx.shape, bool) if f.transparent is None else idx != f.transparent
            area[seen, :3] = colours[idx[seen]]
            area[seen, 3] = 255
            yield canvas.copy()
            if f.disposal == 2:
                area[:] = 0
            elif f.disposal == 3:
                canvas = saved

    def histograms(self) -> list[np.ndarray]:
        """Counts over 64 colours of each frame's canvas; unpainted pixels count nowhere."""
        if all(f.transparent is None and (f.left, f.top, f.width, f.height) == (0, 0, self.width, self.height) for f in self.frames):
            out = []
            for f in self.frames:
                colours = np.concatenate((f.palette, np.zeros((256 - len(f.palette), 3), np.uint8)))
                out.append(np.bincount(_bin(colours), np.bincount(np.frombuffer(f.samples, np.uint8), minlength=256), 64).astype(np.int64))
            return out
        return [np.bincount(_bin(c[c[..., 3] > 0][:, :3]), minlength=64).astype(np.int64) for c in self.canvases()]


def _bin(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int64) >> 6
    return c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2]


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode(payload: bytes, width: int = WIDTH, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames' samples are the payload, a positive multiple of width bytes."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, MAX_ROWS), 0xF7, 0, 0), _GREY]
    for lo in range(0, rows, MAX_ROWS):
        part = payload[lo * width : (lo + MAX_ROWS) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        packed = lzw_encode(part)
        out += [bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(out), at + 1


def decode(data: bytes) -> Gif:
    """Reads a GIF87a or GIF89a file."""
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("GIF: cut off") from e


def _decode(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        at += n
    out = Gif(width, height)
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, after = _blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, colour = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, colour if packed & 1 else None
            at = after
        elif data[at] == 0x2C:
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if local & 0x80:
                n = 3 << (local & 7) + 1
                palette = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
                at += n
            if palette is None:
                palette = np.frombuffer(_GREY, np.uint8).reshape(-1, 3)
            size = data[at]
            if not 1 <= size <= 8:
                raise ValueError("GIF: bad code size")
            raw, at = _blocks(data, at + 1)
            out.frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, lzw_decode(raw, size, w * h), bool(local & 0x40)))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("GIF: unknown block")
    return out


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, zero-padded to rows of 64 samples, as a GIF."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            sizes, media = [], []
            for t in b.column(1):
                raw = (t.as_py() or "").encode("utf-8")
                sizes.append(len(raw))
                media.append(encode(raw + bytes(-len(raw) % WIDTH if raw else WIDTH)))
                if sum(map(len, media)) > 8 << 20:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(len(sizes) - len(media), len(media)), pa.array(sizes[-len(media) :], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    media = []
            if media:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(len(sizes) - len(media), len(media)), pa.array(sizes[-len(media) :], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", doc_id)


def frames(media: DataFrame, key: str = "doc_id", column: str = "media", strict: bool = True) -> DataFrame:
    """key, frame, start_cs, delay_cs, left, top, width, height, disposal, histogram and samples of each frame."""
    kind = media.schema[key].dataType.simpleString()
    names = ["id", "frame", "start_cs", "delay_cs", "left", "top", "width", "height", "disposal", "histogram", "samples"]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                if data is None:
                    continue
                try:
                    g = decode(data)
                except ValueError:
                    if strict:
                        raise
                    continue
                start = 0
                for n, (f, h) in enumerate(zip(g.frames, g.histograms())):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), *(pa.array([x], pa.int64()) for x in (n, start, f.delay_cs, f.left, f.top, f.width, f.height, f.disposal)), pa.array([h.tolist()], pa.list_(pa.int64())), pa.array([f.indices().tobytes()], pa.binary())], names
                    )
                    start += f.delay_cs

    schema = f"id {kind}, frame long, start_cs long, delay_cs long, left long, top long, width long, height long, disposal long, histogram array<long>, samples binary"
    return media.select(F.col(key).alias("id"), F.col(column).alias("m")).mapInArrow(run, schema).withColumnRenamed("id", key)


def digest(media: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Reads each file back and gives what identifies payload, file and feature."""
    kind = media.schema[doc_id].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for n, m in zip(b.column(1).to_pylist(), b.column(2)):
                m = m.as_py()
                g = decode(m)
                payload = b"".join(f.samples for f in g.frames)
                grey = sum(g.histograms())[[0, 21, 42, 63]]
                feature = f"{g.width}x{g.height};frames={len(g.frames)};cs={sum(f.delay_cs for f in g.frames)};grey=" + ",".join(map(str, grey.tolist()))
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col(doc_id).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def op8_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(table(spark, sf_dir, "documents")))
