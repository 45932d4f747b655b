import random
import struct

import numpy as np
import pytest

from edilake.llm import gif


@pytest.mark.parametrize("n", [1, 2, 63, 64, 4000, 300_000])
@pytest.mark.parametrize("kind", ["zero", "random", "text"])
def test_lzw_round_trip(n, kind):
    rnd = random.Random(n)
    data = {"zero": bytes(n), "random": rnd.randbytes(n), "text": (b"the quick brown fox jumps. " * (n // 20 + 1))[:n]}[kind]
    assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


def test_small_code_size_and_deferred_clear():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(4) for _ in range(200_000))
    # An encoder that never clears again: the table stays full.
    known, out, free, cur = {}, [4], 6, data[0]
    for b in data[1:]:
        if (cur, b) in known:
            cur = known[cur, b]
            continue
        out.append(cur)
        if free < 4096:
            known[cur, b] = free
            free += 1
        cur = b
    out += [cur, 5]
    widths = np.concatenate(([3], gif._widths(2, len(out) - 1)))
    assert gif.lzw_decode(gif._pack(np.array(out), widths), 2, len(data)) == data


def test_payload_over_several_frames():
    data = random.Random(2).randbytes(64) * 70_000
    g = gif.decode(gif.encode(data))
    assert len(g.frames) == 2 and b"".join(f.samples for f in g.frames) == data


def _frame(left, top, w, h, samples, disposal=0, transparent=None, local=None, interlaced=False, delay=5):
    out = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
    flags = (0x80 if local else 0) | (0x40 if interlaced else 0)
    out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (local or b"") + b"\x02"
    packed = gif.lzw_encode(bytes(samples), 2)
    return out + bytes([len(packed)]) + packed + b"\0"


def test_disposal_transparency_palettes_and_interlacing():
    shared = bytes([255, 0, 0, 0, 255, 0])
    data = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x80, 0, 0) + shared
    data += _frame(0, 0, 4, 4, [0] * 16)
    data += _frame(1, 1, 2, 2, [1, 0, 0, 1], disposal=3, transparent=0)
    data += _frame(0, 0, 2, 2, [0, 0, 0, 0], disposal=2, local=bytes([0, 0, 255, 0, 0, 0]))
    data += _frame(3, 3, 4, 4, [1] * 16)
    rows = [[0] * 4, [0] * 4, [1] * 4, [1] * 4]
    data += _frame(0, 0, 4, 4, sum(rows, []), interlaced=True) + b"\x3b"
    a, b, c, d, e = gif.decode(data).canvases()
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert (a == red).all()
    assert tuple(b[1, 1]) == green and tuple(b[1, 2]) == red and (b == green).all(-1).sum() == 2
    assert (c == green).all(-1).sum() == 0 and (c == blue).all(-1).sum() == 4
    assert (d[:2, :2] == 0).all() and tuple(d[3, 3]) == green and tuple(d[3, 2]) == red
    # Interlaced rows come as 0, 2, 1, 3 in a frame of four rows.
    assert (e[0] == red).all() and (e[2] == red).all() and (e[1] == green).all() and (e[3] == green).all()
    h = gif.decode(data).histograms()
    assert h[0][48] == 16 and h[2][3] == 4 and sum(h[3]) == 12


def test_broken_files():
    good = gif.encode(bytes(64))
    for bad in (b"", b"GIF89a", good[:-40], b"PNG" + good[3:]):
        with pytest.raises(ValueError):
            gif.decode(bad)


def test_query_cases(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 40), (4, "é" * 40), (5, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as feature")
    out = gif.digest(gif.store(df)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and by[1].payload_sha256 == by[2].payload_sha256 and by[1].n_bytes == 0 and by[2].payload_bytes == 64
    assert by[3].payload_bytes == 64 and by[4].n_bytes == 80 and by[4].payload_bytes == 128
    fr = gif.frames(gif.store(df)).collect()
    assert len(fr) == 6 and all(sum(r.histogram) == r.width * r.height for r in fr)
    assert gif.digest(gif.store(df.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"GIF")), (2, None)], "doc_id long, media binary")
    assert gif.frames(broken, strict=False).count() == 0
