import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from edilake.llm import simple8b
from edilake.llm.common import slabs
from edilake.llm.tokens import Encoder


@pytest.fixture(scope="module")
def enc():
    return Encoder()


HARD = ["", " ", "it's we'll O'd", "á ́b", "x<|endoftext|>y <|startoftext|> <|end oftext|>", "İSTANBUL ΣΑΣ ß", "1234 5.6", "a b c", "日本語 テスト", "퟿\U0001f600!!", "\x00\x01 \x1f", "tab\tnew\nline\r\x0b\x0c", "é́ ̧", "̈́ q"]


def test_ids_equal_the_library(enc):
    rnd = random.Random(3)
    alphabet = "abcDEF ' \t\n.,!?0129éÉßñ́ ‍日<|>"
    texts = HARD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(600)]
    for own in (texts, [t for t in texts if "<|" not in t]):
        (slab,) = slabs(pa.array(own))
        ids, offs = enc.encode(slab)
        for k, t in enumerate(own):
            assert ids[offs[k] : offs[k + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids + [1], repr(t)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("bits", [0, 1, 7, 16, 32, 60, 64])
def test_pack_round_trip(n, bits):
    rnd = random.Random(n * 100 + bits)
    v = np.array([rnd.getrandbits(rnd.randrange(bits + 1)) if bits else 0 for _ in range(n)], np.uint64)
    words, first = simple8b.pack(v)
    assert (simple8b.unpack(words, first, n) == v).all()
    for b in range(len(first) - 1):
        assert (simple8b.unpack_block(words, first, n, b) == v[b * 128 : b * 128 + 128]).all()


def test_selector_density():
    words, _ = simple8b.pack(np.zeros(60, np.uint64))
    assert len(words) == 1
    words, _ = simple8b.pack(np.full(126, 40_000, np.uint64))
    assert len(words) == 42
    assert len(simple8b.pack(np.array([2**64 - 1], np.uint64))[0]) == 2


def test_query_against_brute_force(spark, enc):
    rnd = random.Random(5)
    rows = [(k * 7 % 101, " ".join(rnd.choice(["alpha", "Beta,", "été", "x9"]) for _ in range(rnd.randrange(30))), 1) for k in range(100)]
    rows += [(500, None, 2), (501, "", 3), (502, "long " * 60_000, 4), (7, "again", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = [tuple(r) for r in simple8b.read(simple8b.cut(simple8b.containers(df, parts=3))).collect()]
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got.sort(key=lambda r: r[1])
    assert sorted(r[1] for r in got) == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert [r[0] for r in got] == [w[0] for w in want]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted(want)
    assert simple8b.read(simple8b.cut(simple8b.containers(df.limit(0)))).count() == 0
