"""Token ids of many texts with a public tokenizer file, one library call for each new word only.

The tokenizer's normaliser and pre-tokenizer never join text over white space,
so a text's ids are those of its chunks between ASCII white space, in order.
A task keeps a bounded table of chunks it has met (by a 64-bit hash); new ones
are encoded together by the tokenizers library and told apart by their offsets.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from .common import SPACE, Slab, Words, lower, words

CACHE_CHUNKS = 1_000_000
END_ID = 1
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True


def chunks(slab: Slab) -> Words:
    """Chunks between white space, in lower case; one or two marks behind an ASCII letter are a chunk of their own.

    The pre-tokenizer parts them there as well, and its normaliser lowers case,
    so the ids stay the same and far fewer chunks are new. Texts with ``<|``
    keep their case, as special tokens are matched before normalising.
    """
    data = slab.data
    odd = np.flatnonzero(data[:-1] == 60)
    if not len(odd) or not (data[odd + 1] == 124).any():
        data = lower(data)
    w = words(slab, SPACE, data)
    size = w.end - w.start
    at = np.zeros(len(size), np.int64)
    for marks in (2, 1):
        own = np.flatnonzero(size > marks)
        last = w.end[own]
        ok = _LETTER[data[last - marks - 1]]
        for k in range(marks):
            ok &= _MARK[data[last - 1 - k]]
        at[own[ok]] = marks
    parts = 1 + (at > 0)
    first = np.cumsum(parts) - parts
    start, end = np.empty(int(parts.sum()), np.int64), np.empty(int(parts.sum()), np.int64)
    start[first], end[first] = w.start, w.end - at
    two = at > 0
    start[first[two] + 1], end[first[two] + 1] = w.end[two] - at[two], w.end[two]
    return Words(data, start, end, np.concatenate((first, [len(start)]))[w.rows])


_OWN: dict = {}


def encoder(path: str | None = None) -> "Encoder":
    """This process's encoder: Python workers serve many tasks, and keep what earlier ones learnt."""
    if path not in _OWN:
        _OWN.clear()
        _OWN[path] = Encoder(path)
    return _OWN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or default_path())
        self._reset()

    def _reset(self):
        self.at: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _learn(self, hashes: list[int], chunks: list[bytes]) -> None:
        for lo in range(0, len(chunks), 2000):
            part = [c.decode("utf-8", "replace") for c in chunks[lo : lo + 2000]]
            begin = np.cumsum([0] + [len(p) + 1 for p in part])
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            where = np.array([o[0] for o in e.offsets], np.int64) if len(ids) else np.zeros(0, np.int64)
            cuts = np.searchsorted(where, begin)
            need = self.used + len(ids)
            if need > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(max(need, len(self.ids)), np.uint32)))
            self.ids[self.used : need] = ids
            n0, n1 = len(self.at), len(self.at) + len(part)
            if n1 > len(self.start):
                grow = max(n1, len(self.start))
                self.start = np.concatenate((self.start, np.zeros(grow, np.int64)))
                self.size = np.concatenate((self.size, np.zeros(grow, np.int64)))
            self.start[n0:n1] = self.used + cuts[:-1]
            self.size[n0:n1] = np.diff(cuts)
            self.used = need
            for k, h in enumerate(hashes[lo : lo + 2000]):
                self.at[h] = n0 + k

    def encode(self, slab: Slab, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slab's rows, and each row's offset in them; end_id is appended to each row."""
        w = chunks(slab)
        n = slab.hi - slab.lo
        if len(self.at) > CACHE_CHUNKS:
            self._reset()
        codes, unique = pd.factorize(w.hashes())
        known = np.array([self.at.get(h, -1) for h in unique.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            first = np.full(len(unique), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            before = len(self.at)
            self._learn(unique[new].tolist(), [w.word(k) for k in first[new]])
            known[new] = before + np.arange(len(new))
        entry = known[codes]
        extra = 0 if end_id is None else 1
        size = self.size[entry]
        upto = np.concatenate(([0], np.cumsum(size)))
        offs = upto[w.rows] + extra * np.arange(n + 1)
        out = np.empty(offs[-1], np.uint32)
        if len(entry):
            row = np.repeat(np.arange(n), np.diff(w.rows))
            to = upto[:-1] + extra * row
            total = int(upto[-1])
            step = np.arange(total) - np.repeat(upto[:-1], size)
            out[np.repeat(to, size) + step] = self.ids[np.repeat(self.start[entry], size) + step]
        if extra:
            out[offs[1:] - 1] = end_id
        return out, offs
