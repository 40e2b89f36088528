"""Words of texts in Python workers: hashes of whole batches at once, and the longest common subsequence."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
MEMO = 1 << 18
#: ASCII punctuation, which is no part of a word here; ASCII white space, which separates words.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
BLANK = b" \t\n\r\x0b\x0c"
AS_BLANK = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
MARKS = re.compile("[\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u206f\u3000-\u303f]")
IS_BLANK = np.isin(np.arange(256), list(BLANK))
#: Bytes hashed at once. A word's hash is sum(VALUE[byte] * P**place) modulo 2**64, from differences of running sums.
PIECE = 1 << 17
_random = np.random.default_rng(19)
VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64)
P = 0x9E3779B97F4A7C15


def _powers(p: int) -> np.ndarray:
    out = np.full(PIECE, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER, INVERSE = _powers(P), _powers(pow(P, -1, 1 << 64))


class WordIds(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """(bytes, texts, where each begins): whole texts up to PIECE bytes together; longer ones cut between words."""
    joined, at, begins, size = [], [], [], 0
    for i, t in enumerate(texts):
        lo = 0
        while lo < len(t) or lo == 0:
            hi = min(len(t), lo + PIECE - 1)
            if hi < len(t):
                cut = max(t.rfind(b, lo, hi) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                # a word longer than a piece goes whole
                hi = cut if cut > lo else min((x for x in (t.find(b, hi) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0), default=len(t))
            part = t[lo:hi]
            if size + len(part) + 1 > PIECE and joined:
                yield b"\n".join(joined), at, begins
                joined, at, begins, size = [], [], [], 0
            joined.append(part)
            at.append(i)
            begins.append(size)
            size += len(part) + 1
            lo = max(hi, 1)
    if joined:
        yield b"\n".join(joined), at, begins


def batch_word_hashes(texts: list[str | None], apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text): what white space separates, in lower case, without ASCII punctuation.

    With `apart`, punctuation separates words too, also the common marks beyond ASCII.
    """
    hashes, counts = [], np.zeros(len(texts), int)
    if apart:
        encoded = ((t if t.isascii() else MARKS.sub(" ", t)).lower().encode("utf-8", "surrogatepass").translate(AS_BLANK) for t in (t or "" for t in texts))
    else:
        encoded = ((t or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION) for t in texts)
    for data, at, begins in _pieces(encoded):
        a = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], IS_BLANK[a], [True]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(data) > PIECE:  # one word
            h = np.array([xxhash.xxh64_intdigest(data[s:e]) for s, e in zip(starts, ends, strict=True)], np.uint64)
        else:
            total = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(VALUE[a] * POWER[: len(a)], out=total[1:])
            h = (total[ends] - total[starts]) * INVERSE[np.minimum(starts, PIECE - 1)]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        hashes.append(h)
        np.add.at(counts, at, np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), counts


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two sequences of hashable items, one bit for each item of a."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()
