"""Words of many texts at once, as numbers: boundaries and hashes by numpy over code points.

A word is a run of letters, digits, marks and underscores, in lower case; all else separates. In scripts
written without spaces each character is a word. Hashes depend on the characters alone: not on the texts
beside, nor on how long a word is.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

U = np.uint64
_ODD, _TABLE_SEED = U(0x9E3779B97F4A7C15), U(0x5851F42D4C957F2D)
#: Characters hashed at a time, and how far back from there a place is looked for where no word is cut.
BLOCK, BACK = 1 << 19, 4096
#: Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, and Han characters.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]


def scramble(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_inverse = U(pow(int(_ODD), -1, 1 << 64))
_power = np.concatenate([[U(1)], np.cumprod(np.full(BLOCK, _ODD), dtype=U)])
_back = np.concatenate([[U(1)], np.cumprod(np.full(BLOCK, _inverse), dtype=U)])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its kind (0: separates, 1: part of a word, 2: a word) and its number."""
    kind = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)], np.int8)
    kind[ord("_")] = 1
    for first, last in UNSPACED:
        kind[first : last + 1] *= 2
    return kind, scramble(np.arange(1, 0x110001, dtype=U) * _TABLE_SEED)


class Words:
    """Words of ``texts``: doc (index of the text), hash, and by request hashes of their first letters."""

    def __init__(self, texts: list[str | None], stems: tuple[int, ...] = ()):
        lowered = [(t or "").lower() for t in texts]
        starts = np.cumsum([0] + [len(t) + 1 for t in lowered])
        code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        blocks, begun, at = [], None, 0
        while at < len(code):
            end, runs_on = _cut(code, at)
            found, begun = _hash_block(code[at:end], at, stems, begun, runs_on)
            blocks.append(found)
            at = end
        first, own, *parts = (np.concatenate(x) for x in zip(*blocks, strict=True))
        self.n = len(texts)
        self.doc = np.searchsorted(starts, first, "right") - 1
        self.hash = own
        self.stem = dict(zip(stems, parts, strict=True))

    def grams(self, *steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the words at distances 0, *steps from each word, within one text."""
        span = steps[-1]
        if len(self.hash) <= span:
            return np.zeros(0, np.int64), np.zeros(0, U)
        n = len(self.hash) - span
        mixed = scramble(self.hash[:n])
        for k, s in enumerate(steps):
            mixed = scramble(mixed * _ODD + self.hash[s : s + n] + U(k + 1 + (s << 8)))
        inside = self.doc[:n] == self.doc[span:]
        return self.doc[:n][inside], mixed[inside]


def _breaks(kind: np.ndarray) -> np.ndarray:
    """Whether no word runs on from each character to the next, for all but the last."""
    return (kind[:-1] != 1) | (kind[1:] != 1)


def _cut(code: np.ndarray, at: int) -> tuple[int, bool]:
    """Where the block from ``at`` ends, and whether a word runs on there, which only one longer than BACK does."""
    end = at + BLOCK
    if end >= len(code):
        return len(code), False
    gaps = np.flatnonzero(_breaks(_tables()[0][code[end - BACK : end + 1]]))
    return (end - BACK + int(gaps[-1]) + 1, False) if len(gaps) else (end, True)


def _hash_block(code: np.ndarray, at: int, stems: tuple[int, ...], begun: tuple | None, runs_on: bool) -> tuple[list[np.ndarray], tuple | None]:
    """([first character, hash, *hash of the first letters], begun) of the words that end in a block. begun:
    the same of a word that ends in a later block, with the sum and the length of what there is of it."""
    kinds, numbers = _tables()
    kind = kinds[code]
    inner = _breaks(kind)
    starts = np.flatnonzero(np.append(begun is None, inner) & (kind > 0))
    ends = np.flatnonzero(np.append(inner, not runs_on) & (kind > 0)) + 1
    total = np.concatenate([[U(0)], np.cumsum(numbers[code] * _power[: len(code)], dtype=U)])
    of = lambda a, z: (total[z] - total[a]) * _back[a]
    hashed = lambda a, z: scramble(of(a, z) + (z - a).astype(U))
    lead = lambda n, a, z: scramble(hashed(a, np.minimum(a + n, z)) + U(n))
    before = []
    if begun:
        first, total_before, length, *leads = begun
        end = int(ends[0]) if len(ends) else len(code)
        joined = (total_before + pow(int(_ODD), length, 1 << 64) * int(of(0, end))) % (1 << 64)
        length += end
        if not len(ends):
            return [np.zeros(0, np.int64), *[np.zeros(0, U)] * (1 + len(stems))], (first, joined, length, *leads)
        before, ends = [[first], scramble(np.array([(joined + length) % (1 << 64)], U)), *leads], ends[1:]
        begun = None
    if runs_on:
        a, z = starts[-1:], np.array([len(code)])
        begun = (int(a[0]) + at, int(of(a, z)[0]), len(code) - int(a[0]), *[lead(n, a, z) for n in stems])
        starts = starts[:-1]
    found = [starts + at, hashed(starts, ends), *[lead(n, starts, ends) for n in stems]]
    return [np.concatenate([b, f]).astype(f.dtype) for b, f in zip(before, found, strict=True)] if before else found, begun
