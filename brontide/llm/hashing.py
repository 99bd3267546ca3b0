"""Vectorised word and window hashes over blocks of whole texts (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_BASE = U(0xD1342543DE82EF95)
_INV = U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_pw = np.ones(1, U)
_ipw = np.ones(1, U)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at once; about twelve arrays of eight times that are alive.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, 2 * len(_pw))
        with np.errstate(over="ignore"):
            _pw = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, _BASE, U))])
            _ipw = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, _INV, U))])
    return _pw[:n], _ipw[:n]


class Segments:
    """Hashes of any segments of one array, from its running polynomial sum."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        pw, self.ipw = _powers(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * pw[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(U)
        return mix((self.sums[end] - self.sums[start]) * self.ipw[start] + length * _MUL)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of UTF-8 texts, as 64-bit hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            buf = _LOWER[buf]
        space = _IS_SPACE[buf]
        before = np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(before & ~space)
        end = np.flatnonzero(space & ~before)
        self.hash = Segments(_BYTE[buf]).of(self.start, end)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        at = np.searchsorted(self.start, bounds)
        #: First and past-the-last word of each text.
        self.first, self.last = at[:-1], at[1:]

    def each(self, values: np.ndarray) -> np.ndarray:
        """A value of each text repeated for its words."""
        return np.repeat(values, self.last - self.first)


def blocks(texts: list[bytes | None], size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) of blocks that hold about ``size`` bytes; null counts as empty."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        out = []
        while j < len(texts) and (not out or held + len(texts[j] or b"") <= size):
            out.append(texts[j] or b"")
            held += len(out[-1]) + 1
            j += 1
        yield i, out
        i = j
