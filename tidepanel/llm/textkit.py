"""Vectorised word spans, word hashes, rolling window hashes and minimizers over packed UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

with np.errstate(over="ignore"):
    _BYTE = np.uint64(0x9E3779B97F4A7C55)
    _POW = np.cumprod(np.full(4096, _BYTE, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied to a copy."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts: ``h`` their 64-bit hashes, ``first`` the word offsets of the texts (one more than texts), ``raw``, ``start`` and ``end`` their bytes."""

    def __init__(self, texts: list[bytes | None]):
        lens = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        self.raw = b"\n".join(t or b"" for t in texts)
        buf = np.frombuffer(self.raw, np.uint8)
        word = ~SPACE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(lens))))
        n = len(self.start)
        self.h = np.empty(n, np.uint64)
        if not n:
            return
        size = self.end - self.start
        bytes_of = buf[word]
        total = np.cumsum(size)
        lo = 0
        while lo < n:  # about a million bytes at once
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + (1 << 20), "right")))
            part, off = size[lo:hi], total[lo:hi] - size[lo:hi] - base
            b = bytes_of[base : total[hi - 1]].astype(np.uint64)
            pos = np.arange(len(b)) - np.repeat(off, part)
            with np.errstate(over="ignore"):
                self.h[lo:hi] = mix(np.add.reduceat((b + np.uint64(1)) * _POW[pos & 4095], off) + part.astype(np.uint64))
            lo = hi

    def text(self, i: int, j: int) -> list[bytes]:
        """Words i to j - 1."""
        return [self.raw[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)]


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd ``base`` and of its inverse, n of each at least."""
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        n = max(4096, 1 << (n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _TABLES[base] = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (base, inv))
    return _TABLES[base]


def windows(h: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each run of ``size`` consecutive entries of h; equal runs have equal hashes wherever they stand."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    powers, inverse = _tables(base, len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)], dtype=np.uint64)))
        return mix((sums[size:] - sums[:-size]) * inverse[: len(h) - size + 1])


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over each ``width`` consecutive entries, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """True where an entry is the smallest of some ``width`` consecutive ones (ties: all of them): every run holds one, chosen by its content alone."""
    if len(grams) < width:
        return np.zeros(len(grams), bool)
    low = _slide(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return _slide(np.concatenate((pad, low, pad)), width, np.maximum) == grams
