"""NumPy kernels over UTF-8 text: word bounds, word hashes and hashes of word windows.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; all of these are ASCII, so byte-wise work on
UTF-8 gives the same words as work on code points.
"""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every output bit depends on every input bit (the SplitMix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = _odd(256, 7)
_UP = _powers(_BASE, _PIECE + 1)
_DOWN = _powers(_BASE_INVERSE, _PIECE + 1)


def _piece(a: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = (_UP, _DOWN) if len(a) <= _PIECE else (_powers(_BASE, len(a)), _powers(_BASE_INVERSE, len(a)))
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and 64-bit hashes of the words of ``text``; memory beyond them is bounded unless one
    word is longer than a megabyte."""
    a = np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(a):
        end = min(at + _PIECE, len(a))
        if end < len(a):
            back = np.flatnonzero(_SPACE[a[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                while end < len(a) and not _SPACE[a[end]]:
                    end += 1
        piece = a[at:end]
        s, e, h = _piece(piece, _SPACE[piece])
        out.append((s + at, e + at, h))
        at = end
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words; ``seed`` gives independent functions."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, c in enumerate(_odd(width, 1000 + seed)):
        total += h[k : k + n] * c
    return mix(total)


class Texts:
    """Words of several texts laid end to end: ``starts``/``ends`` into ``data``, ``hashes``, and ``first``, the index of
    each text's first word (with one more entry for the end)."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offsets[1:])
        self.starts, self.ends, self.hashes = word_hashes(self.data)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.place = np.arange(len(self.starts)) - self.first[:-1][self.text_of] if len(texts) else self.text_of

    def whole(self, width: int) -> np.ndarray:
        """For each start of a run of ``width`` words: does the run lie in one text?"""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.zeros(0, bool)
        return self.text_of[:n] == self.text_of[width - 1 :]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``width`` words that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def batches(texts: list, limit: int = 1 << 20):
    """Split a list of UTF-8 texts (``None``: empty) into runs of about ``limit`` bytes; yields (first, texts)."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > limit:
            yield at, run
            at, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield at, run
