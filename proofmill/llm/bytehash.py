"""Vectorised hashing of text batches inside tasks (NumPy): rolling sums, words, shingles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BATCH_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits (SplitMix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out)


class Rolling:
    """Polynomial sums of a byte buffer, so that the hash of any slice takes constant time."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.down = _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(BYTE_VALUES[buf] * _powers(_BASE, n + 1)[:n], out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """Hash of every slice of `width` bytes (unmixed sum, then mixed)."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def batches(texts: Sequence[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, encoded texts) in runs of about `limit` bytes; a longer text is a run of its own."""
    run: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        data = text.encode() if isinstance(text, str) else b""
        if run and size + len(data) > limit:
            yield first, run
            run, first, size = [], k, 0
        run.append(data)
        size += len(data)
    if run:
        yield first, run


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order (A-Z lowered), and the number of words of each text."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    blank = _BLANK[buf]
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    return Rolling(buf).slices(starts, ends), counts


def shingle_sets(texts: Sequence[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a shorter text is one shingle, a text without words has none."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    for c in counts.tolist():
        w = words[at:at + c]
        at += c
        if not c:
            out.append(np.zeros(0, U))
            continue
        width = min(n, c)
        h = np.zeros(c - width + 1, U)
        for k in range(width):
            h = mix(h * U(0x100000001B3) + w[k:k + len(h)])
        out.append(np.unique(h))
    return out
