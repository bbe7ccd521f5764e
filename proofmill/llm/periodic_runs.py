"""Periodic runs in intake notes: extensions by a difference-cover index, runs from harmonic grids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# A perfect difference set modulo 31: every distance that is not a multiple of 31 is the difference of exactly one pair of it. Fixed values.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
BATCH_BYTES, QUERIES = 1 << 20, 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def _synchronising() -> np.ndarray:
    """[a mod 31, (b - a) mod 31]: the least step after which a and b are both in the cover."""
    steps = np.full((PERIOD, PERIOD), PERIOD)
    for x in COVER:
        for y in COVER:
            for a in range(PERIOD):
                steps[a, (y - x) % PERIOD] = min(steps[a, (y - x) % PERIOD], (x - a) % PERIOD)
    return steps


SYNC = _synchronising()
ROW = np.full(PERIOD, -1)
ROW[list(COVER)] = np.arange(len(COVER))


class CoverIndex:
    """How many words two suffixes share, in constant time for any number of pairs at once.

    Only the suffixes at places in the cover are sorted: by their first 31
    words, then by doubling, where the suffix 31 * 2^k further on is in the
    cover too. A query compares at most 30 words until both suffixes reach
    such places, and the rest is a range minimum over the shared lengths of
    neighbours in that order. The last code, and each text's end, must occur
    only once.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        columns = -(-n // PERIOD)
        self.codes = np.concatenate((codes, np.full(PERIOD * (columns + 2) - n, -1, codes.dtype)))
        at = np.asarray(COVER)[:, None] + PERIOD * np.arange(columns)[None, :]
        self.at = at.ravel()
        rank, distinct = self._first_words(self.at)
        levels = [rank.reshape(at.shape)]
        beyond = int((self.at >= n).sum())
        wanted = len(self.at) - max(0, beyond - 1)
        while distinct < wanted and 1 << len(levels) - 1 < columns:
            step, rank = 1 << len(levels) - 1, levels[-1]
            later = np.zeros_like(rank)
            later[:, :-step] = rank[:, step:]
            kinds, back = np.unique(rank * (len(self.at) + 1) + later, return_inverse=True)
            distinct = len(kinds)
            levels.append(back.reshape(at.shape) + 1)
        order = np.argsort(levels[-1].ravel(), kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.columns = columns
        self.minima = self._range_minima(self._neighbours(order, levels))

    def _first_words(self, at: np.ndarray) -> tuple[np.ndarray, int]:
        """Dense ranks (from 1) by the first 31 words, several of them packed into one key."""
        bits = int(self.codes.max() + 2).bit_length()
        per = max(1, 62 // bits)
        keys = []
        for first in range(0, PERIOD, per):
            key = np.zeros(len(at), np.int64)
            for k in range(first, min(first + per, PERIOD)):
                key = key << bits | (self.codes[at + k] + 1)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new) + 1
        return rank, int(new.sum()) + 1

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sorted suffix shares with the next one: whole doubled blocks, then single words."""
        row, a, b = order[:-1] // self.columns, order[:-1] % self.columns, order[1:] % self.columns
        other = order[1:] // self.columns
        shared = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < self.columns) & (b < self.columns)
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][row[inside], a[inside]] == levels[k][other[inside], b[inside]]
            shared += np.where(same, PERIOD << k, 0)
            a, b = a + (same << k), b + (same << k)
        cover = np.asarray(COVER)
        left, right = cover[row] + PERIOD * a, cover[other] + PERIOD * b
        inside = (a < self.columns) & (b < self.columns)
        shared[inside] += self._compared(left[inside], right[inside], np.full(int(inside.sum()), PERIOD))
        return shared

    @staticmethod
    def _range_minima(values: np.ndarray) -> list[np.ndarray]:
        """Sparse table: minima of all runs of 2^k values."""
        table = [values]
        while 2 << len(table) - 1 <= len(values):
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, `most` at the most."""
        shared = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for step in range(int(most.max(initial=0))):
            live = live[most[live] > step]
            live = live[self.codes[a[live] + step] == self.codes[b[live] + step]]
            if not len(live):
                break
            shared[live] += 1
        return shared

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words of the suffixes at a and b (different places)."""
        step = SYNC[a % PERIOD, (b - a) % PERIOD]
        out = self._compared(a, b, step)
        far = np.flatnonzero(out == step)
        if len(far):
            a, b = a[far] + step[far], b[far] + step[far]
            x = self.place[ROW[a % PERIOD] * self.columns + a // PERIOD]
            y = self.place[ROW[b % PERIOD] * self.columns + b // PERIOD]
            low, high = np.minimum(x, y), np.maximum(x, y)
            k = np.frexp((high - low).astype(float))[1] - 1
            least = np.empty(len(far), np.int64)
            for level in np.unique(k).tolist():
                at = np.flatnonzero(k == level)
                row = self.minima[level]
                least[at] = np.minimum(row[low[at]], row[high[at] - (1 << level)])
            out[far] += least
        return out


def _grid_pairs(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) in blocks: for every period, the multiples of it whose word recurs one period on.

    Texts lie in `codes` by falling size, so those with room for two periods
    are a prefix. A stretch of two periods holds a multiple of the period and
    the place one period behind it, whatever its start.
    """
    ends = 1 + np.cumsum(sizes + 1)
    fit = np.searchsorted(-sizes, -2 * np.arange(1, int(sizes.max(initial=0)) // 2 + 1), side="right")
    at, periods, held = [], [], 0
    for p, texts in enumerate(fit.tolist(), 1):
        room = int(ends[texts - 1])
        hit = np.flatnonzero(codes[:room - p:p] == codes[p:room:p]) * p
        if len(hit):
            at.append(hit)
            periods.append(np.full(len(hit), p))
            held += len(hit)
            if held > QUERIES:
                yield np.concatenate(at), np.concatenate(periods)
                at, periods, held = [], [], 0
    if held:
        yield np.concatenate(at), np.concatenate(periods)


def _first_of_each(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) by start and end, of equal stretches the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(1)))] if len(runs) else runs


def runs_of(texts: Sequence[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """Rows (start, length, period) of all runs of each text (word codes >= 0), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return out
    top = max(int(texts[i].max()) for i in order) + 1
    parts = [np.array([top])]
    for k, i in enumerate(order.tolist(), 1):
        parts += [texts[i], np.array([top + k])]
    codes = np.concatenate(parts).astype(np.int64)
    forward, backward, last = CoverIndex(codes), CoverIndex(codes[::-1]), len(codes) - 1
    found = [np.zeros((0, 3), np.int64)]
    for at, period in _grid_pairs(codes, sizes[order]):
        right = forward.shared(at, at + period)
        left = np.zeros(len(at), np.int64)
        inner = np.flatnonzero(at > 0)
        left[inner] = backward.shared(last - at[inner] + 1, last - at[inner] - period[inner] + 1)
        long = left + period + right >= np.maximum(least, 2 * period)
        found.append(_first_of_each(np.stack((at - left, at + period + right, period), 1)[long]))
    # a stretch of several periods is found at each multiple of its smallest one
    runs = _first_of_each(np.concatenate(found))
    begins = 1 + np.concatenate(([0], np.cumsum(sizes[order] + 1)))
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    for k in np.unique(owner).tolist():
        mine = runs[owner == k]
        mine = np.stack((mine[:, 0] - begins[k], mine[:, 1] - mine[:, 0], mine[:, 2]), 1)
        out[order[k]] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def _without(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words that no run contains after its first period, joined by one blank."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone])


def _found(least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, texts, first = pdf["id"].to_numpy(), pdf["text"].tolist(), 0
            while first < len(texts):
                end, size, words = first, 0, []
                while end < len(texts) and (end == first or size < BATCH_BYTES):
                    data = texts[end].encode()
                    words.append(data.split())  # blanks of bytes are 0x20 and 0x09-0x0D
                    size += len(data)
                    end += 1
                flat = np.empty(sum(map(len, words)), object)
                flat[:] = list(chain.from_iterable(words))
                coded = np.split(pd.factorize(flat)[0], np.cumsum([len(w) for w in words])[:-1])
                runs = runs_of(coded, least)
                yield pd.DataFrame({
                    "id": ids[first:end], "n_words": [len(w) for w in words],
                    "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in runs],
                    "collapsed": [_without(w, r).decode() for w, r in zip(words, runs, strict=True)]})
                first = end
    return run


def periodic_runs(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", least: int = 12) -> DataFrame:
    """All maximal periodic stretches of words in every record's notes, and the notes with each reduced to one period.

    A run is a stretch of consecutive words with smallest period q (words q
    apart are equal), at least max(`least`, 2 q) words long, which neither
    neighbour extends. For every period the places on its grid of multiples
    are tested (n log n in all); the stretch through such a place comes from
    two extension queries of the difference-cover index, one forward, one
    backward. Words (between blanks 0x20, 0x09-0x0D) are compared exactly.

    Returns one row per input row: `id_col`, n_words, runs (array of start,
    length, period in words, by start, then period), collapsed (words that
    are in no run behind its first period, joined by one blank).

    Records are independent: nothing is shuffled, a task holds about 1 MB of
    notes at a time, or one record that is longer. Null or empty notes have no words, no runs and
    an empty collapsed text. Null ids, repeated rows and extra columns of any
    name do not matter; an empty table gives an empty table.
    """
    id_type = evidence.schema[id_col].dataType
    rows = evidence.select(F.col(id_col).cast("string").alias("id"), whole_text(F.col(text_col)).alias("text"))
    made = rows.mapInPandas(_found(least), f"id string, n_words long, runs {RUNS}, collapsed string")
    return made.select(F.col("id").cast(id_type).alias(id_col), "n_words", "runs", "collapsed")
