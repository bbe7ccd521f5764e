"""Per-key state of the live jobs. Each processor sees one micro-batch of one key at a time, in pieces or row by row.

Inputs carry `ts_us` (event time in microseconds) and `event_id`; what a batch
brings for a key is applied in (ts_us, event_id) order. However much that is,
a task holds a piece of it: longer batches are sorted in runs, which are
merged piece by piece.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
import tempfile
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

ORDER = ["ts_us", "event_id"]
PIECE_ROWS = 100_000


def _ordered(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames).sort_values(ORDER, kind="stable", ignore_index=True)


def _upto(frame: pd.DataFrame, last: tuple[int, int]) -> int:
    """Rows of a sorted frame that do not come after `last`."""
    ts, event = frame["ts_us"].to_numpy(), frame["event_id"].to_numpy()
    lo, hi = np.searchsorted(ts, last[0], "left"), np.searchsorted(ts, last[0], "right")
    return int(lo + np.searchsorted(event[lo:hi], last[1], "right"))


def _merged(file, runs: list[list[int]]) -> Iterator[pd.DataFrame]:
    """Sorted pieces of sorted runs. A run is the places of its blocks; one block of each is in memory."""
    def block(run: list[int]) -> pd.DataFrame | None:
        if not run:
            return None
        file.seek(run.pop(0))
        return pickle.load(file)

    held = [block(run) for run in runs]
    while any(b is not None for b in held):
        # up to the least of the blocks' ends, nothing that is still unread can come before
        last = min((int(b["ts_us"].iloc[-1]), int(b["event_id"].iloc[-1])) for b in held if b is not None)
        taken = []
        for i, b in enumerate(held):
            if b is None:
                continue
            n = _upto(b, last)
            if n:
                taken.append(b.iloc[:n])
            held[i] = b.iloc[n:] if n < len(b) else block(runs[i])
        yield _ordered(taken)


def sorted_pieces(rows: Iterator[pd.DataFrame], limit: int = PIECE_ROWS) -> Iterator[pd.DataFrame]:
    """All rows in (ts_us, event_id) order, as frames of bounded size.

    Up to `limit` rows are one frame. More are sorted in runs of that size,
    kept in a nameless scratch file of this task, and merged; a task that is
    lost takes the file along and is run again from the batch's own input.
    """
    held, count, runs = [], 0, []
    with tempfile.TemporaryFile() as file:
        def spill() -> None:
            run, sorted_run = [], _ordered(held)
            for first in range(0, len(sorted_run), max(1, limit // 16)):
                file.seek(0, 2)
                run.append(file.tell())
                pickle.dump(sorted_run.iloc[first:first + max(1, limit // 16)].reset_index(drop=True), file, pickle.HIGHEST_PROTOCOL)
            runs.append(run)

        for frame in rows:
            if not len(frame):
                continue
            held.append(frame)
            count += len(frame)
            if count > limit:
                spill()
                held, count = [], 0
        if not runs:
            if held:
                yield _ordered(held)
            return
        if held:
            spill()
            held = []
        yield from _merged(file, runs)


class Keyed(StatefulProcessor):
    """One value state per key; subclasses give its schema and the step over ordered rows, which may come in several pieces."""

    schema = ""
    empty: tuple = ()

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def step(self, key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.state.get()) if self.state.exists() else self.empty
        for piece in sorted_pieces(rows):
            out, state = self.step(key, piece, state)
            yield out
        self.state.update(state)

    def close(self) -> None:
        pass


class ChainAppend(Keyed):
    """Link events to the head of their case; rows older than the head are reported, not linked."""

    schema = "seq long, hash string, ts_us long, event_id long"
    empty = (0, "0" * 64, -(1 << 62), -1)

    def step(self, key, rows, state):
        seq, prev, ts, eid = state
        out = []
        for t, e, head, mid, tail in zip(rows["ts_us"], rows["event_id"], rows["head"], rows["mid"], rows["tail"]):
            if (t, e) <= (ts, eid):
                out.append((key[0], int(e), None, None, None, "OUT_OF_ORDER"))
                continue
            seq, ts, eid = seq + 1, int(t), int(e)
            digest = hashlib.sha256(f"{head}{prev}{mid}{seq}{tail}".encode()).hexdigest()
            out.append((key[0], eid, seq, prev, digest, "LINKED"))
            prev = digest
        cols = ["case_id", "id", "sequence_number", "previous_hash", "event_hash", "outcome"]
        done = pd.DataFrame(out, columns=cols).astype({"sequence_number": "Int64"})
        return done, (seq, prev, ts, eid)


def sorted_rows(rows: Iterator[Row], limit: int = PIECE_ROWS) -> Iterator[Row]:
    """Rows in (ts_us, event_id) order, nulls last; more than `limit` of them are sorted as pieces."""
    head = list(islice(rows, limit + 1))
    if len(head) <= limit:
        yield from sorted(head, key=lambda r: [(r[c] is None, r[c] or 0) for c in ORDER])
        return
    names = list(head[0].asDict())
    frames = (pd.DataFrame(part, columns=names) for part in chain([head], iter(lambda: list(islice(rows, 10_000)), [])))
    for piece in sorted_pieces(frames, limit):
        yield from (Row(**r) for r in piece.to_dict("records"))


class FirstWins(StatefulProcessor):
    """The first request of a key is NEW; later ones REPLAY it or CONFLICT with it.

    Keys are many and bring few rows each, so this one works on rows: a frame a key would cost more than its rows.
    """

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "fp string")

    def handleInputRows(self, key, rows, timerValues):
        found = self.state.get()
        known = fp = None if found is None else found[0]
        for r in sorted_rows(rows):
            yield Row(event_id=r.event_id, fp=r.fp, resolution="NEW" if fp is None else "REPLAY" if r.fp == fp else "CONFLICT")
            fp = r.fp if fp is None else fp
        if fp != known:
            self.state.update((fp,))

    def close(self) -> None:
        pass


class StatusChanges(Keyed):
    """Every status change outside the allowed table."""

    schema = "status string"
    empty = (None,)

    def __init__(self, allowed: dict[str, tuple[str, ...]]) -> None:
        self.allowed = allowed

    def step(self, key, rows, state):
        (old,) = state
        out = []
        for e, status in zip(rows["event_id"], rows["status"]):
            if old is not None and status not in self.allowed.get(old, ()):
                out.append((int(e), key[0], old, status))
            old = status
        return pd.DataFrame(out, columns=["event_id", "user_id", "old_status", "status"]), (old,)


class RetrySchedule(Keyed):
    """Failed dispatches raise the attempt and its delay; a success clears them."""

    schema = "attempt long"
    empty = (0,)

    def __init__(self, cap: int, max_power: int) -> None:
        self.cap, self.max_power = cap, max_power

    def step(self, key, rows, state):
        (attempt,) = state
        out = []
        for e, t, ok in zip(rows["event_id"], rows["ts_us"], rows["ok"]):
            attempt = 0 if ok else attempt + 1
            if not ok:
                delay = float(min(self.cap, 2 ** min(attempt, self.max_power)))
                out.append((int(e), attempt, delay, int(t) + int(delay * 1_000_000)))
        return pd.DataFrame(out, columns=["event_id", "attempt", "delay_s", "next_us"]), (attempt,)


class JobTimeout(Keyed):
    """A job open (queued or running) longer than the limit fails, at the next row or by event-time timer."""

    schema = "event_id long, since_us long"
    empty = (None, None)

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def _failed(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "event_id", "failed_us"])

    def step(self, key, rows, state):
        eid, since = state
        out = []
        for e, t, is_open in zip(rows["event_id"], rows["ts_us"], rows["is_open"]):
            if since is not None and t > since + self.limit_us:
                out.append((key[0], eid, since + self.limit_us))
            eid, since = (int(e), int(t)) if is_open else (None, None)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if since is not None:
            self.handle.registerTimer((since + self.limit_us) // 1000 + 1)
        return self._failed(out), (eid, since)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        eid, since = self.state.get() if self.state.exists() else self.empty
        self.state.update(self.empty)
        yield self._failed([(key[0], eid, since + self.limit_us)] if since is not None else [])
