"""Keyed state in RocksDB: one small state per key, read and written only for the keys that a batch touches.

What a batch costs follows its rows, not the history: earlier answers, places and buffers are looked up by key. Timers run on
event time, so a stream that is read again from its checkpoint does the same again.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from opslens.operators.jobs import TERMINAL

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, time: str = "None") -> DataFrame:
    """Rows that `processor` makes of the rows of each key."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(key).transformWithState(processor, schema, mode, time)


def keyed_frames(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, time: str = "None") -> DataFrame:
    """As `keyed`, with pandas frames in and out: rows leave frame by frame, where `keyed` gathers all rows of a call before they leave."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, time)


class HandleOnce(StatefulProcessor):
    """Handles a key until its status is ok; `handle(key, attempt)` gives status and metadata.

    With `max_attempts` the status may be defer: a timer tries again `retry_ms` of event time later, deliveries meanwhile
    change nothing, and a key deferred at its last attempt becomes an error. A later delivery tries an error again, from the first attempt.
    """

    def __init__(self, handle: Callable[[str, int], tuple[str, str]], max_attempts: int = 1, retry_ms: int = 0) -> None:
        self.handle, self.max_attempts, self.retry_ms = handle, max_attempts, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle
        self.item = handle.getValueState("item", "status STRING, attempts LONG")

    def _attempt(self, key: str, attempts: int, now_ms: int) -> Iterator[Row]:
        status, metadata = self.handle(key, attempts)
        if status == "defer" and attempts < self.max_attempts:
            self.item.update(("defer", attempts))
            self.store.registerTimer(now_ms + self.retry_ms)
            return
        status = "error" if status == "defer" else status
        self.item.update((status, attempts))
        yield Row(key=key, status=status, attempts=attempts, metadata=metadata)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        status = self.item.get()[0] if self.item.exists() else None
        latest = max((r["at_ms"] for r in rows), default=0)
        if status not in ("ok", "defer"):
            yield from self._attempt(key[0], 1, latest)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        status, attempts = self.item.get() if self.item.exists() else (None, 0)
        if status == "defer":
            yield from self._attempt(key[0], attempts + 1, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


class OrderedCaptures(StatefulProcessor):
    """Holds the captures of a session until the watermark has passed them, then goes through them in order of arrival: counts page
    loads, and lets the first delivery of each sequence number of a load through. Only the numbers of the current load are remembered.

    A session may hold far more than a task can. Captures are kept in runs of about `run` characters, each sorted by arrival and cut into
    pieces of about `piece` characters; the runs are merged with one piece of each in memory, and rows leave in frames of about that size.
    For `keyed_frames`, whose numbers come as texts, so that nulls do not make floats of them.
    """

    def __init__(self, run: int = 8 << 20, piece: int = 256 << 10) -> None:
        self.run, self.piece = run, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle
        columns = "arrivals ARRAY<LONG>, times ARRAY<LONG>, paths ARRAY<STRING>, seqs ARRAY<LONG>, loads ARRAY<BOOLEAN>, urls ARRAY<STRING>, bodies ARRAY<STRING>"
        self.pieces = handle.getMapState("pieces", "run LONG, piece LONG", columns)
        self.runs = handle.getMapState("runs", "run LONG", "pieces LONG, due LONG")
        self.place = handle.getValueState("place", "gen LONG, due LONG, runs LONG")
        self.seen = handle.getMapState("seen", "seq LONG", "arrival LONG")

    def _place(self) -> tuple[int, int | None, int]:
        return tuple(self.place.get()) if self.place.exists() else (0, None, 0)

    @staticmethod
    def _size(row: tuple) -> int:
        return 200 + sum(len(v) for v in (row[2], row[5], row[6]) if v)

    def _keep(self, rows: list[tuple], run: int) -> int:
        """Writes rows as run number `run`; gives its earliest time."""
        pieces, some, size = 0, [], 0
        for n, row in enumerate(sorted(rows, key=lambda r: r[0]), 1):
            some.append(row)
            size += self._size(row)
            if size >= self.piece or n == len(rows):
                self.pieces.updateValue((run, pieces), tuple(map(list, zip(*some, strict=True))))
                pieces, some, size = pieces + 1, [], 0
        due = min(r[1] for r in rows)
        self.runs.updateValue((run,), (pieces, due))
        return due

    def _take(self, run: int, pieces: int) -> Iterator[tuple]:
        """The rows of a run, which is forgotten piece by piece."""
        for piece in range(pieces):
            yield from zip(*self.pieces.getValue((run, piece)), strict=True)
            self.pieces.removeKey((run, piece))

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues: TimerValues) -> Iterator:
        gen, due, run = self._place()
        new, size, first = [], 0, None
        text = lambda v: v if isinstance(v, str) else None
        for frame in rows:
            for r in frame.itertuples(index=False):
                body, is_load, seq = text(r.body), r.is_load is not None and r.is_load == True, text(r.seq)  # noqa: E712
                if not is_load and body is None:
                    continue
                new.append((int(r.arrival), int(r.at_ms), text(r.path), None if seq is None else int(seq), is_load, text(r.url), body))
                size += self._size(new[-1])
                if size >= self.run:
                    earliest = self._keep(new, run)
                    first = earliest if first is None else min(first, earliest)
                    new, size, run = [], 0, run + 1
        if new:
            earliest = self._keep(new, run)
            first, run = earliest if first is None else min(first, earliest), run + 1
        if first is not None:
            if due is None or first < due:
                self.store.registerTimer(first)
                due = first
            self.place.update((gen, due, run))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator:
        import pandas as pd

        names = ("session_id", "gen", "arrival", "path", "seq", "url", "body")
        passed = timerValues.getCurrentWatermarkInMs()
        gen, _, number = self._place()
        runs = sorted((r[0], *v) for r, v in self.runs.iterator())
        ready = [(run, pieces) for run, pieces, due in runs if due <= passed]
        dues = [due for _, _, due in runs if due > passed]
        for run, _ in ready:
            self.runs.removeKey((run,))
        seen, fresh, loaded = {k[0] for k in self.seen.keys()}, [], False
        out, size, later, later_size = [], 0, [], 0
        for row in heapq.merge(*(self._take(run, pieces) for run, pieces in ready), key=lambda r: r[0]):
            arrival, at_ms, path, seq, is_load, url, body = row
            if at_ms > passed:
                later.append(row)
                later_size += self._size(row)
                if later_size >= self.run:
                    dues.append(self._keep(later, number))
                    later, later_size, number = [], 0, number + 1
                continue
            if is_load:
                gen, seen, fresh, loaded = gen + 1, set(), [], True
            if body is None or seq in seen:
                continue
            if seq is not None:
                seen.add(seq)
                fresh.append((seq, arrival))
            out.append((key[0], gen, str(arrival), path, None if seq is None else str(seq), url, body))
            size += self._size(row)
            if size >= self.piece:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)
        if later:
            dues.append(self._keep(later, number))
            number += 1
        if loaded:
            self.seen.clear()
        for seq, arrival in fresh:
            self.seen.updateValue((seq,), (arrival,))
        due = min(dues, default=None)
        if due is not None:
            self.store.registerTimer(due)
        self.place.update((gen, due, number))

    def close(self) -> None:
        pass


class Positions(StatefulProcessor):
    """Position of every row of a key by (time, id), also for rows that come late: positions that move are given again.

    Rows stand in sorted pieces of at most `piece` rows, found by their first row. A batch reads the sizes of the pieces and the pieces from its
    earliest row on, so rows that come in order touch the last piece only.
    """

    def __init__(self, piece: int = 1024) -> None:
        self.piece = piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getMapState("pieces", "s LONG, id LONG", "times ARRAY<LONG>, ids ARRAY<LONG>")
        self.sizes = handle.getMapState("sizes", "s LONG, id LONG", "n LONG")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = sorted((-1 if r["sent_s"] is None else r["sent_s"], r["message_id"]) for r in rows)
        sizes = {tuple(k): n[0] for k, n in self.sizes.iterator()}
        firsts = sorted(sizes)
        by_piece: dict[int, list] = {}
        for row in new:
            by_piece.setdefault(max(bisect_right(firsts, row) - 1, 0), []).append(row)
        start = min(by_piece)
        position = sum(sizes[f] for f in firsts[:start])
        moved = False
        for number in range(start, max(len(firsts), 1)):
            first = firsts[number] if firsts else None
            held = list(zip(*self.pieces.getValue(first), strict=True)) if first else []
            if number in by_piece:
                fresh = by_piece[number]
                known = len(held)
                held = sorted(held + fresh)
                place = bisect_right(held, fresh[0]) - 1 if not moved else 0
                if first and (held[0] != first or known + len(fresh) > self.piece):
                    self.pieces.removeKey(first)
                    self.sizes.removeKey(first)
                size = len(held) if len(held) <= self.piece else self.piece // 2
                for a in range(0, len(held), size):
                    some = held[a : a + size]
                    self.pieces.updateValue(some[0], tuple(map(list, zip(*some, strict=True))))
                    self.sizes.updateValue(some[0], (len(some),))
                moved = True
            else:
                place = 0
            for at in range(place, len(held)):
                s, i = held[at]
                yield Row(identity=key[0], message_id=i, sent_s=None if s == -1 else s, position=position + at + 1)
            position += len(held)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


class JobPhase(StatefulProcessor):
    """Phase of a job: the earliest terminal one by (time, seq), else the latest. A job idle for `ttl_ms` behind the watermark is
    given a last time, as expired, and forgotten.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle
        self.job = handle.getValueState("job", "last_us LONG, last_seq LONG, last_phase STRING, end_us LONG, end_seq LONG, end_phase STRING, events LONG")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = tuple(self.job.get()) if self.job.exists() else None
        last, end, count = (known[:3], known[3:6], known[6]) if known else (None, (None, None, None), 0)
        before = last
        for r in rows:
            row = (r["us"], r["seq"], r["phase"])
            count += 1
            if last is None or row[:2] >= tuple(last[:2]):
                last = row
            if row[2] in TERMINAL and (end[0] is None or row[:2] < tuple(end[:2])):
                end = row
        self.job.update((*last, *end, count))
        if before is None or before[0] != last[0]:
            if before is not None:
                self.store.deleteTimer(before[0] // 1000 + self.ttl_ms)
            self.store.registerTimer(last[0] // 1000 + self.ttl_ms)
        yield Row(job_id=key[0], phase=end[2] or last[2], events=count, expired=False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.job.exists():
            known = tuple(self.job.get())
            self.job.clear()
            yield Row(job_id=key[0], phase=known[5] or known[2], events=known[6], expired=True)

    def close(self) -> None:
        pass
