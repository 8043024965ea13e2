"""The job queue and event sessions as streams with state.

`live_jobs` takes the events of a queue (enqueue, claim, heartbeat, done, fail, cancel) and emits each change of a job as it
happens. The jobs of one type are one state, as a claim takes the oldest of its type and nobody else may take it meanwhile;
timers in event time give up on what has not been heard of. A task keeps a bounded number of events and jobs in memory, however
large a batch or a queue is. `sessions` and `sliding` are windows with watermarks.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds without a sign of life after which a running job is queued again, claims after which it has failed, and how
#: long ended jobs are remembered (fixed values).
STALE, ATTEMPTS, KEPT = 90_000, 5, 24 * 3_600_000

EVENT = "type string, id string, at timestamp, event string, owner string, note string, no_retry boolean"
CHANGE = "type string, id string, at timestamp, state string, attempts int, owner string, why string"
_TOLD = CHANGE.replace("at timestamp", "ms long")
# Times are milliseconds, as timers are, but for the one by which jobs are queued: events a microsecond apart have an order.
_JOB = "state string, queued long, beat long, attempts int, owner string, ended long"


def in_order(rows: Iterable[tuple], held: int) -> Iterator[tuple]:
    """Rows by their first three columns. No more than `held` are sorted in memory; sorted runs of more rows go to a file of the
    task, where Spark keeps its own, and are merged from there piece by piece."""
    rows, ends, first = iter(rows), [0], lambda r: r[:3]
    run = sorted(islice(rows, held), key=first)
    if len(run) < held:
        yield from run
        return
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:
        while run:
            for k in range(0, len(run), 100):
                pickle.dump(run[k : k + 100], file)
            ends.append(file.tell())
            run = sorted(islice(rows, held), key=first)

        def read(at: int, end: int) -> Iterator[tuple]:
            while at < end:
                file.seek(at)
                piece = pickle.load(file)
                at = file.tell()
                yield from piece

        yield from heapq.merge(*map(read, ends, ends[1:]), key=first)


class Waiting:
    """The queued jobs of one type, (since, id, attempts) in order, in pages of state of at most `most` jobs. In memory are where
    each page begins and a few pages."""

    def __init__(self, pages, begins, most: int) -> None:
        self.pages, self.begins, self.most = pages, begins, most
        self.order = sorted((*b, n) for (n,), b in begins.iterator())  # (since, id, page)
        self.next = max((b[2] for b in self.order), default=-1) + 1
        self.loaded: dict[int, list[tuple]] = {}
        self.changed: set[int] = set()

    def _page(self, n: int) -> list[tuple]:
        page = self.loaded.pop(n, None)
        if page is None:
            page = list(zip(*self.pages.getValue((n,))))
        self.loaded[n] = page  # now the last one used
        if len(self.loaded) > 20:
            self._write(old := next(iter(self.loaded)))
            del self.loaded[old]
        return page

    def _write(self, n: int) -> None:
        if n in self.changed:
            self.changed.remove(n)
            self.pages.updateValue((n,), tuple(map(list, zip(*self.loaded[n]))))

    def _begin(self, k: int, page: list[tuple]) -> None:
        n, self.next = self.next, self.next + 1
        self.begins.updateValue((n,), page[0][:2])
        self.order.insert(k, (*page[0][:2], n))
        self.loaded[n] = page
        self.changed.add(n)

    def _drop(self, k: int, at: int) -> tuple:
        n = self.order[k][2]
        page = self._page(n)
        job = page.pop(at)
        self.changed.add(n)
        if not page:
            del self.order[k], self.loaded[n]
            self.changed.remove(n)
            self.begins.removeKey((n,))
            self.pages.removeKey((n,))
        return job

    def _at(self, since: int, id_: str) -> int:
        return max(bisect_right(self.order, (since, id_), key=lambda b: b[:2]) - 1, 0)

    def add(self, since: int, id_: str, attempts: int) -> None:
        if not self.order:
            return self._begin(0, [(since, id_, attempts)])
        k = self._at(since, id_)
        *begin, n = self.order[k]
        page = self._page(n)
        if len(page) >= self.most:
            if (since, id_) > page[-1][:2]:
                return self._begin(k + 1, [(since, id_, attempts)])
            half = len(page) // 2
            self._begin(k + 1, page[half:])
            del page[half:]
            self.changed.add(n)
            return self.add(since, id_, attempts)
        insort(page, (since, id_, attempts))
        self.changed.add(n)
        if (since, id_) < tuple(begin):
            self.order[k] = (since, id_, n)
            self.begins.updateValue((n,), (since, id_))

    def remove(self, since: int, id_: str) -> None:
        k = self._at(since, id_)
        self._drop(k, bisect_left(self._page(self.order[k][2]), (since, id_), key=lambda j: j[:2]))

    def oldest(self) -> tuple | None:
        return self._drop(0, 0) if self.order else None

    def close(self) -> None:
        for n in sorted(self.changed):
            self._write(n)


class Jobs:
    """The jobs of one type by id. The last ones put are in memory, `most` at most, and go to the state once however often they
    change. If the state had no jobs at first, names that were never put are known by a filter of fixed size and not asked for."""

    #: Bits of the filter, of which each name sets three.
    BITS = 1 << 27

    def __init__(self, state, most: int) -> None:
        self.state, self.most = state, most
        self.last: dict[str, list] = {}
        self.put_bits = None if state.exists() else bytearray(self.BITS // 8)

    def _places(self, id_: str) -> list[int]:
        n = hash(id_) & (1 << 64) - 1
        return [(n >> k) % self.BITS for k in (0, 20, 37)]

    def get(self, id_: str) -> list | None:
        if id_ in self.last:
            return list(self.last[id_])
        if self.put_bits is not None and not all(self.put_bits[k >> 3] & 1 << (k & 7) for k in self._places(id_)):
            return None
        return list(self.state.getValue((id_,))) if self.state.containsKey((id_,)) else None

    def put(self, id_: str, job: list) -> None:
        self.last.pop(id_, None)
        self.last[id_] = job  # now the last one put
        if self.put_bits is not None:
            for k in self._places(id_):
                self.put_bits[k >> 3] |= 1 << (k & 7)
        if len(self.last) > self.most:
            self._write(self.most // 2 + 1)

    def remove(self, id_: str) -> None:
        self.last.pop(id_, None)
        self.state.removeKey((id_,))

    def _write(self, n: int) -> None:
        for id_ in list(islice(self.last, n)):
            self.state.updateValue((id_,), tuple(self.last.pop(id_)))

    def close(self) -> None:
        self._write(len(self.last))


class Queue(StatefulProcessor):
    """The jobs of one type: each job by its id, the queued ones in order, and by each time at which a timer looks at some the
    jobs that it is for."""

    def __init__(self, held: int) -> None:
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.key = handle, None
        self.known = handle.getMapState("jobs", "id string", _JOB)
        self.pages = handle.getMapState("pages", "page long", "since array<long>, id array<string>, attempts array<int>")
        self.begins = handle.getMapState("begins", "page long", "since long, id string")
        self.watched = handle.getMapState("watched", "at long, part int", "id array<string>, parts int")

    def close(self) -> None:
        pass

    def _open(self, key: tuple) -> None:
        if self.key != key:
            self.key, self.waiting = key, Waiting(self.pages, self.begins, max(self.held // 100, 2))
            self.jobs = Jobs(self.known, max(self.held // 2, 1))
            self.watches: dict[int, list[str]] = {}
            self.n_watches = 0

    def _save(self) -> None:
        self.waiting.close()
        self.jobs.close()
        self._save_watches()

    def _told(self, id_: str, ms: int, job: list, why: str) -> tuple:
        return self.key[0], id_, ms, job[0], job[3], job[4], why

    def _watch(self, at: int, id_: str) -> None:
        self.watches.setdefault(at, []).append(id_)
        self.n_watches += 1
        if self.n_watches >= self.held // 10:
            self._save_watches()

    def _save_watches(self) -> None:
        for at, ids in self.watches.items():
            first = self.watched.getValue((at, 0)) if self.watched.containsKey((at, 0)) else None
            if first is None:
                self.watched.updateValue((at, 0), (ids, 1))
                self.handle.registerTimer(at)
            else:
                self.watched.updateValue((at, first[1]), (ids, 0))
                self.watched.updateValue((at, 0), (list(first[0]), first[1] + 1))
        self.watches, self.n_watches = {}, 0

    def _again(self, id_: str, job: list, us: int, ms: int, why: str) -> tuple:
        """A job that did not end well is queued again, or has failed after its last attempt."""
        over = job[3] >= ATTEMPTS
        job[0], job[1], job[4], job[5] = ("failed", job[1], None, ms) if over else ("queued", us, None, None)
        self.jobs.put(id_, job)
        if over:
            self._watch(ms + KEPT, id_)
        else:
            self.waiting.add(us, id_, job[3])
        return self._told(id_, ms, job, why)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._open(key)
        events = (e for part in rows for e in _events(part))
        yield from _frames(self._changes(in_order(events, self.held)))
        self._save()

    def _changes(self, events: Iterator[tuple]) -> Iterator[tuple]:
        for us, _, event, id_, owner, note, no_retry in events:
            ms = (us + 500) // 1000
            if event == "enqueue" and id_ is not None:
                if self.jobs.get(id_) is None:
                    job = ["queued", us, None, 0, None, None]
                    self.jobs.put(id_, job)
                    self.waiting.add(us, id_, 0)
                    yield self._told(id_, ms, job, "enqueued")
                continue
            if event == "claim":
                oldest = self.waiting.oldest()
                if oldest:
                    since, id_, attempts = oldest
                    job = ["running", since, ms, attempts + 1, owner, None]
                    self.jobs.put(id_, job)
                    self._watch(ms + STALE, id_)
                    yield self._told(id_, ms, job, "claimed")
                continue
            job = None if id_ is None else self.jobs.get(id_)
            if job is None or job[0] not in ("queued", "running", "cancelling"):
                continue
            elif event == "cancel":
                if job[0] == "queued":
                    self.waiting.remove(job[1], id_)
                    self._watch(ms + KEPT, id_)
                job[0], job[5] = ("cancelled", ms) if job[0] == "queued" else ("cancelling", job[5])
                self.jobs.put(id_, job)
                yield self._told(id_, ms, job, "cancelled")
            elif job[0] == "queued" or owner != job[4]:
                continue  # only the owner of a running job is heard
            elif event == "heartbeat":
                job[2] = max(job[2], ms)
                self.jobs.put(id_, job)
                self._watch(job[2] + STALE, id_)
            elif event == "done" or (event == "fail" and (no_retry or job[0] == "cancelling")):
                job[0], job[5] = ("cancelled" if job[0] == "cancelling" else "done" if event == "done" else "failed"), ms
                self.jobs.put(id_, job)
                self._watch(ms + KEPT, id_)
                yield self._told(id_, ms, job, note or event)
            elif event == "fail":
                yield self._again(id_, job, us, ms, note or "failed")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What the timer is for: running jobs not heard of for STALE, ended ones older than KEPT. Later signs of life have set
        timers of their own."""
        self._open(key)
        yield from _frames(self._expired(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self._save()

    def _expired(self, now: int, seen: int) -> Iterator[tuple]:
        if not self.watched.containsKey((now, 0)):
            return
        for part in range(self.watched.getValue((now, 0))[1]):
            ids = self.watched.getValue((now, part))[0]
            self.watched.removeKey((now, part))
            for id_ in ids:
                job = self.jobs.get(id_)
                if job is None:
                    continue
                if job[0] in ("running", "cancelling") and job[2] + STALE <= now:
                    if job[0] == "cancelling":
                        job[0], job[5] = "cancelled", now
                        self.jobs.put(id_, job)
                        self._watch(now + KEPT, id_)
                        yield self._told(id_, now, job, "stale")
                    else:
                        yield self._again(id_, job, now * 1000, now, "stale")
                if job[5] is not None and job[5] + KEPT <= seen:
                    self.jobs.remove(id_)


def _events(part: pd.DataFrame) -> Iterator[tuple]:
    part = part[["us", "id", "event", "owner", "note", "no_retry"]].astype(object)
    for us, id_, event, *more in part.where(part.notna(), None).itertuples(index=False, name=None):
        yield us, id_ or "", event or "", id_, *more


def _frames(changes: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    while part := list(islice(changes, 5000)):
        yield pd.DataFrame(part, columns=["type", "id", "ms", "state", "attempts", "owner", "why"])


def live_jobs(events: DataFrame, late: str = "0 seconds", held: int = 50_000) -> DataFrame:
    """CHANGE rows of a stream of EVENT rows. Events of one type are taken in order of time within a batch; a task sorts `held`
    of them in memory at a time."""
    timed = events.where("type is not null and at is not null").withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    told = timed.groupBy("type").transformWithStateInPandas(statefulProcessor=Queue(held), outputStructType=_TOLD, outputMode="Append", timeMode="EventTime", eventTimeColumnName="")
    return told.select("type", "id", F.timestamp_millis("ms").alias("at"), "state", "attempts", "owner", "why")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of each session of a stream (key, at): rows of a key less than a gap apart; late rows are dropped."""
    timed = events.withWatermark("at", late)
    found = timed.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding(events: DataFrame, key: str, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of each window of a stream (key, at), begun every `step`."""
    timed = events.withWatermark("at", late)
    found = timed.groupBy(F.window("at", size, step).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
