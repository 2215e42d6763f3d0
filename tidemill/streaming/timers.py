"""Streams that act when nothing comes: event-time timers over keyed state.

Within a batch Spark hands over rows before expired timers, so rows decide by their own times, and timers only act for keys that no
row has settled. Rows come in order of time over batches, ties and disorder within one are sorted out; what a key's state holds
goes when its timer does.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_store(spark: SparkSession):
    """The state store that timers need, for the queries started inside."""
    keys = {STORE: ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _timed(rows: DataFrame, time: str) -> DataFrame:
    """rows with an instant `_at` for the watermark; those with no key or time are only for the clock."""
    return rows.withColumn("_at", F.timestamp_seconds(F.col(time))).withWatermark("_at", "0 seconds")


class _Timed(StatefulProcessor):
    def _arm(self, seconds: int) -> None:
        self.handle.registerTimer(int(seconds) * 1000)

    def close(self) -> None:
        pass


class _Readiness(_Timed):
    def __init__(self, kinds: int, wait: int, patience: int):
        self.kinds, self.wait, self.patience = kinds, wait, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "kind string", "known long")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        end, done = key[0], self.done.exists()
        if not self.seen.exists() and not done:
            self._arm(end + self.patience)
        for row in sorted(rows, key=lambda r: r.known):
            if done or row.known > end + self.patience or self.seen.containsKey((row.kind,)):
                continue
            self.seen.updateValue((row.kind,), (row.known,))
            known = [v[0] for v in self.seen.values()]
            if len(known) == self.kinds:
                late, done = max(known) > end + self.wait, True
                self.done.update((True,))
                self.seen.clear()
                yield Row(end=end, state="late" if late else "ready", decided=end + self.wait if late else max(known))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.done.exists():
            yield Row(end=key[0], state="missing", decided=key[0] + self.patience)
        self.done.clear()
        self.seen.clear()


def readiness(arrivals: DataFrame, kinds: int, wait: int = 600, patience: int = 21_600) -> DataFrame:
    """(end, state, decided) of each hour's end in a stream (end, kind, known): ready when all kinds are known, if they are `wait`
    seconds after its end at the latest; late if they are known later; missing after `patience`. An hour is decided once."""
    return _timed(arrivals, "known").groupBy("end").transformWithState(_Readiness(kinds, wait, patience), "end long, state string, decided long", "append", "eventTime")


class _Silence(_Timed):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, silent boolean")

    def _edges(self, key, at: list, edges: list) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(at), "t": np.array(at, np.int64), "edge": edges})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        before, silent = self.last.get() if self.last.exists() else (None, False)
        times = np.unique(np.concatenate([np.unique(chunk["t"].dropna().to_numpy(np.int64)) for chunk in rows]))
        if not len(times):
            return
        if before is not None:  # a beat older than the last changes nothing but that the key is heard of
            times = np.concatenate([[before], times[times > before]])
            self.handle.deleteTimer((before + self.limit) * 1000)
        gaps = np.flatnonzero(np.diff(times) > self.limit)
        silences = gaps[1:] if silent and len(gaps) and gaps[0] == 0 else gaps  # the first was told when its timer expired
        if len(gaps):
            yield self._edges(key, [*(times[silences] + self.limit), *times[gaps + 1]], ["silent"] * len(silences) + ["back"] * len(gaps))
        last = int(times[-1])
        self._arm(last + self.limit)
        self.last.update((last, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, silent = self.last.get()
        if not silent and expiredTimerInfo.getExpiryTimeInMs() == (last + self.limit) * 1000:
            self.last.update((last, True))
            yield self._edges(key, [last + self.limit], ["silent"])


def silence_alerts(beats: DataFrame, limit: int) -> DataFrame:
    """(key, t, edge) of a stream of beats (key, t): silent when a key has not been heard of for over `limit` seconds, once, and
    back when it is again. A batch's beats of a key are one array of distinct times."""
    return _timed(beats, "t").groupBy("key").transformWithStateInPandas(_Silence(limit), "key string, t long, edge string", "append", "eventTime")


class _First(StatefulProcessor):
    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "value double", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        have = self.first.get()[0] if self.first.exists() else None
        for row in sorted(rows, key=lambda r: (r.t, r.id)):
            if have is None:
                have = row.value
                self.first.update((have,))
                yield Row(key=key[0], id=row.id, value=row.value, route="accepted")
            elif row.value != have:
                yield Row(key=key[0], id=row.id, value=row.value, route="revision")

    def close(self) -> None:
        pass


def first_accepted(rows: DataFrame, ttl: int | None = None) -> DataFrame:
    """(key, id, value, route) of a stream (key, t, id, value): the first value of a key is accepted, later ones that differ are
    revisions of it, equal ones leave no trace. Rows with a null are left out. With a ttl (milliseconds) a key is forgotten so
    long after it was accepted; else its state stays."""
    mode = "none" if ttl is None else "processingTime"
    return rows.dropna().groupBy("key").transformWithState(_First(ttl), "key string, id long, value double, route string", "append", mode)


class _Pending(_Timed):
    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "id long", "t long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        before = {id_: t for (id_,), (t,) in self.open.iterator()}
        held = dict(before)  # state is read and written once a batch, only for what stays open
        for row in sorted(rows, key=lambda r: (r.t, r.id is None)):  # an order sees a bar of its own time
            if row.id is not None:
                held[row.id] = row.t
                continue
            for id_, t in held.items():
                yield Row(id=id_, waited=min(row.t - t, self.patience), status="OPEN" if row.t - t <= self.patience else "CANCELLED")
            held = {}
        for id_ in before.keys() - held.keys():
            self.open.removeKey((id_,))
        for id_, t in held.items():
            if before.get(id_) != t:
                self.open.updateValue((id_,), (t,))
                self._arm(t + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.patience
        for (id_,), (t,) in list(self.open.iterator()):
            if t <= due:
                self.open.removeKey((id_,))
                yield Row(id=id_, waited=self.patience, status="CANCELLED")


def pending_orders(rows: DataFrame, patience: int = 3600) -> DataFrame:
    """(id, waited, status) of each order in a stream (key, t, id), in which rows without an id are bars: OPEN with the first bar of
    its key at its time or after, CANCELLED if none comes within `patience` seconds."""
    return _timed(rows, "t").groupBy("key").transformWithState(_Pending(patience), "id long, waited long, status string", "append", "eventTime")
