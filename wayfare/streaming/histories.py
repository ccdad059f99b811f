"""Rolling histories of sessions from visits that arrive out of order, equal to those of the batch job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfare.functions.contracts import MAX_HISTORY

HISTORY_ROW = "raw_user_id string, session_id string, timestamp_utc timestamp, raw_poi_id string, category string, history_size int, history array<string>, late boolean"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VISIT = "at long, poi string, category string"


class Histories(StatefulProcessor):
    """State of a session, all of it in single entries, so that a batch writes only what it changes:

    * waiting: visits (with their number) that an earlier one may still come before;
    * ring: the latest `limit` visits in order, each in the slot of its number modulo limit;
    * clock: how many visits were passed on, and the latest one's time.

    A timer at the earliest waiting visit passes on, in order, all that lies below the watermark; a timer idle_us after the
    latest visit clears the session."""

    def __init__(self, limit: int, idle_us: int):
        self.limit, self.idle_us = limit, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", VISIT, "n int")
        self.ring = handle.getMapState("ring", "slot int", VISIT)
        self.clock = handle.getValueState("clock", "passed long, latest long")

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(at_us // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for r in rows:
            visit = (r["at"], r["raw_poi_id"], r["category"])
            if visit[0] < watermark:
                yield self._row(key, visit, [], True)
                continue
            n = self.waiting.getValue(visit)[0] if self.waiting.containsKey(visit) else 0
            self.waiting.updateValue(visit, (n + 1,))
            first = visit[0] if first is None else min(first, visit[0])
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [(tuple(k), n[0]) for k, n in self.waiting.iterator()]
        passed, latest = self.clock.get() if self.clock.exists() else (0, 0)
        due = sorted(w for w in waiting if w[0][0] < watermark)
        if due:
            held = {k[0]: v[1] for k, v in self.ring.iterator()}  # places by slot
            back = [held[i % self.limit] for i in range(max(0, passed - self.limit), passed)]
            for visit, n in due:
                self.waiting.removeKey(visit)
                for _ in range(n):
                    yield self._row(key, visit, back, False)
                    self.ring.updateValue((passed % self.limit,), visit)
                    back = [*back, visit[1]][-self.limit :]
                    passed, latest = passed + 1, visit[0]
            self.clock.update((passed, latest))
            self._wake(latest + self.idle_us)
        left = [k[0] for k, _ in waiting if k[0] >= watermark]
        if left:
            self._wake(min(left))
        elif passed and latest + self.idle_us < watermark:
            self.ring.clear()
            self.clock.clear()

    def close(self) -> None:
        pass

    def _row(self, key: tuple, visit: tuple, back: list[str], late: bool) -> Row:
        at = dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=visit[0])
        return Row(
            raw_user_id=key[0], session_id=key[1], timestamp_utc=at, raw_poi_id=visit[1], category=visit[2],
            history_size=None if late else len(back), history=None if late else back, late=late,
        )


def rolling_histories(events: DataFrame, lateness: str = "10 minutes", idle: str = "1 day", limit: int = MAX_HISTORY) -> DataFrame:
    """For each visit of a stream, the places of its session's latest visits before it (limit at most, oldest first). A visit is
    passed on when the watermark, lateness behind the latest time seen, has gone past it: so whatever the order of arrival, its
    history is the one that the batch job gives. Visits that arrive below the watermark come out with late = true and no
    history. A session without visits for the time of idle is forgotten. State is kept in RocksDB."""
    events.sparkSession.conf.set(STORE, ROCKS)
    idle_us = int(pd.Timedelta(idle).total_seconds() * 1_000_000)
    timed = events.withWatermark("timestamp_utc", lateness)
    # a plain number: rows below the watermark reach the state instead of being dropped
    visits = timed.select("raw_user_id", "session_id", F.unix_micros("timestamp_utc").alias("at"), "raw_poi_id", "category")
    return visits.groupBy("raw_user_id", "session_id").transformWithState(Histories(limit, idle_us), HISTORY_ROW, "append", "EventTime")
