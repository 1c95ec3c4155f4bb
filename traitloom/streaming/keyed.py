"""Keyed state with a lifetime: what has run out leaves by an event-time timer.

A verdict follows from the times of the rows alone. The timer only clears away state that no
row which is still to come in time can use, so results don't depend on when it fires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Timers need the state store that keeps its rows on disk; it is set for this session's queries from now on."""
    spark.conf.set(PROVIDER_KEY, PROVIDER)


class Lasting(StatefulProcessor):
    """One value for each key, with one timer at the end of its life."""

    def __init__(self, schema: str):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.schema}, until long")

    def held(self) -> tuple | None:
        return tuple(self.value.get())[:-1] if self.value.exists() else None

    def keep(self, value: tuple | None, until: float | None = None) -> None:
        """Set or clear the value; ``until`` is its last moment in seconds."""
        if self.value.exists():
            self.handle.deleteTimer(self.value.get()[-1])
        if value is None:
            self.value.clear()
            return
        end = int(until * 1000) + 1
        self.value.update((*value, end))
        self.handle.registerTimer(end)

    def close(self) -> None:
        pass


class Cache(Lasting):
    def __init__(self, max_age: float):
        super().__init__("fetched double")
        self.max_age = max_age

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.held(), []
        fetched = held and held[0]
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            hit = fetched is not None and row.at - fetched <= self.max_age
            fetched = fetched if hit else row.at
            out.append((key[0], row.seq, "hit" if hit else "miss"))
        self.keep((fetched,), fetched + self.max_age)
        yield pd.DataFrame(out, columns=["key", "seq", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.keep(None)
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "verdict": pd.Series(dtype="str")})


class Lease(Lasting):
    def __init__(self, lease: float):
        super().__init__("holder string, at double")
        self.lease = lease

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, out = self.held(), []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if active and row.at - active[1] > self.lease:
                out.append((key[0], None, active[0], "expired"))
                active = None
            if row.action == "claim":
                verdict = "skipped" if active else "claimed"
                active = active or (row.holder, row.at)
            else:
                verdict = "released" if active and active[0] == row.holder else "ignored"
                active = None if verdict == "released" else active
            out.append((key[0], row.seq, row.holder, verdict))
        self.keep(active, active and active[1] + self.lease)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        holder = self.held()[0]
        self.keep(None)
        yield self._frame([(key[0], None, holder, "expired")])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"slot": pd.Series([r[0] for r in rows], dtype="int64"), "seq": pd.Series([r[1] for r in rows], dtype="Int64"), "holder": [r[2] for r in rows], "verdict": [r[3] for r in rows]})


def cached(requests: DataFrame, max_age: float, delay: str = "1 hour") -> DataFrame:
    """Whether each request (key, seq, ts) is served from a cache or fetched anew, more than ``max_age`` seconds after the last fetch.

    A key's state is one time and goes once the watermark has passed its age. Rows of a key
    are taken in ``seq`` order within a trigger; rows later than ``delay`` are dropped.
    """
    timed = requests.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts") / 1e6)
    return timed.groupBy("key").transformWithStateInPandas(Cache(max_age), "key long, seq long, verdict string", "Append", "EventTime")


def leased(requests: DataFrame, lease: float, delay: str = "1 hour") -> DataFrame:
    """One active holder for each slot, for ``lease`` seconds at most: requests (slot, seq, ts, holder, action) and what becomes of them.

    A claim takes a free slot, a release by its holder frees it, others are skipped or ignored.
    A claim that is not released in time is ``expired``: that row, without a ``seq``, comes out
    once, by the next request or by the timer, whichever is first. State is one row for each
    slot that is held.
    """
    timed = requests.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts") / 1e6)
    return timed.groupBy("slot").transformWithStateInPandas(Lease(lease), "slot long, seq long, holder string, verdict string", "Append", "EventTime")
