"""A sliding-window limiter of a stream that keeps state no longer than it counts.

Each key's accepted times are a value of keyed state. A timer on event time clears a key's state when its last accepted
time has left the window, so state is as large as the keys of one window and not as all keys ever seen. Rows that come
later than the watermark are dropped by Spark before they get here; those within it are taken in order of time within
their batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import LIMIT, WINDOW, admit


class Limiter(StatefulProcessor):
    """id, key, allowed of rows(id, key, at), and with `told` a row without id when a key's state is cleared."""

    def __init__(self, limit: int, window: float, told: bool):
        self.limit, self.window, self.told = limit, window, told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<double>, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get()
        times, timer = (list(state[0]), state[1]) if state else ([], -1)
        batch = pd.concat(list(rows)).assign(t=lambda r: r["at"].astype("datetime64[us]").astype("int64") / 1e6).sort_values(["t", "id"], kind="stable")
        allowed = []
        for t in batch["t"]:
            ok, times = admit(times, float(t), self.limit, self.window)
            allowed.append(ok)
        # one timer a key, at the end of the last accepted time's window
        due = int((times[-1] + self.window) * 1000) + 1
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.held.update((times, due))
        yield pd.DataFrame({"id": batch["id"].astype("Int64"), "key": key[0], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        if self.told:
            yield pd.DataFrame({"id": pd.array([None], "Int64"), "key": [key[0]], "allowed": pd.array([None], "boolean")})

    def close(self) -> None:
        pass


def limited(events: DataFrame, limit: int = LIMIT, window: float = WINDOW, late: str = "1 minute", told: bool = False) -> DataFrame:
    """id, key, allowed of a stream of events(id long, key string, at timestamp): at most `limit` accepted within `window` seconds.

    State is kept by RocksDB, which this sets in the session if another provider is set there. A key's rows of one batch meet
    in one task, as each hangs on those before it.
    """
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    rows = events.select(F.col("id").cast("long").alias("id"), F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limit, window, told), "id long, key string, allowed boolean", "Append", "EventTime")
