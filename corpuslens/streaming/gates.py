"""Rate limits and cooldowns as streams, with state that ends.

State is kept in the RocksDB store, which these processors need: start their
queries inside :func:`keyed_state`, or set that store for the session. Requests
come with the time ``t`` in microseconds as event time. The state of a key ends
when the watermark has passed the last moment at which it could hold anything back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class _Ending(StatefulProcessor):
    """Drops a key's state by an event-time timer, which each new batch of the key moves on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def ends_at(self, micros: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def _of_key(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch, which the source's options bound, in order."""
    return pd.concat(rows).sort_values(["t", "id"])


class _Limiter(_Ending):
    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sent = handle.getListState("sent", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = np.array([row[0] for row in self.sent.get()] if self.sent.exists() else [], np.int64)
        made = _of_key(rows)
        # A request waits for the one ``limit`` places before it: in a table of ``limit``
        # columns that is the one above, and a running maximum down the columns.
        place = np.arange(len(last) + len(made))
        steps = place // self.limit * self.window
        table = np.full((-(-len(place) // self.limit), self.limit), np.iinfo(np.int64).min, np.int64)
        table.flat[: len(place)] = np.concatenate([last, made["t"].to_numpy(np.int64)]) - steps
        times = np.maximum.accumulate(table, axis=0).flat[: len(place)] + steps
        self.sent.put([(int(t),) for t in times[-self.limit :]])
        self.ends_at(int(times[-1]) + self.window)
        yield made.assign(admit=times[len(last) :])[["key", "id", "t", "admit"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sent.clear()
        return iter([])


class _Gate(_Ending):
    def __init__(self, interval_us: int):
        self.interval = interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made = _of_key(rows)
        times = made["t"].to_numpy(np.int64)
        accepted, at = np.zeros(len(times), bool), 0
        if self.last.exists():
            at = int(np.searchsorted(times, self.last.get()[0] + self.interval))
        while at < len(times):
            accepted[at] = True
            at = int(np.searchsorted(times, times[at] + self.interval))
        if accepted.any():
            last = int(times[accepted][-1])
            self.last.update((last,))
            self.ends_at(last + self.interval)
        yield made.assign(accepted=accepted)[["key", "id", "t", "accepted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])


def _keyed(rows: DataFrame, processor: StatefulProcessor, added: str, delay: str) -> DataFrame:
    key_type = rows.schema["key"].dataType.simpleString()
    timed = rows.select("key", "id", "t", F.timestamp_micros("t").alias("at")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(
        processor, f"key {key_type}, id bigint, t bigint, {added}", "append", "eventTime"
    )


def stream_rate_limiter(requests: DataFrame, limit: int, window_us: int, delay: str = "1 minute") -> DataFrame:
    """Streaming form of :func:`corpuslens.operators.admission.admission_schedule`.

    ``requests`` has ``key, id, t``. The state of a key is its last ``limit`` admit
    times, until the watermark is a window past the last of them. Rows come in time
    order from one batch to the next, and are sorted here within a batch. The
    watermark drops rows without a time, of the epoch or before, or ``delay`` or more
    behind the newest of all keys in earlier batches; let it be a second at least.
    Bound a batch with the options of the source.
    """
    return _keyed(requests, _Limiter(limit, window_us), "admit bigint", delay)


def stream_cooldown_gate(runs: DataFrame, interval_us: int, delay: str = "1 minute") -> DataFrame:
    """Streaming form of :func:`corpuslens.operators.admission.cooldown_gate`.

    ``runs`` has ``key, id, t``. The state of a key is its last accepted time, until
    the watermark is an interval past it. A run that comes late, before the last
    accepted time or less than an interval behind it, is not accepted, and what was
    accepted stays so. For the rest see :func:`stream_rate_limiter`.
    """
    return _keyed(runs, _Gate(interval_us), "accepted boolean", delay)
