"""Adaptive-threshold events on a stream, with state in parts and timers.

As `streaming.onsets`, but a key's waiting rows are not one array that each trigger sorts and writes anew. They are filed by time
bucket, in one part a trigger; a timer per bucket reads the bucket's parts once the watermark has passed its end. The work
of a trigger follows its new rows and the buckets that end, however many rows of the key wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pulsegrid.constants import ONSET_K, ONSET_WINDOW
from pulsegrid.functions.kernels import events_between


class OnsetProcessor(StatefulProcessor):
    """State of a key: the last values of the trailing window, and the waiting rows by bucket and part."""

    def __init__(self, bucket_ms: int, window: int, k: float):
        self.bucket_ms, self.window, self.k = bucket_ms, window, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trail = handle.getValueState("trail", "n long, tail array<double>")
        self.parts = handle.getMapState("parts", "bucket long, part long", "us array<long>, id array<long>, x array<double>")
        self.counts = handle.getMapState("counts", "bucket long", "parts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            us = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            kept = us >= passed
            us, ids, x = us[kept], batch["id"].to_numpy()[kept], batch["x"].to_numpy()[kept]
            bucket = us // (self.bucket_ms * 1000)
            for b in np.unique(bucket):
                mine = bucket == b
                at = (int(b),)
                part = self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0
                if not part:
                    self.handle.registerTimer((int(b) + 1) * self.bucket_ms)
                self.parts.updateValue((int(b), part), (us[mine].tolist(), ids[mine].tolist(), x[mine].tolist()))
                self.counts.updateValue(at, (part + 1,))
        yield pd.DataFrame({"key": [], "t": [], "x": [], "threshold": []})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() // self.bucket_ms
        # Timers of one trigger may come in any order: each takes all buckets up to its own, the later ones then find none.
        for b in sorted(k[0] for k in self.counts.keys() if k[0] < due):
            yield self._close(key, b)

    def _close(self, key, bucket: int) -> pd.DataFrame:
        """The events that the rows of a bucket settle."""
        columns = ([], [], [])
        for part in range(self.counts.getValue((bucket,))[0]):
            for column, more in zip(columns, self.parts.getValue((bucket, part)), strict=True):
                column.append(np.asarray(more))
            self.parts.removeKey((bucket, part))
        self.counts.removeKey((bucket,))
        us, ids, x = (np.concatenate(c) for c in columns)
        fresh = x[np.lexsort((ids, us))].astype(np.float64)
        n, tail = self.trail.get() if self.trail.exists() else (0, [])
        values = np.concatenate([np.asarray(tail, dtype=np.float64), fresh])
        first = n - len(tail)
        events = events_between(values, first, n - 1, self.window, self.k)
        self.trail.update((n + len(fresh), values[-self.window :].tolist()))
        return pd.DataFrame(
            {
                "key": [key[0]] * len(events),
                "t": np.array([p for p, _ in events], dtype=np.int64),
                "x": [float(values[p - first]) for p, _ in events],
                "threshold": [th for _, th in events],
            }
        )


def stream_onsets(
    stream: DataFrame,
    key: str,
    ts: str,
    order_id: str,
    value: str,
    delay: str = "10 minutes",
    bucket_ms: int = 60_000,
    window: int = ONSET_WINDOW,
    k: float = ONSET_K,
) -> DataFrame:
    """Events `(key, t, x, threshold)` of a stream of `(key, ts, order_id, value)`, equal to the batch rule on the same rows.

    Rows count in the order of time and id once the watermark has passed the end of their bucket of `bucket_ms`; rows behind the
    watermark are dropped. `ts` is a TIMESTAMP, or a TIMESTAMP_NTZ, which is read in the session's time zone. Needs the
    RocksDB state store, which `session.build_session` sets.
    """
    rows = stream.select(
        F.col(key).alias("key"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(order_id).cast("bigint").alias("id"),
        F.col(value).cast("double").alias("x"),
    ).withWatermark("ts", delay)
    kind = stream.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(
        OnsetProcessor(bucket_ms, window, k), f"key {kind}, t bigint, x double, threshold double", "append", "eventTime"
    )
    return out.withColumnRenamed("key", key)
