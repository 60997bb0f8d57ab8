"""Adaptive-threshold events on a stream, equal to the batch rule on the same rows.

State per key: the last values of the trailing window and the rows that the watermark has
not passed yet. Rows are taken in time order once the watermark has passed them, so the
order of arrival inside the allowed delay does not matter; later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.constants import ONSET_K, ONSET_WINDOW
from pulsegrid.functions.kernels import events_between

STATE = (
    "n bigint, tail array<double>, last_ms bigint, "
    "wait_us array<bigint>, wait_id array<bigint>, wait_x array<double>"
)


def stream_onsets(
    stream: DataFrame,
    key: str,
    ts: str,
    order_id: str,
    value: str,
    delay: str = "10 minutes",
    window: int = ONSET_WINDOW,
    k: float = ONSET_K,
) -> DataFrame:
    """Events `(key, t, x, threshold)` of a stream of `(key, ts, order_id, value)`.

    `ts` is a TIMESTAMP, or a TIMESTAMP_NTZ, which is read in the session's time zone.
    """
    rows = stream.select(
        F.col(key).alias("key"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(order_id).cast("bigint").alias("id"),
        F.col(value).cast("double").alias("x"),
    ).withWatermark("ts", delay)
    key_type = stream.schema[key].dataType.simpleString()

    def step(k_: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        n, tail, _, wait_us, wait_id, wait_x = (
            state.get if state.exists else (0, [], 0, [], [], [])
        )
        waiting = pd.DataFrame({"us": list(wait_us), "id": list(wait_id), "x": list(wait_x)})
        fresh = [
            pd.DataFrame(
                {"us": b["ts"].astype("datetime64[us]").astype("int64"), "id": b["id"], "x": b["x"]}
            )
            for b in batches
        ]
        pending = pd.concat([waiting, *fresh]).astype({"us": "int64", "id": "int64", "x": "float64"})
        pending = pending.sort_values(["us", "id"])
        passed = state.getCurrentWatermarkMs()
        ready = pending[pending["us"] < passed * 1000]
        rest = pending[pending["us"] >= passed * 1000]

        values = np.concatenate([np.asarray(tail, dtype=np.float64), ready["x"].to_numpy()])
        first = n - len(tail)
        events = events_between(values, first, n - 1, window, k)
        n += len(ready)
        state.update(
            (
                n,
                [float(v) for v in values[-window:]],
                passed,
                [int(v) for v in rest["us"]],
                [int(v) for v in rest["id"]],
                [float(v) for v in rest["x"]],
            )
        )
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["us"].min()) // 1000 + 1, passed + 1))
        yield pd.DataFrame(
            {
                "key": [k_[0]] * len(events),
                "t": np.array([p for p, _ in events], dtype=np.int64),
                "x": [float(values[p - first]) for p, _ in events],
                "threshold": [th for _, th in events],
            }
        )

    out = rows.groupBy("key").applyInPandasWithState(
        step,
        f"key {key_type}, t bigint, x double, threshold double",
        STATE,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return out.withColumnRenamed("key", key)
