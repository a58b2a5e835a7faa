"""Practice counters over a stream of first attempts (Structured Streaming).

A learner's state per KC is three numbers, so counters of an unbounded stream keep bounded state per
(student, kc). Late attempts beyond the watermark are dropped, as every later count would change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "obs_id long, student string, kc string, y int, seen long, s long, f long"


def stream_counters(attempts: DataFrame, *, watermark: str = "1 hour") -> DataFrame:
    """Each attempt (obs_id, student, kc, y, at) with the counts before it, in event-time order
    within a micro-batch; attempts of earlier batches come first."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, s = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "obs_id"])
        before = rows["y"].cumsum() - rows["y"]
        rows["seen"], rows["s"] = range(seen, seen + len(rows)), s + before
        rows["f"] = rows["seen"] - rows["s"]
        state.update((seen + len(rows), int(s + rows["y"].sum())))
        yield rows[["obs_id", "student", "kc", "y", "seen", "s", "f"]]

    timely = attempts.withWatermark("at", watermark)
    return timely.groupBy("student", "kc").applyInPandasWithState(step, OUT, "seen long, s long", "append", GroupStateTimeout.NoTimeout)


def windowed_success(attempts: DataFrame, *, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Success rate per KC and event-time window; a window is final once the watermark passes it."""
    grouped = attempts.withWatermark("at", watermark).groupBy(F.window("at", window), "kc")
    return grouped.agg(F.count("*").alias("n"), F.avg("y").alias("success_rate")).select("window.start", "window.end", "kc", "n", "success_rate")
