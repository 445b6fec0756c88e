"""Running scores over a stream: the batch window's streaming counterpart, with a watermark and state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by key and tumbling window; rows later than the watermark are dropped, windows close behind it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("window.start", "window.end", key, "n", "total")


def running_score(events: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """W3 over micro-batches: each event of a key with the number of flagged events up to it, state kept by key. Events
    of one batch are put in order; a later batch's events count after those before it."""
    kind = events.schema[key].dataType.simpleString()
    order_kind = events.schema[order].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        score = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        rows["score"] = score + rows[flag].astype("int64").cumsum()
        if len(rows):
            state.update((int(rows["score"].iloc[-1]),))
        yield rows[[key, order, "score"]]

    return events.select(key, order, flag).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {order_kind}, score long", "score long", "append", "NoTimeout")
