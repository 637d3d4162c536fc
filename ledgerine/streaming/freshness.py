"""Identifiers that become stale, as a stream: a timer for each, set anew by every update."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import MAX_AGE_DAYS

DAY = 86_400_000_000


def gone_stale(updates: DataFrame, key: str = "id", at: str = "updated_at", days: int = MAX_AGE_DAYS) -> DataFrame:
    """(key, updated_at) for each identifier of a stream of updates once it is more than ``days`` days old by the stream's event time.

    The state of an identifier is its newest time, so it is a few bytes; updates of a batch are reduced before they come to it. An age of exactly ``days``
    days is fresh: timers go off when the watermark has passed that age. An identifier that went stale has no state; its next update begins
    anew. Null times are ignored, a null identifier is one.
    """
    kind = updates.schema[key].dataType.simpleString()

    def one(given: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            newest = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [given[0]], "micros": [newest]})
            return
        newest = max((int(p["micros"].max()) for p in parts if len(p)), default=None)
        if state.exists:
            newest = state.get[0] if newest is None else max(newest, state.get[0])
        if newest is None:
            return
        due = (newest + days * DAY) // 1000  # a timer goes off once the watermark, in milliseconds, is above it
        if due < state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [given[0]], "micros": [newest]})
            return
        state.update((newest,))
        state.setTimeoutTimestamp(due)

    timed = updates.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "0 seconds")
    rows = timed.select(F.col(key), F.col(at), F.unix_micros(at).alias("micros"))
    out = rows.groupBy(key).applyInPandasWithState(one, T._parse_datatype_string(f"`{key}` {kind}, micros long"), T._parse_datatype_string("newest long"), "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("micros").alias("updated_at"))
