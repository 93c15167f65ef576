"""The agent monitor over a stream: the same transitions as the batch fold, with state per session."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provenia.operators.monitor import STATES as ALL
from provenia.operators.monitor import step

STATES = "session_id long, state string, n_events long"


def fold(state: str, events: list[str]) -> str:
    """The state after all events: each kind is a map of states to states, and maps are composed pair by pair."""
    kinds, code = np.unique(np.array(events, dtype=object).astype(str), return_inverse=True)
    maps = np.array([[ALL.index(step(s, str(k))) for s in ALL] for k in kinds]).reshape(len(kinds), len(ALL))[code]
    while len(maps) > 1:
        odd = maps[len(maps) // 2 * 2 :]
        maps = np.concatenate([np.take_along_axis(maps[1::2], maps[0 : len(maps) // 2 * 2 : 2], axis=1), odd])
    return ALL[maps[0][ALL.index(state)]] if len(maps) else state


def stream_states(events: DataFrame, late: str | None = None) -> DataFrame:
    """Updates (session_id, state, n_events) of each session with each micro-batch.

    events: session_id, ts, event_id, type. Events of a micro-batch are taken in order of time. Without ``late``, sources
    must deliver the events of a session in order between micro-batches, as the batch fold does by sorting. With it,
    such as "10 minutes", an event may come that much after others of a later time: events wait in the state until the
    watermark has passed them, and an update folds the waiting ones provisionally. What comes later still is lost.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settled, n, at, ids, kinds = state.get if state.exists else ("idle", 0, [], [], [])
        waiting = list(zip(at, ids, kinds, strict=True))
        for rows in parts:
            micros = rows["ts"].astype("datetime64[us]").astype("int64")
            waiting += zip(micros.tolist(), rows["event_id"].tolist(), rows["type"].tolist(), strict=True)
            n += len(rows)
        waiting.sort(key=lambda w: w[:2])
        passed = state.getCurrentWatermarkMs() * 1000 if late else None
        ready = len(waiting) if passed is None else bisect_right([w[0] for w in waiting], passed)
        settled = fold(settled, [w[2] for w in waiting[:ready]])
        waiting = waiting[ready:]
        state.update((settled, n, *([w[k] for w in waiting] for k in range(3))))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], passed) // 1000 + 1)
        yield pd.DataFrame({"session_id": [key[0]], "state": [fold(settled, [w[2] for w in waiting])], "n_events": [n]})

    slim = events.select("session_id", "ts", "event_id", "type")
    slim = slim.withWatermark("ts", late) if late else slim
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    kept = "state string, n long, at array<long>, ids array<long>, kinds array<string>"
    return slim.groupBy("session_id").applyInPandasWithState(update, STATES, kept, "update", timeout)


def final_stream_states(events: DataFrame, sink: str, checkpoint: str, late: str | None = None) -> DataFrame:
    """Run over what the source has now, write updates as Parquet, and read each session's last state."""
    spark = events.sparkSession
    query = (
        stream_states(events, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(sink)).start()
    )
    query.awaitTermination()
    last = spark.read.parquet(sink).groupBy("session_id").agg(F.max_by(F.struct("state", "n_events"), F.struct("batch", "n_events")).alias("s"))
    return last.select("session_id", "s.state", "s.n_events")
