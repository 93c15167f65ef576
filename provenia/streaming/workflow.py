"""Workflows over a stream: stage and end of each in a value state, and a timer that ends it when its time to live is over.

The same steps as workspace.workflow_states, which sees only at the next choice that a workflow has expired; here the timer
says so once the watermark has passed, without another event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from provenia.operators.workspace import STAGES

OUTPUT = "workflow_id long, stage string, done boolean, at long"
_STATE = "stage int, saved long, end string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def advance(state: tuple[int, int, str], ms: int, choice: str, ttl_ms: int) -> tuple[int, int, str]:
    """(stage, when it was reached, end) after a choice."""
    stage, saved, end = state
    if end != "open":
        return state
    if ms - saved > ttl_ms:
        return stage, saved, "expired"
    if choice == "abort":
        return stage, saved, "aborted"
    if choice == "refine":
        return state
    return (stage, saved, "completed") if stage == len(STAGES) - 1 else (stage + 1, ms, "open")


class Workflows(StatefulProcessor):
    """One state and at most one timer a workflow."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("workflow", _STATE)

    def _row(self, key: tuple, state: tuple[int, int, str], at: int) -> pd.DataFrame:
        stage, _, end = state
        return pd.DataFrame({"workflow_id": [key[0]], "stage": [STAGES[stage] if end == "open" else end], "done": [end != "open"], "at": [at]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        some = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        old = tuple(self.state.get()) if self.state.exists() else None
        now = old or (0, int(some["ms"].iloc[0]), "open")
        for ms, choice in zip(some["ms"].tolist(), some["choice"].tolist(), strict=True):
            now = advance(now, ms, choice, self.ttl_ms)
        self.state.update(now)
        if old is not None and old[2] == "open":
            self.handle.deleteTimer(old[1] + self.ttl_ms)
        if now[2] == "open":
            self.handle.registerTimer(now[1] + self.ttl_ms)
        yield self._row(key, now, int(some["ms"].iloc[-1]))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stage, saved, end = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if end != "open" or at < saved + self.ttl_ms:  # of a stage that was left since
            return
        self.state.update((stage, saved, "expired"))
        yield self._row(key, (stage, saved, "expired"), at)

    def close(self) -> None:
        pass


def workflow_stream(choices: DataFrame, ttl_ms: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """Updates (workflow_id, stage, done, at) with each micro-batch, and when a time to live is over.

    choices: workflow_id, ts, event_id, choice. Choices of a micro-batch are taken in order of time; between micro-batches
    the source must deliver those of a workflow in order. ``late``: how far behind the newest event the watermark stays.
    """
    spark = choices.sparkSession
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = choices.select("workflow_id", "ts", "event_id", F.unix_millis("ts").alias("ms"), "choice").withWatermark("ts", late)
    return rows.groupBy("workflow_id").transformWithStateInPandas(Workflows(ttl_ms), OUTPUT, "Update", "EventTime")


def final_workflows(choices: DataFrame, sink: str, checkpoint: str, ttl_ms: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """Run over what the source has now, write updates as Parquet, and read each workflow's last one."""
    spark = choices.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    try:
        query = (
            workflow_stream(choices, ttl_ms, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(sink)).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    last = spark.read.parquet(sink).groupBy("workflow_id").agg(F.max_by(F.struct("stage", "done"), F.struct("batch", "at", "done")).alias("s"))
    return last.select("workflow_id", "s.stage", "s.done")
