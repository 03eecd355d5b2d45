"""Changed files as a stream: what was handed on before is state, by file name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "filename string, hash string, seen long"
#: Spark's name of the store that keeps such state on disk, and the setting that chooses it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"


class Latest(StatefulProcessor):
    """Holds a file name's newest hash; hands on a hash that differs from it. A name unheard of for keep_ms is forgotten."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "hash string, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Of several versions of a file in one batch the last to be modified counts, ties to the greater hash.
        newest = max((m, h) for part in rows for m, h in zip(part["modified"].tolist(), part["hash"].tolist(), strict=True))
        before = self.held.get() if self.held.exists() else None
        # A file that comes late, older than what was handed on, changes nothing.
        late = before is not None and newest[0] < before[1]
        if not late:
            self.held.update((newest[1], newest[0]))
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        if not late and (before is None or before[0] != newest[1]):
            yield pd.DataFrame({"filename": [key[0]], "hash": [newest[1]], "seen": [newest[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> None:
    """State of this kind needs a store on disk; set it before the stream starts."""
    spark.conf.set(SETTING, STORE)


def changed_files(files: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """filename, hash, seen of each new or changed file of a stream (filename, hash, modificationTime), once a change.

    An unchanged file that comes again, from another folder or a listing begun anew, gives
    nothing. Contents aren't in the state; a name's state is two values. With keep_ms names
    are forgotten by timers, which keep a stream at work: give it a trigger that goes on.
    """
    rows = files.select("filename", "hash", F.unix_millis("modificationTime").alias("modified"))
    return rows.groupBy("filename").transformWithStateInPandas(Latest(keep_ms), OUT, "Append", "None" if keep_ms is None else "ProcessingTime")
