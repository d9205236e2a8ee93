"""Append-once as keyed state: rows of a condition wait in state until all that it expects are there, then they are written together, once.

The result is not read again to see what it has: the state knows, and the checkpoint keeps it over restarts. Redelivered rows are known by their unique columns. What does
not complete in time is given out as partial, and what comes after that as late, so that nothing is lost and no part passes for a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state's store, and no batches without rows, which timers would have run for ever where a stream is to end; timers are looked at in each batch of rows.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
OPEN, DONE, EXPIRED = "open", "done", "expired"


class Conditions(StatefulProcessor):
    """State of a condition: its status with the number of rows it has and expects, and its rows by their unique columns, as long as it is open."""

    def __init__(self, schema: T.StructType, keys: list[str], unique: list[str], expected: str, patience_ms: int):
        self.schema, self.keys, self.unique, self.expected, self.patience = schema, keys, unique, expected, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "status string, n long, expected long")
        self.rows = handle.getMapState("rows", T.StructType([self.schema[c] for c in self.unique]), self.schema)

    def _given(self, rows: list[tuple], status: str) -> Iterator[Row]:
        for r in rows:
            yield Row(**dict(zip(self.schema.names, r, strict=True)), status=status)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        if initialState["n"] != initialState["expected"]:
            raise ValueError(f"partial append: {key} has {initialState['n']} rows of {initialState['expected']}")
        self.about.update((DONE, initialState["n"], initialState["expected"]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, n, expected = self.about.get() if self.about.exists() else (OPEN, 0, None)
        if status == DONE:
            return
        if status == EXPIRED:
            yield from self._given([tuple(r) for r in rows], "late")
            return
        fresh = n == 0
        for r in rows:
            if expected is not None and r[self.expected] != expected:
                raise ValueError(f"{key} expects {expected} rows and {r[self.expected]}")
            expected, at = r[self.expected], tuple(r[c] for c in self.unique)
            if not self.rows.containsKey(at):
                self.rows.updateValue(at, tuple(r))
                n += 1
        if n > expected:
            raise ValueError(f"{key} expects {expected} rows and has {n}")
        if n == expected:
            yield from self._given([tuple(v) for _, v in self.rows.iterator()], "complete")
            self._close(DONE, n, expected)
            return
        self.about.update((OPEN, n, expected))
        if fresh:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, n, expected = self.about.get()
        if status == OPEN:
            yield from self._given([tuple(v) for _, v in self.rows.iterator()], "partial")
            self._close(EXPIRED, n, expected)

    def _close(self, status: str, n: int, expected: int) -> None:
        self.rows.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.about.update((status, n, expected))

    def close(self) -> None:
        pass


def whole_conditions(stream: DataFrame, keys: list[str], unique: list[str], expected: str = "n_expected", patience_s: float = 3600, done: DataFrame | None = None) -> DataFrame:
    """The stream's rows with status: complete, of conditions (keys) that have all the rows they expect, given once; partial, of those that did not complete within patience_s of
    their first row; late, what came after that. unique tells a condition's rows apart. done (keys, n, expected): conditions that a table has before the stream's first
    start; one of which it has a part raises, as do rows that expect unlike numbers, or more rows than expected. Nulls are values like others."""
    schema = T.StructType([*stream.schema.fields, T.StructField("status", T.StringType())])
    processor = Conditions(stream.schema, keys, unique, expected, max(1, int(patience_s * 1000)))  # not in the batch that begins it
    start = None if done is None else done.select(*keys, F.col("n").cast("long").alias("n"), F.col("expected").cast("long").alias("expected")).groupBy(*keys)
    return stream.groupBy(*keys).transformWithState(processor, schema, "Append", "ProcessingTime", start)


def counted(table: DataFrame, keys: list[str], expected: str = "n_expected") -> DataFrame:
    """keys, n, expected of a table: what whole_conditions takes as done."""
    return table.groupBy(*keys).agg(F.count("*").alias("n"), F.max(expected).alias("expected"))


def written_whole(stream: DataFrame, path: str, checkpoint: str, keys: list[str], unique: list[str], expected: str = "n_expected", patience_s: float = 3600, done: DataFrame | None = None) -> StreamingQuery:
    """Writes whole_conditions to the table at path, in a folder for each status. The state lives in RocksDB, so that it need not fit in memory; the file sink's log makes
    a batch count once, however often it is run."""
    spark = stream.sparkSession
    was = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        out = whole_conditions(stream, keys, unique, expected, patience_s, done)
        return out.writeStream.format("parquet").partitionBy("status").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:  # a started query has a copy of its own
        for k, v in was.items():
            spark.conf.set(k, v)
