"""Incremental forms: new scenarios as they arrive, whole or in parts, and frame thinning on a stream out of order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from lanewise.sources.storage import pending


def stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def process_new_scenarios(
    stream: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, once: bool = True,
) -> StreamingQuery:
    """Run a batch feature function on scenarios that arrive as files; ids already stored in `out` are skipped.

    Re-delivery of a batch is harmless: its scenarios are found in the store and not written twice. A scenario must
    arrive whole within one batch; see :func:`process_assembled_scenarios` for those that don't.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        todo = pending(df, stored_or_none(df.sparkSession, out))
        compute(df.join(todo, "scenario_id", "left_semi")).write.mode("append").parquet(out)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs the state store that keeps it on disk; a store the user chose stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Assembly(StatefulProcessor):
    """State per scenario: its rows so far, how many and when it expires, and whether it was handed on."""

    def __init__(self, schema: StructType, expected: str, idle_ms: int | None, remember_ms: int | None):
        self.schema, self.expected, self.idle_ms, self.remember_ms = schema, expected, idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.seen = handle.getValueState("seen", "n long, expires long")
        self.done = handle.getValueState("done", "done boolean", self.remember_ms)

    def _hand_on(self, status: str) -> Iterator[pd.DataFrame]:
        whole = pd.DataFrame(list(self.rows.get()), columns=self.schema.names, dtype=object).assign(status=status)
        self.rows.clear()
        self.seen.clear()
        self.done.update((True,))
        yield whole

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows))
        if self.done.exists():
            yield parts.assign(status="late")
            return
        self.rows.appendList([tuple(r) for r in parts.astype(object).where(parts.notna(), None).itertuples(index=False)])
        n, expires = self.seen.get() if self.seen.exists() else (0, None)
        if expires is not None:
            self.handle.deleteTimer(expires)
        n += len(parts)
        if n >= parts[self.expected].max():
            yield from self._hand_on("whole")
            return
        if self.idle_ms is not None:
            expires = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(expires)
        self.seen.update((n, expires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            yield from self._hand_on("expired")

    def close(self) -> None:
        pass


def assemble_scenarios(stream: DataFrame, expected: str, *, idle_s: float | None = None, remember_s: float | None = None) -> DataFrame:
    """Rows of scenarios that arrive over several batches, handed on together, with `status`.

    A scenario is `whole` once as many rows as its column `expected` says have come. With `idle_s`, one that gets none for so long is handed
    on as `expired` with what it has; its timers need a query that runs on, one that stops at the end of the input never would. Rows that come after that are `late`, as long as the scenario is remembered (for good, unless
    `remember_s` is given). State holds the open scenarios only, each as large as its rows.
    """
    with_keyed_state(stream.sparkSession)
    out = StructType([*stream.schema.fields, StructField("status", StringType())])
    idle, remember = (None if s is None else int(s * 1000) for s in (idle_s, remember_s))
    return stream.groupBy("scenario_id").transformWithStateInPandas(
        _Assembly(stream.schema, expected, idle, remember), out, "append", "None" if idle is None and remember is None else "ProcessingTime")


def process_assembled_scenarios(
    stream: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str, late: str, checkpoint: str, *, expected: str, once: bool = True,
    idle_s: float | None = None, remember_s: float | None = None,
) -> StreamingQuery:
    """Run a batch feature function on scenarios once they are whole or expired; rows that come later are appended to `late`.

    Each scenario is handed on in one batch. A batch that is delivered again finds its scenarios in `out` and computes none of them
    twice; late rows of it are written under its number, so they aren't doubled either.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            ready = df.filter("status <> 'late'").drop("status")
            todo = pending(ready, stored_or_none(df.sparkSession, out))
            compute(ready.join(todo, "scenario_id", "left_semi")).write.mode("append").parquet(out)
            df.filter("status = 'late'").drop("status").write.mode("overwrite").parquet(f"{late.rstrip('/')}/batch={epoch}")
        finally:
            df.unpersist()

    if once and (idle_s is not None or remember_s is not None):
        raise ValueError("timers need a query that runs on: once=False")
    writer = assemble_scenarios(stream, expected, idle_s=idle_s, remember_s=remember_s).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class _Thinning(StatefulProcessor):
    """State per log: the last kept time, the latest time seen, and the frames that an earlier one may still precede."""

    def __init__(self, gap: int, delay: int, idle_ms: int | None):
        self.gap, self.delay, self.idle_ms = gap, delay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "last long, latest long, safe long, expires long")
        self.held = handle.getListState("held", "ts_us long, frame_id long")

    def _walk(self, log, frames: list[tuple], last: int | None) -> tuple[pd.DataFrame, int | None]:
        kept = []
        for ts, frame in frames:
            if last is None or ts - last >= self.gap:
                kept.append((log, frame, ts, "kept"))
                last = ts
        return pd.DataFrame(kept, columns=["log_id", "frame_id", "ts_us", "status"]), last

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(f)) for part in rows for t, f in zip(part["ts_us"], part["frame_id"], strict=True)]
        last, latest, safe, expires = self.at.get() if self.at.exists() else (None, None, None, None)
        if expires is not None:
            self.handle.deleteTimer(expires)
        late = [(t, f) for t, f in new if safe is not None and t <= safe]
        frames = sorted([*((t, f) for t, f in self.held.get()), *((t, f) for t, f in new if safe is None or t > safe)])
        latest = max([t for t, _ in new] + ([latest] if latest is not None else []))
        safe = max(latest - self.delay, safe if safe is not None else latest - self.delay)
        ready = [x for x in frames if x[0] <= safe]
        kept, last = self._walk(key[0], ready, last)
        self.held.clear()
        expires = None
        if frames[len(ready):]:
            self.held.put(frames[len(ready):])
            if self.idle_ms is not None:
                expires = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(expires)
        self.at.update((last, latest, safe, expires))
        yield kept
        if late:
            yield pd.DataFrame([(key[0], f, t, "late") for t, f in late], columns=kept.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, latest, _, _ = self.at.get()
        kept, last = self._walk(key[0], sorted((t, f) for t, f in self.held.get()), last)
        self.held.clear()
        self.at.update((last, latest, latest, None))
        yield kept

    def close(self) -> None:
        pass


def thin_frames_stream(frames: DataFrame, min_gap_s: float, *, delay_s: float = 0.0, idle_s: float | None = None) -> DataFrame:
    """Frames (log_id, frame_id, ts_us) of which each is at least `min_gap_s` after the last kept one of its log, with `status` `kept`.

    Frames may arrive out of order: one is decided on when its log has reached `delay_s` beyond it, or, with `idle_s` and a query that runs on, has been silent for so long:
    every arrival within the delay gives what :func:`lanewise.sources.ingest.thin_frames` gives. Frames behind that point come out as
    `late`. State per log: three times and the frames of the delay.
    """
    with_keyed_state(frames.sparkSession)
    us = lambda s: int(round(s * 1e6))
    return frames.select("log_id", "frame_id", "ts_us").groupBy("log_id").transformWithStateInPandas(
        _Thinning(us(min_gap_s), us(delay_s), None if idle_s is None else int(idle_s * 1000)), "log_id long, frame_id long, ts_us long, status string",
        "append", "None" if idle_s is None else "ProcessingTime")
