"""Requests and verdicts as a keyed stream: what each trace's verdict is, and which requests were never answered.

State is kept for each trace, so a micro-batch touches the traces that it names, not the whole table. A request sets a
timer in event time; an answer to it, or to a later request, takes the timer away, and a timer that fires gives the
trace back to the pool of those to ask again. The rules of what replaces what are those of operators.backtracking.merge, so the
last row of each trace is what the batch merge gives, whatever the order, the repeats and the restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracemill.schema import KEY

#: Events: kind is sent or reply; a reply has an error or a number of steps.
EVENT = "dataset string, model string, trace_index long, kind string, batch_seq long, error string, num_backtracking_steps long, ts timestamp"
#: What comes out, a row for each change: status is verdict or expired.
CHANGE = "dataset string, model string, trace_index long, status string, batch_seq long, error string, num_backtracking_steps long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Verdicts(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.verdict = handle.getValueState("verdict", "batch_seq long, error string, steps long")
        self.open = handle.getMapState("open", "batch_seq long", "deadline long")
        self.settled = handle.getValueState("settled", "batch_seq long")  # the latest request that was answered or has expired

    def _settle(self, seq: int) -> None:
        """Nothing up to this request is waited for any more."""
        was = self.settled.get()[0] if self.settled.exists() else -1
        self.settled.update((max(was, seq),))
        for (k,), (deadline,) in list(self.open.iterator()):
            if k <= seq:
                self.handle.deleteTimer(deadline)
                self.open.removeKey((k,))

    def _row(self, key, status: str, seq: int, error, steps) -> dict:
        return dict(zip(KEY, key)) | {"status": status, "batch_seq": seq, "error": error, "num_backtracking_steps": steps}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [r for pdf in rows for r in pdf.itertuples(index=False)]
        changed, out = False, []
        for r in sorted(events, key=lambda e: (e.ts, e.kind != "sent")):
            seq, at = int(r.batch_seq), int(r.ts.timestamp() * 1000)
            if r.kind == "sent":
                if seq > (self.settled.get()[0] if self.settled.exists() else -1) and not self.open.containsKey((seq,)):
                    self.open.updateValue((seq,), (at + self.wait_ms,))
                    self.handle.registerTimer(at + self.wait_ms)
                continue
            # an answer does not bring back a request whose time was over before it came
            late = [k for (k,), (deadline,) in self.open.iterator() if deadline < at]
            out += [self._row(key, "expired", k, None, None) for k in late]
            self._settle(max([seq, *late]))
            error = None if pd.isna(r.error) else str(r.error)
            steps = None if pd.isna(r.num_backtracking_steps) else int(r.num_backtracking_steps)
            old = self.verdict.get() if self.verdict.exists() else None
            # a success before any error, then the later request
            if old is None or (error is None, seq) > (old[1] is None, old[0]):
                self.verdict.update((seq, error, steps))
                changed = True
        if changed:
            out.append(self._row(key, "verdict", *self.verdict.get()))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        late = [k for (k,), (deadline,) in self.open.iterator() if deadline <= at]
        if late:
            self._settle(max(late))
            yield pd.DataFrame([self._row(key, "expired", k, None, None) for k in late])

    def close(self) -> None:
        pass


def verdict_changes(events: DataFrame, wait_seconds: int = 3600, lateness: str = "0 seconds") -> DataFrame:
    """Changes of verdicts and expired requests of a stream of EVENT rows; see write_changes for a table of them.

    wait_seconds after it was sent, a request without an answer expires, once events that late have been seen.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return events.withWatermark("ts", lateness).groupBy(*KEY).transformWithStateInPandas(_Verdicts(wait_seconds * 1000), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")


def write_changes(changes: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that keeps the changes as Parquet, a folder for each micro-batch; a batch that is run again replaces its own."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last verdict of each trace among the changes."""
    rows = spark.read.schema(CHANGE + ", epoch long").parquet(path).where("status = 'verdict'")
    # of a trace's rows the last epoch's counts; one epoch has at most one verdict of it
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("batch_seq", "error", "num_backtracking_steps"), "epoch").alias("v")).select(*KEY, "v.*")


def expired(spark: SparkSession, path: str) -> DataFrame:
    """Requests that were never answered: (key, batch_seq)."""
    return spark.read.schema(CHANGE + ", epoch long").parquet(path).where("status = 'expired'").select(*KEY, "batch_seq").distinct()


def as_batch(events: DataFrame, wait_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """What the stream comes to after all events in order of time: verdicts, and requests that expire once time has passed them."""
    replies = events.where("kind = 'reply'")
    w = Window.partitionBy(*KEY).orderBy(F.when(F.col("error").isNull(), 0).otherwise(1), F.col("batch_seq").desc())
    last = replies.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*KEY, "batch_seq", "error", "num_backtracking_steps")
    sent = events.where("kind = 'sent'").groupBy(*KEY, "batch_seq").agg(F.min("ts").alias("ts")).alias("s")
    got = replies.select(*[F.col(c).alias(f"r_{c}") for c in KEY], F.col("batch_seq").alias("r_seq"), F.col("ts").alias("r_ts")).alias("r")
    same = [F.col(f"s.{c}") == F.col(f"r_{c}") for c in KEY]
    in_time = F.col("r_ts").cast("double") <= F.col("s.ts").cast("double") + wait_seconds
    never = sent.join(got, [*same, F.col("r_seq") >= F.col("s.batch_seq"), in_time], "left_anti")
    return last, never.select(*KEY, "batch_seq")
