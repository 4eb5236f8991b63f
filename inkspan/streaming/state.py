"""Extension: the error log as a stateful stream. Its end state is what the batch fold in ``operators.errors`` gives.

Each id keeps one record: its newest error, its retries so far, and how many
events it is made of. Events may come late and in any order, as the fold does
not depend on it. A record that has had no event for ``keep`` after the
watermark is written once more as expired and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkspan.sources import versions

#: Times are microseconds in the state, as a stored time and an event's come with and without a zone.
RECORD = "stage string, error_msg string, timestamp long, newest long, retry_count long, last_retry long, seen long"
OUTPUT = f"id string, {RECORD}, expired boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(record: dict | None, rows: list[tuple]) -> dict:
    """A record with more events: (event_id, microseconds, stage, error_msg, is_retry)."""
    made = record or {"stage": None, "error_msg": None, "timestamp": None, "newest": None, "retry_count": 0, "last_retry": None, "seen": 0}
    for event_id, ts, stage, message, is_retry in rows:
        made["seen"] += 1
        if is_retry:
            made["retry_count"] += 1
            made["last_retry"] = ts if made["last_retry"] is None else max(made["last_retry"], ts)
        elif made["timestamp"] is None or (ts, event_id) > (made["timestamp"], made["newest"]):
            made |= {"stage": stage, "error_msg": message, "timestamp": ts, "newest": event_id}
    return made


class ErrorRecords(StatefulProcessor):
    """One record per id, with an event-time timer that moves with its newest event."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)

    def _stored(self) -> dict | None:
        found = self.record.get() if self.record.exists() else None
        return dict(zip([f.split()[0] for f in RECORD.split(", ")], found)) if found is not None else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        made = fold(self._stored(), [(r.event_id, r.at, r.stage, r.error_msg, r.is_retry) for r in rows])
        self.record.update(tuple(made.values()))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        last = max(t for t in (made["timestamp"], made["last_retry"]) if t is not None)
        self.handle.registerTimer(last // 1000 + self.keep_ms)
        yield Row(id=key[0], **made, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        made = self._stored()
        self.record.clear()
        if made:
            yield Row(id=key[0], **made, expired=True)

    def close(self) -> None:
        pass


def error_records(events: DataFrame, keep_ms: int, delay: str = "1 hour") -> DataFrame:
    """Changed records of a stream of ``events`` (id, event_id, ts, stage, error_msg, is_retry), each event once within ``delay``."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).withColumn("at", F.unix_micros("ts"))
    made = once.groupBy("id").transformWithState(ErrorRecords(keep_ms), OUTPUT, "Update", "EventTime")
    return made.withColumns({c: F.timestamp_micros(c) for c in ("timestamp", "last_retry")})


def into_store(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of all data there is to a versioned store; a batch that is run again counts once."""
    write = lambda rows, batch: versions.commit(rows, path, f"batch {batch}")
    return records.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, batch: write(rows, batch) and None).start()


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each id, as the batch fold has it; expired records count, as the log keeps them."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("stage", "error_msg", "timestamp", "retry_count", "last_retry"), F.struct("seen", "expired")).alias("r"))
    return last.select("id", "r.*", F.lit(False).alias("reported"))
