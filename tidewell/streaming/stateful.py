"""Stateful streams: the command fold, bounded sessions and delayed retries, with state of their own per key.

All three keep only what a key needs: the fold a status, a session its newest items, a retry its event. State lives in the
RocksDB store beside the query's progress, so a query that is started again goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewell.operators.working import CAPACITY
from tidewell.schemas import OPERATIONS, TRANSITIONS
from tidewell.streaming.jobs import run_available

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_state_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which state of several kinds needs."""
    spark.conf.set(*PROVIDER)


class Fold(StatefulProcessor):
    """Commands of a memory, in the order of ``seq``, over its status."""

    def init(self, handle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = list(rows)  # a key's rows of one micro-batch
        batch = pd.concat(pieces).sort_values("seq") if len(pieces) > 1 else pieces[0].sort_values("seq")
        status = self.status.get()[0] if self.status.exists() else batch["start"].iloc[0]
        out = []
        for seq, op in zip(batch["seq"].tolist(), batch["op"].tolist()):
            target = OPERATIONS.get(op)
            accepted = (status, target) in TRANSITIONS
            out.append((seq, key[0], op, status, target if accepted else status, accepted))
            status = out[-1][4]
        self.status.update((status,))
        yield pd.DataFrame(out, columns=["seq", "id", "op", "before", "after", "accepted"])

    def close(self) -> None:
        pass


class Session(StatefulProcessor):
    """The newest ``capacity`` items of a session; a session without new items for ``idle_ms`` is forgotten."""

    def __init__(self, capacity: int, idle_ms: int | None):
        self.capacity, self.idle_ms = capacity, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "seq long, item_type string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(s), t) for s, t in (self.items.get() if self.items.exists() else ())]
        for piece in rows:
            held = sorted(held + [(int(s), t) for s, t in zip(piece["seq"], piece["item_type"])])[-self.capacity :]
        self.items.put(held)
        yield pd.DataFrame({"session_id": [key[0]] * len(held), "seq": [s for s, _ in held], "item_type": [t for _, t in held], "place": range(1, len(held) + 1)}).astype({"place": "int32"})

    def close(self) -> None:
        pass


class Retry(StatefulProcessor):
    """An event that failed leaves again when its delay is over: a timer for each attempt, none after the last."""

    def init(self, handle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "retry_count int, max_retries int, delay_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for piece in rows:
            for count, most, delay in zip(piece["retry_count"].tolist(), piece["max_retries"].tolist(), piece["delay_ms"].tolist()):
                if count < most:
                    self.event.update((int(count), int(most), int(delay)))
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(delay) * 2 ** int(count))
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "retry_count": pd.Series([], dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count = self.event.get()[0]
        self.event.clear()
        yield pd.DataFrame({"id": [key[0]], "retry_count": [count + 1]}).astype({"retry_count": "int32"})

    def close(self) -> None:
        pass


def stream_fold(commands: DataFrame, memories: DataFrame, out: str) -> DataFrame:
    """``lifecycle.fold`` of a stream of commands (seq, id, op): each micro-batch goes on from the status that is kept."""
    spark = commands.sparkSession
    use_state_store(spark)
    rows = commands.join(memories.select("id", F.col("status").alias("start")), "id").select("id", "seq", "op", "start")
    folded = rows.groupBy("id").transformWithStateInPandas(Fold(), "seq long, id string, op string, before string, after string, accepted boolean", "append", "None")
    run_available(folded, lambda batch: batch, out)
    return spark.read.parquet(out).drop("batch")


def stream_sessions(items: DataFrame, out: str, capacity: int = CAPACITY, idle_ms: int | None = None) -> DataFrame:
    """Bounded working memory over a stream of items (session_id, seq, item_type)."""
    spark = items.sparkSession
    use_state_store(spark)
    rows = items.select("session_id", "seq", "item_type")
    kept = rows.groupBy("session_id").transformWithStateInPandas(Session(capacity, idle_ms), "session_id long, seq long, item_type string, place int", "update", "None" if idle_ms is None else "processingTime")
    run_available(kept, lambda batch: batch, out, "update")
    told = spark.read.parquet(out)
    last = told.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return told.join(last, ["session_id", "batch"], "left_semi").drop("batch")


def delayed_retries(events: DataFrame) -> DataFrame:
    """(id, retry_count) of a stream of failed events (id, retry_count, max_retries, delay_ms), each when its delay is over."""
    use_state_store(events.sparkSession)
    return events.groupBy("id").transformWithStateInPandas(Retry(), "id long, retry_count int", "append", "processingTime")
