"""Structured Streaming forms of the queue-like operators.

Sinks write one folder for each micro-batch and overwrite it when the batch is repeated, so results are exactly once
although delivery is at least once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import sink
from tidewell.session import shared_dir


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream; new files are new rows."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)  # a stream reads folders


def run_available(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, mode: str = "append") -> None:
    """Handles what has arrived, batch by batch, into folders of ``out``; a later call goes on where this one ended."""

    def write(batch: DataFrame, batch_id: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    query.awaitTermination()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain_outbox(outbox: DataFrame, memories: DataFrame, base: str, now: Callable[[int], datetime] = lambda batch: datetime.now()) -> DataFrame:
    """Projects the events of an outbox stream into the sink at ``base``, with those that are due again; their states so far.

    ``now`` gives a micro-batch's time. A micro-batch that is repeated after a crash has its effect once; see ``sink``.
    """
    spark = outbox.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        again = sink.due(spark, base, now(number))
        sink.run_batch(base, number, batch.unionByName(again, allowMissingColumns=True), memories, now(number))

    outbox.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}-progress").trigger(availableNow=True).start().awaitTermination()
    return sink.states(spark, base)


def windowed_counts(events: DataFrame, out: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling event-time windows, with a watermark for late rows; the last state of each window."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    run_available(grouped, lambda batch: batch.select(F.col("window.start").alias("start"), "event_type", "n"), out, "update")
    rows = events.sparkSession.read.parquet(out)
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
