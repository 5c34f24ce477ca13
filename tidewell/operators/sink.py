"""Projection sink with exactly-once effect over an at-least-once outbox.

A batch writes the rows of each projection and the new state of its events into folders of its own number, and last a mark
that names the projections that worked. Readers see marked batches only, so a batch that broke off shows nothing and its
repetition overwrites what it left; a batch that has its mark is never run again. Rows are keyed by (memory_id, batch): the
last batch of a memory replaces all its earlier rows.

One projection's fault doesn't touch another: its events get the error's text and come back after a delay that doubles with
every attempt, until their attempts are spent. An event whose memory is missing fails alone.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.graph import edges
from tidewell.operators.outbox import READY
from tidewell.operators.vector import build_index
from tidewell.session import settle

#: Projections by name: from memories to rows with a memory_id.
PROJECTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {"vector": build_index, "graph": edges}
STATE = "id long, memory_id string, projection_type string, status string, retry_count int, max_retries int, error_message string, created_at timestamp_ntz, attempted_at timestamp_ntz, completed_at timestamp_ntz, next_attempt_at timestamp_ntz"
SPENT = "max retries exceeded"


def marks(spark: SparkSession, base: str) -> DataFrame:
    """(batch, projection, rows, error) of the batches that are through; projection is null in a batch's own row."""
    schema = "batch long, projection string, error string"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/marks")
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/marks")


def states(spark: SparkSession, base: str) -> DataFrame:
    """The last state of every event that a marked batch has handled, and the ``batch``."""
    through = marks(spark, base).where("projection is null")
    if through.isEmpty():
        return spark.createDataFrame([], STATE + ", batch long")
    rows = spark.read.schema(STATE + ", batch long").parquet(f"{base}/events").join(through.select("batch"), "batch", "left_semi")
    columns = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("id", "r.*")


def due(spark: SparkSession, base: str, now: datetime) -> DataFrame:
    """Events to try again by ``now``."""
    return states(spark, base).where((F.col("status") == "retrying") & (F.col("next_attempt_at") <= F.lit(now).cast("timestamp_ntz"))).drop("batch")


def projected(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Rows of a projection as they stand: of each memory those of its last marked batch."""
    good = marks(spark, base).where((F.col("projection") == name) & F.col("error").isNull()).select("batch")
    rows = spark.read.parquet(f"{base}/{name}").withColumn("batch", F.col("batch").cast("long")).join(good, "batch", "left_semi")
    # a superseded memory leaves no vector, but its batch counts: what it had before is gone
    asked = spark.read.schema("memory_id string, projection_type string, status string, batch long").parquet(f"{base}/events")
    last = asked.where((F.col("projection_type") == name) & (F.col("status") == "completed")).join(good, "batch", "left_semi").groupBy("memory_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["memory_id", "batch"], "left_semi")


def run_batch(base: str, batch: int, events: DataFrame, memories: DataFrame, now: datetime, projections: dict[str, Callable[[DataFrame], DataFrame]] | None = None, delay_s: float = 1.0) -> bool:
    """Handles ``events`` (of which only the ready ones) as batch number ``batch``; False if that was through before."""
    spark, projections = events.sparkSession, PROJECTIONS if projections is None else projections
    if not marks(spark, base).where((F.col("batch") == batch) & F.col("projection").isNull()).isEmpty():
        return False
    known = [f.split()[0] for f in STATE.split(", ")]
    lacking = {f.split()[0]: f.split()[1] for f in STATE.split(", ")}
    rows = events.where(F.col("status").isin(*READY)).select(*[F.col(c) if c in events.columns else F.lit(None).cast(lacking[c]).alias(c) for c in known])
    # fixed before anything is written: what is read twice below must be the same rows
    there = memories.select(F.col("id").alias("memory_id"), F.lit(True).alias("there"))
    rows = settle(rows.join(there.join(rows.select("memory_id").distinct(), "memory_id", "left_semi"), "memory_id", "left"))
    spent = F.col("retry_count") >= F.col("max_retries")
    faults: dict[str, str | None] = {}
    for name, make in projections.items():
        asked = rows.where((F.col("projection_type") == name) & ~spent & F.col("there")).select(F.col("memory_id").alias("id")).distinct()
        try:
            make(memories.join(asked, "id", "left_semi")).write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
            faults[name] = None
        except Exception as e:  # a projection's fault is a result; its events come back
            faults[name] = str(e).split("\n")[0]
    down = F.coalesce(*[F.when(F.col("projection_type") == n, F.lit(e)) for n, e in faults.items() if e is not None], F.lit(None).cast("string"))
    handled = F.col("projection_type").isin(*projections)
    fault = F.when(spent, F.lit(SPENT)).when(~handled, F.lit(None)).otherwise(F.coalesce(down, F.when(F.col("there").isNull(), F.concat(F.lit("memory "), "memory_id", F.lit(" not found")))))
    stamp, count = F.lit(now).cast("timestamp_ntz"), F.when(spent | fault.isNull(), F.col("retry_count")).otherwise(F.col("retry_count") + 1)
    status = F.when(spent, "failed").when(fault.isNull(), "completed").when(count >= F.col("max_retries"), "failed").otherwise("retrying")
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(delay_s) * F.pow(F.lit(2.0), count - 1)).cast("decimal(18,6)"))
    after = rows.select("id", "memory_id", "projection_type", status.alias("status"), count.cast("int").alias("retry_count"), "max_retries", F.coalesce(fault, "error_message").alias("error_message"), "created_at", stamp.alias("attempted_at"), F.when(status == "completed", stamp).alias("completed_at"), F.when(status == "retrying", stamp + wait).alias("next_attempt_at"))
    after.write.mode("overwrite").parquet(f"{base}/events/batch={batch}")
    told = spark.createDataFrame([(batch, None, None), *[(batch, n, e) for n, e in faults.items()]], "batch long, projection string, error string")
    told.coalesce(1).write.mode("append").parquet(f"{base}/marks")  # one file, which appears as a whole
    return True


def run_until_done(base: str, events: DataFrame, memories: DataFrame, now: datetime, step, projections=None, delay_s: float = 1.0, most: int = 100) -> int:
    """First ``events``, then what is due, batch after batch, each ``step`` later or when the next event is due, if that is
    later still; the number of batches. An error if events are left to try after ``most`` of them."""
    spark = events.sparkSession
    run_batch(base, 0, events, memories, now, projections, delay_s)
    for batch in range(1, most + 1):
        next_due = states(spark, base).where("status = 'retrying'").agg(F.min("next_attempt_at")).first()[0]
        if next_due is None:
            return batch
        if batch < most:
            now = max(now + step, next_due)
            run_batch(base, batch, due(spark, base, now), memories, now, projections, delay_s)
    raise RuntimeError(f"events are left to try after {most} batches")
