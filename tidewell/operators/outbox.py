"""Projection outbox: batches of an at-least-once queue with bounded retry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READY = ("pending", "retrying")


def take_batch(outbox: DataFrame, size: int | None = 50) -> DataFrame:
    """The oldest ``size`` events that are ready; all of them for None."""
    ready = outbox.where(F.col("status").isin(*READY))
    return ready if size is None else ready.orderBy("created_at", "id").limit(size)


def process(batch: DataFrame, projections: tuple[str, ...] | None = None) -> DataFrame:
    """Events after one attempt: new_status, new_retry_count and outcome (completed, failed, skipped).

    ``succeeds`` tells whether the event's projection works; a type without projection is completed at once.
    """
    handled = F.lit(True) if projections is None else F.col("projection_type").isin(*projections)
    spent = F.col("retry_count") >= F.col("max_retries")
    works = ~handled | F.coalesce("succeeds", F.lit(False))
    count = F.when(~spent & ~works, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    status = F.when(spent, "failed").when(works, "completed").when(count >= F.col("max_retries"), "failed").otherwise("retrying")
    outcome = F.when(status == "retrying", "skipped").otherwise(status)
    return batch.select("*", status.alias("new_status"), count.alias("new_retry_count"), outcome.alias("outcome"))


def summary(processed: DataFrame) -> DataFrame:
    """completed, failed and skipped of a batch in one row."""
    return processed.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("completed", "failed", "skipped")])


def enqueue(changes: DataFrame, projections: tuple[str, ...] = ("vector", "graph")) -> DataFrame:
    """One pending event for each changed memory and projection; ids derive from both, so a rerun adds nothing new."""
    rows = changes.select(F.col("id").alias("memory_id"), F.explode(F.array(*[F.lit(p) for p in projections])).alias("projection_type"), "updated_at")
    return rows.select(
        F.sha2(F.concat_ws("|", "memory_id", "projection_type", "updated_at"), 256).alias("id"), "memory_id", "projection_type", F.lit("project").alias("operation"),
        F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(3).alias("max_retries"), F.col("updated_at").alias("created_at"),
    )
