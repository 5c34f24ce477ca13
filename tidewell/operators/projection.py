"""Projections of memories to the vector index and the entity graph, as the outbox asks for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.graph import edges
from tidewell.operators.vector import build_index


def dispatch(batch: DataFrame, memories: DataFrame) -> DataFrame:
    """``batch`` with ``written``, the rows its projection makes of the memory, and ``succeeds``: that memory is there.

    A vector event makes one index row or, for a memory that isn't searchable, none; a graph event one row an edge.
    """
    asked = batch.select(F.col("memory_id")).distinct()
    own = memories.join(asked.withColumnRenamed("memory_id", "id"), "id", "left_semi")  # only these are projected
    vectors = build_index(own).select("memory_id", F.lit("vector").alias("projection_type"))
    links = edges(own).select("memory_id", F.lit("graph").alias("projection_type"))
    made = vectors.union(links).groupBy("memory_id", "projection_type").agg(F.count("*").alias("written"))
    there = own.select(F.col("id").alias("memory_id"), F.lit(True).alias("succeeds"))
    rows = batch.drop("succeeds", "written").join(there, "memory_id", "left").join(made, ["memory_id", "projection_type"], "left")
    return rows.withColumn("succeeds", F.coalesce("succeeds", F.lit(False))).withColumn("written", F.coalesce("written", F.lit(0)))


def project_apart(changes: DataFrame, projections: dict[str, Callable[[DataFrame], None]]) -> DataFrame:
    """(projection, ok, error): each projection is written on its own, and the failure of one doesn't stop the others."""
    outcome = []
    for name, write in projections.items():
        try:
            write(changes)
            outcome.append((name, True, None))
        except Exception as e:  # a projection's fault is a result; its events stay in the outbox
            outcome.append((name, False, str(e)))
    return changes.sparkSession.createDataFrame(outcome, "projection string, ok boolean, error string")
