"""Filtered listing, statistics and projections of canonical memories."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import conjunction, iso, is_blank, non_empty, preview
from tidewell.schemas import MEMORY_SCHEMA, MEMORY_TYPES

RESPONSE = (
    "id", "memory_type", "status", "title", "content", "asset_id", "component_id", "incident_id", "source_type", "source_id", "created_at", "confidence",
    "importance", "is_synthetic", "tenant_id", "facility_id", "team_id", "access_roles", "supersedes_memory_id", "observed_at", "updated_at", "memory_metadata",
)


def list_memories(memories: DataFrame, limit: int | None = None, offset: int = 0, **equal: str | None) -> DataFrame:
    """Newest first, ties by id; filters that are None or empty don't apply."""
    rows = memories.where(conjunction([F.col(c) == v for c, v in equal.items() if v not in (None, "")])).orderBy(F.desc("created_at"), "id")
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def get_memory(memories: DataFrame, memory_id: str) -> DataFrame:
    return memories.where(F.col("id") == memory_id).limit(1)


def response(memories: DataFrame) -> DataFrame:
    """Columns of a record as the API shows them; decimals as doubles, roles never null; what a table lacks is null."""
    kinds = {name: kind for name, kind in (c.strip().split(" ", 1) for c in re.split(r",(?![^(]*\))", MEMORY_SCHEMA))}
    own = {c: F.col(c) if c in memories.columns else F.lit(None).cast(kinds[c]) for c in RESPONSE}
    own |= {c: own[c].cast("double") for c in ("confidence", "importance")}
    own["access_roles"] = F.coalesce(own["access_roles"], F.array().cast("array<string>"))
    return memories.select(*[own[c].alias(c) for c in RESPONSE])


def search_view(results: DataFrame) -> DataFrame:
    """Result rows with a content preview of 300 characters."""
    return results.withColumn("content", preview("content"))


def vector_payload(memories: DataFrame) -> DataFrame:
    """The nine scalar fields kept beside a vector."""
    return memories.select(
        F.col("id").alias("memory_id"), "memory_type", "status", "asset_id", "facility_id", "source_type", iso("created_at").alias("created_at"),
        F.col("importance").cast("double").alias("importance"), F.col("confidence").cast("double").alias("confidence"),
    )


def stats(memories: DataFrame) -> DataFrame:
    """(grouping, value, n): the total, counts by status and by type, in one pass."""
    rows = memories.groupingSets([["status"], ["memory_type"], []], "status", "memory_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "memory_type").otherwise("total")
    return rows.select(kind.alias("grouping"), F.coalesce("status", "memory_type", F.lit("")).alias("value"), "n")


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def outbox_totals(outbox: DataFrame) -> DataFrame:
    """total, pending (and retrying), failed and completed events in one row."""
    return outbox.agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("pending", "retrying")).alias("pending"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "completed").alias("completed"),
    )


def violations(memories: DataFrame) -> DataFrame:
    """(id, rule) for every broken rule: blank texts, ranges, the type's domain, links to memories that don't exist."""
    rules = F.array(
        *[F.when(is_blank(c), F.lit(f"blank_{c}")) for c in ("title", "content", "source_type")],
        *[F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), F.lit(f"range_{c}")) for c in ("confidence", "importance")],
        F.when(~F.coalesce(F.col("memory_type").isin(*MEMORY_TYPES), F.lit(False)), F.lit("type_domain")),
    )
    own = memories.select("id", F.explode(F.array_compact(rules)).alias("rule"))
    return own.union(orphans(memories, memories, "supersedes_memory_id").select("id", F.lit("orphan_link").alias("rule")))


def orphans(rows: DataFrame, memories: DataFrame, reference: str) -> DataFrame:
    """Rows whose reference isn't the id of any memory."""
    known = memories.select(F.col("id").alias("_known"))
    return rows.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("_known"), "left_anti")


def with_role(memories: DataFrame, role: str) -> DataFrame:
    return memories.where(F.array_contains("access_roles", role))


def json_equals(rows: DataFrame, column: str, path: str, kind: str, value: object) -> DataFrame:
    """Rows whose JSON column holds ``value`` at ``path``; broken JSON doesn't match."""
    return rows.where(F.try_variant_get(F.try_parse_json(F.col(column)), path, kind) == F.lit(value))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that aren't unique."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def health(components: DataFrame, *by: str) -> DataFrame:
    """Roll-up of (name, status), for each value of ``by``: healthy if every status that is given is."""
    return components.groupBy(*by).agg(F.when(F.every(F.coalesce(F.col("status") == "healthy", F.lit(True))), "healthy").otherwise("degraded").alias("status"))


def table_health(tables: dict[str, DataFrame], stale_after: timedelta, now: datetime | None = None) -> DataFrame:
    """(name, n, newest, status) of tables with a created_at: empty, stale (nothing newer than that) or healthy."""
    at = F.current_timestamp().cast("timestamp_ntz") if now is None else F.lit(now).cast("timestamp_ntz")
    parts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max("created_at").cast("timestamp_ntz").alias("newest")) for name, t in tables.items()]
    status = F.when(F.col("n") == 0, "empty").when(F.col("newest") < at - F.lit(stale_after), "stale").otherwise("healthy")
    return reduce(DataFrame.union, parts).withColumn("status", status)


def explorer_records(related: DataFrame, memories: DataFrame, most: int = 10) -> DataFrame:
    """The records of each query's first ``most`` neighbours (query_id, memory_id, rank); ids without a record are left out."""
    return related.where(F.col("rank") <= most).join(memories.withColumnRenamed("id", "memory_id"), "memory_id")


def explorer(memories: DataFrame, **equal: str | None) -> DataFrame:
    """Filters of the explorer page; an empty text doesn't filter."""
    return memories.where(conjunction([F.col(c) == non_empty(F.lit(v)) for c, v in equal.items() if v]))
