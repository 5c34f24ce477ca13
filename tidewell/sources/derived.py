"""The operational tables derived from the parquet tables of a folder, as Spark expressions and as the oracle's SQL.

Each derived column is one SQL expression that both engines read alike; only the time arithmetic is spelled per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.schemas import MEMORY_TYPES

_TYPE = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(MEMORY_TYPES)) + " END"
_ID = "concat('00000000-0000-4000-8000-', lpad(CAST({} AS STRING), 12, '0'))"
MEMORY_COLUMNS = {
    "doc_id": "doc_id",
    "id": _ID.format("doc_id"),
    "memory_type": _TYPE,
    "status": "CASE WHEN doc_id % 10 IN (2, 3) THEN 'superseded' WHEN doc_id % 10 = 5 THEN 'disputed' WHEN doc_id % 10 = 7 THEN 'archived' ELSE 'active' END",
    "title": "concat('memory ', CAST(doc_id AS STRING))",
    "content": "text",
    "asset_id": "CASE WHEN doc_id % 7 <> 0 THEN concat('asset-', CAST(doc_id % 97 AS STRING)) END",
    "component_id": "CASE WHEN doc_id % 3 = 0 THEN concat('comp-', CAST(doc_id % 53 AS STRING)) END",
    "incident_id": "CASE WHEN doc_id % 5 = 0 THEN concat('inc-', CAST(doc_id % 41 AS STRING)) END",
    "source_type": "CASE doc_id % 4 WHEN 0 THEN 'sensor' WHEN 1 THEN 'operator' WHEN 2 THEN 'manual' ELSE 'document' END",
    "source_id": "CASE WHEN doc_id % 8 <> 0 THEN concat(coalesce(source, ''), '-', CAST(doc_id % 200 AS STRING)) END",
    "confidence": "CAST(((doc_id * 37) % 101) / 100.0 AS DECIMAL(3, 2))",
    "importance": "CAST(((doc_id * 53) % 101) / 100.0 AS DECIMAL(3, 2))",
    "is_synthetic": "doc_id % 6 = 0",
    "tenant_id": "CASE WHEN doc_id % 11 <> 0 THEN concat('tenant-', CAST(doc_id % 3 AS STRING)) END",
    "facility_id": "CASE WHEN doc_id % 13 = 0 THEN concat('facility-', coalesce(lang, 'none')) END",
    "team_id": "CASE WHEN doc_id % 17 = 0 THEN concat('team-', CAST(doc_id % 5 AS STRING)) END",
    "supersedes_memory_id": "CASE WHEN doc_id % 10 IN (3, 4) THEN " + _ID.format("doc_id - 1") + " END",
}
_EVENT_STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'retrying' WHEN 'signup' THEN 'failed' ELSE 'processing' END"
OUTBOX_COLUMNS = {
    "id": "event_id",
    "memory_id": _ID.format("user_id"),
    "projection_type": "CASE WHEN event_id % 2 = 0 THEN 'vector' ELSE 'graph' END",
    "operation": "'project'",
    "status": _EVENT_STATUS,
    "retry_count": "CAST(event_id % 5 AS INT)",
    "max_retries": "CAST(3 AS INT)",
    "created_at": "ts",
    "succeeds": "event_id % 3 <> 0",
}
#: lifecycle commands: one sequence for each memory that a user's events stand for
COMMAND_COLUMNS = {
    "seq": "event_id",
    "id": _ID.format("user_id"),
    "op": "CASE WHEN event_id % 23 = 0 THEN 'archive' WHEN event_id % 29 = 0 THEN 'supersede' WHEN event_id % 2 = 0 THEN 'dispute' ELSE 'restore' END",
}
WORKING_COLUMNS = {
    "session_id": "conv_id",
    "seq": "turn",
    "item_type": "CASE role WHEN 'user' THEN 'user_input' WHEN 'assistant' THEN 'agent_step' ELSE 'context' END",
    "content": "text",
    "confidence": "((conv_id * 31 + turn * 17) % 101) / CAST(100 AS DOUBLE)",
    "importance": "((conv_id * 13 + turn * 41) % 101) / CAST(100 AS DOUBLE)",
}


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [f"{e} AS {n}" for n, e in MEMORY_COLUMNS.items()]
    return _read(spark, sf_dir, "documents").selectExpr(*shown, "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 37) AS created_at")


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in OUTBOX_COLUMNS.items()])


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in COMMAND_COLUMNS.items()])


def working_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").selectExpr(*[f"{e} AS {n}" for n, e in WORKING_COLUMNS.items()])


MEMORIES_SQL = f"SELECT {_listed(MEMORY_COLUMNS)}, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 37 SECOND AS created_at FROM documents"
OUTBOX_SQL = f"SELECT {_listed(OUTBOX_COLUMNS)} FROM events"
COMMANDS_SQL = f"SELECT {_listed(COMMAND_COLUMNS)} FROM events"
WORKING_SQL = f"SELECT {_listed(WORKING_COLUMNS)} FROM conversations"
