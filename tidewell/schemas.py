"""Columns, domains and transition rules of the operational-memory model."""

from __future__ import annotations

# Fixed values of the data model.
MEMORY_TYPES = ("observation", "incident", "diagnosis", "maintenance_action", "resolution", "recommendation", "document_fact", "agent_interaction", "feedback")
STATUSES = ("active", "superseded", "disputed", "archived")
TRANSITIONS = (("active", "archived"), ("active", "disputed"), ("active", "superseded"), ("disputed", "archived"), ("disputed", "active"))
OPERATIONS = {"archive": "archived", "dispute": "disputed", "supersede": "superseded", "restore": "active"}
MUTABLE = (
    "memory_type", "title", "content", "asset_id", "component_id", "incident_id", "source_type", "source_id", "observed_at", "confidence",
    "importance", "is_synthetic", "tenant_id", "facility_id", "team_id", "access_roles", "memory_metadata",
)
LIFECYCLE_FIELDS = ("status", "supersedes_memory_id")
REEMBED_FIELDS = ("title", "content", "confidence", "importance")
#: relationship, node label, key word, column of the external id
OWNED_EDGES = (
    ("ABOUT_ASSET", "Asset", "asset", "asset_id"),
    ("ABOUT_COMPONENT", "Component", "component", "component_id"),
    ("PART_OF_INCIDENT", "Incident", "incident", "incident_id"),
    ("OBSERVED_AT", "Facility", "facility", "facility_id"),
    ("BELONGS_TO_TEAM", "Team", "team", "team_id"),
)
WORKING_TYPES = ("observation", "retrieved_evidence", "tool_output", "hypothesis", "user_input", "agent_step", "critic_result", "context")
ERROR_CODES = {"not_found": 404, "invalid_data": 422, "lifecycle": 409, "conflict": 409}
ERROR_OTHER = 400
MAX_HOPS = 5

MEMORY_SCHEMA = """
id string, memory_type string, status string, title string, content string, asset_id string, component_id string, incident_id string,
source_type string, source_id string, created_at timestamp_ntz, observed_at timestamp_ntz, updated_at timestamp_ntz, confidence decimal(3,2),
importance decimal(3,2), is_synthetic boolean, tenant_id string, facility_id string, team_id string, access_roles array<string>,
supersedes_memory_id string, memory_metadata string
"""
OUTBOX_SCHEMA = "id string, memory_id string, projection_type string, operation string, status string, retry_count int, max_retries int, error_message string, created_at timestamp_ntz"
