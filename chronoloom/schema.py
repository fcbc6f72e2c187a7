"""Column lists of the graph tables, as Spark schemas."""

from __future__ import annotations

from pyspark.sql.types import StructType

ENTITY = StructType.fromDDL("uuid string, name string, group_id string, labels array<string>, created_at timestamp, name_embedding array<float>, summary string, attributes string")
EPISODIC = StructType.fromDDL("uuid string, name string, group_id string, created_at timestamp, source string, source_description string, content string, metadata string, valid_at timestamp, entity_edges array<string>")
COMMUNITY = StructType.fromDDL("uuid string, name string, group_id string, created_at timestamp, name_embedding array<float>, summary string")
RELATES_TO = StructType.fromDDL("uuid string, src string, dst string, group_id string, created_at timestamp, name string, fact string, fact_embedding array<float>, episodes array<string>, expired_at timestamp, valid_at timestamp, invalid_at timestamp, attributes string")
MENTIONS = StructType.fromDDL("uuid string, src string, dst string, group_id string, created_at timestamp")
HAS_MEMBER = StructType.fromDDL("uuid string, src string, dst string, dst_label string, group_id string, created_at timestamp")
TOKEN_USAGE = StructType.fromDDL("id string, timestamp timestamp, model string, total_tokens int, prompt_tokens int, completion_tokens int, cost_usd double, user_id string, session_id string, request_source string, ingestion_source string, is_system_call boolean")
CHECKPOINT = StructType.fromDDL("episode_id string, group_id string, step string, created_at timestamp, last_updated_at timestamp, attempt_count int, last_error string")
#: What an extractor returns for a chunk of text.
EXTRACTED_ENTITY = StructType.fromDDL("name string, entity_type string")
EXTRACTED_EDGE = StructType.fromDDL("src_name string, dst_name string, name string, fact string, valid_at string, invalid_at string")
EPISODE = StructType.fromDDL("uuid string, name string, content string, source string, group_id string, reference timestamp")
