"""Column types of the graph tables."""

from __future__ import annotations

TABLES = {
    "nodes": "id string, file_path string, title string, body string, content_hash string, file_mtime long, indexed_at long, created_at long, version int",
    "node_types": "node_id string, schema_type string, sort_order int",
    "node_fields": "node_id string, field_name string, value_text string, value_number double, value_date string, value_json string, value_raw_text string, source string",
    "relationships": "source_id string, target string, rel_type string, context string, resolved_target_id string",
    "global_fields": "name string, field_type string, enum_values array<string>, default_value string, required boolean, ov_required boolean, ov_default boolean, ov_enum boolean, list_item_type string",
    "claims": "schema_name string, field string, label string, description string, sort_order int, required_override boolean, default_overridden boolean, default_override string, enum_override array<string>",
    "schemas": "name string, display_name string, filename_template string, default_directory string",
    "edits_log": "node_id string, timestamp long, event_type string, details string",
    "sync_log": "id long, timestamp long, file_path string, event string, source string, details string",
    "undo_operations": "operation_id string, timestamp long, source_tool string, description string, node_count int, status string",
    "undo_snapshots": "operation_id string, node_id string, file_path string, title string, body string, file_mtime long, created_at long, version int, types array<struct<sort_order:int,schema_type:string>>, "
    "fields array<struct<field_name:string,value_text:string,value_number:double,value_date:string,value_json:string>>, edges array<struct<target:string,rel_type:string,context:string,resolved_target_id:string>>, was_deleted boolean, post_mutation_hash string",
}
EDIT_EVENTS = {"file-indexed", "index-error", "file-deleted", "parse-error", "value-coerced", "value-rejected", "merge-conflict", "field-defaulted", "fields-orphaned", "value-removed", "bulk-mutate", "reconciler-error", "reconciler-sweep", "normalizer-sweep"}
SYNC_EVENTS = {"watcher-event", "parse-retry", "file-written", "noop"}
