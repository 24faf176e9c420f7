"""Typed scans of the fact tables (one Parquet file or folder each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of each fact table: the engine's data model.
SCHEMAS: dict[str, str] = {
    "runs": "id string, created_at_utc_text string, solution_path string, symbol_count int, reference_count int, di_registration_count int, project_identity string, source_project_path string, source_commit string, source_branch string, source_dirty boolean",
    "symbol_facts": "run_id string, fact_index int, symbol_id string, kind string, name string, namespace_name string, containing_symbol_id string, modifiers string, type_kind string, signature string, file_path string, line int, end_line int, defining_assembly string, is_override boolean, body_hash string, loaded_at timestamp_ntz",
    "reference_facts": "run_id string, fact_index int, target_symbol_id string, ref_kind string, enclosing_symbol_id string, target_assembly string, target_in_source boolean, file_path string, line int, receiver_type string, first_argument_template string, enclosing_loop_kind string, enclosing_loop_detail string, non_virtual boolean, enclosing_guards string, loaded_at timestamp_ntz",
    "call_edges": "from_sym string, to_sym string, kind string, file_path string, line int, loop_kind string, loop_detail string, receiver_type string, handoff_dispatcher string, delivery_precision string, non_virtual boolean, enclosing_guards string",
    "source_files": "run_id string, file_index int, project_name string, file_path string, status string, confidence string, basis string, reason string, evidence string",
    "file_texts": "run_id string, file_index int, text string, size_bytes long",
    "upstream_files": "upstream_id int, library string, library_version string, file_name string, text string",
    "context_windows": "window_id int, tokenizer string, capacity_tokens int",
    "type_relation_facts": "type_symbol_id string, related_symbol_id string, relation_kind string",
    "dispatch_facts": "source_member string, target_member string, kind string",
    "allocation_facts": "operation string, resource_type string, enclosing_symbol_id string, file_path string, line int, loop_kind string, loop_detail string, guards string, mechanism string, cardinality string, shallow_size_bytes long, size_confidence string, size_basis string",
    "di_registrations": "service_type string, implementation_type string, lifetime string, registration_kind string, file_path string, line int, confidence string, basis string, reason string, evidence string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet`` with the file's own schema; columns are pruned by the plan that reads it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
