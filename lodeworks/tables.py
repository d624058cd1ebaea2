"""Tables: the Parquet inputs, and the schemas of the library's own entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by keys, before work that takes long for each row: a small file is few tasks as it is read."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


#: DDL of the entities that snapshots consist of; arrays of records are child tables with the parent's key.
SCHEMAS = {
    "files": "id string, path string, basename string, extension string, category string, language string, package_id string, size_bytes bigint, line_count bigint, sha256 string, is_text boolean, encoding string, generated boolean, executable boolean, symlink boolean, symlink_target string, git_object_id string, warnings array<string>",
    "packages": "id string, name string, version string, private boolean, directory string, manifest_path string, manifest_sha256 string, scripts map<string,string>, dependencies map<string,string>, dev_dependencies map<string,string>, peer_dependencies map<string,string>, exports variant, main string, files array<string>",
    "doc_sections": "document_id string, path string, section_id string, heading string, level int, line_start int, line_end int, parent_section_id string, anchor string, content_sha256 string",
    "doc_links": "document_id string, text string, target string, line int, external boolean, resolved_path string, broken boolean",
    "edges": "id string, type string, src string, dst string, evidence_path string, confidence string",
    "symbols": "id string, name string, qualified_name string, kind string, module_id string, package_id string, file_path string, line_start int, line_end int, declaration_sha256 string, signature string, exported boolean, public_reachable boolean, public_packages array<string>, public_export_names array<string>, members array<string>, heritage array<string>",
    "imports": "id string, module_id string, source_specifier string, resolved_module_id string, imported_name string, local_name string, type_only boolean, line int, resolution_status string",
    "exports": "id string, module_id string, exported_name string, local_name string, symbol_id string, source_specifier string, resolved_module_id string, type_only boolean, is_default boolean, re_export boolean, line int, resolution_status string",
    "page_captures": "url string, source_id string, status int, requested_mode string, capture_mode string, captured_at timestamp, title string, content_type string, body string, warnings array<string>",
    "source_values": "component string, item_kind string, kind string, name string, type string, default_value string, commit string, ordinal int",
    "step_logs": "run_id string, step_id string, command string, exit_code int, status string, allow_failure boolean, stdout string, stderr string, source_root string, lab_root string, ordinal int",
    "error_events": "id string, parser string, tool string, category string, severity string, step_id string, message string, file string, line int, col int, rule string, code string, plugin string, raw_excerpt string, source_log string, fingerprint string, blocking boolean, confidence string",
    "steps": "run_id string, id string, ordinal int, started_at timestamp, finished_at timestamp, duration_ms bigint, exit_code int, status string, allow_failure boolean, timeout_seconds int",
    "claims": "unit_id string, id string, text string, status string, confidence string, evidence_ids array<string>, tags array<string>",
    "candidates": "id string, type string, title string, source_path string, score bigint, confidence string, selected boolean, excluded_reason string",
    "acceptance": "id string, type string, required boolean, automated boolean, status string, expected variant, actual variant",
    "changed_files": "path string, status string, old_path string, generated boolean, is_binary boolean",
    "history": "seq int, ts timestamp, previous_status string, next_status string, command string, reason string, evidence_file string",
}
