"""Schemas of the fact tables and of the artifacts."""

from __future__ import annotations

SPAN = "struct<file_path:string,start_line:int,start_column:int,end_line:int>"

FILES = (
    "seq bigint, target_id string, target_id_stability string, project_key string, file_path string, start_line int, end_line int, "
    "lines_of_code int, token_line_count int, blank_line_count int, comment_only_line_count int, commented_line_count int, "
    "mixed_code_comment_line_count int, documentation_comment_line_count int"
)
TYPES = (
    "target_id string, target_id_stability string, parent_file_target_id string, project_key string, name string, file_path string, start_line int, end_line int, "
    f"declarations array<{SPAN}>, lines_of_code int, token_line_count int, member_count int, "
    "semantic struct<inheritance_depth:int,class_coupling:int,public_api_count:int,documented_public_api_count:int>"
)
MEMBERS = (
    "target_id string, target_id_stability string, parent_type_target_id string, project_key string, name string, chunk_kind string, file_path string, start_line int, end_line int, "
    f"declarations array<{SPAN}>, control_flow struct<cyclomatic_complexity:int,decision_point_count:int,cognitive_complexity:int,nesting_depth:int>, member_length int, parameter_count int, "
    "operations struct<operation_count:int,allocation_count:int,await_count:int,control_flow_graph_count:int,basic_block_count:int,reachable_basic_block_count:int,"
    "unreachable_basic_block_count:int,control_flow_edge_count:int,cfg_cyclomatic_complexity:int>"
)
NAMESPACES = f"target_id string, project_key string, project_path string, name string, type_target_ids array<string>, declarations array<{SPAN}>"
EDGES = "from_id string, to_id string, kind string, confidence string"
DIAGNOSTICS = "diag_id bigint, id string, severity string, message string, project_path string, file_path string, start_line int, end_line int, tags array<string>"
PROJECTS = "project_path string, analyzed boolean"
PROJECT_DEPS = "from_project_path string, to_project_path string"
MEMBERSHIPS = "project_key string, file_path string"
REGIONS = "file_path string, start_line int, end_line int, tag string"
SOURCES = "file_path string, text string"
HEALTH = "analysis_quality string, semantic_model string, restore_status string, build_status string, trusted_diagnostics boolean, diagnostics_included_in_hotspot_rank boolean, messages array<string>"

METRICS = (
    "schema_version string, metric_id string, metric_version string, target_id string, target_kind string, target_id_stability string, value_kind string, "
    "numeric_value double, string_value string, bool_value boolean, unit string, file_path string, start_line int, end_line int, tags array<string>"
)
CHUNKS = (
    "schema_version string, chunk_id string, target_id string, target_kind string, target_id_stability string, chunk_kind string, file_path string, "
    "start_line int, end_line int, token_estimate int, text_hash string, related_target_ids array<string>, text string"
)
NODES = "id string, kind string, name string, target_id_stability string, file_path string, start_line int, end_line int, declarations array<struct<file_path:string,start_line:int,end_line:int>>"
HOTSPOTS = (
    "target_id string, target_kind string, target_name string, rank_no int, rank_score double, file_path string, start_line int, end_line int, "
    "reasons array<string>, components array<struct<metric_id:string,value:double,percentile:double,weight:double>>"
)

FACTS = {
    "files": FILES, "types": TYPES, "members": MEMBERS, "namespaces": NAMESPACES, "edges": EDGES, "diagnostics": DIAGNOSTICS, "projects": PROJECTS,
    "project_deps": PROJECT_DEPS, "memberships": MEMBERSHIPS, "regions": REGIONS, "sources": SOURCES,
}
