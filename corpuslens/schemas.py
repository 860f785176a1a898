"""Explicit schemas. Nothing in the package infers one."""

CLASSES = "array<struct<name:string,public_methods:array<string>>>"

FILE_ANALYSIS = (
    "project string, path string, headers array<string>, "
    f"classes {CLASSES}, parse_error string"
)

ANALYSIS_DOCUMENT = (
    "root string, first bigint, files array<struct<path:string,headers:array<string>,"
    f"classes:{CLASSES},parse_error:string>>"
)

REVIEW_SNAPSHOT = (
    "project string, path string, rule_based_issues array<string>, ai_status string, "
    "ai_analysis string, file_hash string, model string, run_id string, run_ts timestamp"
)

RUN_STATE = "project string, started_at double, run_id string"
