"""Schemas of the engine's relations, as DDL."""

FILES = "task_id bigint, file_path string, content string"
LINES = "task_id bigint, file_path string, line_no int, line string"
TOKENS = "task_id bigint, file_path string, idx int, text string, line int"
IMPORTS = "task_id bigint, file_path string, line int, fqcn string, simple_name string, pkg string, is_star boolean, is_static boolean"
TYPES = "task_id bigint, file_path string, fqcn string, simple_name string, kind string, line int, line_end int, annotations array<string>, supertypes array<string>, snippet string"
METHODS = (
    "task_id bigint, file_path string, class_name string, method string, descriptor string, arity int, line int, line_end int, "
    "is_public boolean, is_static boolean, is_ctor boolean, is_abstract boolean, is_native boolean, is_override boolean, "
    "annotations array<string>, complexity int, snippet string"
)
VARIABLES = (
    "task_id bigint, file_path string, class_name string, method string, name string, type string, kind string, modifiers array<string>, "
    "annotations array<string>, line int, init string, snippet string"
)
CALLS = (
    "task_id bigint, file_path string, caller string, caller_class string, scope string, callee_class string, callee string, arity int, "
    "args array<string>, line int, kind string"
)
RAW_HITS = (
    "task_id bigint, file_path string, rule_code string, level string, checker_type string, checker_name string, line_start int, "
    "line_end int, title string, description string, code_snippet string, suggestion string, severity int, ai_generated boolean"
)
REVIEW_RULE = "rule_code string, rule_name string, rule_category string, default_level string, is_enabled boolean, sort_order int"
IGNORE_RULE = "id bigint, rule_type string, rule_code string, file_pattern string, file_path string, line_number int, is_enabled boolean"
CHECKER_CONFIG = "checker_code string, is_enabled boolean, params string, sort_order int"
DEPENDENCIES = "task_id bigint, group_id string, artifact_id string, version string, scope string"
ADVISORIES = "id string, cve string, group_id string, artifact_id string, introduced string, fixed_version string, severity string"
CI_EVENTS = "event_id bigint, trigger_id bigint, platform string, payload string"
