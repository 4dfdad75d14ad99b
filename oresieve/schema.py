"""Schemas of the component table and of graph tables."""

from __future__ import annotations

LOCATION = "struct<file_path:string,start_line:int,end_line:int,start_column:int,end_column:int>"
PARAMETER = "struct<name:string,type_hint:string,default_value:string,is_required:boolean,description:string>"
COMPONENTS = (
    f"id string, name string, type string, language string, location {LOCATION}, source_code string, signature string, parameters array<{PARAMETER}>, "
    "return_type string, decorators array<string>, parent_classes array<string>, methods array<string>, attributes array<map<string,string>>, "
    "existing_docstring string, calls array<string>, imports array<string>, depends_on array<string>, complexity int, lines_of_code int, "
    "is_async boolean, is_generator boolean, is_abstract boolean, is_static boolean, is_class_method boolean, is_public boolean, is_private boolean, "
    "is_protected boolean, priority int, dependency_level int, metadata map<string,string>, http_method string, http_path string, framework string, "
    "path_parameters array<string>, query_parameters array<string>, request_body string, response_model string, status_codes array<int>, tags array<string>, scan_ord long"
)
NODES = "graph_id string, id string, label string, type string, line int, code string, metadata map<string,string>"
EDGES = "graph_id string, source string, target string, type string, label string, metadata map<string,string>"
EXECUTIONS = "file_ord int, line_no long, ts timestamp_ntz, agent_name string, component_name string, action string, status string, level string, message string"
