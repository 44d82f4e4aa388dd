"""Schemas of the domain tables."""

FILES = "file_id bigint, path string, language string, content_hash binary, mtime bigint, size bigint"
NODES = (
    "node_id bigint, kind string, name string, qualified_name string, path string, line_start int, line_end int, signature string, "
    "return_type string, receiver_type string, is_exported boolean, complexity int, decorators array<string>"
)
EDGES = "source_id bigint, target_id bigint, edge_type string, confidence double, path string, line int, metadata string"
CALLS = "path string, callee string, line int, col int, caller_qualified string"
IMPORTS = "path string, local_name string, module string, module_path string"
IMPORT_EDGES = "importer_file_id bigint, imported_file_id bigint"
EXTRACTED = (
    "path string, symbols array<struct<kind:string,name:string,qualified_name:string,line_start:int,line_end:int,signature:string,return_type:string,"
    "receiver_type:string,is_exported:boolean,complexity:int,decorators:array<string>>>, "
    "calls array<struct<callee:string,line:int,col:int,caller_qualified:string>>, imports array<struct<local_name:string,module_path:string>>"
)
