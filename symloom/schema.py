"""The tables of a code index as Spark types, and the record that an extractor gives for a file."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = "file_id bigint, path string, language string, content_hash binary, size_bytes bigint, modified_at bigint, indexed_at bigint"
SYMBOLS = (
    "id bigint, file_id bigint, qualified_name string, name string, kind string, start_line int, start_col int, end_line int, end_col int, "
    "body_start_byte bigint, body_end_byte bigint, signature string, visibility string, parent_symbol_id bigint, doc_comment string"
)
REFS = "id bigint, symbol_id bigint, file_id bigint, line int, col int, end_line int, end_col int, kind string, raw_name string"
CALLS = "id bigint, caller_symbol_id bigint, callee_symbol_id bigint, callee_raw_name string, file_id bigint, line int, col int"
IMPORTS = "id bigint, file_id bigint, raw_path string, resolved_file_id bigint, resolved_symbol_id bigint, alias string, line int"
TYPES = "id bigint, symbol_id bigint, relation string, target_symbol_id bigint, target_raw_name string, file_id bigint, line int"
TABLES = {"files": FILES, "symbols": SYMBOLS, "refs": REFS, "calls": CALLS, "imports": IMPORTS, "types": TYPES}
#: Tables that hang on a file.
OWNED = ["types", "imports", "calls", "refs", "symbols"]

#: What extraction finds in one file; each list becomes a table.
EXTRACTED = (
    "path string, language string, content_hash binary, size_bytes bigint, modified_at bigint, "
    "symbols array<struct<qualified_name:string,name:string,kind:string,start_line:int,start_col:int,end_line:int,end_col:int,"
    "body_start_byte:bigint,body_end_byte:bigint,signature:string,visibility:string,parent_qualified_name:string,doc_comment:string>>, "
    "refs array<struct<line:int,col:int,end_line:int,end_col:int,kind:string,raw_name:string>>, "
    "calls array<struct<caller_qualified_name:string,callee_raw_name:string,line:int,col:int>>, "
    "imports array<struct<raw_path:string,alias:string,line:int>>, "
    "types array<struct<owner_qualified_name:string,relation:string,target_raw_name:string,line:int>>"
)


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
