"""Schemas of the engine's tables."""

SYMBOLS = (
    "file_path string, ordinal int, name string, qualified_name string, kind string, language string, signature string, "
    "documentation string, body string, exported boolean, start_line int, start_col int, end_line int, end_col int, "
    "calls array<string>, implements array<string>"
)
IMPORTS = "file_path string, pos int, imp string"
NODES = "id string, type string, file_path string, symbol struct<name string, qualified_name string, kind string, language string, signature string, documentation string, body string>, token_cost int, skel_cost int"
EDGES = "src string, dst string, type string, weight double"
FILE_CACHE = "rel_path string, size bigint, mtime_ns bigint, checksum string, symbols array<struct<" + SYMBOLS.replace(" string", ":string").replace(" int", ":int").replace(" boolean", ":boolean").replace(" array", ":array") + ">>, imports array<string>"
FS_EVENTS = "repo_id string, path string, op string, ts timestamp"
