"""Tables of the index: explicit schemas, their enumerations, and the check that stands in for CHECK constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

SCHEMA_VERSION, CHUNKER_VERSION = 1, 1

TYPES = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType(), "array<float>": ArrayType(FloatType(), False)}


def schema(ddl: str) -> StructType:
    """From `name type [not null], ...`; needs no session."""
    fields = [c.split(" ", 2) for c in ddl.split(", ")]
    return StructType([StructField(f[0], TYPES[f[1]], len(f) < 3) for f in fields])


TABLES = {
    name: schema(ddl)
    for name, ddl in {
        "files": "id long, path string not null, content_hash string not null, mtime double not null, size long, language string, indexed_at timestamp, embedding_status string, parse_quality string, is_test boolean not null, project_id long not null",
        "chunks": "id long, file_id long not null, parent_chunk_id long, chunk_index int not null, symbol_name string, kind string, start_line int not null, end_line int not null, content string not null, token_count int not null, signature string, parse_quality string, embedded boolean not null",
        "symbols": "id long, chunk_id long not null, file_id long not null, name string not null, qualified_name string, kind string, line int not null, signature string, visibility string, is_exported boolean not null",
        "edges": "id long, src_symbol_id long not null, dst_symbol_id long not null, kind string, file_id long",
        "pending_edges": "id long, src_symbol_id long not null, file_id long not null, dst_symbol_name string not null, kind string, created_at timestamp, dst_qualified_name string, src_language string",
        "diff_log": "id long, file_id long not null, timestamp timestamp not null, change_type string, lines_added int not null, lines_removed int not null, hash_before string, hash_after string",
        "diff_symbols": "id long, diff_id long not null, symbol_id long, symbol_name string not null, change_type string, chunk_id long",
        "embeddings": "chunk_id long, embedding array<float>, project_id long",
        "tool_calls": "id long, session_id string not null, timestamp timestamp not null, tool_name string not null, args_json string, args_bytes long, response_bytes long, response_tokens_est long, result_count long, duration_ms long, is_error boolean",
        "projects": "id long, root_path string, name string, created_at timestamp",
        "config": "key string, value string",
    }.items()
}
ENUMS = {
    ("files", "embedding_status"): {"pending", "partial", "complete"},
    ("files", "parse_quality"): {"full", "partial", "error", "unparseable"},
    ("chunks", "kind"): {"function", "class", "method", "type", "interface", "header", "block"},
    ("symbols", "kind"): {"function", "class", "method", "type", "interface", "variable", "constant", "namespace"},
    ("symbols", "visibility"): {"public", "private", "internal", "exported"},
    ("edges", "kind"): {"imports", "calls", "type_ref", "inherits", "implements"},
    ("diff_log", "change_type"): {"add", "modify", "delete", "rename"},
    ("diff_symbols", "change_type"): {"added", "modified", "removed", "signature_changed", "moved"},
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break an enumeration or a NOT NULL of the table."""
    broken: list[Column] = [~F.col(c).isin(*sorted(v)) for (t, c), v in ENUMS.items() if t == table and c in df.columns]
    broken += [F.col(f.name).isNull() for f in TABLES[table] if not f.nullable and f.name in df.columns]
    return df.where(reduce(lambda a, b: a | b, broken, F.lit(False)))
