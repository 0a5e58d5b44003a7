"""Explicit types of the graph tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

S, L = T.StringType(), T.LongType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k.rstrip("_"), v) for k, v in fields.items()])


POINT = struct(line=L, column=L)
#: Byte offsets; lines and columns count from one. Unsigned 32-bit values need a long.
SPAN = struct(byte_start=L, byte_end=L, start=POINT, end=POINT)
SOURCES = struct(repo_id=S, file_id=S, path=S, language=S, fingerprint=S, text=S)
FILES = struct(file_id=S, path=S, language=S, fingerprint=S, parse_time_micros=L, extraction_time_micros=L, partition_pos=L)
NODES = struct(file_part=S, ord=L, id=S, kind=S, language=S, name=S, qualified_name=S, symbol_kind=S, file_id=S, span=SPAN, provenance=S, confidence=S)
EDGES = struct(file_part=S, ord=L, id=S, kind=S, from_=S, to=S, span=SPAN, provenance=S, confidence=S)
DIAGNOSTICS = struct(file_part=S, ord=L, severity=S, message=S, file_id=S, span=SPAN)
MANIFEST = struct(file_id=S, path=S, fingerprint=S, partition_file=S, record_index=L)
SKIPPED = struct(path=S, reason=S)

# The spelling and order of the enumerations of the data model.
SYMBOL_KINDS = ["function", "method", "class", "interface", "type-alias", "enum", "variable", "module", "field", "unknown"]
NODE_KINDS = ["repository", "directory", "file", "module", "symbol", "import", "export", "package", "external-symbol", "span", "chunk"]
EDGE_KINDS = ["contains", "defines", "imports", "exports", "calls", "references", "extends", "implements", "overrides", "depends-on", "tests"]
LANGUAGES = ["c", "cpp", "go", "javascript", "json", "java", "objective-c", "typescript", "python", "rust", "unknown"]
#: Where the serialised spelling of a language differs from its key.
LANGUAGE_TAGS = {"javascript": "java-script", "typescript": "type-script"}
#: Authority of a fact's source, least first: rank 1 to 6.
PROVENANCES = ["structural-scanner", "tree-sitter", "lsp", "scip", "compiler", "manual"]
CONFIDENCES = ["low", "medium", "high", "exact"]
SEVERITIES = ["info", "warning", "error"]
RISKS = ["low", "medium", "high"]
CHANGES = ["added", "removed", "modified", "renamed", "type-changed", "copied"]


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
