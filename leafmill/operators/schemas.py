"""Spark schemas of results, and the tables of operations and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.extract import Output

RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
DIAGNOSTIC = T.StructType([T.StructField(n, T.StringType()) for n in ("level", "code", "message", "details")])
METADATA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("candidate_count", T.LongType()), T.StructField("candidate_index", T.LongType()), T.StructField("path", T.StringType()),
    T.StructField("tag_name", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("selected_range", RANGE), T.StructField("inner_range", RANGE),
    T.StructField("outer_range", RANGE), T.StructField("include_start", T.BooleanType()), T.StructField("include_end", T.BooleanType()), T.StructField("matched_start", T.StringType()), T.StructField("matched_end", T.StringType()),
])
MATCH = T.StructType([
    T.StructField("index", T.LongType()), T.StructField("path", T.StringType()), T.StructField("value_type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("html", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("preview", T.StringType()), T.StructField("metadata", METADATA),
])
SOURCE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("bytes_read", T.LongType()), T.StructField("input_base_url", T.StringType()),
    T.StructField("effective_base_url", T.StringType()), T.StructField("text", T.StringType()),
])
RESULT = T.StructType([
    T.StructField("operation_id", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("source", SOURCE), T.StructField("document_title", T.StringType()),
    T.StructField("candidate_count", T.LongType()), T.StructField("match_count", T.LongType()), T.StructField("matches", T.ArrayType(MATCH)), T.StructField("diagnostics", T.ArrayType(DIAGNOSTIC)),
])
NODE = T.StructType([
    T.StructField("node_id", T.LongType()), T.StructField("parent_id", T.LongType()), T.StructField("pre", T.LongType()), T.StructField("post", T.LongType()), T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()), T.StructField("ns", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("elem_ordinal", T.IntegerType()), T.StructField("elem_last", T.IntegerType()), T.StructField("type_ordinal", T.IntegerType()),
    T.StructField("type_last", T.IntegerType()), T.StructField("is_empty", T.BooleanType()), T.StructField("path", T.StringType()),
])

OPERATIONS = [
    ("document.parse", "Load and parse a document.", None), ("source.inspect", "Summarise a document and recommend selectors.", "inspect source"),
    ("select.preview", "Preview a selector extraction.", "inspect select"), ("slice.preview", "Preview a slice extraction.", "inspect slice"),
    ("select.extract", "Extract with a CSS selector.", "select"), ("slice.extract", "Extract between two boundaries.", "slice"),
]
SCHEMAS = [
    ("source_request", 7, "core"), ("runtime_options", 7, "core"), ("inspection_options", 7, "core"), ("extraction_request", 7, "core"), ("extraction_definition", 4, "core"), ("extraction_result", 6, "core"),
    ("source_inspection_result", 5, "core"), ("plan", 8, "interop"), ("result", 9, "interop"), ("error", 3, "interop"), ("extraction_report", 7, "cli"), ("source_inspection_report", 5, "cli"),
    ("error_report", 2, "cli"), ("catalog_report", 5, "cli"), ("schema_report", 2, "cli"), ("schema_inventory_report", 1, "cli"),
]


def operation_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OPERATIONS, "operation_id string, description string, command string")


def schema_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMAS, "schema_name string, schema_version int, owner string").orderBy("schema_name", "schema_version")

COUNT = T.StructType([T.StructField("name", T.StringType()), T.StructField("count", T.LongType())])
CANDIDATE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("selector", "path", "tag_name")], *[T.StructField(n, T.LongType()) for n in ("text_char_count", "heading_count", "link_count")]])
HEADING = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("path", T.StringType())])
LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "resolved_href", "href", "path")])
INSPECTION = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("root_tag", T.StringType()),
    *[T.StructField(f"{n}_count", T.LongType()) for n in ("element", "text_char", "link", "image", "form", "table", "script", "style")],
    T.StructField("document_base_href", T.StringType()), T.StructField("effective_base_url", T.StringType()), T.StructField("top_tags", T.ArrayType(COUNT)), T.StructField("top_classes", T.ArrayType(COUNT)),
    T.StructField("extraction_candidates", T.ArrayType(CANDIDATE)), T.StructField("reading_candidates", T.ArrayType(CANDIDATE)), T.StructField("headings", T.ArrayType(HEADING)), T.StructField("links", T.ArrayType(LINK)),
    T.StructField("diagnostics", T.ArrayType(DIAGNOSTIC)),
])

#: Shapes of documents: a name of a type, a list of one shape, or a record of shapes.
Shape = str | list | dict
_NAME = {"schema_name": "string", "schema_version": "integer"}
_EXTRACTION = {
    "strategy": "string", "selector": "string", "pattern": {"mode": "string", "from": "string", "to": "string", "flags": "string"}, "boundary_retention": "string",
    "selection": {"type": "string", "index": "integer"}, "value": {"type": "string", "name": "string"},
}
_SHOWN = {f: {bool: "boolean", int: "integer"}.get(type(v), "string") if not isinstance(v, (tuple, frozenset)) else ["string"] for f, v in vars(Output()).items()}
_REQUEST = {"spec_version": "integer", "extraction": _EXTRACTION, "output": _SHOWN, "source": {"kind": "string", "value": "string", "base_url": "string"}}
_SAID = [{"level": "string", "code": "string", "message": "string", "details": "any"}]
_SEAL = {"interop_profile": "string", **_NAME, "plan_digest_sha256": "string", "strategy_kind": "string", "diagnostics": _SAID}
_TEXTS = {n: "string" for n in ("text_output", "plain_text_output", "inner_html_output", "outer_html_output", "selected_html_output", "comparison_text_output", "comparison_plain_text_output")}
_LISTED = {**_NAME, "owner": "string"}
#: Documents that are read refuse fields that are not theirs.
READ: dict[str, Shape] = {
    "source_request": _REQUEST["source"], "inspection_options": {"include_source_text": "boolean", "sample_limit": "integer"},
    "runtime_options": {"max_bytes": "integer", "fetch_timeout_ms": "integer", "fetch_connect_timeout_ms": "integer", "fetch_preflight": "string", "tls_trust": {"kind": "string", "path": "string"}},
    "extraction_request": _REQUEST, "extraction_definition": {**_NAME, "request": _REQUEST, "runtime": {"max_bytes": "integer"}},
    "plan": {
        "interop_profile": "string", **_NAME, "strategy": {"kind": "string", "selector": "string", "start": "string", "end": "string", "mode": "string", "flags": ["string"], "boundary_retention": "string"},
        "selection": {"mode": "string", "index": "integer"}, "output": {"kind": "string", "name": "string"},
        "rendering": {"whitespace": "string", "rewrite_urls": "boolean"}, "dom_canonicalization": {"ignore_attributes": ["string"], "strip_whitespace_nodes": "boolean"},
    },
}
#: Documents that are written; results have the Spark types of their rows.
WRITTEN: dict[str, Shape | T.StructType] = {
    "extraction_result": RESULT, "source_inspection_result": INSPECTION, "extraction_report": RESULT, "source_inspection_report": INSPECTION,
    "result": {
        **_SEAL, "result_digest_sha256": "string", "candidate_count": "integer", "selection_mode": "string", "output": {"kind": "string", "name": "string"},
        "source": {"input_base_url": "string", "effective_base_url": "string", "document_title": "string"}, "selected_matches": [{"candidate_index": "integer", "metadata": "any", "output_value": "any", **_TEXTS}],
    },
    "error": {**_SEAL, "error_digest_sha256": "string", "error_code": "string", "message": "string", "details": "any"}, "error_report": {"code": "string", "message": "string", "hint": "string"},
    "catalog_report": {**_NAME, "operations": [{"operation_id": "string", "description": "string", "command": "string"}]},
    "schema_report": {**_NAME, "schemas": [{**_LISTED, "json_schema": "any"}]}, "schema_inventory_report": {**_NAME, "schemas": [_LISTED]},
}


def _shape(kind: T.DataType) -> Shape:
    if isinstance(kind, T.StructType):
        return {f.name: _shape(f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_shape(kind.elementType)]
    if isinstance(kind, T.MapType):
        return "map"
    return {"string": "string", "boolean": "boolean"}.get(kind.typeName(), "integer")


def _described(shape: Shape, closed: bool) -> dict:
    if isinstance(shape, dict):
        return {"type": ["object", "null"], "properties": {n: _described(x, closed) for n, x in shape.items()}} | ({"additionalProperties": False} if closed else {})
    if isinstance(shape, list):
        return {"type": ["array", "null"], "items": _described(shape[0], closed)}
    return {"any": {}, "map": {"type": ["object", "null"], "additionalProperties": {"type": "string"}}}.get(shape, {"type": [shape, "null"]})


def json_schema(name: str) -> dict:
    """The JSON Schema document of a schema of the catalog."""
    version = next(v for n, v, _ in SCHEMAS if n == name)
    shape = READ[name] if name in READ else WRITTEN[name]
    shape = _shape(shape) if isinstance(shape, T.StructType) else shape
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": f"urn:leafmill:{name}@{version}", "title": name.replace("_", " ")} | _described(shape, name in READ) | {"type": "object"}
