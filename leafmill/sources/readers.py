"""Readers: folders of HTML files, single files, texts and request definitions.

Guards are column predicates, so that oversized or badly encoded files become diagnostics
without ever reaching Python.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import MAX_BYTES, Output, Request, Selection, byte_size

DEFINITION_VERSION = 4


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, glob: str = "*.htm*", streaming: bool = False) -> DataFrame:
    """path, html, bytes_read and load_error of every file below ``path``; html is null where there is an error."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if streaming else spark.read).format("binaryFile")
    files = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    label = F.regexp_replace("path", "^file:/*", "/")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.when(F.col("length") > max_bytes, F.concat(label, F.lit(f" exceeds {byte_size(max_bytes)} limit."))).when(text.isNull(), F.concat(label, F.lit(" is not valid UTF-8")))
    return files.select(label.alias("path"), F.when(error.isNull(), text).alias("html"), F.col("length").alias("bytes_read"), error.alias("load_error"))


def load_errors(files: DataFrame) -> DataFrame:
    """path, level, code and message of the files that could not be loaded."""
    return files.where("load_error IS NOT NULL").select("path", F.lit("error").alias("level"), F.lit("SOURCE_LOAD_FAILED").alias("code"), F.col("load_error").alias("message"))


def from_text(spark: SparkSession, html: str, label: str = "memory", base_url: str | None = None) -> DataFrame:
    return spark.createDataFrame([(label.strip() or "memory", html, base_url)], "path string, html string, base_url string")


def from_stdin(spark: SparkSession) -> DataFrame:
    return from_text(spark, sys.stdin.buffer.read().decode("utf-8"), "-")


# -- request definitions -------------------------------------------------------------------------

_EXTRACTION = {"strategy", "selector", "pattern", "boundary_retention", "selection", "value"}


class DefinitionError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _known(part: dict, names: set[str], where: str) -> None:
    if extra := sorted(set(part) - names):
        raise DefinitionError("definition_invalid", f"unknown field {extra[0]!r} in {where}")


def definition_of(request: Request, prefix: str = "leafmill") -> dict:
    """A request as a reusable JSON document; defaults are left out."""
    spec: dict = {"strategy": "selector", "selector": request.selector} if request.selector is not None else {
        "strategy": "slice", "pattern": {"mode": "regex" if request.regex else "literal", "from": request.start, "to": request.end} | ({"flags": request.flags} if request.flags else {})}
    if request.retention != "exclude-both":
        spec["boundary_retention"] = request.retention
    if request.selection != Selection():
        spec["selection"] = {"type": request.selection.mode} | ({"index": request.selection.index} if request.selection.mode == "nth" else {})
    if request.value != "text":
        spec["value"] = {"type": request.value} | ({"name": request.attribute} if request.value == "attribute" else {})
    output = {k: v for k, v in vars(request.output).items() if v != getattr(Output(), k)}
    out = {"schema_name": f"{prefix}.extraction_definition", "schema_version": DEFINITION_VERSION, "request": {"spec_version": request.spec_version, "extraction": spec}}
    if output:
        out["request"]["output"] = output
    return out | ({"runtime": {"max_bytes": request.max_bytes}} if request.max_bytes != MAX_BYTES else {})


def request_of(text: str) -> Request:
    """The request of a JSON definition; :class:`DefinitionError` with a code of its own for each kind of fault."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise DefinitionError("definition_json_invalid", str(e)) from e
    if not isinstance(doc, dict) or not str(doc.get("schema_name", "")).endswith(".extraction_definition") or doc.get("schema_version") != DEFINITION_VERSION:
        raise DefinitionError("definition_schema_unsupported", "not an extraction definition of the supported version")
    _known(doc, {"schema_name", "schema_version", "request", "runtime"}, "definition")
    request = doc.get("request", {})
    _known(request, {"spec_version", "extraction", "output", "source"}, "request")
    spec = request.get("extraction", {})
    _known(spec, _EXTRACTION, "extraction")
    selection, value = spec.get("selection", {}), spec.get("value", {})
    output = Output(**request.get("output", {}))
    common = {
        "selection": Selection(selection.get("type", "first"), selection.get("index", 1)), "value": value.get("type", "text"), "attribute": value.get("name"), "output": output,
        "retention": spec.get("boundary_retention", "exclude-both"), "spec_version": request.get("spec_version", 7), "max_bytes": doc.get("runtime", {}).get("max_bytes", MAX_BYTES),
    }
    if spec.get("strategy") == "selector":
        return Request(selector=spec.get("selector", ""), **common)
    if spec.get("strategy") == "slice":
        pattern = spec.get("pattern", {})
        return Request(start=pattern.get("from", ""), end=pattern.get("to", ""), regex=pattern.get("mode") == "regex", flags=pattern.get("flags", ""), **common)
    raise DefinitionError("definition_strategy_unknown", f"unknown strategy {spec.get('strategy')!r}")
