"""Extraction over a DataFrame of documents: one row in, one row out.

The plan is checked and compiled on the driver; a wrong one becomes a diagnostic on every
row without any parsing. Documents cross into Python in Arrow batches, once, whatever
number of plans runs on them; everything across documents is relational.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import urls
from ..functions.css import Matcher
from ..functions.dom import HTML, Document
from ..functions.extract import MAX_BYTES, Plan, Request, byte_size, parsed
from ..functions.inspect import inspect as inspect_one
from ..functions.interop import Sealed, stable_json
from ..functions.shipping import ship
from .schemas import DIAGNOSTIC, INSPECTION, NODE, RESULT


def spread(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``docs`` dealt over more tasks before costly work; unchanged unless asked."""
    return docs.repartition(partitions) if partitions else docs


#: A task of a plan that takes documents whole has about so many bytes of markup; a document counts as so many more, for the nodes that every tree has.
DEALT_BYTES, EACH_BYTES = 4 << 20, 512


def tasks_of(docs: DataFrame, html: str = "html") -> int:
    """How many tasks the markup of ``docs`` needs, counted in a pass over it; one for each core at least."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(html), F.lit(0)).cast("long") + EACH_BYTES)).first()[0] or 0
    return max(-(-total // DEALT_BYTES), docs.sparkSession.sparkContext.defaultParallelism)


def _batches(run: Callable[[dict], Iterator[dict]], schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches from one over rows; batches go out in bounded pieces."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, held = to_arrow_schema(schema), []
        for batch in batches:
            for row in batch.to_pylist():
                held += run(row)
                if len(held) >= 500:
                    yield pa.RecordBatch.from_pylist(held, shape)
                    held = []
        yield pa.RecordBatch.from_pylist(held, shape)

    return over


def measured(docs: DataFrame, html: str, most: int, hold_back: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with the bytes of each document, counted before any Python, and the name of that column; texts over ``most`` do not cross."""
    size, taken = "_bytes", {c.lower() for c in docs.columns}
    while size in taken:
        size = f"_{size}"
    out = docs.withColumn(size, F.coalesce(F.octet_length(F.col(html).cast("string")), F.lit(0)))
    return (out.withColumn(html, F.when(F.col(size) <= most, F.col(html))) if hold_back else out), size


def oversized(docs: DataFrame, html: str = "html", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The other columns, code, message and bytes_read of the documents over ``max_bytes``, with built-in functions alone."""
    out, size = measured(docs, html, max_bytes)
    said = F.lit(f"Preloaded source exceeds {byte_size(max_bytes)} limit.")
    return out.where(F.col(size) > max_bytes).select(*[c for c in docs.columns if c != html], F.lit("SOURCE_LOAD_FAILED").alias("code"), said.alias("message"), F.col(size).cast("long").alias("bytes_read"))


def _keys(docs: DataFrame, html: str, base: str | None) -> list[T.StructField]:
    return [f for f in docs.schema.fields if f.name not in (html, base)]


def _flat(result: dict) -> dict:
    """A result for Spark: open values as JSON text."""
    for m in result["matches"]:
        m["value"] = m["value"] if isinstance(m["value"], str) else stable_json(m["value"])
        m.pop("comparison", None)
        if "attributes" in m["metadata"]:
            m["metadata"]["attributes"] = list(m["metadata"]["attributes"].items())
    for d in result["diagnostics"]:
        d["details"] = None if d["details"] is None else stable_json(d["details"])
    return result


def extract(docs: DataFrame, request: Request, html: str = "html", base_url: str | None = None, partitions: int | None = None) -> DataFrame:
    """The other columns of ``docs`` and the result of ``request`` for each document."""
    return multi_extract(docs, {"": request}, html, base_url, partitions).drop("plan")


def multi_extract(docs: DataFrame, requests: Mapping[str, Request], html: str = "html", base_url: str | None = None, partitions: int | None = None) -> DataFrame:
    """Several named requests over one parse of each document; one row for each of both."""
    ship(docs.sparkSession)
    keys = _keys(docs, html, base_url)
    compiled = dict(requests)
    plans: dict[str, Plan] = {name: Plan(request) for name, request in compiled.items()}
    schema = T.StructType([*keys, T.StructField("plan", T.StringType()), *RESULT.fields])
    names = [f.name for f in keys]
    if all(p.error is not None for p in plans.values()):  # nothing to read: a literal answer beside the keys
        rows = [(name, *_literal(p)) for name, p in plans.items()]
        return docs.select(*names).crossJoin(F.broadcast(docs.sparkSession.createDataFrame(rows, T.StructType(schema.fields[len(keys) :]))))

    def run(row: dict) -> Iterator[dict]:
        for name, request in compiled.items():
            plan = _plan(request)
            yield {k: row[k] for k in names} | {"plan": name} | _flat(plan.run(row[html], row[base_url] if base_url else None, size=row[size]))

    most = max(r.max_bytes for r in compiled.values())
    known, size = measured(docs, html, most, not any(r.output.include_source_text for r in compiled.values()))
    return spread(known, partitions).mapInArrow(_batches(run, schema), schema)


def _literal(plan: Plan) -> tuple:
    got = _flat(plan.run(""))
    said = [tuple(d[n] for n in DIAGNOSTIC.names) for d in got["diagnostics"]]
    return got["operation_id"], False, None, None, 0, 0, [], said


_plans: dict[Request, Plan] = {}


def _plan(request: Request) -> Plan:
    """Compiled plans, once per worker."""
    if request not in _plans:
        _plans[request] = Plan(request)
    return _plans[request]


def matches(results: DataFrame) -> DataFrame:
    """One row per match."""
    keys = [c for c in results.columns if c not in RESULT.names]
    return results.select(*keys, F.inline("matches"))


def diagnostics(results: DataFrame) -> DataFrame:
    """One row per diagnostic."""
    keys = [c for c in results.columns if c not in RESULT.names]
    return results.select(*keys, F.inline("diagnostics"))


def run_plan(docs: DataFrame, plan: dict | str, html: str = "html", base_url: str | None = None, label: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each document's sealed result or error as stable JSON, with its digest and whether it is a result; texts over ``max_bytes`` don't cross into Python."""
    ship(docs.sparkSession)
    keys = _keys(docs, html, base_url)
    text = stable_json(json.loads(plan) if isinstance(plan, str) else plan)
    schema = T.StructType([*keys, T.StructField("is_result", T.BooleanType()), T.StructField("digest_sha256", T.StringType()), T.StructField("document", T.StringType())])
    names = [f.name for f in keys]

    def run(row: dict) -> Iterator[dict]:
        got = _sealed(text, max_bytes).run(row[html] or "", row[base_url] if base_url else None, str(row[label]) if label else "memory", row[size])
        good = "result_digest_sha256" in got
        yield {k: row[k] for k in names} | {"is_result": good, "digest_sha256": got["result_digest_sha256" if good else "error_digest_sha256"], "document": stable_json(got)}

    known, size = measured(docs, html, max_bytes)
    return known.mapInArrow(_batches(run, schema), schema)


_seals: dict[tuple[str, int], Sealed] = {}


def _sealed(text: str, max_bytes: int) -> Sealed:
    if (text, max_bytes) not in _seals:
        _seals[text, max_bytes] = Sealed(text, max_bytes)
    return _seals[text, max_bytes]


def node_rows(document: Document, paths: bool = True) -> list[dict]:
    """The nodes of a tree in document order with their interval, ordinals and paths."""
    clock, out, rows, places, named = 0, [], {}, Matcher(), {}
    todo = [(document.root, 0, False)]
    while todo:
        n, depth, leaving = todo.pop()
        if leaving:
            rows[n.number]["post"] = clock
        else:
            element = n.kind == "element"
            at = places.place(n) if element else (None,) * 4
            rows[n.number] = {
                "node_id": n.number, "parent_id": n.parent.number if n.parent is not None else None, "pre": clock, "post": None, "depth": depth, "kind": n.kind, "ns": n.ns if element else None,
                "tag": n.tag or None, "attrs": sorted(n.attrs.items()) if element else None, "text": n.text if n.kind in ("text", "comment", "doctype") else None, "elem_ordinal": at[0], "elem_last": at[1],
                "type_ordinal": at[2], "type_last": at[3], "is_empty": not any(c.kind == "element" or c.kind == "text" and c.text for c in n.children) if element else None,
                "path": named.get(n.number) if element and paths else None,
            }
            out.append(rows[n.number])
            todo.append((n, depth, True))
            todo.extend((c, depth + 1, False) for c in reversed(n.children))
            of_tag: dict[str, int] = {}
            for c in n.children if paths else ():  # as path_of says, from the parent's path
                if c.kind == "element":
                    of_tag[c.tag] = of_tag.get(c.tag, 0) + 1
                    named[c.number] = (f"{named[n.number]} > " if element else "") + f"{c.tag}:nth-of-type({of_tag[c.tag]})"
        clock += 1
    return out


def parse_nodes(docs: DataFrame, html: str = "html", paths: bool = True, partitions: int | None = None, max_bytes: int = MAX_BYTES, by: Sequence[str] | None = None) -> DataFrame:
    """The node table: the other columns of ``docs`` and one row per node; none for documents that :func:`oversized` tells.

    With ``by``, the key of a document, documents are dealt over :func:`tasks_of` them and their nodes over as many, for plans with windows over documents:
    neither what a task parses and writes nor what it sorts and holds grows with the corpus or with the splits it is read in.
    """
    docs = docs.where(F.coalesce(F.octet_length(F.col(html)), F.lit(0)) <= max_bytes)
    ship(docs.sparkSession)
    keys = _keys(docs, html, None)
    schema = T.StructType([*keys, *NODE.fields])
    names = [f.name for f in keys]

    def run(row: dict) -> Iterator[dict]:
        own = {k: row[k] for k in names}
        return (own | r for r in node_rows(parsed(row[html] or ""), paths))

    if not by:
        return spread(docs, partitions).mapInArrow(_batches(run, schema), schema)
    tasks = tasks_of(docs, html)
    whole = spread(docs, partitions) if partitions else docs.repartition(tasks, *by)
    return whole.mapInArrow(_batches(run, schema), schema).repartition(tasks, *by)


def links(docs: DataFrame, html: str = "html", base_url: str | None = None, partitions: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every ``a[href]``: its number, link, absolute link and label; none for documents that :func:`oversized` tells."""
    docs = docs.where(F.coalesce(F.octet_length(F.col(html)), F.lit(0)) <= max_bytes)
    ship(docs.sparkSession)
    keys = _keys(docs, html, base_url)
    schema = T.StructType([*keys, T.StructField("link_index", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("href", "resolved", "label")]])
    names = [f.name for f in keys]

    def run(row: dict) -> Iterator[dict]:
        document = parsed(row[html] or "")
        base = urls.effective_base(document, urls.redacted(row[base_url]) if base_url and row[base_url] else None)
        anchors = (e for e in document.elements() if e.tag == "a" and e.ns == HTML and "href" in e.attrs)
        for i, e in enumerate(anchors, 1):
            yield {k: row[k] for k in names} | {"link_index": i, "href": e.attrs["href"], "resolved": urls.resolve(base, e.attrs["href"]), "label": " ".join(e.content().split())}

    return spread(docs, partitions).mapInArrow(_batches(run, schema), schema)


def inspect(docs: DataFrame, html: str = "html", base_url: str | None = None, sample_limit: int = 8, partitions: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The other columns of ``docs`` and a summary of each document; of one over ``max_bytes`` only the diagnostic."""
    ship(docs.sparkSession)
    keys = _keys(docs, html, base_url)
    schema = T.StructType([*keys, *INSPECTION.fields])
    names = [f.name for f in keys]

    def run(row: dict) -> Iterator[dict]:
        if row[size] > max_bytes:
            said = {"level": "error", "code": "SOURCE_LOAD_FAILED", "message": f"Preloaded source exceeds {byte_size(max_bytes)} limit.", "details": {"source": "memory", "kind": "memory", "maxBytes": max_bytes}}
            got = {"diagnostics": [said]}
        else:
            got = inspect_one(row[html] or "", row[base_url] if base_url else None, sample_limit)
        for d in got["diagnostics"]:
            d["details"] = stable_json(d["details"])
        yield {k: row[k] for k in names} | got

    known, size = measured(docs, html, max_bytes)
    return spread(known, partitions).mapInArrow(_batches(run, schema), schema)
