"""Command line: select, slice, inspect (select, slice, source), catalog and schema.

One document on the driver, without Spark; the same plans run on corpora through
``operators.corpus``. Exit codes: 2 usage, 3 source, 4 extraction, 5 output.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from .functions.extract import MAX_BYTES, RETENTION, VALUES, Output, Plan, Request, Selection, byte_size
from .functions.inspect import inspect
from .functions.interop import stable_json
from .functions.suggest import hint
from .operators.schemas import OPERATIONS, SCHEMAS, json_schema
from .sources.http import fetch
from .sources.readers import DefinitionError, definition_of, request_of

USAGE, SOURCE, EXTRACTION, OUTPUT = 2, 3, 4, 5
UNITS = {"b": 1, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}


class Failure(Exception):
    def __init__(self, code: int, name: str, message: str):
        super().__init__(message)
        self.code, self.name = code, name


def parse_size(text: str) -> int:
    """``512``, ``4 KiB``, ``1.5mib``: positive and a whole number of bytes."""
    m = re.fullmatch(r"\s*(\d+)(?:\.(\d+))?\s*([A-Za-z]*)\s*", text)
    unit = UNITS.get(m[3].lower() or "b") if m else None
    if unit is None:
        raise argparse.ArgumentTypeError(f"not a size: {text}")
    tens = 10 ** len(m[2] or "")
    total = int(m[1] + (m[2] or "")) * unit
    if total % tens or not total:
        raise argparse.ArgumentTypeError(f"not a whole positive number of bytes: {text}")
    return total // tens


def _load(args: argparse.Namespace) -> tuple[str, str, str | None]:
    """Text, label and base URL of the input."""
    limit = args.max_bytes
    if args.input_html is not None:
        return args.input_html, "inline-html", args.base_url
    if args.input is None:
        raise Failure(USAGE, "input_missing", "an input is needed")
    if args.input == "-":
        raw, label = sys.stdin.buffer.read(limit + 1), "-"
    elif re.match("https?://", args.input, re.I):
        got = fetch(args.input, limit)
        if got["load_error"]:
            raise Failure(SOURCE, "source_load_failed", got["load_error"])
        return got["html"], got["shown_url"], args.base_url or got["shown_url"]
    else:
        path = Path(args.input)
        if path.is_dir():
            raise Failure(SOURCE, "source_load_failed", f"Input path is a directory, not a file: {path}")
        try:
            raw, label = path.read_bytes(), str(path.resolve())
        except OSError as e:
            raise Failure(SOURCE, "source_load_failed", f"Could not access file {path}: {e.strerror}") from e
    if len(raw) > limit:
        raise Failure(SOURCE, "source_load_failed", f"{label} exceeds {byte_size(limit)} limit.")
    try:
        return raw.decode("utf-8"), label, args.base_url
    except UnicodeDecodeError as e:
        raise Failure(SOURCE, "source_load_failed", f"{label} is not valid UTF-8: {e.reason}") from e


def _request(args: argparse.Namespace, preview: bool) -> Request:
    if args.request_file:
        given = [f for f in ("css", "from_", "to", "match", "value", "attribute") if getattr(args, f, None) is not None]
        if given:
            raise Failure(USAGE, "request_file_conflict", f"--{given[0].strip('_')} cannot be combined with --request-file")
        try:
            return request_of(Path(args.request_file).read_text()).with_values(preview=preview)
        except (OSError, DefinitionError) as e:
            raise Failure(USAGE, getattr(e, "code", "definition_unreadable"), str(e)) from e
    value = args.value or ("structured" if preview else "text")
    if (value == "attribute") != (args.attribute is not None):
        raise Failure(USAGE, "attribute_flag", "--attribute goes with --value attribute, and the other way round")
    mode = args.match or "first"
    if (mode == "nth") != (args.index is not None):
        raise Failure(USAGE, "index_flag", "--index goes with --match nth, and the other way round")
    common = {
        "selection": Selection(mode, args.index or 1), "value": value, "attribute": args.attribute, "max_bytes": args.max_bytes, "preview": preview,
        "output": Output("rendered" if args.whitespace is None else args.whitespace, args.rewrite_urls, args.include_source_text, preview_chars=args.preview_chars),
    }
    if args.operation == "select":
        if not (args.css or "").strip():
            raise Failure(USAGE, "selector_missing", "--css is needed")
        return Request(selector=args.css, **common)
    if not args.from_ or not args.to:
        raise Failure(USAGE, "boundary_missing", "--from and --to are needed")
    if args.flags and args.pattern != "regex":
        raise Failure(USAGE, "flags_without_regex", "--flags need --pattern regex")
    return Request(start=args.from_, end=args.to, regex=args.pattern == "regex", flags=args.flags or "", retention=args.boundary_retention, **common)


def _snake(value):
    """camelCase keys as snake_case, all the way down."""
    if isinstance(value, dict):
        return {re.sub("([A-Z])", lambda m: "_" + m[1].lower(), k): _snake(v) for k, v in value.items()}
    return [_snake(v) for v in value] if isinstance(value, list) else value


def _mode(args: argparse.Namespace, request: Request) -> str:
    html = request.value in ("selected-html", "inner-html", "outer-html")
    mode = args.output or ("text" if request.preview else "html" if html else "json" if request.value == "structured" else "text")
    if mode == "html" and not html or request.value == "structured" and mode not in ("json", "none") and not request.preview or mode == "none" and not args.bundle:
        raise Failure(USAGE, "output_mode", f"--output {mode} does not go with this value")
    return mode


def _shown(result: dict, mode: str) -> str:
    if mode == "json":
        return json.dumps(_snake(result), ensure_ascii=False, indent=2)
    texts = [m["value"] if isinstance(m["value"], str) else stable_json(m["value"]) for m in result["matches"]]
    return "\n\n".join(texts)


def preview_text(result: dict) -> str:
    """The first eight matches with where they are."""
    out = [f"{result['operation_id']}: {result['match_count']} of {result['candidate_count']} candidates"]
    for m in result["matches"][:8]:
        where = " > ".join(("..." if len((m["path"] or "").split(" > ")) > 4 else "", *(m["path"] or "").split(" > ")[-4:])).removeprefix(" > ") if m["path"] else "bytes {start}..{end}".format(**m["metadata"]["selected_range"])
        out.append(f"{m['index']}. {where[-96:]}\n   {m['preview']}")
    if len(result["matches"]) > 8:
        out.append(f"... and {len(result['matches']) - 8} more")
    return "\n".join(out + [f"{d['level']}: {d['message']}" for d in result["diagnostics"]])


def inspection_text(got: dict) -> str:
    out = [f"title: {got['title']}", f"elements: {got['element_count']}, links: {got['link_count']}, images: {got['image_count']}, characters: {got['text_char_count']}"]
    for name in ("extraction_candidates", "reading_candidates"):
        out += [name.replace("_", " ") + ":", *(f"  {c['selector']} ({c['text_char_count']} characters)" for c in got[name])]
    out += ["headings:", *(f"  {'#' * h['level']} {h['text']}" for h in got["headings"]), "links:", *(f"  {x['text']} [{x['resolved_href']}]" for x in got["links"])]
    return "\n".join(out)


def _write(path: str, text: str, overwrite: bool) -> None:
    target = Path(path)
    try:
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("w" if overwrite else "x", encoding="utf-8") as f:
            f.write(text)
    except OSError as e:
        raise Failure(OUTPUT, "output_write_failed", f"Could not write {path}: {e.strerror}") from e


def _bundle(folder: str, result: dict, overwrite: bool) -> None:
    texts = "\n\n".join(m["text"] if m["text"] is not None else str(m["value"]) for m in result["matches"])
    sections = "\n".join(f'<section data-match-index="{m["index"]}">\n{m["html"]}\n</section>' for m in result["matches"])
    title = (result["document_title"] or Path(result["source"]["value"]).stem).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    page = f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{title}</title>\n</head>\n<body>\n{sections}\n</body>\n</html>\n'
    report = {k: v for k, v in result.items() if k != "matches"} | {"bundle": folder}
    for name, text in (("selection.html", page), ("selection.txt", texts), ("selection.json", json.dumps(_snake(result["matches"]), ensure_ascii=False)), ("report.json", json.dumps(_snake(report), ensure_ascii=False))):
        _write(f"{folder}/{name}", text, overwrite)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def source(p: argparse.ArgumentParser) -> None:
        p.add_argument("input", nargs="?", help="file, http(s) URL, or - for standard input")
        p.add_argument("--input-html")
        p.add_argument("--base-url")
        p.add_argument("--max-bytes", type=parse_size, default=MAX_BYTES)
        p.add_argument("--output-file")
        p.add_argument("--overwrite", action="store_true")

    def extraction(p: argparse.ArgumentParser, kind: str) -> None:
        source(p)
        p.set_defaults(operation=kind)
        if kind == "select":
            p.add_argument("--css")
        else:
            p.add_argument("--from", dest="from_")
            p.add_argument("--to")
            p.add_argument("--pattern", choices=["literal", "regex"], default="literal")
            p.add_argument("--flags")
            p.add_argument("--boundary-retention", choices=list(RETENTION), default="exclude-both")
        p.add_argument("--match", choices=["single", "first", "nth", "all"])
        p.add_argument("--index", type=int)
        p.add_argument("--value", choices=list(VALUES))
        p.add_argument("--attribute")
        p.add_argument("--whitespace", choices=["rendered", "normalize"])
        p.add_argument("--rewrite-urls", action="store_true")
        p.add_argument("--include-source-text", action="store_true")
        p.add_argument("--preview-chars", type=int, default=160)
        p.add_argument("--output", choices=["text", "html", "json", "none"])
        p.add_argument("--bundle")
        p.add_argument("--request-file")
        p.add_argument("--emit-request-file")

    for kind in ("select", "slice"):
        extraction(commands.add_parser(kind), kind)
    looks = commands.add_parser("inspect").add_subparsers(dest="look", required=True)
    for kind in ("select", "slice"):
        extraction(looks.add_parser(kind), kind)
    page = looks.add_parser("source")
    source(page)
    page.add_argument("--sample-limit", type=int, default=8)
    page.add_argument("--output", choices=["text", "json"], default="text")
    p = commands.add_parser("catalog")
    p.add_argument("--operation")
    p.add_argument("--output", choices=["text", "json"], default="text")
    p = commands.add_parser("schema")
    p.add_argument("--name")
    p.add_argument("--schema-version", type=int)
    p.add_argument("--output", choices=["text", "json", "document"], default="text")
    return top


def _listed(report: str, name: str, fields: tuple[str, ...], rows: list[tuple]) -> str:
    """A report that lists rows, with its own schema name and version."""
    version = next(v for n, v, _ in SCHEMAS if n == report)
    return json.dumps({"schema_name": report, "schema_version": version, name: [dict(zip(fields, r, strict=True)) for r in rows]}, ensure_ascii=False, indent=2)


def run(argv: list[str]) -> str:
    args = parser().parse_args(argv)
    if args.command == "catalog":
        found = [o for o in OPERATIONS if args.operation in (None, o[0])]
        if not found:
            raise Failure(USAGE, "operation_unknown", f"unknown operation {args.operation}.{hint(args.operation, [o[0] for o in OPERATIONS])}")
        if args.output == "json":
            return _listed("catalog_report", "operations", ("operation_id", "description", "command"), found)
        return "\n".join(f"{name}: {text}" for name, text, _ in found)
    if args.command == "schema":
        if args.schema_version is not None and args.name is None:
            raise Failure(USAGE, "schema_version_without_name", "--schema-version needs --name")
        found = sorted(s for s in SCHEMAS if args.name in (None, s[0]) and args.schema_version in (None, s[1]))
        if not found:
            versions = ", ".join(str(v) for n, v, _ in sorted(SCHEMAS) if n == args.name)
            raise Failure(USAGE, "schema_unknown", f"unknown schema {args.name}." + (f" Versions: {versions}." if versions else hint(args.name, sorted({n for n, _, _ in SCHEMAS}))))
        if args.output == "json":
            return _listed("schema_report", "schemas", ("schema_name", "schema_version", "owner"), found)
        if args.output == "document":
            return json.dumps(json_schema(found[0][0]) if len(found) == 1 else [json_schema(n) for n, _, _ in found], ensure_ascii=False, indent=2)
        return "\n".join(f"{name}@{version} ({owner})" for name, version, owner in found)
    if getattr(args, "look", None) == "source":
        text, _, base = _load(args)
        got = inspect(text, base, args.sample_limit)
        shown = json.dumps(got, ensure_ascii=False, indent=2) if args.output == "json" else inspection_text(got)
    else:
        preview = args.command == "inspect"
        request = _request(args, preview)
        mode = _mode(args, request)
        if args.emit_request_file:
            _write(args.emit_request_file, json.dumps(definition_of(request), indent=2), args.overwrite)
        text, label, base = _load(args)
        result = Plan(request).run(text, base, label)
        if args.bundle:
            _bundle(args.bundle, result, args.overwrite)
        if not result["ok"]:
            first = next(d for d in result["diagnostics"] if d["level"] == "error")
            raise Failure(SOURCE if first["code"] == "SOURCE_LOAD_FAILED" else USAGE if first["code"].startswith(("INVALID", "UNSUPPORTED")) else EXTRACTION, first["code"].lower(), first["message"])
        shown = "" if mode == "none" else preview_text(result) if preview and mode == "text" else _shown(result, mode)
    if args.output_file:
        _write(args.output_file, shown, args.overwrite)
        return ""
    return shown


def main(argv: list[str] | None = None) -> int:
    try:
        text = run(sys.argv[1:] if argv is None else argv)
    except Failure as e:
        print(json.dumps({"error": e.name, "message": str(e)}), file=sys.stderr)
        return e.code
    if text:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
