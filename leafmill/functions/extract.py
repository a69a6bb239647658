"""Extraction from one document: requests, candidates, selection, values and diagnostics.

Errors are data: a result lists diagnostics and is ``ok`` when none is an error. Results are
plain dictionaries shaped like the Spark schemas in ``operators.schemas``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import lru_cache

from . import css, slices, urls
from .dom import Document, Node, path_of, serialized
from .html_parser import parse, parse_fragment
from .text import body_text, canonical, element_text, plain_text, spaced, title

SPEC_VERSION, MAX_BYTES, PREVIEW = 7, 50 * 1024 * 1024, 160
VALUES = ("text", "selected-html", "inner-html", "outer-html", "attribute", "structured")
RETENTION = {"exclude-both": (False, False), "include-start": (True, False), "include-end": (False, True), "include-both": (True, True)}


@dataclass(frozen=True)
class Selection:
    """``single``, ``first``, ``nth`` (``index`` from 1) or ``all``."""

    mode: str = "first"
    index: int = 1


@dataclass(frozen=True)
class Output:
    whitespace: str = "rendered"
    rewrite_urls: bool = False
    include_source_text: bool = False
    include_html: bool = True
    include_text: bool = True
    preview_chars: int = PREVIEW


@dataclass(frozen=True)
class Canonical:
    ignored: frozenset[str] = frozenset()
    strip_blank: bool = False


@dataclass(frozen=True)
class Request:
    """What to extract from each document: by ``selector``, or between ``start`` and ``end``."""

    selector: str | None = None
    start: str | None = None
    end: str | None = None
    regex: bool = False
    flags: str = ""
    retention: str = "exclude-both"
    selection: Selection = field(default_factory=Selection)
    value: str = "text"
    attribute: str | None = None
    output: Output = field(default_factory=Output)
    max_bytes: int = MAX_BYTES
    preview: bool = False
    spec_version: int = SPEC_VERSION
    canonical: Canonical | None = None

    @property
    def operation(self) -> str:
        return ("select" if self.selector is not None else "slice") + (".preview" if self.preview else ".extract")

    def with_values(self, **changes) -> Request:
        return replace(self, **changes)


def diagnostic(level: str, code: str, message: str, details: dict | None = None) -> dict:
    return {"level": level, "code": code, "message": message, "details": details}


@lru_cache(maxsize=4)
def parsed(html: str) -> Document:
    """The tree of a document; the last few are kept, as several plans may read one. Not to be changed."""
    return parse(html)


def byte_size(n: int) -> str:
    """``1 byte``, ``7 bytes``, or the largest of KiB, MiB and GiB with at most one rounded decimal."""
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        size = 1024**power
        if n >= size:
            tenths = (n * 10 + size // 2) // size
            return f"{tenths // 10}.{tenths % 10} {unit}" if tenths % 10 else f"{tenths // 10} {unit}"
    return "1 byte" if n == 1 else f"{n} bytes"


def looks_like_document(text: str) -> bool:
    return text.lstrip()[:9].lower().startswith(("<!doctype", "<html"))


# -- selection -----------------------------------------------------------------------------


def chosen(count: int, selection: Selection) -> tuple[list[int], list[dict]]:
    """Numbers (from 1) of the candidates that are selected, and what there is to say."""
    if not count:
        return [], [diagnostic("error", "NO_MATCH", "No matches were found for the extraction request.")]
    if selection.mode == "all":
        return list(range(1, count + 1)), []
    if selection.mode == "nth":
        if selection.index > count:
            return [], [diagnostic("error", "MATCH_INDEX_OUT_OF_RANGE", f"Match index {selection.index} is out of range for {count} candidates.", {"requestedIndex": selection.index, "candidateCount": count})]
        return [selection.index], []
    if count == 1:
        return [1], []
    if selection.mode == "single":
        return [], [diagnostic("error", "AMBIGUOUS_MATCH", f"Exact-one selection requires exactly one candidate, but {count} were found.", {"candidateCount": count})]
    return [1], [diagnostic("warning", "MULTIPLE_MATCHES", f"Matched {count} candidates while using match type first.", {"candidateCount": count, "selectedIndex": 1})]


def preview_of(value, limit: int) -> str:
    """The value cut to ``limit`` bytes, dots included, at a character boundary."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    raw = text.encode("utf-8", "replace")
    if len(raw) <= limit:
        return text
    return raw[: max(limit - 3, 0)].decode("utf-8", "ignore") + "..."[: max(limit, 0)]


# -- compiled plans --------------------------------------------------------------------------


class Plan:
    """A request checked and compiled once; ``error`` holds what is wrong with it."""

    def __init__(self, request: Request):
        self.request, self.error, self.selectors, self.finders = request, None, (), ()
        if request.spec_version != SPEC_VERSION:
            self.error = diagnostic("error", "UNSUPPORTED_SPEC_VERSION", f"Unsupported spec version {request.spec_version}. Expected {SPEC_VERSION}.", {"expected": SPEC_VERSION, "received": request.spec_version})
        elif request.selector is not None:
            try:
                self.selectors = css.parse(request.selector)
            except css.SelectorError as e:
                self.error = diagnostic("error", "INVALID_SELECTOR", "CSS selector is invalid.", {"selector_parse": {"line": e.line, "column_utf16": e.column, "parse_error_class": e.kind}})
            else:
                if request.value == "selected-html":
                    self.error = diagnostic("error", "UNSUPPORTED_VALUE_TYPE", "selected-html is only valid for slice extraction.", {"strategy": "selector", "value": "selected-html"})
        else:
            try:
                self.finders = tuple(slices.finder(p or "", request.regex, request.flags) for p in (request.start, request.end))
            except slices.PatternError as e:
                self.error = diagnostic("error", "INVALID_SLICE_PATTERN", e.message, e.details)

    def run(self, html: str | None, base_url: str | None = None, label: str = "memory", size: int | None = None) -> dict:
        """The result of one document; ``size`` in bytes where the text itself was held back."""
        request, html = self.request, html or ""
        size = len(html.encode("utf-8", "replace")) if size is None else size
        shown = urls.redacted(base_url) if base_url else None
        out = {
            "operation_id": request.operation, "ok": False, "document_title": None, "candidate_count": 0, "match_count": 0, "matches": [], "diagnostics": [],
            "source": {"kind": "memory", "value": label.strip() or "memory", "bytes_read": size, "input_base_url": shown, "effective_base_url": None, "text": html if request.output.include_source_text else None},
        }
        if self.error is not None:
            out["diagnostics"] = [self.error]
        elif size > request.max_bytes:
            out["diagnostics"] = [diagnostic("error", "SOURCE_LOAD_FAILED", f"Preloaded source exceeds {byte_size(request.max_bytes)} limit.", {"source": label, "kind": "memory", "maxBytes": request.max_bytes})]
        else:
            document = parsed(html)
            base = urls.effective_base(document, shown)
            out["document_title"], out["source"]["effective_base_url"] = title(document), base
            if request.output.rewrite_urls and base is None:
                out["diagnostics"].append(diagnostic(
                    "warning", "EFFECTIVE_BASE_URL_UNRESOLVED", "URL rewriting was requested, but no effective base URL could be resolved. Relative URLs are left unchanged.",
                    {"documentBaseHref": urls.base_href(document), "rewriteRequested": True}))
            run = self._select if request.selector is not None else self._slice
            run(out, document, html, base)
        out["match_count"] = len(out["matches"])
        out["ok"] = all(d["level"] != "error" for d in out["diagnostics"])
        return out

    # -- by selector ---------------------------------------------------------------------------

    def _select(self, out: dict, document: Document, html: str, base: str | None) -> None:
        request = self.request
        found = css.select(document, self.selectors)
        out["candidate_count"] = len(found)
        numbers, said = chosen(len(found), request.selection)
        out["diagnostics"] += said
        if not numbers:
            return
        absolute = urls.rewritten(document, base) if base is not None else document
        shown = absolute if request.output.rewrite_urls else document
        for i, number in enumerate(numbers, 1):
            at = found[number - 1].number
            one = self._selected(shown.nodes[at], absolute.nodes[at], i, len(numbers), number, len(found))
            (out["matches"] if "code" not in one else out["diagnostics"]).append(one)

    def _selected(self, e: Node, in_text: Node, i: int, count: int, number: int, total: int) -> dict:
        request, mode = self.request, self.request.output.whitespace
        text = lazily(lambda: element_text(in_text, mode))
        inner, outer = lazily(lambda: serialized(e, True)), lazily(lambda: serialized(e))
        path, attributes = path_of(e), dict(sorted(e.attrs.items()))
        kind = request.value
        if kind == "attribute":
            name = css.lower(request.attribute or "")
            if name not in attributes:
                return diagnostic("error", "MISSING_ATTRIBUTE", f'Matched node is missing attribute "{name}".', {"attribute": name, "path": path})
            value = spaced(attributes[name], mode)
        elif kind == "structured":
            value = {
                "attributes": attributes, "candidateCount": total, "candidateIndex": number, "innerHtmlOutput": inner(), "matchCount": count, "matchIndex": i, "outerHtmlOutput": outer(), "path": path,
                "plainTextOutput": plain_text(in_text, mode), "tagName": e.tag, "textOutput": text(),
            }
        else:
            value = {"text": text, "inner-html": inner, "outer-html": outer, "plain-text": lambda: plain_text(in_text, mode)}[kind]()
        one = {
            "index": i, "path": path, "value_type": kind, "value": value, "html": outer() if request.output.include_html else None, "text": text() if request.output.include_text else None,
            "preview": preview_of(value, request.output.preview_chars),
            "metadata": {"kind": "selector", "candidate_count": total, "candidate_index": number, "path": path, "tag_name": e.tag, "attributes": attributes},
        }
        if request.canonical is not None:
            bare = canonical(in_text, request.canonical.ignored, request.canonical.strip_blank)
            one["comparison"] = (element_text(bare, mode), plain_text(bare, mode))
        return one

    # -- by boundaries ---------------------------------------------------------------------------

    def _slice(self, out: dict, document: Document, html: str, base: str | None) -> None:
        request = self.request
        found, dangling = slices.cuts(html, *self.finders)
        offset = slices.Offsets(html)
        names = {"from": request.start, "to": request.end}
        if dangling is not None:
            at = offset(dangling)
            out["diagnostics"].append(diagnostic("error", "NO_MATCH", f"End pattern was not found after offset {at}: {request.end}", names | {"offset": at}))
            return
        if not found:
            out["diagnostics"].append(diagnostic("error", "NO_MATCH", f"Start pattern was not found: {request.start}", names))
            return
        out["candidate_count"] = len(found)
        numbers, said = chosen(len(found), request.selection)
        out["diagnostics"] += said
        keep = RETENTION[request.retention]
        spans = [found[n - 1].selected(*keep) for n in numbers]
        torn = slices.inside_markup(html, {p for s in spans for p in s})
        cut = [
            {"matchIndex": i, "candidateIndex": n, "selectedRange": {"start": offset(s[0]), "end": offset(s[1])}}
            for i, (n, s) in enumerate(zip(numbers, spans, strict=True), 1) if s[0] in torn or s[1] in torn
        ]
        if cut:
            near = cut[0]["selectedRange"]
            out["diagnostics"].append(diagnostic(
                "warning", "SLICE_SPLITS_MARKUP",
                f"Selected slice boundaries appear to cut through HTML markup near {near['start']}..{near['end']}. Choose stricter boundaries or include the matched tags when the markup should remain intact.",
                {"affectedMatches": cut}))
        for i, n in enumerate(numbers, 1):
            one = self._cut(html, base, found[n - 1], offset, i, len(numbers), n, len(found))
            (out["matches"] if "code" not in one else out["diagnostics"]).append(one)

    def _cut(self, html: str, base: str | None, cut: slices.Cut, offset: slices.Offsets, i: int, count: int, number: int, total: int) -> dict:
        request, mode, keep = self.request, self.request.output.whitespace, RETENTION[self.request.retention]
        selected = cut.selected(*keep)
        span = lambda s: {"start": offset(s[0]), "end": offset(s[1])}
        fragment = lambda s, rewrite: rewritten_fragment(html[slice(*s)], base if rewrite else None)
        shown, inner, outer = (lazily(lambda s=s: fragment(s, request.output.rewrite_urls)) for s in (selected, cut.inner, cut.outer))
        text = lazily(lambda: body_text(parse_fragment(fragment(selected, True)), mode, False))
        attributes = lazily(lambda: first_attributes(shown()))
        kind = request.value
        if kind == "attribute":
            name = css.lower(request.attribute or "")
            if name not in attributes():
                hint = None
                if not keep[0] and selected[0] != cut.outer[0]:
                    hint = "include-both" if keep[1] else "include-start"
                said = f'Extracted fragment is missing attribute "{name}".'
                if hint:
                    said += f" If the attribute lives on the opening tag, use --boundary-retention {hint} so the fragment keeps that tag."
                return diagnostic("error", "MISSING_ATTRIBUTE", said, {"attribute": name, "selectedRange": span(selected), "hint": f"use --boundary-retention {hint}" if hint else None})
            value = spaced(attributes()[name], mode)
        elif kind == "structured":
            value = {
                "attributes": attributes(), "candidateCount": total, "candidateIndex": number, "includeEnd": keep[1], "includeStart": keep[0], "innerHtmlOutput": inner(), "innerRange": span(cut.inner),
                "matchCount": count, "matchIndex": i, "matchedEnd": html[cut.inner[1] : cut.outer[1]], "matchedStart": html[cut.outer[0] : cut.inner[0]], "outerHtmlOutput": outer(), "outerRange": span(cut.outer),
                "selectedHtmlOutput": shown(), "selectedRange": span(selected), "textOutput": text(),
            }
        else:
            value = {"text": text, "selected-html": shown, "inner-html": inner, "outer-html": outer}[kind]()
        return {
            "index": i, "path": None, "value_type": kind, "value": value, "html": outer() if request.output.include_html else None, "text": text() if request.output.include_text else None,
            "preview": preview_of(value, request.output.preview_chars),
            "metadata": {
                "kind": "delimiter-pair", "candidate_count": total, "candidate_index": number, "selected_range": span(selected), "inner_range": span(cut.inner), "outer_range": span(cut.outer),
                "include_start": keep[0], "include_end": keep[1], "matched_start": html[cut.outer[0] : cut.inner[0]], "matched_end": html[cut.inner[1] : cut.outer[1]],
            },
        }


def lazily(make):
    """A value made when first asked for."""
    held: list = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    return get


def rewritten_fragment(text: str, base: str | None) -> str:
    """A fragment with absolute links, verbatim without a base."""
    if base is None:
        return text
    if looks_like_document(text):
        return serialized(urls.rewritten(parse(text), base).root)
    return serialized(urls.rewritten(parse_fragment(text), base).first("body"), True)


def first_attributes(fragment: str) -> dict[str, str]:
    body = parse_fragment(fragment).first("body")
    first = next(iter(body.child_elements()), None) if body is not None else None
    return dict(sorted(first.attrs.items())) if first is not None else {}
