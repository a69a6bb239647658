"""Sealed plans and results: stable JSON, digests, plan checks and execution.

A plan is a JSON document. Its schema name is ``<prefix>.plan``; results and errors take the
same prefix and profile, so the caller's names stay data. Digests are SHA-256 of the
stable JSON, a result's with its own digest field left out.
"""

from __future__ import annotations

import hashlib
import json

from . import urls
from .extract import MAX_BYTES, Canonical, Output, Plan, Request, Selection

VERSIONS = {"plan": 8, "result": 9, "error": 3}
SEMANTICS = 4
OUTPUTS = ("text", "plain_text", "selected_html", "inner_html", "outer_html", "attribute", "structured")
FLAGS = {"case_insensitive": "i", "multi_line": "m", "dot_matches_new_line": "s", "swap_greed": "U", "ignore_whitespace": "x"}
CODES = {"UNSUPPORTED_SPEC_VERSION": "plan_invalid", "INVALID_SELECTOR": "plan_invalid", "INVALID_SLICE_PATTERN": "plan_invalid", "NO_MATCH": "no_match", "MATCH_INDEX_OUT_OF_RANGE": "no_match", "AMBIGUOUS_MATCH": "ambiguous_match", "MISSING_ATTRIBUTE": "missing_attribute"}


def stable_json(value) -> str:
    """Sorted keys, no spaces, text as it is."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def digest(value) -> str:
    return hashlib.sha256(stable_json(value).encode("utf-8", "surrogatepass")).hexdigest()


def identity(html: str, label: str, input_base_url: str | None, plan: dict, version_field: str, version: int = SEMANTICS) -> str:
    """Names one extraction: the complete input, the plan and the version of the semantics."""
    source = {"html": html, "label": label} | ({"input_base_url": input_base_url} if input_base_url else {})
    return digest({"html_input": source, "plan": plan, version_field: version})


def complaint(plan: dict) -> str | None:
    """What is wrong with a plan beyond its strategy's own syntax; None if nothing is."""
    prefix, _, kind = str(plan.get("schema_name", "")).rpartition(".")
    if not prefix or kind != "plan" or plan.get("schema_version") != VERSIONS["plan"]:
        return f"unsupported plan schema {plan.get('schema_name')}@{plan.get('schema_version')}"
    strategy, output = plan.get("strategy", {}), plan.get("output", {})
    if not isinstance(strategy, dict) or not isinstance(output, dict):
        return "strategy and output must be objects"
    by_css = strategy.get("kind") == "css_selector"
    for field in ("kind", "selector") if by_css else ("kind", "start", "end"):
        if not isinstance(strategy.get(field), str):
            return f"strategy needs a text {field}"
    if output.get("kind") not in OUTPUTS:
        return f"unknown output kind {output.get('kind')}"
    if not by_css and strategy.get("mode") == "literal" and strategy.get("flags"):
        return "literal delimiter pairs do not accept regex flags"
    if by_css and output["kind"] == "selected_html" or not by_css and output["kind"] == "plain_text":
        return f"output kind {output['kind']} is not available for strategy {strategy.get('kind')}"
    rules = plan.get("dom_canonicalization")
    if rules is not None:
        if not by_css:
            return "dom_canonicalization requires a css_selector strategy"
        name = output.get("name", "")
        if output["kind"] == "attribute" and name.lower() in {a.lower() for a in rules.get("ignore_attributes", [])}:
            return f"dom_canonicalization must not ignore the measured attribute {name}"
        if output["kind"] not in ("text", "plain_text", "structured"):
            shown = "".join(w.capitalize() for w in output["kind"].split("_"))
            return f"dom_canonicalization requires css_selector text or structured output; output kind {shown} does not expose comparison text"
    return None


def request_of(plan: dict) -> Request:
    strategy, selection, rendering, rules = plan["strategy"], plan.get("selection", {}), plan.get("rendering", {}), plan.get("dom_canonicalization")
    out = Request(
        value="structured", selection=Selection(selection.get("mode", "first"), selection.get("index") or 1),
        output=Output(rendering.get("whitespace", "rendered"), rendering.get("rewrite_urls", False), include_html=False, include_text=False),
        canonical=None if rules is None else Canonical(frozenset(a.lower() for a in rules.get("ignore_attributes", [])), rules.get("strip_whitespace_nodes", False)),
    )
    if strategy["kind"] == "css_selector":
        return out.with_values(selector=strategy["selector"])
    flags = "".join(FLAGS.get(f, f) for f in strategy.get("flags", []))
    return out.with_values(start=strategy["start"], end=strategy["end"], regex=strategy.get("mode") == "regex", flags=flags, retention=strategy.get("boundary_retention", "exclude_both").replace("_", "-"))


class Sealed:
    """A checked plan that runs on documents and seals what it gets."""

    def __init__(self, plan: dict | str, max_bytes: int = MAX_BYTES):
        self.plan = json.loads(plan) if isinstance(plan, str) else plan
        self.prefix = str(self.plan.get("schema_name", "")).rpartition(".")[0]
        self.digest, self.wrong = digest(self.plan), complaint(self.plan)
        strategy = self.plan.get("strategy", {})
        self.kind = strategy.get("kind") if isinstance(strategy, dict) else None
        self.compiled = None if self.wrong else Plan(request_of(self.plan).with_values(max_bytes=max_bytes))

    def _seal(self, kind: str, body: dict) -> dict:
        body = {"interop_profile": self.plan.get("interop_profile"), "plan_digest_sha256": self.digest, "schema_name": f"{self.prefix}.{kind}", "schema_version": VERSIONS[kind], "strategy_kind": self.kind} | body
        return body | {f"{kind}_digest_sha256": digest(body)}

    def _error(self, code: str, message: str, details: dict, diagnostics: list[dict]) -> dict:
        return self._seal("error", {"error_code": code, "message": message, "details": details, "diagnostics": diagnostics})

    def run(self, html: str, input_base_url: str | None = None, label: str = "memory", size: int | None = None) -> dict:
        """A sealed result, or a sealed error; ``size`` in bytes, if the text was held back because of it."""
        if self.wrong:
            return self._error("plan_invalid", self.wrong, {"contract_error": self.wrong}, [])
        got = self.compiled.run(html, input_base_url, label, size=size)
        said = [{k: v for k, v in d.items() if v is not None} for d in got["diagnostics"]]
        if not got["ok"]:
            first = next(d for d in got["diagnostics"] if d["level"] == "error")
            details = {"core_diagnostic_code": first["code"], "core_details": {"candidateCount": got["candidate_count"]} | (first["details"] or {})}
            return self._error(CODES.get(first["code"], "internal_error"), first["message"], details, said)
        output, matches = self.plan["output"], []
        for m in got["matches"]:
            value, meta = m["value"], {k: v for k, v in m["metadata"].items()}
            meta["kind"] = self.kind
            one = {"candidate_index": meta["candidate_index"], "metadata": meta, "text_output": value["textOutput"], "inner_html_output": value["innerHtmlOutput"], "outer_html_output": value["outerHtmlOutput"]}
            if "plainTextOutput" in value:
                one["plain_text_output"] = value["plainTextOutput"]
            if "selectedHtmlOutput" in value:
                one["selected_html_output"] = value["selectedHtmlOutput"]
            if "comparison" in m:
                one["comparison_text_output"], one["comparison_plain_text_output"] = m["comparison"]
            kind = output["kind"]
            if kind == "attribute":
                name = output["name"].lower()
                if name not in value["attributes"]:
                    return self._error("missing_attribute", f'Selected candidate is missing attribute "{name}".', {"attribute": name}, said)
                one["output_value"] = value["attributes"][name]
            elif kind == "structured":
                one["output_value"] = value
            elif kind in ("text", "plain_text"):
                one["output_value"] = one.get(f"comparison_{kind}_output", one[f"{kind}_output"])
            else:
                one["output_value"] = one[f"{kind}_output"]
            matches.append(one)
        source = {"input_base_url": urls.redacted(input_base_url) if input_base_url else None, "effective_base_url": got["source"]["effective_base_url"], "document_title": got["document_title"]}
        return self._seal("result", {
            "candidate_count": got["candidate_count"], "diagnostics": said, "output": output, "selected_matches": matches, "selection_mode": self.plan.get("selection", {}).get("mode", "first"),
            "source": {k: v for k, v in source.items() if v is not None},
        })
