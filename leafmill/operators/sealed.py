"""Checks of sealed documents, as column expressions: is a result what its plan allows, and is its digest its own.

Everything is read off the stable JSON that :func:`corpus.run_plan` gives; nothing is parsed in Python, and
nothing moves between rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MATCH = "candidate_index long, metadata struct<kind:string>, output_value string, " + ", ".join(f"{n} string" for n in ("text_output", "plain_text_output", "inner_html_output", "outer_html_output", "selected_html_output", "comparison_text_output", "comparison_plain_text_output"))
_BODY = f"plan_digest_sha256 string, result_digest_sha256 string, error_digest_sha256 string, strategy_kind string, selection_mode string, error_code string, candidate_count long, output struct<kind:string,name:string>, selected_matches array<struct<{_MATCH.replace(' ', ':').replace(',:', ',')}>>, diagnostics array<struct<level:string,code:string>>"
_HEX = "^[0-9a-f]{64}$"


def body_digest(document: Column, kind: str) -> Column:
    """The digest of a sealed document without its own digest. Keys are sorted and text is escaped, so the field can be cut out of the JSON."""
    field = f'"{kind}_digest_sha256":"[^"]*"'
    return F.sha2(F.regexp_replace(document, f"(?<=[{{]){field},|,{field}(?=[,}}])", "").cast("binary"), 256)


def _rules(b: Column) -> list[tuple[str, Column]]:
    """Names of what can be wrong with a result, each with its condition; the first that holds is told."""
    many, matches, kind, mode = b["candidate_count"], b["selected_matches"], b["output"]["kind"], b["selection_mode"]
    some = lambda test: F.exists(matches, lambda m: F.coalesce(test(m), F.lit(False)))
    css = b["strategy_kind"] == "css_selector"
    compared = lambda m: m["comparison_text_output"].isNotNull() | m["comparison_plain_text_output"].isNotNull()
    said = lambda m, name: F.coalesce(m[f"comparison_{name}"], m[name])
    plain = lambda m: m["output_value"].isNull()
    return [
        ("plan_digest_invalid", ~b["plan_digest_sha256"].rlike(_HEX)),
        ("no_candidates", many < 1), ("no_matches", F.size(matches) < 1),
        ("selection_count", F.when(mode == "all", F.size(matches) != many).when(mode == "single", (F.size(matches) != 1) | (many != 1)).otherwise(F.size(matches) != 1)),
        ("candidate_out_of_range", some(lambda m: (m["candidate_index"] < 1) | (m["candidate_index"] > many))),
        ("candidate_repeated", F.size(F.array_distinct(F.transform(matches, lambda m: m["candidate_index"]))) != F.size(matches)),
        ("kind_mismatch", some(lambda m: m["metadata"]["kind"] != b["strategy_kind"])),
        ("plain_text_missing", css & some(lambda m: m["plain_text_output"].isNull())), ("selected_html_unexpected", css & some(lambda m: m["selected_html_output"].isNotNull())),
        ("selected_html_missing", ~css & some(lambda m: m["selected_html_output"].isNull())), ("plain_text_unexpected", ~css & some(lambda m: m["plain_text_output"].isNotNull())),
        ("comparison_unexpected", (~css | ~kind.isin("text", "plain_text", "structured")) & some(compared)),
        ("output_missing", some(plain)),
        ("text_mismatch", (kind == "text") & some(lambda m: m["output_value"] != said(m, "text_output"))), ("plain_text_mismatch", (kind == "plain_text") & some(lambda m: m["output_value"] != said(m, "plain_text_output"))),
        ("structured_not_an_object", (kind == "structured") & some(lambda m: ~m["output_value"].startswith("{"))),
        *[(f"{n}_mismatch", (kind == n) & some(lambda m, n=n: m["output_value"] != m[f"{n}_output"])) for n in ("inner_html", "outer_html", "selected_html")],
        ("errors_in_result", F.exists(b["diagnostics"], lambda d: d["level"] == "error")),
    ]


def checked(sealed: DataFrame, document: str = "document", name: str = "complaint") -> DataFrame:
    """``sealed`` with what is wrong with each document: null if nothing is."""
    text, body = F.col(document), F.from_json(F.col(document), _BODY)
    out = sealed.withColumn("_body", body)
    b = F.col("_body")
    is_error = b["error_digest_sha256"].isNotNull()
    own = F.coalesce(b["result_digest_sha256"], b["error_digest_sha256"])
    counted = F.when(is_error, body_digest(text, "error")).otherwise(body_digest(text, "result"))
    found = F.when(b.isNull() | own.isNull(), "not_sealed").when(~own.rlike(_HEX), "digest_invalid").when(own != counted, "digest_mismatch").when(is_error, F.when(b["error_code"].isNull(), "error_code_missing"))
    for complaint, holds in _rules(b):
        found = found.when(F.coalesce(holds, F.lit(False)), complaint)
    return out.withColumn(name, found).drop("_body")


def code_histogram(sealed: DataFrame, keys: Sequence[str] = (), document: str = "document") -> DataFrame:
    """keys, code and count: how often each code occurs, of errors and of diagnostics; with no keys over all documents."""
    body = F.from_json(F.col(document), "error_code string, diagnostics array<struct<code:string>>")
    codes = F.array_compact(F.concat(F.array(body["error_code"]), F.coalesce(F.transform(body["diagnostics"], lambda d: d["code"]), F.array().cast("array<string>"))))
    return sealed.select(*keys, F.explode(codes).alias("code")).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("count"))
