"""Checks of sealed documents: intact ones pass, each kind of damage is told."""

import json

import pytest

from leafmill.functions.interop import Sealed, digest, stable_json
from leafmill.operators import corpus, sealed

PAGE = '<article><p a="1">One</p><p>Two, "quoted" and "result_digest_sha256":"x",</p></article>'


def plan(output="text", selection="all", strategy=None, **more):
    return {
        "interop_profile": "p-v1", "schema_name": "p.plan", "schema_version": 8, "strategy": strategy or {"kind": "css_selector", "selector": "p"}, "selection": {"mode": selection},
        "output": {"kind": output} | more, "rendering": {"whitespace": "normalize", "rewrite_urls": False},
    }


SLICE = {"kind": "delimiter_pair", "start": "<p", "end": "</p>", "mode": "literal", "boundary_retention": "include_both"}


def resealed(document, change, kind="result"):
    body = {k: v for k, v in document.items() if k != f"{kind}_digest_sha256"}
    change(body)
    return stable_json(body | {f"{kind}_digest_sha256": digest(body)})


def told(spark, documents):
    return {r.i: r.complaint for r in sealed.checked(spark.createDataFrame(list(enumerate(documents)), "i int, document string")).collect()}


def test_intact_documents_pass(spark):
    made = [Sealed(plan(k)).run(PAGE) for k in ("text", "plain_text", "structured", "inner_html", "outer_html")] + [Sealed(plan("attribute", "first", name="a")).run(PAGE)]
    made += [Sealed(plan("selected_html", "all", SLICE)).run(PAGE), Sealed(plan("text", "single")).run(PAGE), Sealed(plan("text", "first")).run("")]
    assert ["error_code" in m for m in made] == [False] * 7 + [True] * 2
    assert set(told(spark, [stable_json(m) for m in made]).values()) == {None}


def first(body):
    return body["selected_matches"][0]


DAMAGE = {
    "no_candidates": lambda b: b.update(candidate_count=0), "no_matches": lambda b: b.update(selected_matches=[]), "selection_count": lambda b: b.update(candidate_count=3),
    "candidate_out_of_range": lambda b: first(b).update(candidate_index=9), "candidate_repeated": lambda b: first(b).update(candidate_index=2), "kind_mismatch": lambda b: first(b)["metadata"].update(kind="other"),
    "plain_text_missing": lambda b: first(b).pop("plain_text_output"), "selected_html_unexpected": lambda b: first(b).update(selected_html_output="x"), "output_missing": lambda b: first(b).pop("output_value"),
    "text_mismatch": lambda b: first(b).update(output_value="x"), "errors_in_result": lambda b: b.update(diagnostics=[{"level": "error", "code": "X", "message": "m"}]), "plan_digest_invalid": lambda b: b.update(plan_digest_sha256="abc"),
}


def test_damage_is_told(spark):
    good = Sealed(plan()).run(PAGE)
    documents = [resealed(json.loads(stable_json(good)), change) for change in DAMAGE.values()]
    assert list(told(spark, documents).values()) == list(DAMAGE)
    text = stable_json(good)
    broken = [text.replace("One", "Ona", 1), text.replace('"candidate_count":2', '"candidate_count":3'), "{", "{}", None, stable_json(good | {"result_digest_sha256": "0" * 64}), stable_json(good | {"result_digest_sha256": "no"})]
    assert list(told(spark, broken).values()) == ["digest_mismatch", "digest_mismatch", "not_sealed", "not_sealed", "not_sealed", "digest_mismatch", "digest_invalid"]
    error = Sealed(plan("text", "single")).run(PAGE)
    assert list(told(spark, [stable_json(error | {"message": "x"}), resealed(error, lambda b: b.pop("error_code"), "error")]).values()) == ["digest_mismatch", "error_code_missing"]


def test_codes_are_counted(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, "<i>"), (3, "<p>x"), (4, "")], "id int, html string")
    got = corpus.run_plan(docs, plan("text", "single"))
    counts = {(r.id, r.code): r["count"] for r in sealed.code_histogram(got, ["id"]).collect()}
    assert counts[1, "ambiguous_match"] == 1 and counts[2, "no_match"] == 1 and counts[4, "NO_MATCH"] == 1 and not any(i == 3 for i, _ in counts)
    assert {r.code: r["count"] for r in sealed.code_histogram(got).collect()}["no_match"] == 2
    assert json.loads(got.where("id = 3").first().document)["candidate_count"] == 1


@pytest.mark.parametrize("kind", ["result", "error"])
def test_body_digest(spark, kind):
    for body in ({"a": 1}, {"z": "é"}, {"a": 1, "z": {"q": 'x","result_digest_sha256":"y'}}, {}):
        whole = stable_json(body | {f"{kind}_digest_sha256": "f" * 64})
        assert spark.createDataFrame([(whole,)], "d string").select(sealed.body_digest(sealed.F.col("d"), kind)).first()[0] == digest(body) or not body
