"""Small documents with known answers: sealed plans, rendering and rewritten URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.extract import Output, Request, Selection
from leafmill.operators import corpus

START = "https://example.com/docs/start.html"

# Inputs, plans and answers that must be met exactly.
GUIDE = '<html><head><title>Example</title></head><body><article><a href="guide.html">Guide</a></article></body></html>'
MEASURED = '<article class="measurement" data-nonce="volatile"><!-- transient --><a href="/offer" data-nonce="volatile">Guide</a>&#32;&#32;&#10;</article>'
RAW = '<article class="measurement"><a href="/offer" data-nonce="volatile">Guide</a></article>'
TWO = '<article class="measurement" data-nonce="one"><a href="/one">One</a>&#32;&#32;&#10;</article><article class="measurement" data-nonce="two"><a href="/two">Two</a>&#32;&#32;&#10;</article>'
PRE = "<pre>Alpha<span></span>&#32;&#32;&#10;&#32;&#32;<span></span>Beta</pre>"
SHOUT = '<ARTICLE data-id="7">Hello</ARTICLE>'
#: case, html, base, selector or boundaries, output, selection, rendering, canonical form; then error code, values, text, plain text, comparison text, warning
SEALED = [
    ("outer_html", GUIDE, START, "article a", "outer_html", "single", ("normalize", True), None, None, '<a href="https://example.com/docs/guide.html">Guide</a>', "Guide [https://example.com/docs/guide.html]", "Guide", None, None),
    ("inner_html", GUIDE, START, "article a", "inner_html", "single", ("normalize", True), None, None, "Guide", "Guide [https://example.com/docs/guide.html]", "Guide", None, None),
    ("attribute", GUIDE, START, "article a", "attribute:href", "single", ("normalize", True), None, None, "https://example.com/docs/guide.html", "Guide [https://example.com/docs/guide.html]", "Guide", None, None),
    ("structured", GUIDE, START, "article a", "structured", "single", ("normalize", True), None, None, None, "Guide [https://example.com/docs/guide.html]", "Guide", None, None),
    ("canonical_nonce", MEASURED, None, "article.measurement", "text", "single", ("normalize", False), (["data-nonce"], True), None, "Guide [/offer]", "Guide [/offer]", "Guide", "Guide [/offer]", None),
    ("canonical_href", MEASURED, None, "article.measurement a", "text", "single", ("normalize", False), (["href"], False), None, "Guide", "Guide [/offer]", "Guide", "Guide", None),
    ("canonical_structured", RAW, None, "article.measurement a", "structured", "single", ("normalize", False), (["href"], False), None, None, "Guide [/offer]", "Guide", "Guide", None),
    ("canonical_attribute", MEASURED, None, "article.measurement a", "attribute:href", "single", ("normalize", False), (["data-nonce"], True), "plan_invalid", None, None, None, None, None),
    ("canonical_all", TWO, None, "article.measurement", "text", "all", ("normalize", False), (["data-nonce", "href"], True), None, "One; Two", "One [/one]; Two [/two]", "One; Two", "One; Two", None),
    ("canonical_pre", PRE, None, "pre", "text", "single", ("rendered", False), ([], True), None, "Alpha Beta", "Alpha\n  Beta", "Alpha  \n  Beta", "Alpha Beta", None),
    ("canonical_rewritten", '<article><a href="guide.html">Guide</a></article>', START, "article a", "structured", "single", ("normalize", True), (["href"], False), None, None, "Guide [https://example.com/docs/guide.html]", "Guide", "Guide", None),
    ("literal", "HEAD<article>Hello</article>TAIL", None, ("<article>", "</article>", "literal", "exclude_both"), "text", "single", ("normalize", False), None, None, "Hello", "Hello", None, None, None),
    ("regex", SHOUT, None, ("<article[^>]*>", "</article>", "regex", "include_both"), "selected_html", "single", ("normalize", False), None, None, SHOUT, "Hello", None, None, None),
    ("regex_attribute", SHOUT, None, ("<article[^>]*>", "</article>", "regex", "include_both"), "attribute:data-id", "single", ("normalize", False), None, None, "7", "Hello", None, None, None),
    ("regex_structured", SHOUT, None, ("<article[^>]*>", "</article>", "regex", "include_both"), "structured", "single", ("normalize", False), None, None, None, "Hello", None, None, None),
    ("ambiguous", "<article>One</article><article>Two</article>", None, "article", "text", "single", ("normalize", False), None, "ambiguous_match", None, None, None, None, None),
    ("no_match", "<html><body><section>None</section></body></html>", None, "article", "text", "single", ("normalize", False), None, "no_match", None, None, None, None, None),
    ("missing_attribute", GUIDE, START, "article a", "attribute:data-id", "single", ("normalize", True), None, "missing_attribute", None, None, None, None, None),
    ("unresolved_base", '<html><body><article><a href="guide.html">Guide</a></article></body></html>', None, "article a", "outer_html", "single", ("normalize", True), None, None, '<a href="guide.html">Guide</a>', "Guide [guide.html]", "Guide", None, "EFFECTIVE_BASE_URL_UNRESOLVED"),
]
#: case, html, base, selector, attribute (None: text as rendered), answer
SHOWN = [
    ("break", "<p>Alpha<br>Beta</p>", None, "body", None, "Alpha\nBeta"),
    ("rule", "<p>Alpha</p><hr><p>Beta</p>", None, "body", None, "Alpha\n\n---\n\nBeta"),
    ("definition", "<dl><dt>Term</dt><dd>Definition</dd></dl>", None, "body", None, "Term\n: Definition"),
    ("label", "<section><div><p>Release Date:</p></div><div><p>4/14/2026</p></div></section>", None, "body", None, "Release Date: 4/14/2026"),
    ("navigation", '<nav><a href="/docs">Docs</a></nav>', None, "nav", None, "Docs [/docs]"),
    ("status", '<p class="status pricing report">All Systems Operational</p>', None, "p", None, "All Systems Operational"),
    ("srcset", '<img srcset="hero.jpg 1x, hero@2x.jpg 2x">', "https://example.test/assets/", "img", "srcset", "https://example.test/assets/hero.jpg 1x, https://example.test/assets/hero@2x.jpg 2x"),
    ("refresh", '<meta http-equiv="refresh" content="0; url= /next">', "https://example.test/", "meta", "content", "0; url= https://example.test/next"),
    ("base_of_other_scheme", '<base href="ftp://files.test/x/"><a href="guide.html">Guide</a>', START, "a", "href", "https://example.com/docs/guide.html"),
]


def _plan(where: str | tuple, output: str, selection: str, rendering: tuple, rules: tuple | None) -> dict:
    kind, _, name = output.partition(":")
    if isinstance(where, str):
        strategy = {"kind": "css_selector", "selector": where}
    else:
        start, end, mode, kept = where
        strategy = {"kind": "delimiter_pair", "start": start, "end": end, "mode": mode, "boundary_retention": kept} | ({"flags": ["case_insensitive"]} if mode == "regex" else {})
    plan = {
        "interop_profile": "leafmill-v1", "schema_name": "leafmill.plan", "schema_version": 8, "strategy": strategy, "selection": {"mode": selection}, "output": {"kind": kind} | ({"name": name} if name else {}),
        "rendering": {"whitespace": rendering[0], "rewrite_urls": rendering[1]},
    }
    return plan if rules is None else plan | {"dom_canonicalization": {"ignore_attributes": rules[0], "strip_whitespace_nodes": rules[1]}}


def _document(spark: SparkSession, case: str, html: str, base: str | None) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.lit(case).alias("case_name"), F.lit(html).alias("html"), F.lit(base).cast("string").alias("base"))


def sealed_facts(spark: SparkSession) -> DataFrame:
    """What sealed results and errors say, case by case."""
    parts = [corpus.run_plan(_document(spark, case, html, base), _plan(*how), base_url="base").withColumn("whole", F.lit(how[1] == "structured")) for case, html, base, *how in (c[:8] for c in SEALED)]
    match = "array<struct<output_value:string,text_output:string,plain_text_output:string,comparison_text_output:string>>"
    got = reduce(DataFrame.unionByName, parts).withColumn("m", F.from_json(F.get_json_object("document", "$.selected_matches"), match))

    def joined(field: str) -> F.Column:
        values = F.filter(F.col(f"m.{field}"), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.array_join(values, "; "))

    return got.select(
        "case_name", "is_result", F.get_json_object("document", "$.error_code").alias("error_code"), F.when(~F.col("whole"), joined("output_value")).alias("value"), joined("text_output").alias("text"),
        joined("plain_text_output").alias("plain"), joined("comparison_text_output").alias("comparison"), F.when(F.col("is_result"), F.get_json_object("document", "$.diagnostics[0].code")).alias("warning"),
    )


def shown_facts(spark: SparkSession) -> DataFrame:
    """Rendered texts and rewritten URLs, case by case."""
    parts = []
    for case, html, base, selector, attribute, _ in SHOWN:
        request = Request(selector=selector, selection=Selection("first"), value="attribute" if attribute else "text", attribute=attribute, output=Output("rendered", rewrite_urls=base is not None))
        parts.append(corpus.matches(corpus.extract(_document(spark, case, html, base), request, base_url="base")).select("case_name", "value"))
    return reduce(DataFrame.unionByName, parts)


def test_sealed_facts(spark):
    columns = ["case_name", "is_result", "error_code", "value", "text", "plain", "comparison", "warning"]
    got = {r.case_name: tuple(r) for r in sealed_facts(spark).select(*columns).collect()}
    assert got == {c[0]: (c[0], c[8] is None, *c[8:]) for c in SEALED}


def test_shown_facts(spark):
    assert {r.case_name: r.value for r in shown_facts(spark).collect()} == {c[0]: c[-1] for c in SHOWN}
