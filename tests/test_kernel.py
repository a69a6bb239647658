"""The kernel without Spark: parsing, selectors, URLs, slices, text and sealed plans."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import css, slices, urls
from leafmill.functions.dom import serialized
from leafmill.functions.extract import Canonical, Output, Plan, Request, Selection, byte_size, looks_like_document, preview_of
from leafmill.functions.html_parser import parse, parse_fragment
from leafmill.functions.inspect import inspect
from leafmill.functions.interop import Sealed, digest, identity, stable_json
from leafmill.functions.text import body_text, element_text, spaced

TREES = [
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"), ("<p><b>x<br><p>y", "<p><b>x<br></b></p><p><b>y</b></p>"), ("<table>a<tr>b<td>c", "ab<table><tbody><tr><td>c</td></tr></tbody></table>"),
    ("<a><p>X<a>Y</a>Z</p></a>", "<a></a><p><a>X</a><a>Y</a>Z</p>"), ("<b><p>1</b>2</p>", "<b></b><p><b>1</b>2</p>"), ("<svg><foreignObject><p>x</p></foreignObject><path/></svg>y", "<svg><foreignObject><p>x</p></foreignObject><path></path></svg>y"),
    ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"), ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
    ("<pre>\nx</pre><textarea>\ny</textarea>", "<pre>x</pre><textarea>y</textarea>"), ("&notit;&copy x&#x80;<i title='&copy=1&amp;'>", '¬it;© x€<i title="&amp;copy=1&amp;"></i>'), ("<noscript><p>x</noscript>", "<noscript>&lt;p&gt;x</noscript>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("<button>a<button>b", "<button>a</button><button>b</button>"), ("x<!-- c -->y<!bogus>z", "x<!-- c -->y<!--bogus-->z"), ("a</p>b", "a<p></p>b"),
]


@pytest.mark.parametrize("source,want", TREES)
def test_trees(source, want):
    assert serialized(parse_fragment(source).first("body"), True) == want


def test_head_and_quirks():
    assert serialized(parse("<p><table>").first("body"), True) == "<p><table></table></p>"
    assert serialized(parse("<!DOCTYPE html><p><table>").first("body"), True) == "<p></p><table></table>"
    assert serialized(parse("<body a=1><body a=2 b=3>").first("body")) == '<body a="1" b="3"></body>'
    assert serialized(parse('<script>if(a<b){"</scrip>"}<!-- <script> </script> --></script>ok').first("script"), True) == 'if(a<b){"</scrip>"}<!-- <script> </script> -->'


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abpi\"'= &;!-tdr\n\0é", max_size=60))
def test_parsing_never_fails_and_settles(text):
    once = serialized(parse_fragment(text).first("body") or parse_fragment(text).root, True)
    assert isinstance(once, str)
    Plan(Request(selector="*", selection=Selection("all"))).run(text)
    inspect(text)


HTML = '<div id=a class="x y"><p>1</p><p lang=EN-us>2<b>q</b></p><span></span><p data-v="f o">3</p></div><ul><li>1<li class=z>2<li>3</ul>'
SELECTED = {
    "p": 3, "div p": 3, "div > p": 3, "p + p": 1, "p ~ span": 1, ".x.y": 1, "#a": 1, "[lang|=en]": 1, "[data-v~=o]": 1, "[data-v^='f']": 1, "[data-v$='']": 0, "p:nth-child(2)": 1, "li:nth-child(odd)": 2, "li:nth-of-type(-n+2)": 2,
    "p:not([lang])": 2, ":is(b, li.z)": 2, ":has(b)": 4, "div:has(> p + p)": 1, "li:last-child": 1, "*|li": 3, "|li": 0, "span:empty": 1, ":root": 1, "p, li": 6, "li:only-child": 0, ":where(p, ::x)": 3, ":host(p)": 0, "P": 3, "[LANG]": 1,
}


@pytest.mark.parametrize("selector,count", SELECTED.items())
def test_selectors(selector, count):
    assert len(css.select(parse(HTML), css.parse(selector))) == count


@pytest.mark.parametrize("selector,kind,column", [
    ("", "empty_selector", 1), ("p >", "dangling_combinator", 4), ("..", "class_needs_ident", 2), ("a:hover", "unsupported_pseudo_class_or_element", 2), ("ns|p", "expected_namespace", 3), ("[a b]", "unexpected_token_in_attribute_selector", 4),
    ("𝒳 é::x", "unsupported_pseudo_class_or_element", 5), ("p[", "end_of_input", 3),
])
def test_selector_errors(selector, kind, column):
    with pytest.raises(css.SelectorError) as e:
        css.parse(selector)
    assert (e.value.kind, e.value.line, e.value.column) == (kind, 1, column)


@pytest.mark.parametrize("base,link,want", [
    ("https://example.com/docs/start.html", "guide.html", "https://example.com/docs/guide.html"), ("https://e.com/a/", "/für x", "https://e.com/f%C3%BCr%20x"), ("https://e.com", "?q", "https://e.com/?q"), ("https://e.com/a/b", "../c/./d", "https://e.com/c/d"),
    ("https://E.com:443/a", "//x.Y/z", "https://x.y/z"), ("http://e.com/", "\\a\\b", "http://e.com/a/b"), ("https://e.com/", "#x", "#x"), ("https://e.com/", "mailto:a@b.c", "mailto:a@b.c"), (None, "a", "a"),
])
def test_links(base, link, want):
    assert urls.resolve(base, link) == want


def test_rewriting():
    assert urls.srcset("https://example.test/assets/", "hero.jpg 1x, hero@2x.jpg 2x") == "https://example.test/assets/hero.jpg 1x, https://example.test/assets/hero@2x.jpg 2x"
    assert urls.refresh("https://example.test/", "0; url= /next") == "0; url= https://example.test/next"
    assert urls.style("https://e.com/", "a{b:url(x.png)} @import 'y.css'; /* url(z) */") == "a{b:url(https://e.com/x.png)} @import 'https://e.com/y.css'; /* url(z) */"
    assert urls.redacted("https://a.b/c?x=1#f") == "https://a.b/c?[redacted]" and urls.redacted("https://u@a.b/") is None and urls.redacted("ftp://a/") is None
    assert urls.normal("HTTP://0x7f.1/%7Ea b") == "http://127.0.0.1/%7Ea%20b"
    assert urls.effective_base(parse('<base href="ftp://x/">'), "https://e.com/") == "https://e.com/"


TEXTS = [
    ("<p>Alpha<br>Beta</p>", "Alpha\nBeta"), ("<p>Alpha</p><hr><p>Beta</p>", "Alpha\n\n---\n\nBeta"), ("<dl><dt>Term</dt><dd>Definition</dd></dl>", "Term\n: Definition"),
    ("<table><caption>Windows builds</caption><tr><td>Alpha</td></tr></table>", "Windows builds\nAlpha"), ("<section><div><p>Release Date:</p></div><div><p>4/14/2026</p></div></section>", "Release Date: 4/14/2026"),
    ('<nav><a href="/docs">Docs</a></nav>', "Docs [/docs]"), ("<ol start=3><li>a<ul><li>x</ul><li value=9>b<p>c</p></ol>", "3. a\n    - x\n9. b\n\n   c"), ("<table><tr><th>A<th>Bb<tr><td>long cell<td>x</table>", "A         | Bb\nlong cell | x"),
    ("<h1>T</h1><p>T</p><p>y</p>", "# T\n\ny"), ("<math><mfrac><mi>a</mi><mrow><mi>b</mi><mo>+</mo><mn>1</mn></mrow></mfrac></math>", "a/(b + 1)"), ('<p><a href="/x">BUY NOW TODAY</a></p><p>x</p>', "x"),
]


@pytest.mark.parametrize("source,want", TEXTS)
def test_text(source, want):
    assert body_text(parse_fragment(source), "rendered", False) == want


def test_reader_leaves_furniture_out():
    d = parse_fragment('<p class="status pricing report">All Systems Operational</p>')
    assert body_text(d, "normalize", True) == "" and element_text(d.first("p"), "normalize") == "All Systems Operational"
    assert spaced("  a  b\n\n\n c ", "normalize") == "  a b\n\n c"


def test_selection_and_values():
    run = lambda **k: Plan(Request(selector="article", **k)).run("<article>One</article><article>Two</article>")
    assert [d["code"] for d in run(selection=Selection("single"))["diagnostics"]] == ["AMBIGUOUS_MATCH"]
    assert [d["code"] for d in run()["diagnostics"]] == ["MULTIPLE_MATCHES"] and run()["ok"]
    assert run(selection=Selection("nth", 3))["diagnostics"][0]["details"] == {"requestedIndex": 3, "candidateCount": 2}
    assert [m["value"] for m in run(selection=Selection("all"), value="outer-html")["matches"]] == ["<article>One</article>", "<article>Two</article>"]
    assert Plan(Request(selector="p")).run("x")["diagnostics"][0]["code"] == "NO_MATCH"
    assert Plan(Request(selector="p", value="selected-html")).run("x")["diagnostics"][0]["code"] == "UNSUPPORTED_VALUE_TYPE"
    assert Plan(Request(selector="p", max_bytes=3)).run("<p>x")["diagnostics"][0]["message"] == "Preloaded source exceeds 3 bytes limit."
    assert Plan(Request(selector="p", spec_version=6)).run("x")["diagnostics"][0]["message"] == "Unsupported spec version 6. Expected 7."
    got = Plan(Request(selector="a", selection=Selection("all"), value="attribute", attribute="HREF")).run('<a href=x></a><a></a>')
    assert [m["value"] for m in got["matches"]] == ["x"] and not got["ok"]


def test_slices():
    run = lambda html, a, b, **k: Plan(Request(start=a, end=b, **k)).run(html)
    got = run("é<p>1</p><p>2</p>", "<p>", "</p>", selection=Selection("all"), value="selected-html")
    assert [(m["value"], m["metadata"]["inner_range"]) for m in got["matches"]] == [("1", {"start": 5, "end": 6}), ("2", {"start": 13, "end": 14})]
    assert run("é<p>1</p><p>2", "<p>", "</p>")["diagnostics"][0]["message"] == "End pattern was not found after offset 10: </p>"
    assert run("x", "<p>", "</p>")["diagnostics"][0]["message"] == "Start pattern was not found: <p>"
    assert run("x", "", "y")["diagnostics"][0]["message"] == "Patterns must not be empty."
    assert run("x", "a", "y", regex=True, flags="c")["diagnostics"][0]["message"] == "Unsupported regex flag: c"
    assert run("x", "(?=a)", "y", regex=True)["diagnostics"][0]["code"] == "INVALID_SLICE_PATTERN"
    assert run('<a href="x">y</a>', 'href="', '"', value="selected-html")["diagnostics"][0]["code"] == "SLICE_SPLITS_MARKUP"
    hinted = run("<a href=x>y</a>", "<a", "</a>", value="attribute", attribute="href")["diagnostics"][-1]
    assert hinted["details"]["hint"] == "use --boundary-retention include-start"
    assert run("aXbXc", "a|b", "X", regex=True, flags="U", selection=Selection("all"), retention="include-both", value="selected-html")["match_count"] == 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab<>é", max_size=30), st.text(alphabet="ab<", min_size=1, max_size=2), st.text(alphabet="ab>", min_size=1, max_size=2))
def test_slices_cover_what_they_say(text, a, b):
    found, _ = slices.cuts(text, slices.finder(a, False), slices.finder(b, False))
    last = 0
    for c in found:
        assert text[c.outer[0] : c.inner[0]] == a and text[c.inner[1] : c.outer[1]] == b and c.outer[0] >= last
        last = c.outer[1]


def test_small_functions():
    assert [byte_size(n) for n in (1, 7, 1024, 1536, 5 << 20, 3 << 30)] == ["1 byte", "7 bytes", "1 KiB", "1.5 KiB", "5 MiB", "3 GiB"]
    assert looks_like_document("  <!DOCTYPE html>") and looks_like_document("<HTML>") and not looks_like_document("<p>")
    assert preview_of("é" * 100, 21).endswith("...") and len(preview_of("é" * 100, 21).encode()) <= 21
    assert stable_json({"b": 1, "a": "é\n"}) == '{"a":"é\\n","b":1}'


PLAN = {"interop_profile": "p-v1", "schema_name": "p.plan", "schema_version": 8, "strategy": {"kind": "css_selector", "selector": "article a"}, "selection": {"mode": "single"}, "output": {"kind": "outer_html"}, "rendering": {"whitespace": "normalize", "rewrite_urls": True}}
GUIDE = '<html><head><title>Example</title></head><body><article><a href="guide.html">Guide</a></article></body></html>'


def test_sealed_results():
    got = Sealed(PLAN).run(GUIDE, "https://example.com/docs/start.html")
    one = got["selected_matches"][0]
    assert one["output_value"] == '<a href="https://example.com/docs/guide.html">Guide</a>' and one["text_output"] == "Guide [https://example.com/docs/guide.html]" and one["plain_text_output"] == "Guide"
    assert got["result_digest_sha256"] == digest({k: v for k, v in got.items() if k != "result_digest_sha256"}) and got["plan_digest_sha256"] == digest(PLAN)
    assert got == Sealed(stable_json(PLAN)).run(GUIDE, "https://example.com/docs/start.html")
    missing = Sealed(PLAN | {"output": {"kind": "attribute", "name": "data-id"}}).run(GUIDE)
    assert (missing["error_code"], missing["message"]) == ("missing_attribute", 'Selected candidate is missing attribute "data-id".')
    assert Sealed(PLAN | {"strategy": {"kind": "css_selector", "selector": "p"}}).run(GUIDE)["error_code"] == "no_match"
    wrong = Sealed(PLAN | {"dom_canonicalization": {"ignore_attributes": ["x"]}}).run(GUIDE)
    assert wrong["error_code"] == "plan_invalid" and wrong["message"].endswith("output kind OuterHtml does not expose comparison text")
    assert identity(GUIDE, "l", None, PLAN, "v") != identity(GUIDE, "l", "https://e.com/", PLAN, "v")


def test_canonical_comparison():
    html = '<article class="measurement" data-nonce="volatile"><!-- transient --><a href="/offer" data-nonce="volatile">Guide</a>&#32;&#32;&#10;</article>'
    request = Request(selector="article.measurement a", canonical=Canonical(frozenset({"href"})), output=Output("normalize"))
    assert Plan(request).run(html)["matches"][0]["comparison"] == ("Guide", "Guide")


def test_inspection():
    html = "<body><main id=m><article class='post x'><h1>Title</h1><p>" + "word " * 60 + "</p><p>more text here <a href=/a>link a</a></p><aside class=related><a href=/r>Related</a></aside></article></main><footer>f</footer>"
    got = inspect(html, "https://e.com/")
    assert [c["selector"] for c in got["extraction_candidates"]] == ["article.post.x", "#m"] and got["headings"][0]["text"] == "Title"
    assert [x["resolved_href"] for x in got["links"]] == ["https://e.com/a"] and got["top_tags"][0] == {"name": "a", "count": 2}
    assert inspect(html, limit=0)["headings"] == [] and inspect("<base href='/x'>")["diagnostics"][0]["code"] == "EFFECTIVE_BASE_URL_UNRESOLVED"
