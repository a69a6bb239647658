"""Deep and broad documents, and installs that cannot be written to."""

import os
import time
import zipfile

import pytest

from leafmill.functions import css
from leafmill.functions.dom import copied, serialized
from leafmill.functions.extract import Output, Plan, Request, Selection
from leafmill.functions.html_parser import parse
from leafmill.functions.inspect import inspect
from leafmill.functions.interop import Sealed

DEEP = "<div>" * 5000 + "<p>core text</p>" + "</div>" * 5000


@pytest.mark.parametrize("value", ["outer-html", "inner-html", "text", "structured"])
def test_deep_documents_extract(value):
    got = Plan(Request(selector="div", selection=Selection("first"), value=value, output=Output())).run(DEEP)
    assert got["ok"] and "core text" in str(got["matches"][0]["value"])


def test_deep_documents_inspect_and_copy():
    assert inspect(DEEP)["element_count"] == 5004
    root = parse(DEEP).html()
    assert serialized(copied(root)) == serialized(root)


def test_siblings_match_in_linear_time():
    took = []
    for n in (5000, 20000):
        document = parse("<ul>" + "<li>x" * n + "<li class=z>y</ul>")
        began = time.process_time()
        assert len(css.select(document, css.parse("li + li"))) == n
        assert len(css.select(document, css.parse("li:first-child ~ li"))) == n
        assert css.select(document, css.parse("li.none ~ li")) == []
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def brute(selector, element):
    """``a how b`` of two compounds by definition."""
    left, how, right = selector.split("|")
    hit = lambda e, s: css.Matcher().any(css.parse(s), e)
    siblings = element.parent.child_elements() if element.parent is not None else [element]
    before = siblings[: siblings.index(element)]
    pool = {" ": [a for a in element.ancestors() if a.kind == "element"], ">": [a for a in [element.parent] if a is not None and a.kind == "element"], "+": before[-1:], "~": before}[how]
    return hit(element, right) and any(hit(e, left) for e in pool)


@pytest.mark.parametrize("how", [" ", ">", "+", "~"])
def test_combinators_by_definition(how):
    document = parse("<div class=a><p class=b>1</p><div><span class=a>2</span><p class=b>3</p><p>4</p><section class=a><p class=b>5</p></section></div></div><p class=b>6</p>")
    for left in (".a", "p", "div", "*"):
        for right in (".b", "p", "span", "*"):
            want = [e for e in document.elements() if brute(f"{left}|{how}|{right}", e)]
            assert css.select(document, css.parse(f"{left} {how} {right}")) == want


def test_any_namespace_with_a_value():
    document = parse('<svg><use xlink:href="x"></use></svg><a href="x">l</a>')
    assert [e.tag for e in css.select(document, css.parse('[*|href="x"]'))] == ["use", "a"]
    assert [e.tag for e in css.select(document, css.parse('[href="x"]'))] == ["a"]


@pytest.mark.parametrize("strategy", [{}, {"kind": "css_selector"}, {"kind": "delimiter_pair", "mode": "literal", "end": "x"}, "text"])
def test_plans_without_needed_fields_are_sealed_errors(strategy):
    sealed = Sealed({"schema_name": "x.plan", "schema_version": 1, "strategy": strategy, "output": {"kind": "text"}})
    assert sealed.run("<p>a</p>")["error_code"] == "plan_invalid"


def test_shipping_writes_nothing_beside_the_sources(tmp_path, monkeypatch):
    import leafmill.functions.shipping as shipping

    class Context:
        applicationId, added = "test", []

        def addPyFile(self, path):
            self.added.append(path)

    session = type("Session", (), {"sparkContext": Context()})()
    shipping.ship(session)
    names = zipfile.ZipFile(Context.added[0]).namelist()
    assert "leafmill/functions/dom.py" in names and not any("__pycache__" in n or os.path.isabs(n) for n in names)


@pytest.mark.parametrize("markup,selector,count", [
    ("<ul>" + "<li>x<b>y</b></li>" * 20_000 + "</ul>", "ul:has(b)", 1), ("<ul>" + "<li>x<b>y</b></li>" * 20_000 + "</ul>", "li:not(:has(+ b)):has(~ li)", 19_999), ("<div>" * 5000 + "<b>x</b>", "div:has(b)", 5000),
])
def test_has_is_linear(markup, selector, count):
    document = parse(markup)
    began = time.time()
    assert len(css.select(document, css.parse(selector))) == count and time.time() - began < 5


def test_has_leads_from_every_anchor():
    document = parse("<div id=a><p><b>x</b></p><i></i><p class=y></p></div><div id=c><ul><li><b></b></li></ul></div>")
    ids = lambda s: [e.attrs.get("id") or e.tag for e in css.select(document, css.parse(s))]
    assert ids("div:has(b)") == ["a", "c"] and ids("div:has(> b)") == [] and ids("p:has(+ i)") == ["p"] and ids("p:has(~ .y)") == ["p"]
    assert ids(":has(> p > b, + #c)") == ["a"] and ids("div:not(:has(p))") == ["c"] and ids("ul:has(:is(b, i):first-child)") == ["ul"]
