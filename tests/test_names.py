"""Names of elements are compared with the vocabularies once, and count as before."""

from leafmill.functions import chrome
from leafmill.functions.html_parser import parse
from leafmill.functions.inspect import inspect


def test_names_are_judged_once(monkeypatch):
    judged, among = [], chrome.among
    monkeypatch.setattr(chrome, "among", lambda word, vocabulary: judged.append(word) or among(word, vocabulary))
    chrome._known.cache_clear()
    page = "<article>" + "<section class='story-intro box'><h2>Heading here</h2><p>Some words to read.</p></section>" * 60 + "</article>"
    first = inspect(page)
    once = len(judged)
    assert first["element_count"] == 184 and once < 184
    assert inspect(page) == first and len(judged) == once


def test_counts_are_those_of_single_words():
    long = "x" * 300
    page = f"<div class='ad advertised sidebars {long}shopping'></div><div class='{'ad ' * 100}'></div><DIV ID=Content></DIV><p/><p ></p>"
    boxes = [e for e in parse(page).elements() if e.tag == "div"]
    assert [e.tag for e in parse(page).elements() if e.tag in ("div", "p")] == ["div"] * 3 + ["p"] * 2
    signals = chrome.Signals()
    for e in boxes:
        for vocabulary in (chrome.UTILITY, chrome.STRONG, chrome.CONTENT, chrome.CITES):
            said = [w.lower() for w in chrome._WORD.findall(" ".join(("div", *(f"{k} {v}" for k, v in e.attrs.items()))))]
            assert signals.hits(e, vocabulary) == sum(any(t == w or len(w) >= 5 and len(t) > len(w) + 2 and w in t for w in vocabulary) for t in said)
    assert [signals.hits(e, chrome.UTILITY) for e in boxes] == [3, 100, 0]
