"""Unique selectors from counts, against matching each idea."""

import random

from leafmill.functions.dom import path_of
from leafmill.functions.html_parser import parse
from leafmill.functions.inspect import Inspector
from leafmill.operators import corpus, selectors

NAMES = ["main", "content", "a", "b", "c-d", "_e", "9x", "é", "wrapper", "post", "a b"]


def grown(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "section", "p", "article", "x-y"])
        attrs = ""
        if rng.random() < 0.6:
            attrs += ' class="' + rng.choice([" ", "\n", "  "]).join(rng.choices(NAMES, k=rng.randrange(4))) + '"'
        if rng.random() < 0.3:
            attrs += f""" id='{rng.choice(["x", "y1", "a b", " z ", "q'"[:1] + '"', "8", ""])}'"""
        if rng.random() < 0.2:
            attrs += f' role="{rng.choice(["main", "note", " main"])}"'
        if rng.random() < 0.2:
            attrs += f' itemprop="{rng.choice(["articleBody", "name"])}"'
        out.append(f"<{tag}{attrs}>t{grown(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else ''}</{tag}>")
    return "".join(out)


def test_recommendations_equal_matching(spark):
    rng = random.Random(6)
    pages = [(i, grown(rng)) for i in range(120)] + [(900, "")]
    nodes = corpus.parse_nodes(spark.createDataFrame(pages, "page_id int, html string").repartition(4))
    got = {(r.page_id, r.path): r.selector for r in selectors.recommended(nodes, ["page_id"]).collect()}
    want = {}
    for i, html in pages:
        document = parse(html)
        run = Inspector(document, None)
        want |= {(i, path_of(e)): run.recommended(e, path_of(e)) for e in document.elements()}
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)
    assert len({s.split("[")[0][:1] for s in got.values()}) > 5
