"""Operators over intervals of the node table, against the tree itself."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions.chrome import Signals
from leafmill.functions.dom import path_of
from leafmill.functions.html_parser import parse
from leafmill.functions.inspect import visible_chars
from leafmill.functions.text import item_marker
from leafmill.operators import corpus, furniture, intervals

KEY = ["page_id"]
TAGS = "div div section aside p a a img span h2 ul li nav article main footer table b template noscript".split()
NAMES = "content main-content ad advert sidebar wrapper layoutbox share related entry bodytext footer hiddenmenu xadvertx comment".split()


def grown(rng: random.Random, depth: int = 0) -> str:
    """Random markup with names that matter, images, hidden parts and little texts."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(TAGS)
        attrs = ""
        if rng.random() < 0.45:
            attrs += f' class="{" ".join(rng.sample(NAMES, rng.randrange(1, 3)))}"'
        attrs += rng.choice(["", "", "", "", ' hidden', ' aria-hidden="TRUE"', ' style="color: red; Display : none; display : None"', ' role="Navigation"', ' role="main"', ' itemprop="articleBody"', ' data-kind="promo box"', ' id="Content1"'])
        text = rng.choice(["", "", "word ", "two words", "  ", "x" * 40, "café   \U0001d4b3"])
        if tag == "img":
            out.append(f'<img alt="{text}">')
        else:
            out.append(f"<{tag}{attrs}>{text}{grown(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else ''}</{tag}>")
    return "".join(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(17)
    rows = [(i, "<title>T</title><body>" + grown(rng)) for i in range(120)]
    wide = '<div class="sidebar wrapper">' + "<i>x</i>" * 255 + "{}<main>m</main></div>"
    return rows + [(500, wide.format("")), (501, wide.format("<i>y</i>")), (502, ""), (503, None), (504, "<div><a href=x>a</a><img><a href=y>b</a></div><div><img><a>a</a><a>b</a></div><div><a>a</a><a>b</a><img></div>")]


@pytest.fixture(scope="module")
def trees(pages):
    return {i: parse(h or "") for i, h in pages}


@pytest.fixture(scope="module")
def nodes(spark, pages):
    return corpus.parse_nodes(spark.createDataFrame(pages, "page_id long, html string").repartition(6)).cache()


def test_subtree_counts(nodes, trees):
    got = {(r.page_id, r.node_id): r for r in intervals.subtree_counts(nodes, KEY).collect()}
    assert got.keys() == {(i, e.number) for i, t in trees.items() for e in t.elements()}
    for i, t in trees.items():
        for e in t.elements():
            below, r = [n.tag for n in e.elements()], got[i, e.number]
            assert (r.elements, r.links, r.items, r.paragraphs, r.headings) == (len(below), below.count("a"), below.count("li"), below.count("p"), sum(t in intervals.HEADINGS for t in below))
        assert got[i, t.first("body").number].visible_chars == visible_chars(t)


def test_running_sums_before(nodes, trees):
    got = intervals.tour(nodes, KEY, {"texts": F.col("kind") == "text"}, ["kind"]).collect()
    for r in got:
        order = list(trees[r.page_id].root.walk())
        at = next(k for k, n in enumerate(order) if n.number == r.node_id)
        assert r.texts_before == sum(n.kind == "text" for n in order[:at])


def test_text_content(nodes, trees):
    got = {(r.page_id, r.path): r.content for r in intervals.text_content(nodes, KEY, intervals.is_element("div", "p", "li", "main")).collect()}
    assert got == {(i, path_of(e)): e.content() for i, t in trees.items() for e in t.elements() if e.tag in ("div", "p", "li", "main")}


def test_inside_and_maximal(nodes, trees):
    div = intervals.is_element("div")
    got = {(r.page_id, r.node_id) for r in intervals.inside(nodes, KEY, div).where("inside").collect()}
    assert got == {(i, n.number) for i, t in trees.items() for n in t.root.walk() if any(a.tag == "div" for a in n.ancestors())}
    top = {(r.page_id, r.node_id) for r in intervals.maximal(nodes, KEY, div).collect()}
    assert top == {(i, n.number) for i, t in trees.items() for n in t.elements() if n.tag == "div" and not any(a.tag == "div" for a in n.ancestors())}


def test_furniture_equals_the_tree(nodes, trees):
    got = {(r.page_id, r.node_id): (r.chrome, r.hidden) for r in furniture.marked(nodes, KEY).where("kind = 'element'").collect()}
    seen = set()
    for i, t in trees.items():
        s = Signals()
        for e in t.elements():
            want = (s.chrome(e), s.hidden(e) or s.hidden_style(e))
            assert got[i, e.number] == want, (i, path_of(e), e.attrs)
            seen.add(want)
    assert len(seen) == 4


def test_utility_roots(nodes, trees):
    got = {(r.page_id, r.node_id): r.utility_roots for r in furniture.utility_roots(nodes, KEY).collect()}
    want = {}
    for i, t in trees.items():
        s = Signals()
        for e in t.elements():
            if not s.chrome(e) and not any(a.kind == "element" and s.chrome(a) for a in e.ancestors()):
                below = [n for n in e.elements() if s.chrome(n)]
                want[i, e.number] = sum(not any(a in below for a in n.ancestors()) for n in below)
    assert got == want and sum(want.values()) > 20


def test_list_markers(spark):
    lists = [
        "<ol><li>a<li>b<ol reversed><li>x<li>y</ol><li>c</ol><ul><li>z</ul>", "<ol start=5 reversed><li value=9>a<li>b<li value=+2>c<li value=x>d</ol>", "<ol reversed><li>a<div><li>b</div><li value=9223372036854775807>c<li>d</ol>",
        "<ol start=9223372036854775807><li>a<li>b</ol><ol start=99999999999999999999><li>a</ol><ol start=-3><li>a<p>t</p><li>b</ol>", "<li>loose<menu><li>m</menu>", "<ol start=' 4'><li>a</ol>", "",
    ]
    table = corpus.parse_nodes(spark.createDataFrame(list(enumerate(lists)), "page_id int, html string"))
    got = {(r.page_id, r.path): r.marker for r in intervals.list_markers(table, KEY).collect()}
    assert got == {(i, path_of(e)): item_marker(e) for i, h in enumerate(lists) for e in parse(h).elements() if e.tag == "li"}


def test_one_exchange_and_no_join(nodes):
    for df in (intervals.subtree_counts(nodes, KEY), furniture.utility_roots(nodes, KEY), intervals.text_content(nodes, KEY, intervals.is_element("p"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Cartesian" not in plan
