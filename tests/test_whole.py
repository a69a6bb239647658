"""Queries without SQL, or whose SQL is not plain, against brute force over all rows."""

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pytest

from leafmill.functions.html_parser import parse
from leafmill.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    return con


def test_link_resolve_returns_every_link(spark, sf_dir, db):
    want = []
    for page, url, html in db.execute("SELECT page_id, url, html FROM pages").fetchall():
        for i, href in enumerate(re.findall('<a href="([^"]*)">', html), 1):
            want.append((page, i, href, urljoin(url, "".join(c if c.isascii() else quote(c) for c in href))))
    got = sorted(tuple(r) for r in registry.queries()["link_resolve"](spark, sf_dir).select("page_id", "link_index", "href", "resolved").collect())
    assert got == sorted(want)
    assert any(not h.isascii() and h != "/für" for _, _, h, _ in got)
    assert sorted(db.execute(f"SELECT page_id, link_index, href, resolved FROM ({registry.oracle_sql()['link_resolve']})").fetchall()) == got


class Tags(HTMLParser):
    """Counts start tags; on the given pages only ``b``, left open across paragraphs, has more elements than start tags."""

    def __init__(self, html):
        super().__init__()
        self.counts = Counter()
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.counts[tag] += 1


def test_histograms_hold_every_tag(spark, sf_dir, db):
    raw = db.execute("SELECT page_id, html FROM pages").fetchall()
    pages = {page: Counter(e.tag for e in parse(html).elements()) for page, html in raw}
    for page, html in raw:
        assert {**pages[page], "b": 0} == {**Tags(html).counts, "b": 0} and pages[page]["b"] >= Tags(html).counts["b"]
    got = {(r.page_id, r.tag): r["count"] for r in registry.queries()["tag_histogram"](spark, sf_dir).collect()}
    assert got == {(page, tag): n for page, counts in pages.items() for tag, n in counts.items()}
    whole = {r.tag: (r.n_documents, r.n_elements) for r in registry.queries()["corpus_tags"](spark, sf_dir).collect()}
    assert whole == {tag: (sum(tag in c for c in pages.values()), sum(c[tag] for c in pages.values())) for tag in set().union(*pages.values())}
    assert {"p", "b", "br", "div", "html", "meta"} <= set(whole)
