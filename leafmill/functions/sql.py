"""SQL functions: Arrow scalar functions and table functions over HTML text.

``register(spark)`` adds ``html_text``, ``html_select_first``, ``html_attr``, ``html_title``, ``url_resolve`` and
``url_redact``, and the table functions ``html_select(html, css, mode)``, ``html_slice(html, from, to)`` and ``html_nodes(html)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import slices, urls
from .css import parse, select
from .extract import Output, Plan, Request, Selection, parsed
from .shipping import ship
from .text import body_text, title

_plans: dict[tuple, Plan] = {}


def _plan(css: str, value: str, name: str | None) -> Plan:
    if (css, value, name) not in _plans:
        _plans[css, value, name] = Plan(Request(selector=css, value=value, attribute=name, selection=Selection("first"), output=Output("normalize", include_html=False, include_text=False)))
    return _plans[css, value, name]


def _first(html: str | None, css: str, value: str, name: str | None = None) -> str | None:
    if html is None:
        return None
    got = _plan(css, value, name).run(html)["matches"]
    return got[0]["value"] if got else None


def html_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else body_text(parsed(h), "normalize", True))


def html_title(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else title(parsed(h)))


def html_select_first(html: pd.Series, css: pd.Series) -> pd.Series:
    return pd.Series([_first(h, c, "text") for h, c in zip(html, css, strict=True)], dtype=object)


def html_attr(html: pd.Series, css: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([_first(h, c, "attribute", n) for h, c, n in zip(html, css, name, strict=True)], dtype=object)


def url_resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else urls.resolve(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def url_redact(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if u is None else urls.redacted(u))


class HtmlSelect:
    """index, tag, text and html of the elements that a selector matches."""

    def eval(self, html: str, css: str, mode: str = "all") -> Iterator[tuple]:
        plan = Plan(Request(selector=css, selection=Selection(mode), value="text"))
        for m in plan.run(html or "")["matches"]:
            yield m["index"], m["metadata"]["tag_name"], m["text"], m["html"]


class HtmlSlice:
    """index and value of the slices between two literals."""

    def eval(self, html: str, start: str, end: str) -> Iterator[tuple]:
        found, dangling = slices.cuts(html or "", slices.finder(start, False), slices.finder(end, False))
        for i, c in enumerate(found if dangling is None else [], 1):
            yield i, html[slice(*c.inner)]


class HtmlNodes:
    """number, parent, kind, tag and text of the nodes of a document."""

    def eval(self, html: str) -> Iterator[tuple]:
        for n in parsed(html or "").root.walk():
            yield n.number, n.parent.number if n.parent is not None else None, n.kind, n.tag or None, n.text or None


def register(spark: SparkSession) -> None:
    ship(spark)
    for f in (html_text, html_title, html_select_first, html_attr, url_resolve, url_redact):
        spark.udf.register(f.__name__, F.pandas_udf(f, "string"))
    spark.udtf.register("html_select", F.udtf(HtmlSelect, returnType="index long, tag string, text string, html string"))
    spark.udtf.register("html_slice", F.udtf(HtmlSlice, returnType="index long, value string"))
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType="node_id long, parent_id long, kind string, tag string, text string"))


def matches(html: str, css: str) -> int:
    """How many elements a selector matches (a helper for tests and notebooks)."""
    return len(select(parsed(html), parse(css)))
