"""Registered queries over subtrees of the node table, with what the raw markup says as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, corpus, furniture, intervals, selectors
from ..sources.tables import kept
from .dom_queries import _plain
from .slice_queries import html, pages

KEY = ["page_id"]
#: Elements that the tree builder repeats where markup leaves them open, and what stands in them: not to be read off the markup.
INLINE = ("b", "br")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.parse_nodes(html(spark, sf_dir), by=KEY)


def subtree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, headings, items, paragraphs and visible characters below each element."""
    found = intervals.subtree_counts(_nodes(spark, sf_dir), KEY)
    return found.where(~F.col("tag").isin(*INLINE)).select("page_id", "path", "links", "headings", "items", "paragraphs", "visible_chars")


def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every paragraph and list item."""
    return intervals.text_content(_nodes(spark, sf_dir), KEY, intervals.is_element("p", "li")).select("page_id", "path", "content")


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before every list item of a rendered page."""
    return intervals.list_markers(_nodes(spark, sf_dir), KEY).select("page_id", "path", "ordinal", "marker")


def recommended_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest usual selector of each element."""
    return selectors.recommended(_nodes(spark, sf_dir), KEY, ~F.col("tag").isin(*INLINE)).select("page_id", "path", "selector")


def furniture_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where page furniture and hidden parts begin."""
    return furniture.roots(_nodes(spark, sf_dir), KEY).select("page_id", "why", "path")


def utility_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many roots of furniture each content element holds."""
    found = furniture.utility_roots(_nodes(spark, sf_dir), KEY)
    return found.where(~F.col("tag").isin(*INLINE)).select("page_id", "path", "utility_roots")


def clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs of each page stand outside of furniture."""
    return furniture.clean(_nodes(spark, sf_dir), KEY).where("tag = 'p'").groupBy("page_id").agg(F.count(F.lit(1)).alias("paragraphs"))


def content_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to extract and what to read of each page, ranked by joins and windows over measured containers."""
    found = kept(candidates.measured(pages(spark, sf_dir).select("page_id", "url", "html"), base_url="url"), "candidates")
    return candidates.recommended(found, KEY).select("page_id", "purpose", "rank", "selector", "path", "headings", "links")


def _decoded(c: str) -> str:
    """DuckDB: references decoded, one that lacks its semicolon at the end too."""
    return f"regexp_replace({_plain(c)}, '&amp$', '&')"


def _visible(markup: str) -> str:
    """DuckDB: characters of the texts between tags, squeezed, a space between them."""
    said = "trim(regexp_replace(" + _decoded("s") + ", '\\s+', ' ', 'g'))"
    pieces = f"list_filter(list_transform(regexp_split_to_array({markup}, '<[^>]*>'), lambda s: {said}), lambda s: s <> '')"
    return f"coalesce(list_sum(list_transform({pieces}, lambda s: length(s) + 1)) - 1, 0)::BIGINT"


_ROOT = "html:nth-of-type(1)"
_BODY = f"{_ROOT} > body:nth-of-type(1)"
_ITEM = f"'{_BODY} > nav:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(' || i || ')'"
_PARAGRAPH = f"'{_BODY} > article:nth-of-type(1) > p:nth-of-type(' || i || ')'"
#: Pages cut into the parts that their template has; every part's length, links and paragraphs are the page's own.
_PARTS = """
part AS MATERIALIZED (SELECT page_id, regexp_extract(html, '(?s)<body>(.*)$', 1) AS body, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS footer,
    regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS items, string_split(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<p>')[2:] AS prose FROM pages),
item AS MATERIALIZED (SELECT page_id, i, items[i] AS markup FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM part)),
paragraph AS MATERIALIZED (SELECT page_id, i, split_part(prose[i], '</p>', 1) AS markup FROM (SELECT page_id, prose, unnest(range(1, len(prose) + 1)) AS i FROM part))"""


def _counted() -> str:
    one = lambda path, links, headings, items, paragraphs, markup: f"SELECT page_id, '{path}' AS path, {links}::BIGINT AS links, {headings}::BIGINT AS headings, {items}::BIGINT AS items, {paragraphs}::BIGINT AS paragraphs, {_visible(markup)} AS visible_chars FROM part"
    n, p = "len(items)", "len(prose)"
    head = ["", " > meta:nth-of-type(1)", " > title:nth-of-type(1)", " > style:nth-of-type(1)", " > script:nth-of-type(1)"]
    rows = [one(f"{_ROOT} > head:nth-of-type(1){h}", 0, 0, 0, 0, "''") for h in head]
    rows += [one(_ROOT, n, 1, n, p, "body"), one(_BODY, n, 1, n, p, "body"), one(f"{_BODY} > nav:nth-of-type(1)", n, 0, n, 0, "nav"), one(f"{_BODY} > nav:nth-of-type(1) > ul:nth-of-type(1)", n, 0, n, 0, "nav")]
    rows += [one(f"{_BODY} > div:nth-of-type(1)", 0, 0, 0, 0, "ad"), one(f"{_BODY} > article:nth-of-type(1)", 0, 1, 0, p, "article"), one(f"{_BODY} > article:nth-of-type(1) > h1:nth-of-type(1)", 0, 0, 0, 0, "h1")]
    rows += [one(f"{_BODY} > footer:nth-of-type(1)", 0, 0, 0, 0, "footer")]
    rows += [f"SELECT page_id, {_ITEM}, 1, 0, 0, 0, {_visible('markup')} FROM item", f"SELECT page_id, {_ITEM} || ' > a:nth-of-type(1)', 0, 0, 0, 0, {_visible('markup')} FROM item"]
    rows += [f"SELECT page_id, {_PARAGRAPH}, 0, 0, 0, 0, {_visible('markup')} FROM paragraph"]
    return f"WITH {_PARTS} {' UNION ALL '.join(rows)}"


def _selectors() -> str:
    """An element that its markup has once goes by its tag, or by its class; list items, their links and paragraphs by their paths if there are several."""
    alone = lambda path, tag: f"SELECT page_id, '{path}' AS path, '{tag}' AS selector FROM pages WHERE len(regexp_extract_all(html, '<{tag.split('.')[0]}[ >]')) = 1"
    body = {"nav": "nav", "nav:nth-of-type(1) > ul": "ul", "div": "div.ad", "article": "article", "article:nth-of-type(1) > h1": "h1", "footer": "footer"}
    rows = [alone(_ROOT, "html"), alone(_BODY, "body"), alone(f"{_ROOT} > head:nth-of-type(1)", "head")] + [alone(f"{_ROOT} > head:nth-of-type(1) > {t}:nth-of-type(1)", t) for t in ("meta", "title", "style", "script")]
    rows += [alone(f"{_BODY} > {path}:nth-of-type(1)", selector) for path, selector in body.items()]
    several = lambda path, tag, of: f"SELECT page_id, {path} AS path, CASE WHEN count(*) OVER (PARTITION BY page_id) = 1 THEN '{tag}' ELSE {path} END FROM {of}"
    rows += [several(_ITEM, "li", "item"), several(f"{_ITEM} || ' > a:nth-of-type(1)'", "a", "item"), several(_PARAGRAPH, "p", "paragraph")]
    return f"WITH {_PARTS} {' UNION ALL '.join(rows)}"


def _utility() -> str:
    """Furniture on the given pages: the meta element, the navigation, boxes of class ad and the footer, if the markup has them."""
    has = "(len(regexp_extract_all(html, '<meta ')) + {0})"
    body = "(len(regexp_extract_all(html, '<nav>')) + len(regexp_extract_all(html, '<div class=\"ad\">')) + len(regexp_extract_all(html, '<footer>')))"
    rows = [f"SELECT page_id, '{_ROOT}' AS path, {has.format(body)}::BIGINT AS utility_roots FROM pages", f"SELECT page_id, '{_ROOT} > head:nth-of-type(1)', {has.format(0)}::BIGINT FROM pages", f"SELECT page_id, '{_BODY}', {body}::BIGINT FROM pages"]
    rows += [f"SELECT page_id, '{_ROOT} > head:nth-of-type(1) > {tag}:nth-of-type(1)', 0 FROM pages WHERE html LIKE '%<{tag}>%'" for tag in ("title", "style", "script")]
    rows += [f"SELECT page_id, '{_BODY} > article:nth-of-type(1){more}', 0 FROM part" for more in ("", " > h1:nth-of-type(1)")] + [f"SELECT page_id, {_PARAGRAPH}, 0 FROM paragraph"]
    return f"WITH {_PARTS} {' UNION ALL '.join(rows)}"


_STANDS = {"<meta ": f"{_ROOT} > head:nth-of-type(1) > meta:nth-of-type(1)", "<nav>": f"{_BODY} > nav:nth-of-type(1)", '<div class="ad">': f"{_BODY} > div:nth-of-type(1)", "<footer>": f"{_BODY} > footer:nth-of-type(1)"}

_TEXT = _decoded("regexp_replace(markup, '<[^>]*>', '', 'g')")

ORACLES = {
    "subtree_counts": _counted(),
    "element_text": f"WITH {_PARTS} SELECT page_id, {_ITEM} AS path, {_TEXT} AS content FROM item UNION ALL SELECT page_id, {_PARAGRAPH}, {_TEXT} FROM paragraph",
    "recommended_selectors": _selectors(),
    "list_markers": f"WITH {_PARTS} SELECT page_id, {_ITEM} AS path, NULL::VARCHAR AS ordinal, '- ' AS marker FROM item",
    "furniture_roots": " UNION ALL ".join(f"SELECT page_id, 'chrome' AS why, '{path}' AS path FROM pages WHERE contains(html, '{tag}')" for tag, path in _STANDS.items()),
    "utility_roots": _utility(),
    # a page whose article is a short heading, repeated as its only paragraph, has too little text to be a candidate
    "content_candidates": f"WITH {_PARTS} SELECT page_id, purpose, 1::BIGINT AS rank, 'article' AS selector, '{_BODY} > article:nth-of-type(1)' AS path, len(regexp_extract_all(article, '<h[1-6]>'))::BIGINT AS headings, len(regexp_extract_all(article, '<a href='))::BIGINT AS links FROM part, (VALUES ('reading'), ('extraction')) t(purpose) WHERE length(h1) >= 18 OR {_visible('article')} >= 2 * length(h1) + 22",
    "clean_paragraphs": f"WITH {_PARTS} SELECT page_id, count(*) AS paragraphs FROM paragraph GROUP BY page_id",
}

QUERIES = {f.__name__: f for f in (subtree_counts, element_text, list_markers, recommended_selectors, furniture_roots, utility_roots, clean_paragraphs, content_candidates)}
