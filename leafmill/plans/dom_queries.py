"""Registered queries over parsed documents."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.extract import Output, Request, Selection
from ..operators import corpus, relational, sealed
from ..operators import selection as sel
from ..sources.tables import kept
from .slice_queries import html, pages

ALL = Selection("all")
LEAN = Output("normalize", include_html=False, include_text=False)
LEAN_RENDERED = Output("rendered", include_html=False, include_text=False)


def _values(spark: SparkSession, sf_dir: str, request: Request, value: str = "value") -> DataFrame:
    return corpus.matches(corpus.extract(html(spark, sf_dir), request)).select("page_id", F.col("index").alias("match_index"), F.col("value").alias(value))


def select_nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Request(selector="nav li > a", selection=ALL, value="attribute", attribute="href", output=LEAN), "href")


def select_nth_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Request(selector="nav a", selection=Selection("nth", 5), value="attribute", attribute="href", output=LEAN), "href")


def select_attr_meta_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Request(selector="head > meta[charset]", selection=Selection("single"), value="attribute", attribute="charset", output=LEAN))


def select_style_inner_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Request(selector="style", value="inner-html", output=LEAN))


def select_script_inner_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Request(selector="script", value="inner-html", output=LEAN))


def select_item_outer_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Request(selector="nav > ul > li:first-child", value="outer-html", output=LEAN))


def select_first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Request(selector="article > h1", value="inner-html", output=LEAN))


def select_missing_attr_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = corpus.extract(html(spark, sf_dir), Request(selector="nav a", selection=Selection("first"), value="attribute", attribute="title", output=LEAN))
    return corpus.diagnostics(got).where("level = 'error'").select("page_id", "code", "message")


def invalid_selector_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = corpus.extract(html(spark, sf_dir), Request(selector="p::before", output=LEAN))
    return corpus.diagnostics(got).select("page_id", "level", "code", "message", "details")


def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = corpus.extract(html(spark, sf_dir), Request(selector="html", output=LEAN, value="attribute", attribute="lang"))
    return got.select("page_id", "document_title")


def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page."""
    docs = pages(spark, sf_dir).select("page_id", "url", "html")
    return corpus.links(docs, base_url="url").select("page_id", "link_index", "href", "resolved")


def link_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.links(html(spark, sf_dir)).select("page_id", "link_index", "label")


def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags of each page. No SQL: elements that the tree builder repeats (``b`` left open) are not in the markup."""
    return sel.histogram(corpus.parse_nodes(html(spark, sf_dir), paths=False), ["page_id"])


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.histogram(corpus.parse_nodes(html(spark, sf_dir), paths=False), ["page_id"], "class")


def corpus_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags of the whole corpus: documents that have them, and elements. No SQL, as for one page."""
    counts = sel.histogram(corpus.parse_nodes(html(spark, sf_dir), paths=False), ["page_id"])
    return counts.groupBy("tag").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("count").alias("n_elements"))


def _relational(spark: SparkSession, sf_dir: str, selector: str) -> DataFrame:
    nodes = kept(corpus.parse_nodes(html(spark, sf_dir), paths=True).where("kind = 'element'"), "nodes")  # parsed once, whatever the selector joins
    found = sel.numbered(relational.select(nodes, selector, ["page_id"]), ["page_id"])
    return found.select("page_id", "candidate_index", "candidate_count", "path")


def relational_nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nav > ul > li:nth-child(odd) > a[href^="/"]`` as joins over the node table."""
    return _relational(spark, sf_dir, 'nav > ul > li:nth-child(odd) > a[href^="/"]')


def relational_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relational(spark, sf_dir, "nav ~ article, div.ad + article > h1, head > title:only-of-type")


def relational_not_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relational(spark, sf_dir, "body > :not(article):not(footer):not(:has(li))")


def multi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests over one parse of each page."""
    plans = {
        "heading": Request(selector="h1", value="inner-html", output=LEAN), "charset": Request(selector="meta[charset]", value="attribute", attribute="charset", output=LEAN),
        "ad": Request(start='<div class="ad">', end="</div>", value="selected-html", output=LEAN),
    }
    got = corpus.multi_extract(html(spark, sf_dir), plans)
    return corpus.matches(got).select("page_id", "plan", "value")


def slice_regex_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact slice engine, held against the built-in one."""
    request = Request(start="<a href=[^>]*>", end="</a>", regex=True, flags="i", selection=ALL, value="selected-html", output=LEAN)
    got = corpus.matches(corpus.extract(html(spark, sf_dir), request))
    return got.select("page_id", F.col("index").alias("match_index"), F.col("metadata.inner_range.start").alias("inner_start"), F.col("metadata.inner_range.end").alias("inner_end"), "value")


def slice_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = Request(start="<a ", end="</a>", retention="include-both", selection=ALL, value="attribute", attribute="href", output=LEAN)
    return _values(spark, sf_dir, request, "href")


def slice_splits_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices that begin inside a tag are told so."""
    request = Request(start='<a href="', end='">', selection=Selection("first"), value="selected-html", output=LEAN)
    got = corpus.extract(html(spark, sf_dir), request)
    warned = corpus.diagnostics(got).where("code = 'SLICE_SPLITS_MARKUP'").select("page_id", "code", "message")
    return warned


def rendered_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article as text (no SQL equivalent)."""
    return _values(spark, sf_dir, Request(selector="article", output=LEAN_RENDERED), "text")


def rendered_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with links as text: a selected list of plain links has one line for each."""
    return _values(spark, sf_dir, Request(selector="nav > ul", output=LEAN_RENDERED), "text")


def sealed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest-sealed results of one plan (no SQL equivalent)."""
    plan = {
        "interop_profile": "leafmill-v1", "schema_name": "leafmill.plan", "schema_version": 8, "strategy": {"kind": "css_selector", "selector": "article > h1"}, "selection": {"mode": "single"},
        "output": {"kind": "plain_text"}, "rendering": {"whitespace": "normalize", "rewrite_urls": True},
    }
    docs = pages(spark, sf_dir).select("page_id", "url", "html")
    return corpus.run_plan(docs, plan, base_url="url").select("page_id", "is_result", "digest_sha256")


def _plan(selector: str, selection: dict) -> dict:
    return {
        "interop_profile": "leafmill-v1", "schema_name": "leafmill.plan", "schema_version": 8, "strategy": {"kind": "css_selector", "selector": selector}, "selection": selection,
        "output": {"kind": "text"}, "rendering": {"whitespace": "normalize", "rewrite_urls": False},
    }


def sealed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed headings, those of odd pages damaged afterwards: what the checks say of each."""
    got = corpus.run_plan(html(spark, sf_dir), _plan("article > h1", {"mode": "single"}))
    damaged = F.regexp_replace("document", '"candidate_count":1', '"candidate_count":2')
    return sealed.checked(got.withColumn("document", F.when(F.col("page_id") % 2 == 1, damaged).otherwise(F.col("document")))).select("page_id", "is_result", "complaint")


def sealed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each code occurs where every page is asked for its sixth link."""
    return sealed.code_histogram(corpus.run_plan(html(spark, sf_dir), _plan("nav a", {"mode": "nth", "index": 6})))


def inspect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all pages (no SQL equivalent; counts that SQL can give are in inspect_counts)."""
    docs = pages(spark, sf_dir).select("page_id", "url", "html")
    got = corpus.inspect(docs, base_url="url")
    return got.select("page_id", "title", "element_count", "text_char_count", F.get("extraction_candidates", F.lit(0))["selector"].alias("extraction_selector"), F.get("reading_candidates", F.lit(0))["selector"].alias("reading_selector"), F.size("links").alias("n_links"))


def inspect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = corpus.inspect(html(spark, sf_dir), sample_limit=0)
    return got.select("page_id", "title", "root_tag", "link_count", "image_count", "form_count", "table_count", "script_count", "style_count")


def inspect_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings that inspection samples."""
    return corpus.inspect(html(spark, sf_dir)).select("page_id", F.inline("headings")).select("page_id", "level", "text", "path")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions asked in SQL."""
    sql.register(spark)
    html(spark, sf_dir).createOrReplaceTempView("leafmill_pages")
    return spark.sql("SELECT page_id, html_attr(html, 'nav a', 'href') AS href, s.index AS item, s.value FROM leafmill_pages, LATERAL html_slice(html, '<li>', '</li>') s")


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes (no SQL equivalent): counted by kind."""
    return corpus.parse_nodes(html(spark, sf_dir), paths=False).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _plain(column: str) -> str:
    """DuckDB: character references of the test pages replaced."""
    out = column
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


_LINKS = "SELECT page_id, url, i AS link_index, regexp_extract(h[i], 'href=\"([^\"]*)\"', 1) AS href, regexp_extract(h[i], '>([^<]*)$', 1) AS label FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*') AS h FROM pages))"
_ONE = "SELECT page_id, 1::BIGINT AS match_index, regexp_extract(html, '{}', 1) AS value FROM pages"
_PATH = "'html:nth-of-type(1) > body:nth-of-type(1) > "

ORACLES = {
    "select_nav_links": f"SELECT page_id, link_index AS match_index, href FROM ({_LINKS})",
    "select_nth_link": f"SELECT page_id, 1::BIGINT AS match_index, href FROM ({_LINKS}) WHERE link_index = 5",
    "select_attr_meta_charset": _ONE.format('<meta charset="([^"]*)">'),
    "select_style_inner_html": _ONE.format("<style>([^<]*)</style>"),
    "select_script_inner_html": _ONE.format("(?s)<script>(.*?)</script>"),
    "select_item_outer_html": _ONE.format("(<li>.*?</li>)"),
    "select_first_heading": "SELECT page_id, 1::BIGINT AS match_index, replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '\"') AS value FROM pages",
    "select_missing_attr_diag": f"SELECT page_id, 'MISSING_ATTRIBUTE' AS code, 'Matched node is missing attribute \"title\".' AS message FROM ({_LINKS}) WHERE link_index = 1",
    "invalid_selector_diag": "SELECT page_id, 'error' AS level, 'INVALID_SELECTOR' AS code, 'CSS selector is invalid.' AS message, '{\"selector_parse\":{\"column_utf16\":2,\"line\":1,\"parse_error_class\":\"unsupported_pseudo_class_or_element\"}}' AS details FROM pages",
    "doc_title": f"SELECT page_id, trim(regexp_replace({_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS document_title FROM pages",
    "link_resolve": f"SELECT page_id, link_index, href, regexp_extract(url, '^https?://[^/?#]*') || array_to_string(list_transform(string_split(href, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE url_encode(c) END), '') AS resolved FROM ({_LINKS})",
    "link_labels": f"SELECT page_id, link_index, trim(regexp_replace({_plain('label')}, '\\s+', ' ', 'g')) AS label FROM ({_LINKS})",
    "class_histogram": "SELECT page_id, c AS class, count(*) AS count FROM (SELECT page_id, unnest(regexp_extract_all(html, ' class=\"([^\"]*)\"', 1)) AS c FROM pages) GROUP BY ALL",
    "relational_nav_links": f"SELECT page_id, ((link_index + 1) // 2)::BIGINT AS candidate_index, ((max(link_index) OVER (PARTITION BY page_id) + 1) // 2)::BIGINT AS candidate_count, {_PATH}nav:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(' || link_index || ') > a:nth-of-type(1)' AS path FROM ({_LINKS}) WHERE link_index % 2 = 1",
    "relational_siblings": f"SELECT page_id, c AS candidate_index, 3::BIGINT AS candidate_count, p AS path FROM pages, (VALUES (1::BIGINT, 'html:nth-of-type(1) > head:nth-of-type(1) > title:nth-of-type(1)'), (2, {_PATH}article:nth-of-type(1)'), (3, {_PATH}article:nth-of-type(1) > h1:nth-of-type(1)')) v(c, p)",
    "relational_not_has": f"SELECT page_id, 1::BIGINT AS candidate_index, 1::BIGINT AS candidate_count, {_PATH}div:nth-of-type(1)' AS path FROM pages",
    "multi_select": "SELECT page_id, 'heading' AS plan, replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '\"') AS value FROM pages UNION ALL SELECT page_id, 'charset', regexp_extract(html, '<meta charset=\"([^\"]*)\">', 1) FROM pages UNION ALL SELECT page_id, 'ad', regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) FROM pages",
    "slice_attribute": f"SELECT page_id, link_index AS match_index, href FROM ({_LINKS})",
    "slice_splits_markup": "SELECT page_id, 'SLICE_SPLITS_MARKUP' AS code, 'Selected slice boundaries appear to cut through HTML markup near ' || (s + 9) || '..' || (s + 9 + strlen(h)) || '. Choose stricter boundaries or include the matched tags when the markup should remain intact.' AS message FROM (SELECT page_id, strlen(split_part(html, '<a href=\"', 1)) AS s, regexp_extract(html, '<a href=\"(.*?)\">', 1) AS h FROM pages)",
    "inspect_counts": f"SELECT page_id, trim(regexp_replace({_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title, 'html' AS root_tag, len(regexp_extract_all(html, '<a '))::BIGINT AS link_count, 0::BIGINT AS image_count, 0::BIGINT AS form_count, 0::BIGINT AS table_count, 1::BIGINT AS script_count, 1::BIGINT AS style_count FROM pages",
    "inspect_headings": f"SELECT page_id, 1 AS level, trim(regexp_replace({_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '\\s+', ' ', 'g')) AS text, {_PATH}article:nth-of-type(1) > h1:nth-of-type(1)' AS path FROM pages",
    "sql_functions": f"SELECT l.page_id, l.href, i AS item, h[i][5:-6] AS value FROM (SELECT page_id, href FROM ({_LINKS}) WHERE link_index = 1) l JOIN (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS h FROM pages)) m USING (page_id)",
    "sealed_checks": "SELECT page_id, true AS is_result, CASE WHEN page_id % 2 = 1 THEN 'digest_mismatch' END AS complaint FROM pages",
    "sealed_codes": "SELECT code, count(*) AS count FROM pages, (VALUES ('no_match'), ('MATCH_INDEX_OUT_OF_RANGE')) t(code) WHERE len(regexp_extract_all(html, '<a href=')) < 6 GROUP BY code",
    "rendered_nav": f"SELECT page_id, 1::BIGINT AS match_index, string_agg('- ' || {_plain('label')} || ' [' || {_plain('href')} || ']', chr(10) ORDER BY link_index) AS text FROM ({_LINKS}) GROUP BY page_id",
}

from .slice_queries import ORACLES as _SLICES  # noqa: E402

ORACLES["slice_regex_exact"] = _SLICES["slice_regex_ci"]

QUERIES = {
    f.__name__: f
    for f in (
        select_nav_links, select_nth_link, select_attr_meta_charset, select_style_inner_html, select_script_inner_html, select_item_outer_html, select_first_heading, select_missing_attr_diag,
        invalid_selector_diag, doc_title, link_resolve, link_labels, tag_histogram, class_histogram, corpus_tags, relational_nav_links, relational_siblings, relational_not_has, multi_select,
        slice_regex_exact, slice_attribute, slice_splits_markup, rendered_article, rendered_nav, sealed_results, sealed_checks, sealed_codes, node_table, inspect_pages, inspect_counts, inspect_headings, sql_functions,
    )
}
