"""Registered queries over raw source: slices, byte ranges and predicates with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns, corpus
from ..operators import native_slices as ns
from ..operators import selection as sel


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "html")


#: DuckDB: slices of pages between two patterns with byte ranges; documents with a dangling start left out.
def _oracle(a: str, b: str, select: str, where: str = "TRUE", table: str = "pages", key: str = "page_id", text: str = "html") -> str:
    whole = f"(?s:{a}.*?{b})"
    return f"""
WITH d AS (SELECT {key} AS k, coalesce({text}, '') AS t FROM {table}),
h AS (SELECT k, regexp_extract_all(t, '{whole}') AS hits, regexp_split_to_array(t, '{whole}') AS gaps FROM d),
g AS (SELECT * FROM h WHERE len(hits) > 0 AND NOT regexp_matches(gaps[len(gaps)], '{a}')),
u AS (SELECT k, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM g),
p AS (SELECT k, i, len(hits) AS n, hits[i] AS hit, strlen(hits[i]) AS size, strlen(regexp_extract(hits[i], '^(?:{a})')) AS a, strlen(regexp_extract(hits[i], '(?:{b})$')) AS b,
             sum(strlen(gaps[i])) OVER w + coalesce(sum(strlen(hits[i])) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
      FROM u WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT {select} FROM p WHERE {where}"""


_VALUE = "hit[length(regexp_extract(hit, '^(?:{a})')) + 1 : length(hit) - length(regexp_extract(hit, '(?:{b})$'))]"


def slice_literal_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.slice_rows(html(spark, sf_dir), "<p>", "</p>").select("page_id", F.col("index").alias("match_index"), "inner_start", "inner_end", "value")


def slice_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.slice_rows(html(spark, sf_dir), "<li>", "</li>").select("page_id", F.col("index").alias("match_index"), "outer_start", "inner_start", "inner_end", "outer_end")


def slice_include_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ns.slice_rows(html(spark, sf_dir), "<h1>", "</h1>")
    return found.select("page_id", F.concat(F.lit("<h1>"), "value", F.lit("</h1>")).alias("value"), F.col("outer_start").alias("selected_start"), F.col("outer_end").alias("selected_end"))


def slice_regex_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ns.slice_rows(html(spark, sf_dir), "<A HREF=[^>]*>", "</A>", regex=True, flags="i")
    return found.select("page_id", F.col("index").alias("match_index"), "inner_start", "inner_end", "value")


def slice_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.slice_rows(html(spark, sf_dir), "<li>", "</li>").where("index = 1").select("page_id", "value")


def slice_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.slice_rows(html(spark, sf_dir), "<li>", "</li>").where("index = 5").select("page_id", "value")


def slice_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sel.selected(ns.slice_rows(html(spark, sf_dir), "<footer>", "</footer>"), ["page_id"], sel.Selection("single"), "index")
    return found.select("page_id", "value")


def slice_no_match_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.slice_diagnostics(html(spark, sf_dir), "<video", "</video>")


def slice_dangling_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns.slice_diagnostics(html(spark, sf_dir), "<p>", "</p>")


def slice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries over plain text: the first word after each sentence end of conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return ns.slice_rows(turns, ". ", " ", source="text").select("conv_id", "turn", F.col("index").alias("match_index"), "inner_start", "value")


def selection_diags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each selection mode says about the list items of each page."""
    docs = html(spark, sf_dir)
    items = ns.slice_rows(docs, "<li>", "</li>").select("page_id")
    out = None
    for mode, index in (("single", 1), ("first", 1), ("nth", 5), ("nth", 9)):
        one = sel.selection_diagnostics(docs, items, ["page_id"], sel.Selection(mode, index)).withColumn("mode", F.lit(f"{mode}{index}"))
        out = one if out is None else out.unionByName(one)
    return out


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = html(spark, sf_dir)
    return docs.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("candidate_count"))


def byte_limit_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over a size limit, told before any parsing."""
    return corpus.oversized(html(spark, sf_dir).select("page_id", "html"), max_bytes=4096)


def looks_like_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", columns.looks_like_document(F.col("html")).alias("is_document"))


def format_byte_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", columns.byte_size(F.octet_length("html")).alias("shown"))


def sha256_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


def url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", columns.redacted(F.col("url")).alias("shown"))


def lang_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


def pages_by_host_and_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus roll-up: pages and bytes by host and language with subtotals."""
    rows = pages(spark, sf_dir).select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.octet_length("html").cast("long").alias("size"))
    out = rows.rollup("lang", "host").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.grouping_id().cast("long").alias("level"))
    return out


def nav_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that more than one page's navigation shares, with how many pages do."""
    items = ns.slice_rows(html(spark, sf_dir), '<li><a href="', "</a></li>").select("page_id", F.regexp_extract("value", ">(.*)$", 1).alias("label")).distinct()
    return items.groupBy("label").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page")).where("n_pages > 1")


def corpus_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ns.slice_rows(html(spark, sf_dir), '<li><a href="', "</a></li>").select(F.regexp_extract("value", ">(.*)$", 1).alias("label"))
    return items.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(20)


def docs_without_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join: pages without any quotation mark reference; left join: whether they also have a dangling paragraph."""
    docs = html(spark, sf_dir)
    breaks = docs.where(F.col("html").contains("&quot;")).select("page_id")
    dangling = ns.slice_diagnostics(docs, "<p>", "</p>").select("page_id")
    return docs.select("page_id").join(breaks, "page_id", "left_anti").join(dangling.withColumn("dangling", F.lit(True)), "page_id", "left").select("page_id", F.coalesce("dangling", F.lit(False)).alias("dangling"))


def _li(select: str, where: str = "TRUE") -> str:
    return _oracle("<li>", "</li>", select, where)


_SELECTION = """
WITH c AS (SELECT page_id, CASE WHEN regexp_matches(split_part(html, '</li>', -1), '<li>') THEN 0 ELSE len(regexp_extract_all(html, '<li>')) END AS n FROM pages)
SELECT page_id, 'error' AS level, CASE n WHEN 0 THEN 'NO_MATCH' ELSE 'AMBIGUOUS_MATCH' END AS code,
       CASE n WHEN 0 THEN 'No matches were found for the extraction request.' ELSE 'Exact-one selection requires exactly one candidate, but ' || n || ' were found.' END AS message, 'single1' AS mode
FROM c WHERE n <> 1
UNION ALL SELECT page_id, CASE n WHEN 0 THEN 'error' ELSE 'warning' END, CASE n WHEN 0 THEN 'NO_MATCH' ELSE 'MULTIPLE_MATCHES' END,
       CASE n WHEN 0 THEN 'No matches were found for the extraction request.' ELSE 'Matched ' || n || ' candidates while using match type first.' END, 'first1' FROM c WHERE n <> 1
UNION ALL SELECT page_id, 'error', CASE n WHEN 0 THEN 'NO_MATCH' ELSE 'MATCH_INDEX_OUT_OF_RANGE' END,
       CASE n WHEN 0 THEN 'No matches were found for the extraction request.' ELSE 'Match index ' || k || ' is out of range for ' || n || ' candidates.' END, 'nth' || k FROM c, (VALUES (5), (9)) v(k) WHERE n < k"""

_NAV = "SELECT page_id, regexp_extract(h, '>([^<]*)</a></li>$', 1) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li><a href=\".*?</a></li>')) AS h FROM pages)"

ORACLES = {
    "slice_literal_all": _oracle("<p>", "</p>", "k AS page_id, i AS match_index, (o + a)::BIGINT AS inner_start, (o + size - b)::BIGINT AS inner_end, hit[4:-5] AS value"),
    "slice_byte_ranges": _li("k AS page_id, i AS match_index, o::BIGINT AS outer_start, (o + a)::BIGINT AS inner_start, (o + size - b)::BIGINT AS inner_end, (o + size)::BIGINT AS outer_end"),
    "slice_include_both": _oracle("<h1>", "</h1>", "k AS page_id, hit AS value, o::BIGINT AS selected_start, (o + size)::BIGINT AS selected_end"),
    "slice_regex_ci": _oracle("(?i:<A HREF=[^>]*>)", "(?i:</A>)", "k AS page_id, i AS match_index, (o + a)::BIGINT AS inner_start, (o + size - b)::BIGINT AS inner_end, regexp_extract(hit, '(?s)^<[^>]*>(.*)</a>$', 1) AS value"),
    "slice_first": _li("k AS page_id, hit[5:-6] AS value", "i = 1"),
    "slice_nth": _li("k AS page_id, hit[5:-6] AS value", "i = 5"),
    "slice_single": _oracle("<footer>", "</footer>", "k AS page_id, hit[9:-10] AS value", "n = 1"),
    "slice_no_match_diag": "SELECT page_id, 'NO_MATCH' AS code, 'Start pattern was not found: <video' AS message FROM pages WHERE NOT contains(html, '<video')",
    "slice_dangling_diag": """
WITH g AS (SELECT page_id, regexp_split_to_array(html, '(?s)<p>.*?</p>') AS gaps, html FROM pages), r AS (SELECT page_id, gaps[len(gaps)] AS rest, html, len(gaps) AS n FROM g)
SELECT page_id, 'NO_MATCH' AS code, CASE WHEN contains(rest, '<p>') THEN 'End pattern was not found after offset ' || (strlen(html) - strlen(rest) + strlen(split_part(rest, '<p>', 1))) || ': </p>' ELSE 'Start pattern was not found: <p>' END AS message
FROM r WHERE contains(rest, '<p>') OR n = 1""",
    "slice_documents": """
WITH d AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
h AS (SELECT conv_id, turn, regexp_extract_all(t, '(?s)[.] .*? ') AS hits, regexp_split_to_array(t, '(?s)[.] .*? ') AS gaps FROM d),
g AS (SELECT * FROM h WHERE len(hits) > 0 AND NOT contains(gaps[len(gaps)], '. ')),
u AS (SELECT conv_id, turn, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM g)
SELECT conv_id, turn, i AS match_index, (2 + list_sum(list_transform(gaps[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: strlen(x))), 0))::BIGINT AS inner_start, hits[i][3:-2] AS value FROM u""",
    "selection_diags": _SELECTION,
    "candidate_counts": "SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS candidate_count FROM pages",
    "byte_limit_diag": "SELECT page_id, 'SOURCE_LOAD_FAILED' AS code, 'Preloaded source exceeds 4 KiB limit.' AS message, strlen(html)::BIGINT AS bytes_read FROM pages WHERE strlen(html) > 4096",
    "looks_like_document": "SELECT page_id, regexp_matches(lower(ltrim(html)), '^(<!doctype|<html)') AS is_document FROM pages",
    "format_byte_size": """
WITH s AS (SELECT page_id, strlen(html) AS n, (strlen(html) * 10 + 512) // 1024 AS t FROM pages)
SELECT page_id, CASE WHEN n >= 1024 THEN (t // 10)::VARCHAR || CASE WHEN t % 10 > 0 THEN '.' || (t % 10)::VARCHAR ELSE '' END || ' KiB' WHEN n = 1 THEN '1 byte' ELSE n || ' bytes' END AS shown FROM s""",
    "sha256_identity": "SELECT page_id, sha256(html) AS digest FROM pages",
    "url_redact": "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '?[redacted]') AS shown FROM pages",
    "lang_attr": "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages",
    "pages_by_host_and_lang": """
WITH r AS (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, strlen(html) AS size FROM pages)
SELECT lang, host, count(*) AS n, sum(size)::BIGINT AS bytes, grouping(lang, host)::BIGINT AS level FROM r GROUP BY ROLLUP (lang, host)""",
    "nav_label_pairs": f"SELECT label, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page FROM ({_NAV}) GROUP BY label HAVING count(DISTINCT page_id) > 1",
    "corpus_top_labels": f"SELECT label, count(*) AS n FROM ({_NAV}) GROUP BY label ORDER BY n DESC, label LIMIT 20",
    "docs_without_quotes": """
SELECT page_id, (contains(list_last(regexp_split_to_array(html, '(?s)<p>.*?</p>')), '<p>') OR NOT regexp_matches(html, '(?s)<p>.*?</p>')) AS dangling FROM pages WHERE NOT contains(html, '&quot;')""",
}

QUERIES = {
    f.__name__: f
    for f in (
        slice_literal_all, slice_byte_ranges, slice_include_both, slice_regex_ci, slice_first, slice_nth, slice_single, slice_no_match_diag, slice_dangling_diag, slice_documents, selection_diags,
        candidate_counts, byte_limit_diag, looks_like_document, format_byte_size, sha256_identity, url_redact, lang_attr, pages_by_host_and_lang, nav_label_pairs, corpus_top_labels, docs_without_quotes,
    )
}
