"""Operators on Spark: against each other, against DuckDB, on streams and files."""

import json

import pytest

from leafmill import cli
from leafmill.functions.extract import Output, Request, Selection
from leafmill.operators import corpus, native_slices, relational, schemas
from leafmill.plans import registry
from leafmill.sources import readers, sinks
from leafmill.streaming import streams

duckdb = pytest.importorskip("duckdb")
ALL = Selection("all")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_sql(spark, sf_dir, db, name):
    got = registry.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    mine = sorted(tuple(str(r[c]) for c in cols) for r in got.collect())
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert mine == sorted(tuple(str(v) for v in r) for r in want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).collect()


SELECTORS = ["p", "nav > ul li:nth-child(2n+1) a", "article p + p", "h1 ~ p", "body :not(li):not(a)", "p:has(b)", "nav:has(> ul > li:last-child)", "li:is(:first-child, :last-child)", '[class~="ad"], a[href$="a"], meta[charset="UTF-8"]', "p:only-of-type, b:empty", "div *", "|p"]


@pytest.mark.parametrize("selector", SELECTORS)
def test_relational_equals_tree(spark, sf_dir, selector):
    docs = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").where("page_id < 12")
    nodes = corpus.parse_nodes(docs)
    mine = sorted((r.page_id, r.path) for r in relational.select(nodes, selector, ["page_id"]).collect())
    paths = corpus.matches(corpus.extract(docs, Request(selector=selector, selection=ALL, value="inner-html", output=Output(include_html=False, include_text=False))))
    assert mine == sorted((r.page_id, r.path) for r in paths.collect())


def test_intervals_nest(spark):
    rows = corpus.parse_nodes(spark.createDataFrame([(1, "<table>a<tr>b<td>c"), (2, None), (3, "")], "id int, html string")).collect()
    by = {(r.id, r.node_id): r for r in rows}
    assert all(by[r.id, r.parent_id].pre < r.pre < r.post < by[r.id, r.parent_id].post for r in rows if r.parent_id is not None)
    assert {r.id for r in rows} == {1, 2, 3}


def test_invalid_plans_are_data(spark):
    docs = spark.createDataFrame([(1, "<p>x"), (2, None)], "id int, html string")
    got = corpus.diagnostics(corpus.extract(docs, Request(selector="p::x"))).collect()
    assert [(r.id, r.code) for r in sorted(got)] == [(1, "INVALID_SELECTOR"), (2, "INVALID_SELECTOR")]
    plan = corpus.extract(docs, Request(selector="p::x"))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    found = native_slices.slice_rows(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "<p>", "</p>")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in found._jdf.queryExecution().toString().replace("\n", "")


def test_files_sinks_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<title>A & b</title><p>hi</p>")
    (tmp_path / "in" / "b.html").write_bytes(b"\xff<p>")
    (tmp_path / "in" / "c.html").write_text("<p>" + "x" * 100)
    files = readers.read_files(spark, str(tmp_path / "in"), max_bytes=64)
    assert sorted(r.message.split(".html ")[1] for r in readers.load_errors(files).collect()) == ["exceeds 64 bytes limit.", "is not valid UTF-8"]
    results = corpus.extract(files.where("load_error IS NULL").select("path", "html"), Request(selector="p"))
    bundle = sinks.bundles(results).first()
    assert "<title>A &amp; b</title>" in bundle.selection_html and bundle.selection_txt == "hi" and json.loads(bundle.selection_json)[0]["value"] == "hi"
    sinks.write_text(results, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "hi"
    streams.run_to_memory(streams.stream_files(spark, str(tmp_path / "in"), Request(selector="p")).select("path", "match_count"), "streamed")
    assert sorted(r.match_count for r in spark.table("streamed").collect()) == [1, 1]


def test_windows_over_streams(spark, tmp_path):
    rows = [("2026-01-01 00:01:00", "<p>a</p>"), ("2026-01-01 00:02:00", "<i>b</i>"), ("2026-01-01 01:00:00", "<p>c</p>")]
    spark.createDataFrame(rows, "t string, html string").selectExpr("cast(t as timestamp) t", "html").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("t timestamp, html string").parquet(str(tmp_path / "s"))
    results = streams.extract_stream(stream, Request(selector="p"))
    streams.run_to_memory(streams.windowed_counts(results, "t"), "windows", "complete")
    assert sorted((r.n_documents, r.n_matches, r.n_failed) for r in spark.table("windows").collect()) == [(1, 1, 0), (2, 1, 1)]


def test_definitions():
    request = Request(start="a", end="b", regex=True, flags="i", selection=Selection("nth", 2), value="attribute", attribute="x", retention="include-both", output=Output("normalize", preview_chars=9))
    assert readers.request_of(json.dumps(readers.definition_of(request))) == request
    for text, code in (("{", "definition_json_invalid"), ("{}", "definition_schema_unsupported"), ('{"schema_name": "x.extraction_definition", "schema_version": 4, "y": 1}', "definition_invalid")):
        with pytest.raises(readers.DefinitionError) as e:
            readers.request_of(text)
        assert e.value.code == code


def test_catalogs(spark):
    assert schemas.operation_catalog(spark).count() == 6 and schemas.schema_catalog(spark).where("owner = 'interop'").count() == 3


def test_command_line(tmp_path, capsys):
    page = tmp_path / "p.html"
    page.write_text("<title>T</title><article><a href=x>A</a><a href=y>B</a></article>")
    assert cli.main(["select", str(page), "--css", "article a", "--match", "all", "--value", "attribute", "--attribute", "href"]) == 0
    assert capsys.readouterr().out == "x\n\ny\n"
    assert cli.main(["select", str(page), "--css", "p"]) == cli.EXTRACTION and cli.main(["select", "/none", "--css", "p"]) == cli.SOURCE and cli.main(["select", str(page), "--css", "p::x"]) == cli.USAGE
    assert cli.main(["slice", str(page), "--from", "<a", "--to", "</a>", "--bundle", str(tmp_path / "b"), "--output", "none"]) == 0
    assert {f.name for f in (tmp_path / "b").iterdir()} == {"selection.html", "selection.txt", "selection.json", "report.json"}
    assert cli.main(["slice", str(page), "--from", "<a", "--to", "</a>", "--bundle", str(tmp_path / "b"), "--output", "none"]) == cli.OUTPUT
    capsys.readouterr()
    assert cli.main(["inspect", "select", str(page), "--css", "a", "--output", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["matches"][0]["value"]["tag_name"] == "a"
    assert cli.main(["catalog"]) == 0 and cli.main(["schema", "--name", "plan"]) == 0 and cli.main(["schema", "--schema-version", "1"]) == cli.USAGE
    assert cli.parse_size("1.5kib") == 1536
