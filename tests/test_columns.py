"""Column forms against the row functions they stand for."""

import json

from pyspark.sql import functions as F

from leafmill import cli
from leafmill.functions import urls
from leafmill.functions.extract import Output, Request, byte_size, looks_like_document
from leafmill.functions.interop import Sealed
from leafmill.operators import columns, corpus, schemas
from leafmill.sources import readers


def test_columns_equal_row_functions(spark):
    sizes = [0, 1, 2, 1023, 1024, 1025, 1075, 1076, 10_189, 2**20 - 1, 2**20, 2**20 + 60_000, 5 * 2**20, 52_428_800, 2**30, 3 * 2**30 + 2**29, 2**45]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", columns.byte_size(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: byte_size(n) for n in sizes}
    texts = ["<!DOCTYPE html>", " \n<HTML lang=x>", "  <html>", "x<html>", "", "<htm", "<!doctypo", "\x1c<!docType"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", columns.looks_like_document(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == {t: looks_like_document(t) for t in texts}
    links = ["https://a.b/c?x=1#f", "HTTP://A.b:80", "http://a.b:8080/?#", "https://a.b:443/x", "https://a.b?", "https://u@a.b/", "https://u:p@a.b/", "ftp://a/", "", "a.b/c", "https://a.b/c#f?x"]
    got = spark.createDataFrame([(u,) for u in links], "u string").select("u", columns.redacted(F.col("u")).alias("r")).collect()
    assert {r.u: r.r for r in got} == {u: urls.redacted(u) for u in links}


def test_json_schemas_describe_what_is_read_and_written(spark, capsys):
    assert {n for n, _, _ in schemas.SCHEMAS} == schemas.READ.keys() | schemas.WRITTEN.keys()
    plan, result = schemas.json_schema("plan"), schemas.json_schema("result")
    assert plan["additionalProperties"] is False and plan["properties"]["rendering"]["properties"]["rewrite_urls"] == {"type": ["boolean", "null"]} and "additionalProperties" not in result
    assert schemas.json_schema("extraction_result")["properties"]["matches"]["items"]["properties"]["index"] == {"type": ["integer", "null"]}
    sealed = Sealed({"interop_profile": "p", "schema_name": "p.plan", "schema_version": 8, "strategy": {"kind": "css_selector", "selector": "p"}, "output": {"kind": "text"}})
    good, bad = sealed.run("<p>x"), sealed.run("")
    assert good.keys() <= result["properties"].keys() and bad.keys() <= schemas.json_schema("error")["properties"].keys()
    assert good["selected_matches"][0].keys() <= result["properties"]["selected_matches"]["items"]["properties"].keys()
    known = schemas.json_schema("extraction_definition")["properties"]
    for request in (Request(selector="p", value="attribute", attribute="x"), Request(start="a", end="b", regex=True, flags="i", retention="include-both", max_bytes=9, output=Output("rendered", preview_chars=9))):
        definition = readers.definition_of(request)
        assert definition.keys() <= known.keys() and definition["request"].keys() <= known["request"]["properties"].keys()
        for part in ("extraction", "output"):
            assert definition["request"].get(part, {}).keys() <= known["request"]["properties"][part]["properties"].keys()
    assert cli.main(["schema", "--name", "plan", "--output", "document"]) == 0 and json.loads(capsys.readouterr().out) == plan


def test_plans_hold_large_texts_back(spark):
    plan = {
        "interop_profile": "p-v1", "schema_name": "p.plan", "schema_version": 8, "strategy": {"kind": "css_selector", "selector": "p"}, "selection": {"mode": "first"},
        "output": {"kind": "text"}, "rendering": {"whitespace": "normalize", "rewrite_urls": False},
    }
    docs = spark.createDataFrame([(1, "<p>x"), (2, "<p>" + "y" * 100), (3, None)], "id int, html string")
    got = {r.id: (r.is_result, r.document) for r in corpus.run_plan(docs, plan, max_bytes=50).collect()}
    assert got[1][0] and not got[2][0] and "exceeds 50 bytes limit" in got[2][1] and "SOURCE_LOAD_FAILED" in got[2][1] and not got[3][0]
