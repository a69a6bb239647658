"""Bundles: four files a document, all or none, never over what is there."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leafmill.functions.extract import Request, Selection
from leafmill.operators import corpus
from leafmill.sources import sinks

PAGES = [("https://a.example/x?y", '<html lang=" de "><p lang=fr>eins<b>!</b></p><p>zwei</p>'), ("https://b.example/", "<title>B & b</title><p>one</p>"), ("c/d.html", "<p>x <i lang=it>y</i>"), ("none", "<i>no match</i>")]


@pytest.fixture
def results(spark):
    docs = spark.createDataFrame(PAGES, "name string, html string").withColumn("base", F.when(F.col("name").startswith("http"), F.col("name")))
    return corpus.extract(docs, Request(selector="p", selection=Selection("all")), base_url="base")


def found(path):
    return {os.path.join(d, f).split("/", path.count("/") + 2)[-1]: open(os.path.join(d, f), encoding="utf-8").read() for d, _, files in os.walk(path) for f in files}


def test_four_files_a_document(results, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_bundles(results, path, "name")
    files = found(path)
    assert len(files) == 16 and {k.split("/")[-1] for k in files} == set(sinks.FILES)
    page = next(v for k, v in files.items() if k.startswith("https%3A%2F%2Fb.example") and k.endswith("selection.html"))
    assert "<title>B &amp; b</title>" in page and '<section data-match-index="1">\n' in page
    first = {k.split("/")[-1]: v for k, v in files.items() if k.startswith("https%3A%2F%2Fa.example")}
    assert '<html lang="fr">' in first["selection.html"] and first["selection.txt"] == "eins!\n\nzwei" and len(json.loads(first["selection.json"])) == 2
    assert json.loads(first["report.json"])["match_count"] == 2
    with pytest.raises(Exception, match="it is there already"):
        sinks.write_bundles(results, path, "name")
    assert found(path) == files
    sinks.write_bundles(results.where("name = 'none'"), path, "name", overwrite=True)
    assert len(found(path)) == 4


def test_a_failed_task_leaves_nothing(results, tmp_path):
    path = str(tmp_path / "out")
    os.makedirs(path)
    bad = results.withColumn("name", F.when(F.col("name") == "none", F.raise_error(F.lit("killed"))).otherwise(F.col("name")))
    with pytest.raises(Exception):
        sinks.write_bundles(bad, path, "name")
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="Two bundles"):
        sinks.write_bundles(results.withColumn("name", F.lit("same")), path, "name")
    assert os.listdir(path) == []


def test_titles_and_pages(results, spark):
    shown = {r.name: (r.t, r.l) for r in results.select("name", sinks.title_of(results).alias("t"), sinks.language_of(results).alias("l")).collect()}
    assert shown["https://b.example/"] == ("B & b", None) and shown["c/d.html"][1] == "it" and shown["https://a.example/x?y"][1] == "fr"
    source = F.struct(F.col("name").alias("value"))
    named = results.select("name", source.alias("source"), F.lit(" ").alias("document_title"))
    assert {r.name: r.t for r in named.select("name", sinks.title_of(named).alias("t")).collect()} == {"https://a.example/x?y": "a.example", "https://b.example/": "b.example", "c/d.html": "d", "none": "none"}
    whole = corpus.extract(spark.createDataFrame([(1, "<!DOCTYPE html><html lang=en><p>x</p></html>")], "id int, html string"), Request(selector="html", value="outer-html"))
    assert whole.select(sinks.html_of(whole).alias("h")).first().h.startswith('<html lang="en">')
