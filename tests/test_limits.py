"""Size limits before Python, and paths of nodes."""

from leafmill.functions.dom import path_of
from leafmill.functions.extract import Request
from leafmill.functions.html_parser import parse
from leafmill.operators import corpus


def test_oversized_documents_stay_outside(spark):
    big = "<p>" + "é" * 200 + "</p><a href='/x'>l</a>"
    docs = spark.createDataFrame([(1, "<p>small</p><a href='/y'>k</a>", 1), (2, big, 2), (3, None, 3)], "id long, html string, _bytes int")
    size = len(big.encode())
    rows = {r.id: r for r in corpus.extract(docs, Request(selector="p", max_bytes=100)).collect()}
    assert rows[1].ok and rows[2].diagnostics[0].code == "SOURCE_LOAD_FAILED" and rows[2].source.bytes_read == size and rows[2]["_bytes"] == 2
    assert [(r.id, r.bytes_read) for r in corpus.oversized(docs, max_bytes=100).collect()] == [(2, size)]
    assert {r.id for r in corpus.parse_nodes(docs, max_bytes=100).collect()} == {1, 3}
    assert {r.id for r in corpus.links(docs, max_bytes=100).collect()} == {1}
    seen = {r.id: r for r in corpus.inspect(docs, max_bytes=100).collect()}
    assert seen[1].element_count == 5 and seen[2].element_count is None and seen[2].diagnostics[0].code == "SOURCE_LOAD_FAILED"


def test_paths_are_those_of_single_nodes():
    document = parse("<div><p>1<b>x</b></p><svg><p></p><a/></svg><p>2</p><template><i>t</i></template></div><table><tr><td>3<td>4</table>")
    by_number = {n.number: n for n in document.nodes}
    for row in corpus.node_rows(document):
        if row["kind"] == "element":
            assert row["path"] == path_of(by_number[row["node_id"]])
