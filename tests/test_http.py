"""Pages from a local server: fallback, refusal, limits, repeats and the plan of the reader."""

import socket
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from leafmill.sources.http import Fetch, PageReader, broken, by_host, fetch, fetch_all, read_pages

PAGE = "<title>Grüße</title>".encode()


class Pages(BaseHTTPRequestHandler):
    asked: Counter = Counter()

    def answer(self, body: bool) -> None:
        path = self.path.split("?")[0]
        Pages.asked[self.command, path] += 1
        if path == "/resets" and (self.command == "HEAD" or Pages.asked["GET", path] < 3):
            self.close_connection = True
            return self.connection.shutdown(socket.SHUT_RDWR)
        if path == "/moved":
            self.send_response(302)
            self.send_header("location", "/page")
            return self.end_headers()
        status = {"/nohead": 405 if self.command == "HEAD" else 200, "/gone": 410}.get(path, 200)
        raw = b"\xff\xfe" if path == "/latin" else PAGE
        self.send_response(status)
        self.send_header("content-type", "image/png" if path == "/image" else "text/html; charset=utf-8")
        if path != "/endless":
            self.send_header("content-length", str(10**9 if path == "/big" else len(raw)))
        self.end_headers()
        if body:
            self.wfile.write(raw * (1000 if path == "/endless" else 1))

    def do_GET(self):
        self.answer(True)

    def do_HEAD(self):
        self.answer(False)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def steps(got):
    return [(s["action"], s["outcome"], s["status"]) for s in got["steps"]]


def test_preflight_and_fallback(site):
    good = fetch(f"{site}/page?q=1#x")
    assert good["html"] == PAGE.decode() and good["shown_url"] == f"{site}/page?[redacted]" and steps(good) == [("head", "succeeded", 200), ("get", "succeeded", 200)]
    assert steps(fetch(f"{site}/nohead")) == [("head", "fallback", 405), ("get", "succeeded", 200)]
    assert steps(fetch(f"{site}/page", head_first=False)) == [("head", "skipped", None), ("get", "succeeded", 200)]
    assert fetch(f"{site}/moved")["html"] == PAGE.decode()
    gone = fetch(f"{site}/gone")
    assert steps(gone) == [("head", "fallback", 410), ("get", "failed", 410)] and gone["load_error"] == f"GET {site}/gone returned unexpected status 410."


def test_refused_by_preflight(site):
    before = Pages.asked["GET", "/image"]
    assert fetch(f"{site}/image")["load_error"] == f"HEAD {site}/image reported non-HTML content type image/png."
    assert fetch(f"{site}/big")["load_error"] == "HEAD response exceeds 50 MiB limit."
    assert Pages.asked["GET", "/image"] == before and Pages.asked["GET", "/big"] == 0
    assert fetch(f"{site}/latin")["load_error"] == f"{site}/latin is not valid UTF-8"
    assert fetch(f"{site}/endless", max_bytes=4096)["load_error"] == f"{site}/endless exceeds 4 KiB limit."


def test_only_broken_connections_fall_back_or_repeat(site):
    Pages.asked.clear()
    got = fetch(f"{site}/resets")
    assert [s[:2] for s in steps(got)] == [("head", "fallback"), ("get", "failed")] and got["html"] is None
    Pages.asked.clear()
    again = fetch(f"{site}/resets", how=Fetch(retries=3))
    assert again["html"] == PAGE.decode() and [s[:2] for s in steps(again)].count(("get", "retried")) == 2
    with socket.socket() as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    refused = fetch(f"http://127.0.0.1:{port}/")
    assert steps(refused) == [("head", "failed", None)] and "Could not preflight" in refused["load_error"]
    assert not broken(TimeoutError()) and not broken(ConnectionRefusedError()) and broken(ConnectionResetError()) and broken(EOFError())
    assert "credentials" in fetch("http://u:p@127.0.0.1/")["load_error"]


def test_trust(tmp_path):
    (tmp_path / "none.pem").write_text("nothing")
    assert "does not contain any PEM certificates" in fetch("https://127.0.0.1:9/", how=Fetch(trust=str(tmp_path / "none.pem")))["load_error"]
    assert "Could not read custom CA bundle" in fetch("https://127.0.0.1:9/", how=Fetch(trust=str(tmp_path / "no.pem")))["load_error"]


def test_partitions_by_host():
    some = [f"http://big.example/{i}" for i in range(25)] + [f"http://h{i}.example/" for i in range(8)] + ["http://big.example/0"]
    dealt = by_host(some, 10)
    assert sorted(u for p in dealt for u in p) == sorted(set(some)) and max(map(len, dealt)) <= 10 and len(dealt) == 4
    assert len(PageReader({"urls": "[]"}).partitions()) == 1


def test_data_source_and_table(spark, site):
    some = [f"{site}/page?{i}" for i in range(7)] + [f"{site}/gone", f"{site}/image"]
    got = read_pages(spark, some, perTask=3)
    assert got.rdd.getNumPartitions() == 3
    want = {u: (None if "?" not in u else PAGE.decode()) for u in some}
    assert {r.url: r.html for r in got.collect()} == want and got.where("load_error IS NOT NULL").count() == 2
    table = spark.createDataFrame([(u,) for u in [*some, some[0], None]], "link string")
    assert {r.url: r.html for r in fetch_all(table, "link", partitions=2).collect()} == want
    assert read_pages(spark, []).count() == 0
