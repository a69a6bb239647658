"""Changes of documents in a stream: a return to earlier content counts, a restart repeats nothing."""

import json
import os
from datetime import timedelta

import pytest

from leafmill.functions.extract import Request
from leafmill.streaming import streams


@pytest.fixture
def watch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def put(number, rows):
        file = tmp_path / "in" / f"{number:03d}.json"
        file.write_text("\n".join(json.dumps({"url": u, "t": t, "html": h}) for u, t, h in rows))
        os.utime(file, (1_767_000_000 + number, 1_767_000_000 + number))  # read in this order

    def run():
        streams.with_state(spark)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        docs = spark.readStream.schema("url string, t timestamp, html string").option("maxFilesPerTrigger", 1).json(source)
        got = streams.changes(streams.extract_stream(docs, Request(selector="p")), "url", "t", "1 hour", timedelta(days=1))
        query = got.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.schema("url string, time timestamp, digest string, previous string, matches string").parquet(out).collect()
        return sorted((r.url, str(r.time)[11:16], json.loads(r.matches)[0]["text"], r.previous is None) for r in rows)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield put, run
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_back_to_earlier_content(watch):
    put, run = watch
    at = lambda m: f"2026-01-01T10:{m:02d}:00"
    put(1, [("u", at(1), "<p>A"), ("v", at(1), "<p>V"), (None, at(1), "<p>N")])
    put(2, [("u", at(2), "<p>B"), ("v", at(2), "<p>V")])
    put(3, [("u", at(3), "<p>A"), ("u", at(1), "<p>late")])
    first = run()
    assert first == [("u", "10:01", "A", True), ("u", "10:02", "B", False), ("u", "10:03", "A", False), ("v", "10:01", "V", True)]
    assert run() == first  # a restart with nothing new
    put(4, [("u", at(5), "<p>C"), ("u", at(4), "<p>A"), ("v", at(5), "<p>V")])
    assert run() == sorted([*first, ("u", "10:05", "C", False)])
