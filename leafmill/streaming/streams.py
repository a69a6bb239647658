"""Streams of documents. The row functions are stateless, so they run on streams as they are;
roll-ups use watermarks, and changes are found by the latest digest of each document's result, kept as state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.extract import Request
from ..functions.shipping import ship
from ..operators import corpus
from ..sources.readers import read_files


def extract_stream(docs: DataFrame, request: Request, html: str = "html", base_url: str | None = None) -> DataFrame:
    return corpus.extract(docs, request, html, base_url)


def stream_files(spark: SparkSession, path: str, request: Request, glob: str = "*.htm*") -> DataFrame:
    """Results for files as they arrive in a folder."""
    files = read_files(spark, path, glob=glob, streaming=True).where("load_error IS NULL").select("path", "html")
    return corpus.extract(files, request)


def windowed_counts(results: DataFrame, time: str, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Documents, matches and failures per window of event time; later data are dropped."""
    own = results.withWatermark(time, late).groupBy(F.window(time, every))
    return own.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("match_count").alias("n_matches"), F.sum((~F.col("ok")).cast("long")).alias("n_failed")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_documents", "n_matches", "n_failed")


class Latest(StatefulProcessor):
    """The digest last seen of each key, with its time; forgotten when the watermark is ``keep_ms`` past it."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("latest", "at long, digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.held.get() if self.held.exists() else None
        at, digest = last if last is not None else (None, None)
        before = at
        for row in sorted(rows, key=lambda r: (r["at"], r["digest"])):  # the versions of one document in one batch
            if at is not None and row["at"] < at:
                continue  # older than what is known
            if row["digest"] != digest:
                yield Row(key=key[0], at=row["at"], digest=row["digest"], previous=digest, matches=row["matches"])
            at, digest = row["at"], row["digest"]
        if at is not None and at != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.keep_ms)
            self.handle.registerTimer(at // 1000 + self.keep_ms)
        if at is not None:
            self.held.update((at, digest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(results: DataFrame, key: str, time: str, late: str = "1 day", keep: timedelta = timedelta(days=30)) -> DataFrame:
    """Every change of what is extracted from a document: key, time, digest, previous (digest before, null at first), matches (JSON).

    Unlike a filter of digests seen before, a return to an earlier content is a change too. State is one digest a document; one not
    heard of until the watermark is ``keep`` past its last version counts as new when it comes back. Rows without key or time are left
    out; rows older than the last known version of their document, or than the watermark, say nothing. Needs the RocksDB state
    store (:func:`with_state`).
    """
    ship(results.sparkSession)
    matches, when = F.to_json("matches"), F.col(time).cast("timestamp")
    told = results.select(F.col(key).cast("string").alias("key"), when.alias("time"), F.unix_micros(when).alias("at"), F.sha2(matches, 256).alias("digest"), matches.alias("matches")).where("key IS NOT NULL AND time IS NOT NULL")
    processor = Latest(int(keep.total_seconds() * 1000))
    found = told.withWatermark("time", late).groupBy("key").transformWithState(processor, "key string, at long, digest string, previous string, matches string", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").alias("time"), "digest", "previous", "matches")


def with_state(spark: SparkSession) -> SparkSession:
    """The session with a state store that keeps state on disk and expires it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """A stream read to its present end into a table in memory (for tests and small jobs)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
