"""Sinks: text, HTML and JSON of results, and bundles of the four forms together."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.shipping import ship


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def text_of(results: DataFrame) -> Column:
    """All matches of a result as text, a blank line between them."""
    return F.array_join(F.transform(results["matches"], lambda m: F.coalesce(m["text"], m["value"])), "\n\n")


def title_of(results: DataFrame) -> Column:
    """The document's title; without one the host of its URL, or the name of its file without the suffix."""
    value = F.coalesce(results["source"]["value"], F.lit(""))
    host = F.regexp_extract(value, "(?i)^https?://([^/?#]+)", 1)
    stem = F.regexp_replace(F.regexp_extract(value, "([^/]*)/*$", 1), "(?<=.)\\.[^.]*$", "")
    titled = F.when(F.trim(results["document_title"]) != "", results["document_title"])
    return F.coalesce(titled, F.when(host != "", host), F.when(stem != "", stem), F.lit("Selection"))


def language_of(results: DataFrame) -> Column:
    """The language that the first match to name one names: of its root, else of its first element, else of any below; null if none does."""
    markup = F.transform(results["matches"], lambda m: F.coalesce(m["html"], F.when(m["value_type"].isin("inner-html", "outer-html"), m["value"]), F.lit("")))
    named = lambda m, where: F.trim(F.regexp_extract(m, where, 1))
    one = lambda m: F.coalesce(*[F.when(named(m, w) != "", named(m, w)) for w in (r'(?is)<html\b[^>]*?\slang="([^"]*)"', r'(?is)^\s*<[a-z][^>]*?\slang="([^"]*)"', r'(?is)<[a-z][^>]*?\slang="([^"]*)"')])
    return F.get(F.filter(F.transform(markup, one), lambda x: x.isNotNull()), F.lit(0))


def html_of(results: DataFrame) -> Column:
    """All matches as one page, each in a section of its own; a single match that is a page itself stays as it is."""
    section = lambda m: F.concat(F.lit('<section data-match-index="'), m["index"].cast("string"), F.lit('">\n'), F.coalesce(m["html"], m["value"]), F.lit("\n</section>"))
    language = F.coalesce(F.concat(F.lit(' lang="'), escaped(language_of(results)), F.lit('"')), F.lit(""))
    body = F.array_join(F.transform(results["matches"], section), "\n")
    page = F.concat(F.lit("<!DOCTYPE html>\n<html"), language, F.lit('>\n<head>\n<meta charset="utf-8">\n<title>'), escaped(title_of(results)), F.lit("</title>\n</head>\n<body>\n"), body, F.lit("\n</body>\n</html>\n"))
    only = F.when(F.size(results["matches"]) == 1, F.get(results["matches"], F.lit(0))["value"])
    return F.when(only.rlike(r"(?i)^\s*(?:<!doctype|<html)"), only).otherwise(page)


def report_of(results: DataFrame) -> Column:
    names = [c for c in results.columns if c not in ("matches",)]
    return F.to_json(F.struct(*names))


def write_text(results: DataFrame, path: str, overwrite: bool = False) -> None:
    results.select(text_of(results).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_json(results: DataFrame, path: str, overwrite: bool = False) -> None:
    results.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def bundles(results: DataFrame) -> DataFrame:
    """The keys and the four files of each bundle: selection_html, selection_txt, selection_json, report_json."""
    keys = [c for c in results.columns if c not in ("operation_id", "ok", "source", "document_title", "candidate_count", "match_count", "matches", "diagnostics")]
    return results.select(*keys, html_of(results).alias("selection_html"), text_of(results).alias("selection_txt"), F.to_json("matches").alias("selection_json"), report_of(results).alias("report_json"))


#: The files of a bundle and the columns they come from.
FILES = {"selection.html": "selection_html", "selection.txt": "selection_txt", "selection.json": "selection_json", "report.json": "report_json"}


class BundleExists(ValueError):
    """Bundles are made anew: nothing that is there is written over, unless asked."""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    bundles: int


class BundleWriter(DataSourceWriter):
    """Tasks write whole bundles below a staging folder; the job's commit moves each task's folder into place with one rename, its abort deletes all."""

    def __init__(self, options: dict, overwrite: bool):
        value = {k.lower(): v for k, v in options.items()}
        self.path, self.key, self.overwrite = value["path"].rstrip("/"), value["key"], overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        store, root = _store(self.path)
        there = store.get_file_info(root).type
        if not overwrite and there != fs.FileType.NotFound and (there == fs.FileType.File or store.get_file_info(fs.FileSelector(root))):
            raise BundleExists(f"Could not create bundle directory {self.path}: it is there already.")

    def write(self, rows: Iterator[Row]) -> Staged:
        folder = f"part-{uuid.uuid4().hex}"
        store, root = _store(f"{self.staging}/{folder}")
        store.create_dir(root, recursive=True)
        seen: set[str] = set()
        for row in rows:
            name = quote(str(row[self.key]), safe="") or "_"
            if name in (".", "..") or name in seen:
                raise BundleExists(f"Two bundles, or none that can be a folder, are named {row[self.key]!r}.")
            seen.add(name)
            store.create_dir(f"{root}/{name}")
            for file, column in FILES.items():
                with store.open_output_stream(f"{root}/{name}/{file}") as out:
                    out.write((row[column] or "").encode())
        return Staged(folder, len(seen))

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _store(self.path)
        _, staging = _store(self.staging)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.path.rstrip("/") != staging:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for message in messages:
            if message is not None and message.bundles:
                store.move(f"{staging}/{message.folder}", f"{root}/{message.folder}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, staging = _store(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class BundleSink(DataSource):
    """Options: ``path``, and ``key``, the column that names a bundle."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_bundles"

    def writer(self, schema: T.StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(dict(self.options), overwrite)


def write_bundles(results: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """The four files of each result in a folder named by ``key``, below a folder for each task; all of them or none.

    Results are dealt by key, so that two of one name meet in a task and the job fails.
    """
    ship(results.sparkSession).dataSource.register(BundleSink)
    some = bundles(results).select(key, *FILES.values()).repartition(key)
    some.write.format("leafmill_bundles").mode("overwrite" if overwrite else "append").option("key", key).save(path)
