"""Secret scans, personal data, exact dedup and sharding against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import boosting, exact_dedup, hyperminhash, ngram_join, periodic_runs, pii, quality, secret_scan, sharding

from leafmill.llm.spans import masked

from .conftest import odd_rows


def secrets(t):
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15])


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


@pytest.mark.parametrize("module,run,brute", [(secret_scan, secret_scan.scan, secrets), (pii, pii.find, personal)])
def test_base_spans(odd, empty, module, run, brute):
    got = sorted(((r.doc_id or 0, r.base_sha256) for r in run(odd).collect()))
    assert got == sorted((i or 0, digest(brute(t or ""), module.KINDS)) for i, t in odd_rows())
    assert run(empty).collect() == []


EDGES = [
    "secret: token=\"abcdefgh12\"", "password = short", "api_key:'abcdefghij' APIKEY==x12345678", "AKIA AKIAKIA123456789012", "deadbeef" * 5 + "g" + "ab" * 16,
    "a@b.c+d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111-1111-1111-1111 41111111111111112222 5", "+1-2 +123456789 )( +12 (345) 678-9012x", "ſecret=abcdefghij Key",
]


def test_edges(spark):
    docs = spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string")
    for module, run, brute in ((secret_scan, secret_scan.scan, secrets), (pii, pii.find, lambda t: sorted(
            [x for x in personal(t) if x[1]] + [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]))):
        for r in run(docs).collect():
            assert r.base_sha256 == digest(brute(EDGES[r.doc_id]), module.KINDS), EDGES[r.doc_id]


def test_parts_are_linked_only_together(spark):
    far = " filler" * 200
    texts = ["login = bob and password: abc12 at https://db.example.org", "password: abc12", "login = bob", "https://db.example.org", "login = bob" + far + "password: abc12"]
    rows = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [x.split(":")[0] for x in rows[0].split(",")] == ["ident", "weak", "endpoint"]
    assert [rows[i] for i in (1, 2, 3, 4)] == ["", "", "", ""]


def test_redaction(spark):
    rows = [(1, "x token=abcdefgh123 y", 21, "k"), (2, None, None, None), (3, "clean", 5, "k"), (4, "é secret = 0123456789abcdef0123456789abcdef!", 43, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    out = {r.doc_id: (r.text, r.n_chars, r.base) for r in secret_scan.redact(docs).collect()}
    assert out == {1: ("x [SECRET] y", 12, "k"), 2: (None, None, None), 3: ("clean", 5, "k"), 4: ("é [SECRET]!", 11, "z")}


def test_clashing_columns_come_back_as_they_were(spark):
    """Every internal name of every operator that returns its caller's columns, in any case, as a column of the documents."""
    own = ["_secret_base", "_SECRET_linked", "_secret_text", "_secret_n", "__secret_base_0", "__secret_base_3", "_base_p0", "_base_p1", "_key", "_x", "x", "base", "linked", "selected", "rep", "cls", "n", "key", "stays", "digest", "run", "keep_id", "label"]
    text = "x token=abcdefgh123 y and password: abc12 of login = bob, mail bo@x.example.org or 212-555-0188"
    rows = [(i, f"{text} {i // 2}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in own])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    outs = [secret_scan.redact(docs), pii.with_spans(docs, base="found", selected="more").drop("found", "more"), exact_dedup.drop_duplicates(docs), quality.keep_good(docs, labels), ngram_join.keep_one(docs), hyperminhash.keep_one(docs), periodic_runs.collapse(docs)]
    for out in outs:
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c} {r.doc_id}" for r in got for c in own)
    assert [len(o.collect()) for o in outs[2:4]] == [3, 6]


def test_rows_without_any_id_are_all_kept(spark):
    docs = spark.createDataFrame([(None, "eq"), (None, "eq"), (1, "a"), (None, "a")], "doc_id long, text string")
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.dedup(docs).collect()) == [(0, 2, True), (0, 2, True), (1, 2, False), (1, 2, True)]


def test_boosted_proposals(spark):
    docs = spark.createDataFrame([(1, "call me at 555-010-2030 now"), (2, "order 555-010-2030% of"), (3, "reach us: name [at] host [dot] org.")], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert rows[1].startswith("local:11:23") and rows[2] == "" and rows[3].startswith("spelled:")
    rows = pii._drawn(4, 200)
    x, y = pii._matrix(rows, 4, []), np.array([r[3] for r in rows], float)
    trees = boosting.fit(x, y, trees=4)
    margin = sum(boosting.evaluate(t, x) for t in trees)
    cols = spark.createDataFrame(x.tolist(), [f"f{i}" for i in range(x.shape[1])]).select(boosting.as_column(trees, lambda j: F.col(f"f{j}")).alias("m"))
    assert sorted(round(r.m, 9) for r in cols.collect()) == sorted(round(float(m), 9) for m in margin)


@pytest.mark.parametrize("fan,bits", [(1, 3), (2, 4), (4, None)])
def test_exact_dedup(odd, fan, bits):
    rows, groups = odd_rows(), {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.dedup(odd, fan, bits).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_dedup_keeps_columns(odd, empty):
    out = exact_dedup.drop_duplicates(odd)
    assert out.columns == odd.columns and out.where("doc_id IN (1, 4)").count() == 0 and out.where("doc_id IN (2, 5)").count() == 2
    assert exact_dedup.dedup(empty).collect() == []


def test_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(3, "same", "a"), (3, "same", "b"), (2, "same", "c"), (None, "eq", "d"), (None, "eq", "e"), (None, None, "f"), (7, "", "g"), (None, "alone", "h")]
    out = sorted(str(tuple(r)[:2]) for r in exact_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect())
    assert out == sorted(map(str, [(3, "same"), (None, "eq"), (7, ""), (None, "alone")]))


def test_dedup_sorts_and_merges_runs(spark):
    """Every round's plan exchanges by run and segment and sorts by digest."""
    docs = spark.range(300).selectExpr("id AS doc_id", "cast(id % 90 AS string) AS text")
    entries = docs.selectExpr("doc_id % 16 AS run", "unhex(sha2(text, 256)) AS digest", "length(text) AS bytes", "xxhash64(text) AS check", "doc_id AS largest", "doc_id AS smallest", "1L AS n")
    out = exact_dedup._ordered(entries.withColumn("run", F.shiftright("run", 2)), 2, 1)
    rows = out.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).collect()
    for part in {r.part for r in rows}:
        keys = [(r.run, r.digest[0] >> 6, bytes(r.digest)) for r in sorted(rows, key=lambda r: r.at) if r.part == part]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert sum(r.n for r in rows) == 300


def test_sharding(odd, empty, spark):
    assert sharding.shard(empty).collect() == []
    rows = sharding.shard(odd, shards=3).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 8 for _, t in odd_rows())
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32((t or "").encode()) for _, t in odd_rows())
    docs = spark.range(5000).selectExpr("id doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE repeat(cast(id AS string), 3) END text")
    for together in (True, False):
        rows = sharding.shard(docs, shards=2 if together else 8, rows_per_bucket=100).collect()
        slots, sizes, same = {}, {}, set()
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
            sizes[r.shard] = sizes.get(r.shard, 0) + r.size
            same |= {r.shard} if r.doc_id % 3 == 0 else set()
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert (len(same) == 1) == together
        if not together:
            assert max(sizes.values()) < 1.02 * min(sizes.values())


def test_links_are_by_distance(spark):
    """Parts link when they start at most REACH apart, wherever the windows of the index lie."""
    texts = []
    for at in (0, 100, 250, 500):
        for gap in (200, 240, 256, 257, 300, 511):
            texts.append(" " * at + "login: bobby".ljust(gap) + "token: abcd")
    rows = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (rows[i] != "") == (t.index("token") - t.index("login") <= secret_scan.REACH), (i, rows[i])


def test_many_spans_in_one_text(spark):
    """200,000 matches in one text: positions, links and masks without quadratic work."""
    n = 100_000
    text = "token=abcdefgh1 AKIAABCDEFGHIJKL12 " * n
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    row = secret_scan.scan(docs).first()
    assert (row.n_assign, row.n_access) == (n, n) and row.base_sha256 == digest(secrets(text), secret_scan.KINDS)
    assert secret_scan.redact(docs).select(F.sha2("text", 256)).first()[0] == hashlib.sha256(("[SECRET] " * 2 * n).encode()).hexdigest()
    text = "bo@example.org 10.0.0.1 " * n
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip) == (n, n) and row.base_sha256 == digest(personal(text), pii.KINDS)


def test_masks_merge_overlaps(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        text = "".join(rng.choice("abcdé𝒳 ") for _ in range(rng.randrange(60)))
        rows.append((i, text, [(s, 0, min(len(text), s + rng.randrange(1, 9))) for s in (rng.randrange(len(text)) for _ in range(rng.randrange(12)))] if text else []))
    out = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<s:int,k:int,e:int>>").withColumn("got", masked(F.col("text"), F.col("spans"), "#"))
    for r in out.collect():
        want, at = "", 0
        for s, _, e in sorted((x.s, x.k, x.e) for x in r.spans):
            if e > at:
                want += r.text[at:s] + "#" if s >= at else ""
                at = e
        assert r.got == want + r.text[at:]


def test_shards_are_near_equal_with_large_groups(spark):
    """Groups of nearly a whole shard, more of them than shards have room for, and rows without doc_id."""
    docs = spark.range(24_000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('group ', (id div 3) % 11) ELSE repeat(cast(id AS string), 1 + id % 7) END AS text")
    sizes, shards = {}, {}
    for r in sharding.shard(docs).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) < 1.03 * min(sizes.values())
    assert sum(len(x) > 1 for x in shards.values()) <= 11


@pytest.mark.parametrize("kind", sorted(pii.PROPOSED))
def test_proposals_never_seen(kind):
    precision, recall = pii.measured(kind)
    assert precision >= 0.95 and recall >= 0.9


@pytest.mark.parametrize("kind", sorted(pii.PROPOSED))
def test_features_agree_with_columns(spark, kind):
    rows = pii._drawn(kind, 80) + pii._drawn(kind, 80, unseen=True) + ([("a.b at c dot com", "ÉCOLE Mail-Me K", "x", 1)] if kind == 7 else [])
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m string, before string, after string, y int")
    cols = pii._feature_columns(F.col("m"), F.col("before"), F.col("after"), kind)
    got = docs.select("i", F.array(*cols).alias("f"), pii._word_column(F.col("before")).alias("w")).orderBy("i").collect()
    assert [r.f for r in got] == pii._matrix(rows, kind, []).tolist()
    assert [set(r.w) for r in got] == [pii._words(before) for _, before, _, _ in rows]


def test_leads_of_the_tests_are_not_those_of_training():
    words = lambda leads: {w for v in leads.values() for x in v for w in re.findall("[a-z]{3,}", x.lower())}
    assert not words(pii.UNSEEN) & (words(pii.LEADS) - {"the", "via", "and"})


MISSED = ["Emergency line 212-555-0188", "Hotline: 800-555-0199", "Support desk 312.555.0147", "T: 312-555-0147", "Voice 312-555-0147", "Ping us: 212-555-0188", "Give me a buzz: 646.555.0112", "SSNs such as 078-05-1120", "say hello: john at example dot com"]
CLEAN = ["shelf 012-345-6789", "order 212-155-0188", "firmware 000-12-3456", "look at figure dot three", "barcode AB12 3456 7890 12", "lot 900-12-3456"]


def test_words_that_training_never_saw(spark):
    docs = spark.createDataFrame(list(enumerate(MISSED + CLEAN)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert [t for i, t in enumerate(MISSED) if not spans[i]] == []
    assert [(t, spans[len(MISSED) + i]) for i, t in enumerate(CLEAN) if spans[len(MISSED) + i]] == []
