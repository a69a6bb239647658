"""BPE and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe, packing, transducer

from .conftest import odd_rows, prose

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = str(P.path("byte_bpe_50k.json")), str(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte():
    return tokenizers.Tokenizer.from_file(BYTE)


@pytest.mark.parametrize("lexicon", [0, 5, 1000])
def test_round_trip(odd, byte, lexicon):
    got = sorted(str(tuple(r)) for r in bpe.round_trip(odd, BYTE, lexicon).collect())
    want = []
    for i, t in odd_rows():
        ids = byte.encode(t or "", add_special_tokens=False).ids
        back = byte.decode(ids, skip_special_tokens=False)
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    assert got == sorted(want)


def test_empty(empty):
    assert bpe.round_trip(empty, BYTE).collect() == []
    assert packing.pack(empty, WORD).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    own, t = bpe.vocabulary(BYTE), tokenizers.Tokenizer.from_file(BYTE) if not hasattr(test_ids_of_any_text, "t") else test_ids_of_any_text.t
    test_ids_of_any_text.t = t
    words = own.cut(text)
    ids = [i for w in own.merge_all(words) for i in w.tolist()]
    assert ids == [i for w in words for i in own.merge(w)] == t.encode(text, add_special_tokens=False).ids


def test_long_words_merge_alike(byte):
    own = bpe.vocabulary(BYTE)
    for word in (prose(1, 60).replace(" ", ""), "ab" * 500, "☃" * 100):
        assert own.merge(word) == byte.encode(word, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 1 << 20), max_size=3), max_size=30), st.lists(st.binary(max_size=6), max_size=10))
def test_transducer(tmp_path_factory, entries, others):
    path = tmp_path_factory.mktemp("t") / "lexicon.bin"
    made = transducer.build(sorted(entries.items()))
    transducer.write(made, str(path))
    t = transducer.Transducer(str(path))
    words = [*entries, *others]
    for word, rank in zip(words, t.ranks(words).tolist(), strict=True):
        assert (rank >= 0) == (word in entries)
        if rank >= 0:
            assert t.ids[t.first[rank] : t.first[rank + 1]].tolist() == entries[word]


def test_suffixes_are_shared():
    made = transducer.build(sorted((s + b"tion", [1]) for s in (b"na", b"mo", b"se", b"xx")))
    assert len(made["final"]) <= 10  # separate tails would take 25 states


def test_packing(odd, spark):
    t = tokenizers.Tokenizer.from_file(WORD)
    want = []
    for i, text in odd_rows():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k : 2048 * (k + 1)]
            want.append((i or 0, k, 2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = packing.pack(odd, WORD).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    check_sequences(rows, 2048)


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_in_rounds_is_tight(spark):
    pieces = spark.range(6000).selectExpr("id doc_id", "0 piece", "0L start", "cast(1 + pmod(xxhash64(id), 700) AS long) length", "id ids_crc32")
    rows = packing.pack_pieces(pieces, 1000, deme=500).collect()
    least = -(-sum(r.length for r in rows) // 1000)
    assert len(rows) == 6000 and check_sequences(rows, 1000) <= 1.01 * least + 1


def test_evolution_never_loses_pieces():
    sizes = [1 + (i * 7919) % 900 for i in range(400)]
    bins = packing.evolve(sizes, 1000, 3)
    assert sorted(i for items in bins.items for i in items) == list(range(400))
    assert all(sum(sizes[i] for i in items) == 1000 - free for items, free in zip(bins.items, bins.free, strict=True))


def test_demes_are_bounded_by_row(spark, monkeypatch):
    """Pieces that repeat every column still spread over demes, and all are packed."""
    from pyspark.sql import functions as F

    pieces = spark.range(6000).selectExpr("cast(null AS long) AS doc_id", "0 AS piece", "0L AS start", "100L + (id % 3) * 0 AS length", "7L AS ids_crc32").repartition(4)
    largest = []
    real = packing._evolved
    monkeypatch.setattr(packing, "_evolved", lambda dealt, *a: largest.append(dealt.groupBy("deme").count().agg(F.max("count")).first()[0]) or real(dealt, *a))
    rows = packing.pack_pieces(pieces, 1000, deme=500).collect()
    assert max(largest) < 1000 and len(rows) == 6000
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r.offset)
    assert all(sorted(b) == [100 * i for i in range(len(b))] and len(b) <= 10 for b in bins.values()) and len(bins) <= 606
