"""Each stage of the pipeline against what its operator says, and the whole run."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from leafmill.llm import exact_dedup, ngram_join, quality, secret_scan
from leafmill.llm.common import documents, saved

from .test_join import sets_of


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(saved(stage(spark, kept[-1], sf_dir), "test"))
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert all(d.columns == docs.columns for d in kept[1:5])
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert ids(kept[1]) == good
    assert ids(kept[2]) == {r.doc_id for r in exact_dedup.dedup(kept[1]).where("kept").collect()}
    assert ids(kept[3]) == {r.component_id for r in ngram_join.join(kept[2]).collect()}
    assert ids(kept[4]) == ids(kept[3]) and ids(kept[5]) == ids(kept[3])
    assert kept[4].where("text LIKE '%token = \"%'").count() == 0


def test_stages_take_odd_rows(spark, odd, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, sf_dir).columns == odd.columns
        assert stage(spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, empty, sf_dir).count() == 0


def test_run_against_brute_force(spark, sf_dir):
    """What every stage after the classifier keeps, masks and packs, from plain Python over all documents."""
    docs = documents(spark, sf_dir)
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        if r.doc_id in good:
            texts[r.text or ""] = max(r.doc_id, texts.get(r.text or "", -1))
    rows = sorted((i, t) for t, i in texts.items())
    sets, gone = sets_of([t for _, t in rows]), set()
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    gone = {i for i in range(len(rows)) if sets[i] and find(i) != i}
    left = spark.createDataFrame([r for i, r in enumerate(rows) if i not in gone], "doc_id long, text string")
    coder, want = Tokenizer.from_file(corpus_pipeline.vocabulary_path(corpus_pipeline.WORD_BPE)), []
    coder.no_truncation()
    coder.no_padding()
    for r in secret_scan.scan(left).join(left, "doc_id").collect():
        text, at, out = r.text, 0, []
        for kind, s, e in sorted((x.split(":") for x in r.spans.split(",") if x), key=lambda x: int(x[1])):
            if kind in ("assign", "access", "hex", "weak") and int(e) > at:
                out += [text[at : int(s)], "[SECRET]"] if int(s) >= at else []
                at = int(e)
        ids = [*coder.encode("".join(out) + text[at:], add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want.append((r.doc_id, k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 2048 + 1
