import sys
import zlib

import numpy as np
from conftest import ROOT
from test_decontam import D
from test_ngram_join import N, brute

sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402

from gridtrace.llm import pii, toxicity  # noqa: E402
from gridtrace.llm.queries import TEST_KEY  # noqa: E402


def plain(spark, docs, sf):
    """The stages by brute force over plain rows; the toxicity model alone is shared."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), held_out=False)
    look = toxicity.Lookup(model.lexicon)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = model.score(np.array([toxicity.features(t or "", look) for _, t in rows]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    first = {d: c for d, _, _, c in brute(rows, N.Rule(5, 80, 100))}
    rows = [r for r in rows if first[r[0]] == r[0]]
    strip = lambda t: [w for w in (x.strip(D._EDGE).lower() for x in t.split()) if w]
    grams = set()
    for (t,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect():
        w = strip(t)
        grams |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    rows = [(d, t) for d, t in rows if not any(tuple(w[k : k + 13]) in grams for w in [strip(t)] for k in range(len(w) - 12))]
    f = pii.Feistel(TEST_KEY.encode())
    return {d: pii.replace(t, pii.find(t, f)) for d, t in rows}


def check_pieces(got, texts):
    from test_packing import whole_ids

    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for d, rows in by.items():
        ids, at = np.append(whole_ids(texts[d]), 1).astype("<u4"), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_run_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = plain(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    check_pieces(corpus_pipeline.run(spark, sf).collect(), want)


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    schema = docs.schema.simpleString()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.schema.simpleString() == schema and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


def test_odd_rows_go_through(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "plain words without an id", "en", "s", 25), (3, "same words here again and again", "en", "s", 32), (3, "same words here again and again", "en", "s", 32)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 2, 3, None]
