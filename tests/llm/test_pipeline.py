"""The pipeline against plain versions of its stages."""

import re

import numpy as np

import corpus_pipeline
from wayfold.llm import simhash


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def test_near_copies_go_and_others_stay(spark, docs, rows):
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((a, b), key=lambda i: i)
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert kept == {i for i in ids if root[i] == i}


def test_pipeline_on_the_smallest_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in before.collect()}
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        seen.append([r.doc_id for r in docs.collect()])
    good, distinct, apart, mixed = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert np.mean([(i in set(good)) == bool(labels[i]) for i in labels if i in texts]) > 0.97
    norm = lambda i: re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or "")
    first = {}
    for i in sorted(good):
        first.setdefault(norm(i), i)
    assert sorted(distinct) == sorted(first.values())
    assert set(apart) <= set(distinct) and len(set(apart)) == len(apart)
    assert set(mixed) <= set(apart) and max(mixed.count(i) for i in mixed) <= 2
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(mixed)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_stages_on_edges(spark, docs, empty, clashing):
    for name, stage in corpus_pipeline.STAGES:
        for df in (empty, docs, clashing):
            out = stage(spark, df, "/root/testdata/sf0.001")
            if name != "bpe":
                assert out.columns == df.columns
            out.collect()
