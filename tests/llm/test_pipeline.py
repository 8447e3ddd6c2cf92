"""The corpus pipeline: stages, their order, what they keep, and that a rerun agrees."""

from __future__ import annotations

import itertools
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    from tallyroom.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
    from tallyroom.llm.common import written

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], FOLDER)))
    for df in steps[:-1]:
        assert df.columns == docs.columns
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in steps]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.classify_toxicity(docs, labels).where("rejected").collect()}
    assert ids[1] == [d for d in ids[0] if d not in rejected]
    texts = {r.doc_id: r.text for r in steps[2].collect()}
    for r in line_dedup.dedup_lines(steps[1]).collect():
        assert texts[r.doc_id] == r.text if r.doc_id in texts else r.n_deleted and not (r.text or "").strip()
    smallest = {r.component_id for r in jaccard_join.jaccard_components(steps[2]).collect()}
    assert set(ids[3]) == smallest
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    dirty = {r.doc_id for r in decontamination.find_contamination(steps[3], bench).where("contaminated").collect()}
    assert ids[4] == [d for d in ids[3] if d not in dirty]
    assert decontamination.find_contamination(steps[4], bench).where("size(hit_spans) > 0").where("n_hit >= 13 AND contaminated").count() == 0
    mixed = {r.doc_id: r.taken for r in mixing.mix(steps[4]).collect()}
    assert {r.doc_id: r.taken for r in steps[5].collect()} == mixed


def test_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "xx", None, 0)], docs.schema)
    for df in (docs, odd):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, FOLDER)
        assert df.count() in (0, 2)


def test_near_copies_against_brute_force(spark):
    """Five words and 0.8, on the documents and on a pair that four words and 0.85 tell apart."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    words = [f"w{i}" for i in range(50)]
    pair = [(10**6, " ".join(words), "en", "x", 0), (10**6 + 1, " ".join([*words[:25], "other", *words[26:]]), "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(pair, docs.schema))
    sets = {}
    for r in docs.collect():
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), r.text or "")) if x]
        n = min(5, len(w))
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    lead = {d: d for d in sets}

    def root(d):
        while lead[d] != d:
            d = lead[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            lead[high] = low
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()}
    assert kept == {d for d in sets if root(d) == d}
    assert 10**6 in kept and 10**6 + 1 not in kept
