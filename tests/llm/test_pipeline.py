"""The pipeline, stage by stage, against plain Python."""

import random
from collections import Counter

import numpy as np
from test_near_copies import plain_kept
from test_tokens_and_copies import check_packing

import corpus_pipeline as cp
from panelforge.functions.staging import staged

SMALL = "/root/testdata/sf0.001"


def clear_repeats(texts, length, words):
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int)]))
        for a, b in zip(edge[::2], edge[1::2]):
            if len(d[a:b].split()) <= words:
                gone[a:b] = False
        out.append(bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng, base = random.Random(1), docs.collect()
    passage = "é".join(base[3].text[:150].split(" ")) + " some words that stand in two texts " * 6
    more = [(9001, None), (9002, "12 - 3"), (9003, base[5].text), (9004, base[6].text + " end"), (9005, passage + "Un."), (9006, "Deux. " + passage), (None, "No id here."), (None, "No id here.")]
    extra = spark.createDataFrame([(i, t, "en", "src", 1) for i, t in more], docs.schema)
    docs = staged(docs.unionByName(extra).selectExpr("*", "'x' AS gram", "1 AS removed", "'y' AS lang_pred", "'z' AS __row", "2 AS read", "3 AS told", "4.5 AS score", "'w' AS doc", "5 AS kept"), "input")
    rows = {(r.doc_id, r.text) for r in docs.collect()}

    def through(name, docs):
        out = staged(dict(cp.STAGES)[name](spark, docs, SMALL), name)
        assert out.dtypes == docs.dtypes
        assert out.where("__row = 'z' AND lang_pred = 'y' AND read = 2 AND told = 3 AND doc = 'w' AND kept = 5").count() == out.count()
        return out, sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    kept, got = through("language", docs)
    assert Counter(got) == Counter((r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    best = {}
    for i, t in got:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    kept, got = through("exact_dedup", kept)
    assert got == sorted(((None if i < 0 else i, t) for t, i in best.items()), key=str)
    want = plain_kept(got)
    before = len(got)
    kept, got = through("near_dedup", kept)
    assert sorted((i is None, i or 0) for i, _ in got) == want and len(got) < before
    left = clear_repeats([t for _, t in got], cp.REPEAT, cp.PASSAGE_WORDS)
    kept, after = through("suffix_dedup", kept)
    assert after == sorted(((i, t) for (i, _), t in zip(got, left)), key=str) and after != got
    assert all(r.n_chars == len(r.text) for r in kept.collect() if (r.doc_id, r.text) not in rows)
    check_packing(kept)
    assert cp.STAGES[-1][1](spark, kept, SMALL).columns[:3] == ["doc_id", "start", "length"] and rng


def test_run_and_empty(spark, tmp_path):
    assert cp.run(spark, SMALL).count() > 100
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name
