"""Near copies against brute-force similarities of five-word shingles."""

import random

import pytest

import corpus_pipeline as cp
from panelforge.llm import nearcopies

SMALL = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(s, t):
    return s == t or 5 * len(s & t) >= 4 * len(s | t)


def plain_kept(rows):
    """Smallest ids of the groups; a null id is larger than all others."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc_id is None, doc_id or 0))
    return sorted(min(g) for g in groups.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [2, 8])
def test_near_dedup_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    monkeypatch.setattr(nearcopies, "BLOCK", 5 if small == 2 else nearcopies.BLOCK)
    monkeypatch.setattr(nearcopies, "LOCAL", 2 if small == 2 else nearcopies.LOCAL)
    rng = random.Random(3)
    made = [None, "", " \n", "One two", "one  TWO", "one two three four five six"]
    for _ in range(12):  # around the threshold: up to 9 edits in 200 words
        base = [f"w{rng.randrange(900)}" for _ in range(200)]
        made += [" ".join(base)] + [edited(rng, base, n) for n in (1, 3, 4, 5, 6, 9)]
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    made += [edited(rng, base, rng.randrange(8)) for _ in range(60)]  # a large group, and sets that share its shingles without the similarity
    made += [" ".join(base[:120]) + " " + edited(rng, base[:40], 40) for _ in range(30)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)] + [(None, "no id here at all"), (None, "No id  here at all")], docs.schema))
    rows = [tuple(r) for r in docs.collect()]
    got = dict(cp.STAGES)["near_dedup"](spark, docs, SMALL)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == plain_kept(rows)
    assert got.columns == docs.columns


def test_one_shingle_of_many_documents(spark):
    """5000 unlinked documents that share a line cost no candidates; equal lines alone are one group."""
    rng = random.Random(5)
    line = " ".join(f"licence{i}" for i in range(12))
    made = [(i, " ".join(f"w{rng.randrange(10**7)}" for _ in range(40)) + " " + line) for i in range(5000)]
    made += [(6000 + i, line.upper() if i % 2 else line + " ") for i in range(40)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(6)
    texts = nearcopies.with_row(docs)
    from panelforge.functions.staging import staged

    postings = staged(texts.mapInArrow(nearcopies._sliced(5, 7), nearcopies.ROWS).repartition(7, "part").mapInArrow(nearcopies._counted, nearcopies.ROWS), "t").repartition(7, "slice").mapInArrow(nearcopies._prefixes, nearcopies.POSTINGS)
    assert postings.select("node").distinct().count() == 1
    assert sorted(r.doc_id for r in nearcopies.representatives(docs, 5).select("doc_id").collect()) == [*range(5000), 6000]


def test_very_long_text(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[:70_000]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.representatives(docs, 5).select("doc_id").collect()) == [1, 3]
