"""Repeated byte strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import suffixes

SMALL = "/root/testdata/sf0.001"


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeéstn") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randrange(40, 160)) for _ in range(6)]
    docs = [None, "", "short", "a" * 3000, "ab" * 700, "a" * 400, "b" * 399, "xyz " * 30 + text(200)]
    for _ in range(60):
        docs.append(" ".join(rng.choice([rng.choice(shared), text(rng.randrange(1, 80))]) for _ in range(rng.randrange(1, 6))))
    for i in rng.sample(range(8, len(docs)), 12):
        d = docs[i]
        at = rng.randrange(len(d))
        docs += [d, d[:at] + "#" + d[at + 1 :]]
    return docs


def rows(df, length, hot=suffixes.HOT):
    cut = suffixes.without_repeats(df, length, hot).collect()
    return sorted((str(r.doc.doc_id), r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in cut)


def test_runs_of_blocks_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    texts = [(t or "").encode() for t in made_up(1)]
    seen = Counter()
    for parts, data in suffixes._pieces(texts, 240):
        for doc, _, _, first, last, anchor in zip(*suffixes.runs_of_block(parts, data, 240)):
            assert first <= anchor and last <= anchor <= first + 240 - suffixes.GRAM
            seen.update((doc, s) for s in range(first, last + 1))
    assert seen == Counter((i, s) for i, t in enumerate(texts) for s in range(len(t) - 239))


@pytest.mark.parametrize("length,hot", [(400, 4000), (400, 2), (240, 4000), (128, 3)])
def test_against_all_windows(spark, length, hot):
    texts = made_up(length + hot)
    df = spark.createDataFrame([(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, gram int, removed string").repartition(5)
    stored = suffixes.staged(df, "input")
    want = plain([r.text for r in stored.collect()], length)
    ids = [str(r.doc_id) for r in stored.collect()]
    assert rows(stored, length, hot) == sorted((i, *w) for i, w in zip(ids, want))


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *w) for r, w in zip(got, plain([r.text for r in got], 400)))
    assert sorted(map(tuple, suffixes.digests(docs).collect())) == want and any(w[2] for w in want)


def test_merge_of_shards_against_sorting():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 90))) for _ in range(40)]
    strings += [strings[0], strings[1][3:] + b"ab"]
    seen = Counter(s[i : i + 24] for s in strings for i in range(len(s) - 23))
    want = [[seen[s[i : i + 24]] > 1 for i in range(len(s) - 23)] for s in strings]
    for size in (1, 300, 1 << 18):
        assert [f.tolist() for f in suffixes.repeated_windows(strings, 24, size)] == want


def test_a_merge_holds_whole_grams_of_bounded_size():
    rng = random.Random(5)
    rows = sorted((rng.choice([-7, -1, 0, 2, 9, 40, 41]), i, 1, bytes(rng.randrange(1, 60))) for i in range(300))
    names = ["gram", "bytes", "n", "body"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[a : a + 11]], schema=pa.schema(list(zip(names, [pa.int64()] * 3 + [pa.binary()])))) for a in range(0, 311, 11)]
    for limit in (1, 2500, 1 << 20):
        parts = [[tuple(r.values()) for r in t.to_pylist()] for t in suffixes.whole_grams(iter(batches), limit)]
        assert [r for p in parts for r in p] == rows
        seen = Counter(g for p in parts for g in {r[0] for r in p})
        assert set(seen.values()) == {1} and (len(parts) == 7) == (limit == 1) and (len(parts) == 1) == (limit == 1 << 20)
        assert all(sum(len(r[3]) for r in p if r[0] != p[-1][0]) < limit for p in parts)
    assert not list(suffixes.whole_grams(iter([]), 1))


def test_merges_of_any_size_decide_alike(spark):
    rng = random.Random(6)
    bases = [bytes(rng.choice(b"abcd") for _ in range(400)) for _ in range(4)]
    rows = [(g, i, rng.choice([1, 1, 1, 2]), bytes((b := bases[g % 4])[(a := rng.randrange(0, 200)) : a + rng.randrange(128, 200)])) for i in range(80) for g in [rng.randrange(12)]]
    held = spark.createDataFrame(rows, "gram long, bytes long, n long, body binary").repartition(1).sortWithinPartitions("gram")
    plain = sorted((g, i) for g, i, n, b in rows if n == 1 and any(b[k : k + 128] in o for h, j, _, o in rows if h == g and j != i for k in range(len(b) - 127)))
    one, many = ([(r.gram, r.bytes, r.spans) for r in suffixes.decide(held, 128, limit).sort("gram", "bytes").collect()] for limit in (1 << 20, 1))
    assert many and [r[:2] for r in many] == plain
    assert len(one) >= len(many) and {r[:2] for r in many} <= {r[:2] for r in one}  # bases are shared by grams here, which windows of a gram never are


def test_empty(spark):
    assert suffixes.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
