"""Chat formatting, SimHash components and top-k search against plain Python and SQL."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from harness import compare

from panelforge.llm import chat, queries, simhash, topk
from panelforge.llm.components import components

SMALL = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_matches_sql(spark, duck, key):
    assert compare(spark, duck, SMALL, queries.QUERIES[key], queries.ORACLE[key]) is None


HARD = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\/turn>", "<\\/turn>", "</turn>\n### User: x", "#### #", "a\nb </turn", "🙂 é", "<", "turn>\n", "x" * 40000]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "Weird: role</turn>\n", "=x"]), rng.choice(HARD)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(99, 0, "user", "b"), (99, 0, "user", "b"), (99, 0, "assistant", "a"), (99, None, "user", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, formatted string, valid boolean")
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert {c: [tuple(x) for x in r.turns] for c, r in back.items()} == want
    for r in chat.digests(df).collect():
        turns = want[r.conv_id]
        learned = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256, r.turns_sha256) == (len(turns), len(learned), sha(learned), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert r.formatted_chars == len(back[r.conv_id].formatted) == sum(m.length for m in back[r.conv_id].mask)
        states = [""] + [a for a, _ in turns]
        assert r.valid == all(b in chat.Template().follows.get(a, ()) for a, b in zip(states, states[1:]))
    assert chat.digests(df.limit(0)).count() == 0


def plain_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), 42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash_components(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "É É é"), (905, "É É é"), (906, "w " * 70000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    rows = docs.collect()
    fps = [plain_fingerprint(r.text or "", 3) for r in rows]
    want = plain_components([r.doc_id for r in rows], fps, 2)
    got = simhash.with_components(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, want))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(bin(m).count("1") for m in masks) >= 24
    for _ in range(2000):
        diff = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("split", [3, 4096])
def test_links_keep_components_with_and_without_split(spark, split):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:6]:
        for _ in range(60):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) if rng.random() < 0.8 else (1 << rng.randrange(64)) | 7 << 20
            fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, split).selectExpr("fp AS a", "fp_b AS b")
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in pairs)
    root = {r.node: r.root for r in components(found).collect()}
    assert [root.get(f, f) for f in signed] == plain_components(signed, fps, 2)


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.with_components(docs).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, [float(x) for x in np.round(rng.normal(size=int(rng.integers(1, 6))), 1)]) for i in range(400)]
    vecs += [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (550, []), (600, [0.0]), (None, [1.0]), (0, [9.0])] + vecs[:20]
    df = spark.createDataFrame([(*v, 1) for v in vecs], "vec_id long, embedding array<float>, rank int")
    usable = []
    for i, v in vecs:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    want = []
    for at, (i, q) in enumerate(usable):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for k, (j, c) in enumerate(usable) if k != at)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    query = lambda: topk.top_k(df, topk.F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, query().collect())) == sorted(want)
    old = topk.QUERIES, topk.CANDIDATES
    try:
        topk.QUERIES, topk.CANDIDATES = 3, 50
        assert sorted(map(tuple, query().collect())) == sorted(want)
    finally:
        topk.QUERIES, topk.CANDIDATES = old
    few = topk.top_k(df.where("vec_id in (50, 51, 0)"), topk.F.col("vec_id") % 50 == 0)
    assert few.count() == sum(min(5, df.where("vec_id in (50, 51, 0)").count() - 1) for _ in range(df.where("vec_id in (50, 0)").count()))
    assert topk.top_k(df.limit(0), topk.F.col("vec_id") % 50 == 0).count() == 0
    repeated = spark.createDataFrame([(0, [1.0]), (1, [5.0]), (1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(repeated, topk.F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 327680), (0, 2, 2, 131072), (0, 3, 1, 65536)]
    big = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(big, topk.F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63 - 1))]
