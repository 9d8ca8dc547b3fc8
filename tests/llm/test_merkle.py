"""The Merkle manifest against plain Python trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelforge.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, part int, leaf string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    n = r[3] if r[3] is None else r[3] + more
    return sha("".join(map(enc, (r[0], r[1], r[2], n, r[4]))))


def tree(nodes, fanout):
    """Root and, per leaf, the list of (left, right) sibling strings."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(proofs, at):
            start = i - i % fanout
            p.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fanout])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lower = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        lower[g] = tree([leaf_of(r) for r in groups[g]], fanout)
    root, above = tree([lower[g][0] for g in order], fanout)
    out = []
    for g, upper in zip(order, above):
        for r, proof in zip(groups[g], lower[g][1]):
            proof = proof + upper
            told = leaf_of(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for a, b in proof:
                told = sha(a + told + b)
            out.append((r[0], leaf_of(r), lower[g][0], root, sha("".join(a + b for a, b in proof)), told, told == root))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(-5, 300)]), rng.choice([None, "s", "sü"]), rng.choice([None, "", "en", "en", "en", "en", "é", "zz"]), rng.choice([None, 3, 40]), rng.choice([None, "", "ä b", "x" * 5000]), "g", 1, "l") for _ in range(n)]
    return rows + [rows[0]] * 5 + [(7, "one", "alone", 1, "t", "g", 1, "l"), (8, "s", "long", 1, "é" * 300_000, "g", 1, "l")]


@pytest.mark.parametrize("fanout,levels,n", [(2, 12, 200), (2, 1, 150), (2, 2, 90), (3, 1, 140), (4, 1, 77)])
def test_against_plain_trees(spark, fanout, levels, n):
    rows = made(n, n)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), tampered, fanout, levels)
    want = plain(rows, fanout)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({w[-1] for w in want}) == 2  # some tampered rows are told


def test_one_row_and_empty(spark):
    row = (7, "s", "en", 1, "t", "g", 1, "l")
    got = merkle.manifest(spark.createDataFrame([row], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(7, leaf_of(row), leaf_of(row), leaf_of(row), sha(""), leaf_of(row), True)]
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
