"""The toxicity machine against a plain kernel machine, and on held-out labels."""

import itertools
import math
import random

import numpy as np
import pytest

from panelforge.llm import toxicity as tox

DOCS = "doc_id long, text string, lang string, value double, top string"


def plain_map(word):
    """Subsequence weights of a string by enumeration."""
    kinds = [0, *(ord(c) - 96 if "a" <= c <= "z" else 27 if c.isdigit() else 28 if ord(c) < 128 else 29 + ord(c) % 3 for c in word), 0]
    out = {}
    for i, j, k in itertools.combinations(range(len(kinds)), 3):
        u = kinds[i], kinds[j], kinds[k]
        if k - i < tox.SPAN and 28 not in u:
            out[u] = out.get(u, 0) + tox.DECAY ** (k - i - 2)
    return out


def plain_kernel(a, b):
    x, y = plain_map(a), plain_map(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(u, 0) for u, v in x.items()) / norm if norm else 0.0


WORDS = ["idiot", "i.d.i.o.t", "id*iot", "ok", "a", "###", "naïve", "i d i o t", "m0ron", "moron", "the", "thethethe", "ß"]


def test_kernel_against_enumeration():
    table = np.zeros(tox.SYMBOLS**3)
    for one in WORDS:
        table[:] = 0
        at, share = tox.subsequences([one, "longer than the first"])
        np.add.at(table, at[0], share[0])
        got = tox.values(WORDS, table, 0.0)
        assert got == pytest.approx([plain_kernel(one, w) for w in WORDS], abs=1e-9)
    assert plain_kernel("idiot", "i.d.i.o.t") > 0.8 > 0.3 > plain_kernel("idiot", "moron")


def test_machine_against_plain_kernel_machine(monkeypatch):
    """Landmarks, Nyström map and machine, folded into one table, give what the kernel matrix gives unfolded."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdeot") for _ in range(rng.randrange(2, 8))) for _ in range(60)} | {"idiot", "moron"})
    toxic = np.array([float(w in ("idiot", "moron")) * 9 + (i % 11 == 0) for i, w in enumerate(words)])
    clean = np.array([float(w not in ("idiot", "moron")) for w in words])
    monkeypatch.setattr(tox, "LANDMARKS", 24)
    weights, bias = tox.machine(words, toxic / toxic.sum(), clean / clean.sum())
    order = sorted(range(len(words)), key=lambda i: tox.xxhash.xxh64_intdigest(words[i].encode()))
    top = np.argsort(clean / clean.sum() - toxic / toxic.sum(), kind="stable")[:12].tolist()
    marks = [words[i] for i in top + [i for i in order if i not in top][:12]]
    k = np.array([[plain_kernel(a, b) for b in marks] for a in marks])
    c = np.array([[plain_kernel(a, b) for b in marks] for a in words])
    # the machine in the dual form of the map: f = c @ alpha + b, with norm alpha' k alpha
    y = np.r_[np.ones(len(words)), -np.ones(len(words))]
    wt = np.r_[toxic / toxic.sum(), clean / clean.sum()] * tox.MISFIT
    both = np.concatenate([c, c])
    x = np.c_[both, np.ones(len(both))]
    ridge = np.zeros((25, 25))
    ridge[:24, :24] = k
    ridge[24, 24] = 1e-6
    beta = np.zeros(25)
    for _ in range(200):
        act = (y * (x @ beta) < 1) & (wt > 0)
        new = np.linalg.lstsq((x[act] * wt[act, None]).T @ x[act] + ridge, (x[act] * wt[act, None]).T @ y[act], rcond=None)[0]
        if np.abs(x @ (new - beta)).max() < 1e-9:
            break
        beta = new
    assert tox.values(words, weights, bias) == pytest.approx(x[: len(words)] @ beta, abs=2e-3)


def test_strings():
    assert tox.strings("You I d i o t, Stop. a") == ["you", "i d i o t,", "stop.", "a"]
    long = "".join(chr(97 + i % 26) for i in range(100))
    assert set(tox.strings(long)) == {long[i : i + 32] for i in range(0, 84, 16)} and tox.strings(" \n") == []


def test_odd_texts_and_small_tables(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(20, 60))]
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["blockhead", "numbskull", "b.l.o.c.k.head", "numb*skull"])
        docs.append((i, " ".join(words), "en", 1.0, "x"))
        labels.append((i, int(i % 4 == 0)))
    docs += [(1000, None, "en", 1.0, "x"), (1001, "", "en", 1.0, "x"), (1002, "ok " * 400_000, "en", 1.0, "x"), (None, "blockhead numbskull blockhead", "en", 1.0, "x"), (1003, "a perfect block head", "en", 1.0, "x"), (1003, "a perfect block head", "en", 1.0, "x")]
    docs += [(1004, "you n-u-m-b-s-k-u-l-l you bloxckhead " * 3, "en", 1.0, "x"), (1005, "x" * 300_000, "en", 1.0, "x")]
    labels += [(1000, None), (None, 1), (0, 1)]
    d, l = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in tox.score(d, tox.fit(d, l)).collect()}
    assert got[1000].score == got[1001].score and got[1001].predicted == 0 and got[1002].predicted == 0 and got[1005].predicted == 0
    assert got[None].predicted == 1 and got[1004].predicted == 1 and not got[None].held_out
    held = [got[i] for i in range(400) if got[i].held_out]
    assert len(held) > 50 and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert tox.score(d, tox.fit(d, l)).count() == len(docs)
    one = tox.score(d, tox.fit(d, l.where("toxic = 0")))
    assert {r.score for r in one.collect()} == {0.0}
    none = tox.score(d.limit(0), tox.fit(d.limit(0), l.limit(0)))
    assert none.count() == 0


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = tox.score(docs, tox.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic]
    wrong = [r.predicted for r in rows if not r.toxic]
    assert sum(caught) / len(caught) > 0.85 and sum(wrong) / len(wrong) < 0.015
