"""Tokens, packing and exact copies against the libraries and plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from panelforge.llm import cuckoo, packing, pieces, queries

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a ", "  a  b", "▁x ▁", "tab\tand\r\nline\n", "<s> </s> <unk>", "Ａﬁ 日本語 🙂", "\x00\x1c x", "a" * 5000, "it's, we'll. end", "1,000.5", "q <|endoftext|> z", "x \n y", "Ça. Été,", "²½ Ⅷ"]
COLUMNS = "doc_id long, text string, ids string, n_tokens int, digest string, size int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a "), (3, "a ")]
    return spark.createDataFrame([(i, t, "clash", 1, "clash", 2) for i, t in rows], COLUMNS)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_pieces_equal_the_library(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))
    for docs in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        want = sorted((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for r in docs.collect() for ids in [sp.encode(r.text or "")])
        got = pieces.digests(docs, P.path(queries.PIECES)).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_decode_any_ids(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))
    rng = random.Random(3)
    lists = [[rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randrange(12))] for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(900, [32000]), (901, None), (902, [5, None])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in pieces.decode(df, P.path(queries.PIECES)).collect()}
    assert [got[i] for i in range(300)] == [sp.decode(x) for x in lists]
    assert got[900] is None and got[901] is None and got[902] is None


def check_packing(docs):
    tk = tokenizers.Tokenizer.from_file(P.path(queries.BYTES))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(tk.encode(r.text or "", add_special_tokens=False).ids + [0])
    rows = queries.pack_tokens(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in want[r.doc_id])
    assert {d: sum(map(len, x)) for d, x in want.items()} == {d: sum(r.length for r in x) for d, x in by_doc.items()}
    for d, x in want.items():
        if len(x) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    padding = tokens = 0
    for x in by_seq.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0 and tokens == sum(len(i) for x in want.values() for i in x)


def test_packing(spark, odd):
    check_packing(odd)
    check_packing(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_sum_of_squares_takes_the_smallest_sum():
    rng, bins, levels = random.Random(1), packing.SumOfSquares(16, 0), [0] * 17
    for _ in range(400):
        size = rng.randrange(1, 16)
        options = {}
        for h in range(0, 17 - size):
            if h == 0 or levels[h]:
                new = levels[:]
                new[h] -= h > 0
                new[h + size] += h + size < 16
                options[h] = (sum(n * n for n in new[1:16]), -h, new)
        levels = min(options.values())[2]
        bins.place(((0, 0), 0, b"\0" * 4 * size), size)
        assert bins.count[1:16].tolist() == levels[1:16]


def test_cuckoo_index_against_a_dict():
    rng, index, plain = random.Random(2), cuckoo.CuckooIndex(2), {}
    keys = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(3000)]
    keys += [keys[0][:10] + bytes([i]) * 22 for i in range(1, 7)]  # the same tag and bucket
    for n in range(12000):
        k = rng.choice(keys)
        if rng.random() < 0.7:
            if index.get(k) is None:
                assert k not in plain
                index.insert(cuckoo.Entry(k))
                plain[k] = 1
        else:
            assert (index.delete(k) is not None) == (plain.pop(k, None) is not None)
    assert {e.digest for e in index.entries()} == set(plain) and index.live == len(plain)


def test_exact_copies(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (7, ""), (None, "z"), (8, "b "), (8, "b"), (9, "b"), (9, "b")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, kept int, keep_id string")
    got = cuckoo.duplicates(docs.repartition(3)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(
        (str(i), str(k), n, sha(t or "")) for (i, t), (k, n) in zip(rows, [(5, 3)] * 3 + [(7, 2)] * 2 + [(None, 1), (8, 1)] + [(9, 3)] * 3)
    )
    assert sum(r.kept for r in got) == 5
    kept = cuckoo.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "7", "8", "9", "None"]
    gone = cuckoo.duplicates(docs, spark.createDataFrame([("a",), ("none",)], "text string")).where("doc_id in (1, 3, 5)").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in gone] == [(None, 0, False)] * 3


@pytest.mark.parametrize("fn", [lambda d: pieces.digests(d, P.path(queries.PIECES)), queries.pack_tokens, cuckoo.duplicates, cuckoo.deduplicated])
def test_empty_table(spark, fn):
    assert fn(spark.createDataFrame([], "doc_id long, text string")).count() == 0
