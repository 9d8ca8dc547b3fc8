"""Held-out accuracy of the classifiers; token counts against the library and a plain recursion."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from panelforge.llm import langid, quality, queries, viterbi

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{MID}/documents.parquet")


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language(spark, docs):
    got = queries.op3_langid(spark, MID).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_ignores_held_out_labels_and_other_columns(spark, docs):
    changed = docs.withColumn("lang", langid.F.when(langid.held_out(), "xx").otherwise(langid.F.col("lang"))).withColumn("score", langid.F.lit("clash"))
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(changed, langid.fit(changed)).collect()}
    assert a == b


def test_language_decides_what_is_accepted(spark, docs):
    rng = random.Random(8)
    made = [" ".join(f"{rng.randrange(1 << 32):08x}" for _ in range(60)), "日本語の文章です。今日は天気がいいですね。" * 8, "12 34", None, "the"]
    model = langid.fit(docs)
    odd = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert [r.doc_id for r in langid.accepted(odd, model).collect()] == [4]
    assert langid.accepted(docs, model).count() >= docs.count() - 2


def test_language_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "x"), (None, "the"), (6, "É" * 3_000_000), (6, "é")]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in langid.predict(df, langid.fit(docs)).collect()}
    assert got == {(1, True, True), (2, True, True), (3, True, True), (4, False, False), (None, False, False), (6, False, False)}
    assert langid.fit(df) is None and {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), langid.fit(docs)).count() == 0


def test_kernel_against_sets():
    texts = ["abcd", "bcde", "xyz"]
    grams = [{f" {t} "[i : i + n] for n in langid.GRAMS for i in range(len(t) + 3 - n)} for t in texts]
    x = langid.presence(texts, np.zeros((3, langid.SLOTS), np.float32))
    assert (x @ x.T).tolist() == [[len(a & b) for b in grams] for a in grams]


def test_kernel_regression_against_plain_one():
    """Map, regression and folding into one matrix give what the kernel matrix over all landmarks gives."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(w) for _ in range(12)) for w in (["the", "and", "of"], ["der", "und", "von"], ["los", "y", "de"]) for _ in range(9)]
    langs = [x for x in ("en", "de", "es") for _ in range(9)][:26]
    texts = texts[:26]
    model = langid.learn(texts, langs)
    sets = [set(langid.slots(t).tolist()) for t in texts + ["the los und", "zzz"]]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets[:26]] for a in sets])
    y = np.where(np.array(langs)[:, None] == np.array(model.languages), 1.0, -1.0)
    weight = np.array([1 / langs.count(v) for v in langs])
    weight /= weight.mean()
    # minimise sum of weight * (k a + b - y)^2 + RIDGE * a' k a
    x = np.c_[k[:26], np.ones(26)]
    ridge = np.zeros((27, 27))
    ridge[:26, :26] = langid.RIDGE * k[:26]
    a = np.linalg.lstsq((x * weight[:, None]).T @ x + ridge, (x * weight[:, None]).T @ y, rcond=None)[0]
    want = np.c_[k, np.ones(28)] @ a
    p = langid.presence(texts + ["the los und", "zzz"], np.zeros((28, langid.SLOTS), np.float32))
    assert p @ model.weights / np.sqrt(p.sum(axis=1, keepdims=True)) + model.bias == pytest.approx(want, abs=1e-3)


def test_language_of_long_texts_only(spark):
    rows = [(i, "the and of with " * 3 + str(i), "en") for i in range(40)] + [(100 + i, "zorg blu kmin " * 6000 + str(i), "xx") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("en", "xx")


def test_quality_sizes_and_curve_against_plain_ones(spark):
    """Sizes and scores of a model, recomputed text by text."""
    import math

    import zstandard

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{MID}/documents.parquet"), labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert model.weights and len(got) == len(texts)
    for doc_id, text in texts.items():
        if not text:
            assert got[doc_id] == pytest.approx(model.base)
            continue
        data, sizes = text.encode(), []
        for dictionary in (model.good, model.bad):
            coder = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(coder.compress(data)))
        line = model.weights[0] + model.weights[1] * 10 * (sizes[1] - sizes[0]) / len(data) + model.weights[2] * math.log(min(sizes) / len(data) + 0.01)
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(min(line, 30), -30))), abs=1e-12)


def test_quality(spark, docs):
    got = {r.doc_id: r for r in queries.op8_quality(spark, MID).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    assert len(got) == docs.count() and all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[d].score, q) for d, q in truth.items() if got[d].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.93


def test_quality_edges(spark, docs):
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    edges = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "The text.", "x"), (4, "w " * 100000, "x")], "doc_id long, text string, score string")
    model = quality.fit(docs, labels)
    got = quality.score(edges, model).collect()
    assert len(got) == 4 and sum(abs(r.score - model.base) < 1e-12 for r in got) >= 2
    changed = labels.withColumn("quality", quality.F.when(quality.held_out(), 0).otherwise(quality.F.col("quality")))
    assert quality.fit(docs, changed) == model
    assert quality.fit(docs, labels.where("quality = 1")).weights is None and quality.fit(docs, labels.limit(0)).base == 0.5
    few = labels.where("doc_id < 60").unionByName(spark.createDataFrame([(None, 1, 0), (7, None, 0)], labels.schema))
    assert quality.score(docs, quality.fit(docs, few)).count() == docs.count()
    assert quality.score(edges.limit(0), model).count() == 0


def plain(marked, v):
    """All paths, relaxed from left to right."""
    best = [(0.0, 0)] + [None] * len(marked)
    for start in range(len(marked)):
        for end in range(start + 1, min(len(marked), start + 60) + 1):
            piece = marked[start:end]
            score, n = (v.pieces[piece], 1) if piece in v.pieces else (v.unknown, len(piece.encode())) if end == start + 1 else (None, 0)
            if score is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                best[end] = (best[start][0] + score, best[start][1] + n)
    return best[-1][1], best[-1][0]


def test_counts_against_library_and_recursion(spark, docs):
    """The library's unigram model, given the same pieces and scores, counts whole texts alike."""
    path = P.path(queries.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    exact = tokenizers.Tokenizer(tokenizers.models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    v, counter, rng = viterbi.vocabulary(path), viterbi.Counter(viterbi.vocabulary(path)), random.Random(8)
    texts = {r.doc_id: r.text for r in docs.limit(200).collect()}
    assert {r.doc_id: r.n_tokens for r in viterbi.counts(docs.limit(200), path).collect()} == {i: len(exact.encode("▁" + t.replace(" ", "▁")).ids) for i, t in texts.items()}
    words = " ".join(texts.values()).split(" ")
    for text in ["", " ", "  a  ", "▁x", "日本 \U0001f642 x", "a\nb \t\x00", "퟿?", *(" ".join(rng.choices(words, k=50)) for _ in range(50))]:
        assert counter.text(text) == (plain("▁" + text.replace(" ", "▁"), v) if text else (0, 0.0))
    edges = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (1, "x" * 100000, 3)], "doc_id long, text string, n_tokens int")
    assert {(r.doc_id, r.n_tokens) for r in viterbi.counts(edges, path).collect()} == {(1, 0), (None, 2), (1, counter.text("x" * 100000)[0])}
    assert viterbi.counts(edges.limit(0), path).count() == 0
