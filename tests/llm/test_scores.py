import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import documents, edge_rows, sentence, words

from bytesieve.llm import ngram_lm, quality, toxicity
from bytesieve.llm.words import Words


def labelled_tables(spark):
    rows = [(i, sentence(i, 40)) for i in range(240)]
    for i in range(0, 240, 3):
        rows[i] = (i, " ".join(w + "!!" for w in sentence(i, 40).upper().split()))
    for i in range(1, 240, 3):
        rows[i] = (i, sentence(i, 20) + " awful Villain " + sentence(i + 1000, 20))
    labels = [(i, int(i % 3 != 0), int(i % 3 == 1)) for i in range(240)] + [(3, None, None), (None, 1, 0), (9999, 0, 1)]
    return rows, documents(spark, rows + edge_rows()[3:6] + [(None, "x")]), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int")


def held(i, folds):
    return zlib.crc32(str(i).encode()) % folds == 0


def test_quality(spark):
    _, docs, labels = labelled_tables(spark)
    model = quality.train(docs, labels)
    out = quality.scored(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    known = [r for r in out if r.doc_id is not None and r.doc_id < 240 and r.score != out[-1].score]
    right = [r.predicted == int(r.doc_id % 3 != 0) for r in known if r.held_out]
    assert np.mean(right) > 0.95
    assert all(r.held_out == held(r.doc_id, 5) for r in known)
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in out)


def test_toxicity(spark):
    _, docs, labels = labelled_tables(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.scored(docs, model).collect()
    assert len(model[0]) < 5000
    known = {}
    for r in out:
        if r.doc_id is not None and r.held_out:
            known.setdefault(r.doc_id, r.predicted)
    known = {i: p for i, p in known.items() if i > 20}
    assert np.mean([p == int(i % 3 == 1) for i, p in known.items() if i < 240]) > 0.95


def test_toxicity_learns_from_twenty_thousand(spark, monkeypatch):
    docs = spark.range(16_000).selectExpr("id as doc_id", "concat('word ', id) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, s: sizes.append(len(rows)))
    toxicity.train(docs, labels)
    assert sizes == [sum(not held(i, 5) for i in range(16_000))] and 12_000 < sizes[0] < 20_000


def test_models_without_rows(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.train(docs, labels)
        assert module.scored(docs, model).count() == 0
        assert module.scored(documents(spark, [(1, None)]), model).collect()[0].score == 0.5


def test_words_agree_with_plain_split():
    texts = [t for _, t in edge_rows()]
    w = Words(pa.array(texts, pa.string()))
    assert np.diff(w.rows).tolist() == [len(words(t)) for t in texts]
    by_word = {}
    for h, x in zip(w.hashes.tolist(), [x for t in texts for x in words(t)], strict=True):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_ngram_lm(spark):
    rows = edge_rows() + [(100 + i, sentence(i % 20, 30)) for i in range(120)]
    s = ngram_lm.Settings()
    out = ngram_lm.learned_and_scored(documents(spark, rows), s).collect()
    counts = [Counter(), Counter(), Counter()]
    for i, t in rows:
        if i is None or not held(i, 10):
            w = [*words(t), None]
            for n in (1, 2, 3):
                counts[n - 1].update(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
    total, kinds = sum(counts[0].values()), len(counts[0])

    def p(*w):
        if len(w) == 1:
            return (counts[0][w] + 0.1) / (total + 0.1 * (kinds + 1))
        c = counts[len(w) - 1][w]
        c = c if c >= s.least[len(w) - 2] else 0
        m = s.prior[len(w) - 2]
        return (c + m * p(*w[1:])) / (counts[len(w) - 2][w[:-1]] + m)

    want = []
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10(p(*w[max(0, k - 2):k + 1])) for k in range(len(w)))
        want.append((i is not None and held(i, 10), len(w), sum(counts[0][(x,)] > 0 for x in w), round(base, 6), score))
    got = [(r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in out]
    assert {r.train_tokens for r in out} == {total}
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-5 and abs(a[4] - b[4]) < 0.04 * a[1]


def test_ngram_lm_without_rows(spark):
    assert ngram_lm.learned_and_scored(documents(spark, [])).count() == 0
    only = next(i for i in range(100) if held(i, 10))
    row = ngram_lm.learned_and_scored(documents(spark, [(only, "some words")])).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)


def test_ngram_lm_keeps_what_was_seen_once(spark):
    kept, out = next(i for i in range(100) if not held(i, 10)), next(i for i in range(100) if held(i, 10))
    text = " ".join(f"w{i}" for i in range(40))
    got = {r.doc_id: r.score for r in ngram_lm.learned_and_scored(documents(spark, [(kept, text), (out, text)])).collect()}
    one = 1.1 / (41 + 0.1 * 42)
    two = (1 + 4 * one) / (1 + 4)
    three = (1 + 2 * two) / (1 + 2)
    want = math.log10(one) + math.log10(two) + 39 * math.log10(three)
    assert got[kept] == got[out] and abs(got[out] - want) < 0.04 * 41
