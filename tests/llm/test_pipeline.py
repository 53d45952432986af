"""The stages of the pipeline against plain versions, each on what its predecessor kept, and the search of benchmark
passages against a word-by-word one."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import sentence, words

import corpus_pipeline
from bytesieve.llm import byte_bpe, decontaminate, pii, quality, toxicity
from bytesieve.llm.membership import without

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, filter_bits long, filter_word string"


def good(i, n=60):
    return sentence(i, n)


def bad(i):
    return " ".join("!!".join(w.upper()) for w in sentence(i, 40).split())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good and bad rows, copies, benchmark passages and secrets, with columns whose names the stages use themselves."""
    r = random.Random(3)
    rows = [(i, good(i) if i % 3 else bad(i)) for i in range(300)]
    for i in (301, 302, 303):  # copies of document 1, two of them edited
        w = good(1, 60).split()
        if i != 301:
            w[r.randrange(60)] = "edited"
        rows.append((i, " ".join(w)))
    passage = sentence(9000, 30)
    rows += [(310, good(310, 40) + " " + passage + " " + good(311, 40)), (311, good(312) + " write to ann@example.org or +44 20 7946 0958"),
             (312, None), (313, ""), (None, good(314)), (None, good(314))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 5, "x") for i, t in rows], COLUMNS)
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, sentence(9001, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def key(r):
    return (-1 if r.doc_id is None else r.doc_id, r.text or "")


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["good_quality", "near_dedup", "decontaminated", "without_pii", "tokenized"]

    # 1: the plain score of the same weights
    model = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    first = steps["good_quality"](spark, docs, tables)
    assert first.columns == columns
    s = quality.Settings()
    kept = [r for r in docs.collect() if plain_score(r.text, model, s) >= s.cut]
    got = first.collect()
    assert sorted(map(key, got)) == sorted(map(key, kept)) and all(r.filter_bits == 5 and r.filter_word == "x" for r in got)
    assert {r.doc_id for r in got} & {301, 302, 303} == {301, 302, 303} and not {r.doc_id for r in got} & {0, 3, 6, 9}

    # 2: all pairs
    second = steps["near_dedup"](spark, first, tables)
    assert second.columns == columns
    shingles = {}
    for r in got:
        w = words(r.text)
        shingles.setdefault(r.doc_id, set()).update({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    gone, ids = set(), sorted(i for i in shingles if i is not None)
    for x in ids:
        for y in ids:
            if x < y and shingles[x] and 100 * len(shingles[x] & shingles[y]) >= corpus_pipeline.SIMILAR * len(shingles[x] | shingles[y]):
                gone.add(y)
    assert {301, 302, 303} <= gone
    assert sorted(map(key, second.collect())) == sorted(key(r) for r in got if r.doc_id not in gone)

    # 3: the passage
    third = steps["decontaminated"](spark, second, tables)
    assert third.columns == columns
    assert sorted(map(key, third.collect())) == sorted(key(r) for r in second.collect() if r.doc_id != 310)

    # 4: base spans go, texts without any span stay
    fourth = steps["without_pii"](spark, third, tables)
    assert fourth.columns == columns
    after = {r.doc_id: r for r in fourth.collect()}
    assert "ann@" not in after[311].text and "7946" not in after[311].text and after[311].n_chars == len(after[311].text)
    assert fourth.count() == third.count()

    # 5: the tokenizer's own ids
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    last = {(-1 if r.doc_id is None else r.doc_id, r.ids_sha256) for r in steps["tokenized"](spark, fourth, tables).collect()}
    assert last == {(-1 if r.doc_id is None else r.doc_id, hashlib.sha256(",".join(
        map(str, plain.encode_ordinary(r.text or ""))).encode()).hexdigest()) for r in fourth.collect()}


def plain_score(text, model, s):
    """The mean weight of a text's features, one text at a time."""
    import pyarrow as pa

    weights, bias = model
    got = [weights[bucket] for _, bucket in quality.subwords(pa.array([text or ""]), s.bits, s.grams)]
    values = np.concatenate(got) if got else np.zeros(0)
    return 1 / (1 + np.exp(-(values.sum() / max(1, len(values)) + bias)))


def test_pipeline_runs(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 150 and {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)


def test_rows_without_ids(spark):
    """Exact although 64 bits let nearly everything through, whatever the columns are called."""
    rows = spark.createDataFrame([(i if i % 7 else None, i, "b", 3) for i in range(500)],
                                 "id long, filter_word int, filter_bits string, Filter_Bits_ int")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 3)] + [(None,), (3,)], "id long")
    for bits in (6, 23):
        got = without(rows, ids, "id", bits)
        assert got.columns == rows.columns
        assert sorted(r.filter_word for r in got.collect()) == [i for i in range(500) if i % 7 == 0 or i % 3]
    assert without(rows, ids.limit(0), "id").count() == 500


# ------------------------------------------------------------ benchmark passages

def letters(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower())


def plain_diagonal(doc, item):
    """Most equal words on a diagonal, wherever they lie."""
    return max((sum(1 for j, w in enumerate(item) if 0 <= d + j < len(doc) and doc[d + j] == w)
                for d in range(1 - len(item), len(doc))), default=0)


def test_substituted_passages(spark):
    """Each tenth word of a passage is another: at least 95 of 100 are found, and nothing that a word-by-word search has not."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[r.choice(vocabulary) for _ in range(r.randrange(16, 60))] for _ in range(60)]
    docs, planted = [], set()
    for i in range(200):
        doc = [r.choice(vocabulary) for _ in range(150)]
        if i % 2:
            k = r.randrange(60)
            copy = list(items[k])
            for j in r.sample(range(len(copy)), len(copy) // 10):
                copy[j] = "other"
            at = r.randrange(100)
            doc[at:at] = copy
            planted.add((i, k))
        docs.append(doc)
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc, x.item): x.n_equal for x in decontaminate.leaks(d, t).collect()}
    assert len(planted & set(got)) >= 0.95 * len(planted)
    s = decontaminate.Settings()
    for (i, k), equal in got.items():
        assert equal >= s.shortest and plain_diagonal(docs[i], items[k]) >= min(equal, s.covered * len(items[k]))
    missed = [p for p in ((i, k) for i in range(200) for k in range(60)) if p not in got]
    assert sum(plain_diagonal(docs[i], items[k]) >= 0.8 * len(items[k]) for i, k in missed) <= 0.05 * len(planted)


def test_short_items(spark):
    """Items of one to twelve words are found whole; below ten words nothing less counts."""
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(1, 13)]
    docs = [(n, f"so then {text}, and on") for n, text in items] + [(100 + n, " ".join(text.split()[:-1])) for n, text in items]
    got = {(x.doc, x.item) for x in decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(n, n) for n in range(1, 13)} | {(111, 11), (112, 12)}


def test_repetitive_texts_take_linear_memory():
    import tracemalloc

    tracemalloc.start()
    same = np.full(100_000, 7, np.uint64)
    assert decontaminate.best_overlap(same, same, decontaminate.Settings()) == (0, 100_000, 100_000)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    r = np.random.default_rng(2)
    for _ in range(40):
        doc, item = r.integers(0, 5, r.integers(1, 90)), r.integers(0, 5, r.integers(1, 40))
        counts = decontaminate.diagonals(doc.astype(np.uint64), item.astype(np.uint64))
        assert counts.max() == plain_diagonal(doc.tolist(), item.tolist())


# ------------------------------------------------------------ learned parts, step by step

def test_quality_step_by_step():
    """Gradient descent on subword vectors, one number at a time."""
    r = np.random.default_rng(5)
    s = quality.Settings(bits=5, size=3, epochs=2, rate=0.5)
    rows = [(int(r.integers(2)), np.unique(r.integers(0, 32, 6)).astype(np.int32), None) for _ in range(12)]
    rows = [(y, at, r.integers(1, 4, len(at)).astype(np.float32)) for y, at, _ in rows]
    weights, bias = quality.fit(rows, s)
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / s.size, 1 / s.size, (32, s.size)).astype(np.float32)
    out, b = [[0.0] * s.size for _ in range(2)], [0.0, 0.0]
    done = 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            y, at, v = rows[i]
            rate = s.rate * (1 - done / (s.epochs * len(rows)))
            done += 1
            share = v / v.sum()
            mean = [sum(float(share[k]) * float(table[a][d]) for k, a in enumerate(at)) for d in range(s.size)]
            z = [sum(out[c][d] * mean[d] for d in range(s.size)) + b[c] for c in range(2)]
            e = [np.exp(x - max(z)) for x in z]
            p = [x / sum(e) for x in e]
            p[y] -= 1
            back = [sum(p[c] * out[c][d] for c in range(2)) for d in range(s.size)]
            for c in range(2):
                b[c] -= rate * 0.1 * p[c]
                for d in range(s.size):
                    out[c][d] -= rate * p[c] * mean[d]
            for k, a in enumerate(at):
                for d in range(s.size):
                    table[a][d] -= rate * len(at) ** 0.5 * float(share[k]) * back[d]
    want = [sum(float(table[a][d]) * (out[1][d] - out[0][d]) for d in range(s.size)) for a in range(32)]
    assert np.allclose(weights, want, atol=1e-4) and abs(bias - (b[1] - b[0])) < 1e-4


def test_toxicity_step_by_step():
    """FTRL-proximal with rates per coordinate, one coordinate at a time, and the score of a text from the weights."""
    r = np.random.default_rng(6)
    s = toxicity.Settings(bits=5, l1=0.2, l2=0.3, epochs=2)
    rows = [(int(r.integers(2)), np.unique(r.integers(0, 32, 6)), None) for _ in range(30)]
    at, weights, bias = toxicity.fit(rows, s)
    z, n, zb, nb = [0.0] * 32, [0.0] * 32, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    rng = np.random.default_rng(11)
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            y, own, _ = rows[k]
            b = -zb / ((s.beta + nb ** 0.5) / s.alpha)
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y
            for i in own:
                step = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha
                z[i] += g - step * w[i]
                n[i] += g * g
            step = ((nb + g * g) ** 0.5 - nb ** 0.5) / s.alpha
            zb, nb = zb + g - step * b, nb + g * g
    want = {i: weight(i) for i in range(32) if weight(i)}
    assert at.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)])
    assert abs(bias - -zb / ((s.beta + nb ** 0.5) / s.alpha)) < 1e-9


def test_toxicity_scores_are_sums(spark):
    """The score of a text is the logistic of the bias and the weights of its distinct features."""
    import pyarrow as pa

    s = toxicity.Settings()
    texts = ["you awful villain", "", "a quiet river stone", "awful awful awful"]
    buckets = [sorted({int(b) for _, bs in toxicity.grams(pa.array([t]), s.bits, s.skips) for b in bs}) for t in texts]
    at = np.array(sorted({b for own in buckets for b in own}))
    weights = np.random.default_rng(1).normal(size=len(at))
    look = dict(zip(at.tolist(), weights.astype(np.float32).astype(float).tolist()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, (at, weights, 0.25)).collect()}
    for i, own in enumerate(buckets):
        assert abs(got[i] - 1 / (1 + np.exp(-(0.25 + sum(look[b] for b in own))))) < 1e-5


def test_quality_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, sentence(i, 200)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    sizes = []

    def features(column):
        parts = list(quality.subwords(column, 18, (2, 4)))
        row, bucket = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        from bytesieve.llm import labelled
        return labelled.summed(row, bucket, len(column), 1 << 18)

    from bytesieve.llm import labelled
    for most in (1 << 30, 20_000, 0):
        got = labelled.fitted(docs, labels, "quality", features, 5, 6000, most, lambda rows: str(
            (len(rows), sum(len(b) * 4 + len(v) * 4 for _, b, v in rows))).encode())
        sizes.append(eval(got.decode()))
    free = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))
    assert sizes[0][0] == free and 0 < sizes[1][0] < free and sizes[1][1] <= 20_000 and sizes[2] == (0, 0)


def test_pii_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "mail bob@example.com now", 3)], "doc_id long, text string, span int")
    assert pii.redacted(docs, pii.train(docs)).columns == docs.columns
