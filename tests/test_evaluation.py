import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytesieve.functions import ordered as O
from bytesieve.operators import evaluation as ev
from bytesieve.operators import scoring as sc


def preds(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_pred int, y_prob double")


def brute_auc(rows):
    pos = [p for t, _, p in rows if t == 1]
    neg = [p for t, _, p in rows if t == 0]
    if not pos or not neg:
        return 0.0
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total = sum(t for t, _, _ in rows)
    out = last = 0.0
    for th in sorted({p for _, _, p in rows}, reverse=True):
        tp = sum(t for t, _, p in rows if p >= th)
        n = sum(p >= th for _, _, p in rows)
        out += (tp / total - last) * tp / n
        last = tp / total
    return out


@pytest.mark.parametrize("kind", ["mixed", "hot", "crowded"])
def test_curves(spark, kind):
    rng = random.Random(7)
    prob = {"mixed": lambda: rng.randrange(100) / 100, "hot": lambda: 0.5 if rng.random() < .4 else rng.random(),
            "crowded": lambda: 1 - rng.random() * 1e-9}[kind]
    rows = [(rng.random() < .3, 0, prob()) for _ in range(600)]
    rows = [(int(t), p, q) for t, p, q in rows]
    df = preds(spark, rows)
    assert abs(ev.auc_roc(df).first()[0] - brute_auc(rows)) < 1e-9
    assert abs(ev.average_precision(df).first()[0] - brute_ap(rows)) < 1e-9
    curve = {r.threshold: (r.fpr, r.tpr) for r in ev.roc_curve(df).collect()}
    p, n = sum(t for t, _, _ in rows), sum(1 - t for t, _, _ in rows)
    for th, (fpr, tpr) in curve.items():
        assert abs(tpr - sum(t for t, _, q in rows if q >= th) / p) < 1e-9
        assert abs(fpr - sum(1 - t for t, _, q in rows if q >= th) / n) < 1e-9
    best = ev.best_threshold(df).first()
    assert abs((best.tpr - best.fpr) - max(t - f for f, t in curve.values())) < 1e-9


def test_one_class(spark):
    assert ev.auc_roc(preds(spark, [(1, 1, 0.3), (1, 0, 0.4)])).first()[0] == 0.0
    assert ev.mcc(preds(spark, [(1, 1, 0.3)])).first()[0] == 0.0
    r = ev.error_rates(preds(spark, [(1, 1, 0.3)])).first()
    assert (r.false_positive_rate, r.true_positive_rate) == (0.0, 1.0)


def test_numbers(spark):
    df = preds(spark, [(0, 0, .1)] * 3 + [(0, 1, .6)] + [(1, 1, .9)] * 4 + [(1, 0, .2)] * 2)
    c = ev.confusion(df).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (3, 1, 2, 4)
    b = ev.basic_metrics(df).first()
    assert abs(b.accuracy - 0.7) < 1e-12 and abs(b.recall - 0.7) < 1e-12
    f0, f1 = 6 / 9, 8 / 11
    assert abs(b.f1 - (f0 * 4 + f1 * 6) / 10) < 1e-12
    f = ev.class_f1(df).first()
    assert abs(f.f1_benign - f0) < 1e-12 and abs(f.f1_malicious - f1) < 1e-12
    assert abs(ev.mcc(df).first()[0] - (12 - 2) / np.sqrt(5 * 6 * 4 * 5)) < 1e-12


def test_epochs(spark):
    e = spark.createDataFrame([(1, .5), (2, .9), (3, .9), (4, .7)], "epoch int, accuracy double")
    assert ev.best_epoch(e).first().epoch == 2
    assert [r.best_accuracy for r in ev.running_best(e).orderBy("epoch").collect()] == [.5, .9, .9, .9]
    assert [r.f1 for r in ev.metric_series(e, "f1").collect()] == [0.0] * 4
    g = spark.createDataFrame([(.96, .01), (.96, None), (.9, .0)], "accuracy double, false_negative_rate double")
    assert [r.passed for r in ev.quality_gate(g).collect()] == [True, False, False]


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_percentile(spark, share):
    rng = random.Random(9)
    values = [rng.choice([1.0, 2.5, rng.random() * 50]) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in values], "ms double")
    assert abs(sc.exact_percentile(df, "ms", share).first()[0] - np.percentile(values, share * 100)) < 1e-9


def test_a_million_scores_spread_evenly(spark):
    """Ranges follow the count of distinct scores: none is much larger than asked for, and the sums are exact."""
    df = spark.range(1_000_000).select((F.col("id") % 2).cast("int").alias("y_true"), (F.pow(F.col("id") / 1e6, 3)).alias("y_prob"))
    c = ev.threshold_counts(df, rows=50_000)
    got = c.agg(F.count("*"), F.sum("tp"), F.sum("fp"), F.max("tp")).first()
    assert tuple(got) == (1_000_000, 250_000_500_000, 250_000_000_000, 500_000)
    parts = O.with_ranged_sum(df.select("y_prob"), [F.col("y_prob")], {"at": F.lit(1)}, rows=50_000)
    sizes = [n for n in parts.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert sum(sizes) == 1_000_000 and max(sizes) < 4 * 50_000
    assert parts.agg(F.max("at")).first()[0] == 1_000_000
    small = ev.threshold_counts(df.limit(10))
    assert small.count() == 10


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_ranged_sums_and_maxima(spark, rows):
    rng = random.Random(rows)
    values = [(i, rng.randrange(50)) for i in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(values, "k int, v int")
    got = O.with_ranged_sum(df, [F.col("k").desc()], {"s": F.col("v")}, {"m": F.col("v")}, rows=rows).collect()
    total, top, want = 0, 0, {}
    for k, v in sorted(values, reverse=True):
        total, top = total + v, max(top, v)
        want[k] = (v, total, top)
    assert {r.k: (r.v, r.s, r.m) for r in got} == want


def test_newton(spark):
    """The optimum of a weighted, ridged log-loss: its gradient is zero; repeated and separable rows are fine."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x @ [2, -1, 0.5] + rng.normal(size=300) > 0.3).astype(int)
    rows = [([float(v) for v in a], int(b), float(c)) for a, b, c in zip(x, y, rng.uniform(0.5, 2, 300))]
    df = spark.createDataFrame(rows, "features array<double>, label int, c double").repartition(5)
    w = sc.newton(df, weight="c", ridge=0.7).weights
    full = np.hstack([np.ones((300, 1)), x])
    grad = full.T @ (np.array([r[2] for r in rows]) * (1 / (1 + np.exp(-full @ w)) - y)) + 0.7 * np.array([0, *w[1:]])
    assert np.abs(grad).max() < 1e-8
    score = {tuple(r.features): r.score for r in sc.linear_score(df, sc.Linear(w)).collect()}
    assert abs(score[tuple(rows[0][0])] - 1 / (1 + np.exp(-full[0] @ w))) < 1e-12
    apart = spark.createDataFrame([([0.0], 0), ([1.0], 1)] * 20, "features array<double>, label int")
    assert np.isfinite(sc.newton(apart).weights).all()
    assert (sc.newton(df.limit(0)).weights == 0).all()
    with pytest.raises(ValueError):
        sc.newton(df, most=2)


def test_softmax(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-1000.0, 1000.0), (3.0, 1.0)], "l0 double, l1 double")
    r = sc.with_softmax(df).collect()
    assert [x.verdict for x in r] == ["BENIGN", "MALICIOUS", "BENIGN"]
    assert abs(r[0].malicious_prob - .5) < 1e-12 and r[1].malicious_prob == 1.0
    v = sc.score_validity(sc.with_softmax(df)).first()
    assert all([v.non_negative, v.at_most_one, v.sums_to_one, v.no_nan, v.no_inf])


def test_models_learn(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 6))
    rows = [(int(i), [float(v) for v in r], int(r[0] + r[1] > 1)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    for kind in ("logistic", "mlp"):
        out = sc.score(df, sc.train(df, model=kind, max_iter=60))
        hit = out.where("(score >= 0.5) = (label = 1)").count() / 400
        assert hit > 0.9
    with pytest.raises(ValueError):
        sc.train(df, model="other")


def _field(n, payload):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])
    if isinstance(payload, int):
        return varint(n << 3) + varint(payload)
    return varint(n << 3 | 2) + varint(len(payload)) + payload


def tiny_onnx(weights):
    """A one-node model, output = input x weights, in wire format."""
    w = np.asarray(weights, dtype=np.float32)
    dims = lambda *ds: b"".join(_field(1, d) for d in ds)
    shape = lambda *ds: _field(2, b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in ds))
    info = lambda name, *ds: _field(1, name) + _field(2, _field(1, _field(1, 1) + shape(*ds)))
    node = _field(1, b"input") + _field(1, b"w") + _field(2, b"output") + _field(4, b"MatMul")
    init = dims(*w.shape) + _field(2, 1) + _field(8, b"w") + _field(9, w.tobytes())
    graph = (_field(1, node) + _field(2, b"g") + _field(5, init) + _field(11, info(b"input", b"n", w.shape[0]))
             + _field(12, info(b"output", b"n", w.shape[1])))
    return _field(1, 7) + _field(8, _field(1, b"") + _field(2, 13)) + _field(7, graph)


def test_onnx_scorer(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    path = tmp_path / "m.onnx"
    path.write_bytes(tiny_onnx([[1, 0], [0, 2], [1, 1]]))
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(50)], "id long, features array<double>")
    got = sc.score_with(df, sc.onnx_loader(str(path)), batch=7).orderBy("id").collect()
    assert [(r.l0, r.l1) for r in got] == [(i + 2.0, 4.0) for i in range(50)]
