import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytesieve.operators import curation as cu


def labelled(spark, rows):
    return spark.createDataFrame(rows, "id long, features array<double>, label int")


def many(spark, n, share=3, width=4):
    return spark.range(n).select(
        "id", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.col("id") * 7 + i * 3) % 100 / 100.0).alias("features"),
        F.when(F.col("id") % share == 0, 1).otherwise(0).alias("label"))


def checks(df, **kw):
    return {r.check: (r.status, r.detail) for r in cu.validate(df, **kw).collect()}


def test_validation_messages(spark):
    rows = [(i, [0.5, float("nan") if i == 0 else 2.0], 0 if i else 5) for i in range(12)]
    c = checks(labelled(spark, rows).drop("id"))
    assert c["Minimum samples"] == ("error", "Need 100, got 12")
    assert c["Valid label values"][0] == "error" and "{5}" in c["Valid label values"][1]
    assert c["Minimum samples for class 5"] == ("error", "Got 1, need 10")
    assert c["Class 0 sample count"] == ("pass", "11 samples")
    assert c["Class balance"] == ("pass", "Ratio: 11.0:1")
    assert c["Missing values"] == ("error", "1 NaN values (2.78% of data)")
    assert c["Feature range maximum"] == ("warning", "Max value 2.0000 above expected 1.0")
    assert c["Feature range minimum"] == ("pass", "Min: 0.5000")
    assert c["Duplicate rows"] == ("warning", "10 duplicates (83.3%)")


def test_wide_columns_and_selectors(spark):
    df = spark.createDataFrame([(0.1, 0.2, 1, "x", True)], "f_0 double, f_1 double, label int, filename string, augmented boolean")
    assert cu.loader_columns(df) == ["f_0", "f_1", "augmented"] and cu.validator_columns(df) == ["f_0", "f_1"]
    c = checks(df.select("f_0", "f_1", "label"), features=None)
    assert c["No missing values"][0] == "pass" and c["Feature range maximum"] == ("pass", "Max: 0.2000")
    assert checks(df.drop("label"))["Column 'label' exists"][0] == "error"


def test_sanitize(spark):
    df = labelled(spark, [(1, [float("nan"), math.inf, -math.inf, 3.0, -2.0, 0.5], 0)])
    assert df.select(cu.sanitized(F.col("features"))).first()[0] == [0.0, 1.0, 0.0, 1.0, 0.0, 0.5]
    assert df.select(cu.sanitized(F.col("features"), clip=False)).first()[0] == [0.0, 1.0, 0.0, 3.0, -2.0, 0.5]


def test_splits_are_exact_and_repeatable(spark):
    df = many(spark, 1000)
    split = lambda d: {r.id: r.split for r in cu.split_simple(d, ["id"]).collect()}
    a, b = split(df), split(df.repartition(13))
    assert a == b and len(a) == 1000
    assert [list(a.values()).count(s) for s in ("train", "val", "test")] == [700, 150, 150]
    per = cu.split_stratified(df, ["id"]).groupBy("label", "split").count().collect()
    n = {(r.label, r.split): r["count"] for r in per}
    assert n[(1, "train")] == round(334 * .7) and n[(0, "train")] == round(666 * .7) and sum(n.values()) == 1000
    with pytest.raises(ValueError):
        cu.split_simple(df, ["id"], ratios=(0.5, 0.1, 0.1))


def test_shuffle_is_a_permutation(spark):
    df = many(spark, 500)
    got = [r.id for r in cu.shuffled(df, "id").collect()]
    assert sorted(got) == list(range(500)) and got != list(range(500))
    assert got == [r.id for r in cu.shuffled(df.repartition(3), "id").collect()]


def test_oversample_counts_and_members(spark):
    df = many(spark, 900, share=9).select("id", "label")
    rows = cu.oversample(df, ["id"]).collect()
    ones = [r.id for r in rows if r.label == 1]
    assert len(ones) == 800 and all(i % 9 == 0 for i in ones) and len({*ones}) == 100
    assert len([r for r in rows if r.label == 0]) == 800
    picks = np.bincount([i // 9 for i in [r.id for r in rows if r.oversampled]], minlength=100)
    assert picks.sum() == 700 and picks.std() > 1  # drawn with replacement, not dealt evenly


def test_augment(spark):
    df = many(spark, 300, width=16)
    out = cu.augment(df, ["id"])
    a = {(r.id, r.copy): (r.strategy, tuple(r.features)) for r in out.collect()}
    b = {(r.id, r.copy): (r.strategy, tuple(r.features)) for r in cu.augment(df.repartition(5), ["id"]).collect()}
    assert a == b and len(a) == 1200
    assert {s for s, _ in a.values()} == {"original", "noise", "dropout", "shift", "scale", "combined"}
    base = {r.id: np.array(r.features, dtype=np.float32) for r in df.collect()}
    for (i, _), (s, f) in a.items():
        f, was = np.array(f), base[i]
        assert f.min() >= 0 and f.max() <= 1
        if s == "shift":
            inside = (f > 0) & (f < 1)
            d = (f - was)[inside]
            assert np.allclose(d, d[0], atol=1e-6) and abs(round(d[0] * 255) - d[0] * 255) < 1e-3 and abs(d[0] * 255) <= 8.001
        if s == "dropout":
            assert all(x == 0 or abs(x - y) < 1e-6 for x, y in zip(f, was))
        if s == "scale":
            inside = (f < 1) & (was > 0)
            k = f[inside] / was[inside]
            assert np.allclose(k, k[0], atol=1e-4) and 0.949 <= k[0] <= 1.051


def test_noise_moments(spark):
    df = spark.range(400).select("id", F.array_repeat(F.lit(0.5), 64).alias("features"))
    x = np.array([r.features for r in cu.with_strategy(df, ["id"], "noise").collect()]) - 0.5
    assert abs(x.mean()) < 0.002 and abs(x.std() - 0.05) < 0.002
    d = np.array([r.features for r in cu.with_strategy(df, ["id"], "dropout").collect()])
    assert abs((d == 0).mean() - 0.05) < 0.01
    t = np.array([r.features for r in cu.with_train_noise(df, ["id"]).collect()])
    same = (t == 0.5).all(axis=1).mean()
    assert 0.25 < same < 0.45  # neither change: 0.5 * 0.7


def test_partial_shuffle_keeps_values(spark):
    df = spark.range(20).select("id", F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i / 100.0).alias("features"))
    for r in cu.with_partial_shuffle(df, ["id"]).collect():
        f = np.array(r.features)
        moved = int((np.abs(f - np.arange(1, 101) / 100) > 1e-6).sum())
        assert np.allclose(np.sort(f), np.arange(1, 101) / 100, atol=1e-6) and 0 < moved <= 10


def test_normalize(spark):
    df = labelled(spark, [(1, [1.0, 5.0], 0), (2, [3.0, 5.0], 0)])
    z = [r.features for r in cu.normalized(df, cu.feature_moments(df)).orderBy("id").collect()]
    assert np.allclose(z, [[-1 / math.sqrt(2), 0], [1 / math.sqrt(2), 0]], atol=1e-6)


def test_matrix_checks(spark):
    x = labelled(spark, [(1, [1.0, math.inf], 0), (2, [float("nan"), 0.0], 1)])
    c = {r.check: r.status for r in cu.validate_matrix(x.select("id", "features"), x.where("id = 1").select("id", "label")).collect()}
    assert c == {"Shape match": "error", "No NaN in features": "error", "No Inf in features": "error",
                 "Valid labels": "pass", "Minimum samples": "error"}


def test_null_rows_are_not_repeats(spark):
    df = spark.createDataFrame([("a", None, [1.0]), (None, "a", [1.0]), ("b", None, None), ("b", None, [None]), ("b", None, [])],
                               "x string, y string, v array<double>")
    assert cu.duplicate_counts(df).first().duplicates == 0
    assert cu.duplicate_counts(df.union(df.limit(1))).first().duplicates == 1


def test_null_vectors_are_missing(spark):
    df = labelled(spark, [(1, [0.5, 0.5], 0), (2, None, 1)]).select("features", "label")
    row = cu.missing_check(cu._overall(cu.profile(df), "label")).first()
    assert row.status == "error" and row.detail.startswith("2 NaN values")


def test_many_classes_split_and_oversample(spark):
    df = spark.range(3000).select("id", (F.col("id") % 1500).cast("int").alias("label"))
    assert cu.split_stratified(df, ["id"]).count() == 3000
    rows = cu.oversample(spark.range(1000).select("id", F.when(F.col("id") == 0, 1).otherwise(0).alias("label")), ["id"])
    assert {r.label: r["count"] for r in rows.groupBy("label").count().collect()} == {0: 999, 1: 999}


def test_null_vectors_stay_null(spark):
    df = spark.createDataFrame([(1, None), (2, [0.5, 0.5])], "id long, features array<double>")
    got = {r.id: r.features for r in cu.with_strategy(df, ["id"], "noise").collect()}
    assert got[1] is None and len(got[2]) == 2


def test_many_stray_labels(spark):
    """20,000 invalid labels: a short cell that tells how many; weights of a stray large label."""
    df = spark.range(20_002).select(F.array(F.lit(0.5)).alias("features"), F.col("id").cast("int").alias("label"))
    row = cu.label_check(cu._overall(cu.profile(df), "label")).first()
    assert row.status == "error" and len(row.detail) < 300
    assert row.detail.startswith("Invalid labels: {10, 100, 1000, ") and row.detail.endswith(" and 19980 more}. Expected: {0, 1}")
    far = cu.class_weights(spark.createDataFrame([(0,), (1_000_000,)], "label int"))
    assert far.count() == 1_000_001 and far.where("weight > 0").count() == 2


def test_report_scans_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    labelled(spark, [(i, [0.1 * (i % 10), 0.5], i % 2) for i in range(300)]).select(
        F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("split"), "features", "label").write.parquet(path)
    df = spark.read.parquet(path)
    scans = []
    real = cu.O.written

    def written(d, label):
        scans.append(d._jdf.queryExecution().executedPlan().toString().count(path))
        return real(d, label)

    cu.O.written = written
    try:
        out = cu.validate(df, keys=["split"], total="all")
    finally:
        cu.O.written = real
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    leaves = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and path in line]
    assert len(scans) == 1 and len(leaves) == 1 and plan
    got = {(r.split, r.check): r.detail for r in out.collect()}
    assert got[("a", "Minimum samples")] == "150 samples" and got[("all", "Minimum samples")] == "300 samples"
    assert got[("all", "Duplicate rows")].startswith("290 duplicates")


def test_loader_stats_have_weights(spark):
    rows = [(i, [0.5], 0 if i % 4 else 2, "train" if i < 40 else "val") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int, split string")
    r = cu.loader_stats(df).first()
    assert (r.train_samples, r.num_classes) == (40, 3) and np.allclose(r.class_weights, [40 / 90, 0, 40 / 30])
