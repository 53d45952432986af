"""Training, scoring and score checks."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import ordered as O
from bytesieve.operators import curation


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Add rows / (classes * class rows) as a constant per class."""
    weights = curation.class_weights(df, label).select(F.col("label").cast(df.schema[label].dataType).alias(label), "weight")
    return O.lookup(df, weights, [label], [c for c in df.columns if c != label])


def train(df: DataFrame, features: str = "features", label: str = "label", *, model: str = "logistic",
          max_iter: int = 20, seed: int = 42, hidden: int = 32):
    """Fit a two-class model: ``logistic`` (class-weighted) or ``mlp``."""
    data = with_class_weight(df.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"),
                                       F.col(label).cast("int").alias(label)), label)
    if model == "logistic":
        est = LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", maxIter=max_iter)
    elif model == "mlp":
        width = len(df.select(features).first()[0])
        est = MultilayerPerceptronClassifier(
            featuresCol="x", labelCol=label, layers=[width, hidden, 2], maxIter=max_iter, seed=seed)
    else:
        raise ValueError(f"unknown model {model}")
    return est.fit(data)


def score(df: DataFrame, model, features: str = "features") -> DataFrame:
    """Add ``score`` (probability of class 1) with a fitted model."""
    out = model.transform(df.withColumn("x", array_to_vector(F.col(features).cast("array<double>"))))
    return out.select(*df.columns, F.element_at(vector_to_array("probability"), 2).alias("score"))


@dataclass
class Linear:
    """Weights of a logistic model, the bias first."""
    weights: np.ndarray


def _hessian_parts(df: DataFrame, features: str, label: str, weight: str, w: np.ndarray) -> np.ndarray:
    """Sum over all rows of (gradient, Hessian) of the weighted log-loss: one row per task, added up by place."""
    d = len(w)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ones((batch.num_rows, d))
            x[:, 1:] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d - 1)
            y, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            p = 1 / (1 + np.exp(-(x @ w)))
            total[:, 0] += x.T @ (c * (p - y))
            total[:, 1:] += (x * (c * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * (d + 1))), pa.array(total.ravel())], names=["at", "v"])

    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"),
                     F.col(weight).cast("double").alias("c")).mapInArrow(of, "at long, v double")
    got = rows.groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(d * (d + 1))
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(d, d + 1)


def newton(df: DataFrame, features: str = "features", label: str = "label", weight: str | None = None, *,
           steps: int = 8, ridge: float = 1.0, most: int = 1024) -> Linear:
    """Logistic regression by Newton's method: each step is one aggregation of gradient and Hessian over all rows.

    The driver solves a system as wide as the features (refused beyond ``most``), never sees a row, and holds nothing that
    grows with them.  ``ridge`` pulls every weight but the bias towards zero, so separable classes converge too.
    """
    df = df.withColumn("_c", F.lit(1.0) if weight is None else F.col(weight))
    width = df.select(F.max(F.size(features))).first()[0] or 0
    if width > most:
        raise ValueError(f"{width} features are more than {most}")
    w = np.zeros(width + 1)
    pull = np.full(width + 1, ridge)
    pull[0] = 0
    for _ in range(steps):
        parts = _hessian_parts(df, features, label, "_c", w)
        h = parts[:, 1:] + np.diag(pull)
        if not h[0, 0]:
            break  # no rows
        w = w - np.linalg.solve(h, parts[:, 0] + pull * w)
    return Linear(w)


def linear_score(df: DataFrame, model: Linear, features: str = "features") -> DataFrame:
    """Add ``score`` (probability of class 1) without leaving generated code."""
    terms = F.zip_with(F.col(features).cast("array<double>"), F.array(*[F.lit(float(v)) for v in model.weights[1:]]), lambda a, b: a * b)
    z = F.aggregate(terms, F.lit(float(model.weights[0])), lambda a, x: a + x)
    return df.withColumn("score", 1 / (1 + F.exp(-z)))


def score_with(df: DataFrame, load: Callable[[], Callable], features: str = "features", batch: int = 1024) -> DataFrame:
    """Add logits of a supplied scorer: loaded once per task, fed whole batches.

    ``load()`` runs on the executor and returns a function from an (n, width)
    float32 matrix to an (n, 2) logit matrix.
    """
    @F.pandas_udf("array<double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        fn = load()
        for s in it:
            parts = [np.asarray(fn(np.stack(s.iloc[i:i + batch].to_numpy()).astype(np.float32)), dtype=np.float64)
                     for i in range(0, len(s), batch)]
            yield pd.Series(list(np.concatenate(parts)) if parts else [])

    logits = df.withColumn("_z", run(F.col(features)))
    return logits.select(*df.columns, F.element_at("_z", 1).alias("l0"), F.element_at("_z", 2).alias("l1"))


def onnx_loader(path: str) -> Callable[[], Callable]:
    """Loader for a saved model with an ``input`` and an ``output`` tensor."""
    def load() -> Callable:
        import onnxruntime as ort
        opts = ort.SessionOptions()
        opts.intra_op_num_threads = 1
        session = ort.InferenceSession(path, opts, providers=["CPUExecutionProvider"])
        return lambda x: session.run(["output"], {"input": x})[0]
    return load


# ------------------------------------------------------------ logits and probabilities

def with_softmax(df: DataFrame, l0: str = "l0", l1: str = "l1") -> DataFrame:
    """Probabilities, label, confidence and verdict from two logits."""
    top = F.greatest(l0, l1)
    e0, e1 = F.exp(F.col(l0) - top), F.exp(F.col(l1) - top)
    return (
        df.withColumn("benign_prob", e0 / (e0 + e1)).withColumn("malicious_prob", e1 / (e0 + e1))
        .withColumn("pred", F.when(F.col("malicious_prob") > F.col("benign_prob"), 1).otherwise(0))
        .withColumn("confidence", F.greatest("benign_prob", "malicious_prob"))
        .withColumn("verdict", F.when(F.col("pred") == 1, "MALICIOUS").otherwise("BENIGN"))
    )


def threshold_action(prob: Column, threshold: float = rules.MALWARE_THRESHOLD) -> Column:
    return F.when(prob >= threshold, "BLOCK").otherwise("PASS")


def score_validity(df: DataFrame) -> DataFrame:
    """One row: are all probabilities in range, summing to 1, and finite?"""
    p0, p1 = F.col("benign_prob"), F.col("malicious_prob")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.agg(
        F.count("*").alias("rows"), F.bool_and((p0 >= 0) & (p1 >= 0)).alias("non_negative"),
        F.bool_and((p0 <= 1) & (p1 <= 1)).alias("at_most_one"),
        F.bool_and(F.abs(p0 + p1 - 1) <= rules.PROB_SUM_TOLERANCE).alias("sums_to_one"),
        F.bool_and(~F.isnan("l0") & ~F.isnan("l1")).alias("no_nan"),
        F.bool_and(finite(F.col("l0")) & finite(F.col("l1"))).alias("no_inf"))


def score_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str], limit: float = rules.MAX_SCORE_DIFF) -> DataFrame:
    """Largest absolute difference of two scorers on the same keys."""
    right = b.select(key, *[F.col(c).alias("_r_" + c) for c in columns])
    gap = F.greatest(*[F.abs(F.col(c) - F.col("_r_" + c)) for c in columns]) if len(columns) > 1 else \
        F.abs(F.col(columns[0]) - F.col("_r_" + columns[0]))
    return a.join(right, key).agg(F.count("*").alias("rows"), F.max(gap).alias("max_diff")).withColumn(
        "matches", F.col("max_diff") < limit)


# ------------------------------------------------------------ timings and importance

def exact_percentile(df: DataFrame, value: str, share: float, rows: int = O.ROWS_PER_RANGE) -> DataFrame:
    """One row: the linearly interpolated percentile.

    Spark's ``percentile`` gathers every distinct value in one task.  Here the
    values are counted, cumulated in ranges, and only the two
    neighbours of the wanted position are kept.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    cum = O.with_ranged_sum(per, [F.col(value)], {"_upto": F.col("_c")}, rows=rows)
    at = F.lit(share) * (F.col("_n") - 1)
    placed = cum.withColumn("_n", cum.agg(F.max("_upto").alias("n")).scalar())
    low = F.min(F.when(F.col("_upto") >= F.floor(at) + 1, F.col(value)))
    high = F.min(F.when(F.col("_upto") >= F.ceil(at) + 1, F.col(value)))
    one = placed.agg(low.alias("_lo"), high.alias("_hi"), F.max("_n").alias("_n"))
    return one.select((F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))).alias("percentile"))


def latency_stats(df: DataFrame, millis: str = "ms") -> DataFrame:
    """Mean, 95th percentile and minimum, with the two latency gates."""
    base = df.agg(F.avg(millis).alias("mean_ms"), F.min(millis).alias("min_ms"), F.count(millis).alias("runs"))
    p95 = exact_percentile(df, millis, 0.95).scalar()
    return base.withColumn("p95_ms", p95).withColumn("mean_ok", F.col("mean_ms") < rules.MAX_MEAN_MS).withColumn(
        "p95_ok", F.col("p95_ms") < rules.MAX_P95_MS)


def importance(weight: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-weight / F.lit(temperature)))


def top_features(df: DataFrame, k: int = 20, by: str = "importance", slot: str = "slot") -> DataFrame:
    """The k most important slots; the lower slot wins ties."""
    return df.orderBy(F.desc(by), slot).limit(k)
