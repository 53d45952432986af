"""Evaluation of a table of (y_true, y_pred, y_prob).

Everything starts from one small aggregate: counts per (true, predicted) pair,
or counts per distinct score.  Neither grows with the rows, so nothing here
orders or partitions the raw rows by class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import ordered as O


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    t, p = F.col(y_true), F.col(y_pred)
    cell = lambda a, b: F.count(F.when((t == a) & (p == b), 1))
    return df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def class_counts(df: DataFrame) -> DataFrame:
    """Per class: rows of the class, rows predicted as it, and both."""
    pairs = df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")))))
    return sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def class_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    c = class_counts(df)
    precision, recall = _div(F.col("hits"), F.col("predicted")), _div(F.col("hits"), F.col("support"))
    return c.select("label", precision.alias("precision"), recall.alias("recall"),
                    _div(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"), "support", "hits")


def basic_metrics(df: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    n = F.sum("support")
    avg = lambda c: _div(F.sum(F.col(c) * F.col("support")), n).alias(c)
    return class_metrics(df).agg(_div(F.sum("hits"), n).alias("accuracy"), avg("f1"), avg("precision"), avg("recall"))


def class_f1(df: DataFrame) -> DataFrame:
    c = confusion(df)
    f1 = lambda hit: _div(2 * F.col(hit), 2 * F.col(hit) + F.col("fp") + F.col("fn"))
    return c.select(f1("tn").alias("f1_benign"), f1("tp").alias("f1_malicious"))


def error_rates(df: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df).select(
        _div(fp, fp + tn).alias("false_positive_rate"), _div(fn, fn + tp).alias("false_negative_rate"),
        _div(tp, tp + fn).alias("true_positive_rate"), _div(tn, tn + fp).alias("true_negative_rate"))


def mcc(df: DataFrame) -> DataFrame:
    """Matthews correlation, in DOUBLE throughout so large counts cannot overflow."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return confusion(df).select(
        _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def normalized_confusion(df: DataFrame) -> DataFrame:
    """Share of each prediction within its true class."""
    pairs = df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y_true")))


def class_report(df: DataFrame) -> DataFrame:
    """Per-class rows plus macro and weighted averages."""
    m = class_metrics(df)
    cols = ["precision", "recall", "f1"]
    n = F.sum("support")
    rows = m.select(F.col("label").cast("string").alias("row"), *cols, "support")
    macro = m.agg(F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in cols], n.alias("support"))
    weighted = m.agg(F.lit("weighted avg").alias("row"),
                     *[_div(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in cols], n.alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


# ------------------------------------------------------------ score curves

def threshold_counts(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob", rows: int = O.ROWS_PER_RANGE) -> DataFrame:
    """Per distinct score: its positives/negatives and those at or above it.

    Equal scores collapse first (partial aggregation per task).  The running
    sums then work in ranges of at most about ``rows`` distinct scores, so neither
    a popular score nor a crowded score range lands in one task.
    """
    per = df.groupBy(F.col(y_prob).alias("threshold")).agg(
        F.count(F.when(F.col(y_true) == 1, 1)).alias("pos"), F.count(F.when(F.col(y_true) == 0, 1)).alias("neg"))
    return O.with_ranged_sum(per, [F.col("threshold").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, rows=rows)


def roc_curve(df: DataFrame, **kw) -> DataFrame:
    """fpr and tpr per distinct threshold."""
    c = threshold_counts(df, **kw)
    # Every positive and negative is at or above the lowest score.
    totals = c.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("n")).alias("t")).scalar()
    return c.select("threshold", _div(F.col("fp"), totals["n"]).alias("fpr"), _div(F.col("tp"), totals["p"]).alias("tpr"))


def auc_roc(df: DataFrame, **kw) -> DataFrame:
    """Area under the ROC curve: pairs ranked right, ties count half; 0 for one class."""
    c = threshold_counts(df, **kw)
    # Negatives strictly below a score = all negatives - those at or above it.
    one = c.agg(
        F.sum(F.col("pos").cast("double") * F.col("fp")).alias("above"),
        F.sum(F.col("pos").cast("double") * F.col("neg")).alias("ties"),
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    right = F.col("p") * F.col("n") - F.col("above") + F.col("ties") / 2
    return one.select(_div(right, F.col("p") * F.col("n")).alias("auc_roc"))


def average_precision(df: DataFrame, **kw) -> DataFrame:
    """Step-wise area under precision/recall."""
    c = threshold_counts(df, **kw)
    return c.agg(_div(
        F.sum(_div(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"))


def best_threshold(df: DataFrame, **kw) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest threshold wins ties."""
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    return roc_curve(df, **kw).agg(
        F.max_by(F.struct("threshold", "fpr", "tpr"), F.struct(j, "threshold")).alias("b")).select(
        "b.threshold", "b.fpr", "b.tpr")


# ------------------------------------------------------------ epochs and gates

def best_epoch(epochs: DataFrame) -> DataFrame:
    """The epoch with the largest accuracy; the earliest wins ties."""
    return epochs.agg(F.max_by(F.struct(*epochs.columns), F.struct("accuracy", -F.col("epoch"))).alias("b")).select("b.*")


def running_best(epochs: DataFrame) -> DataFrame:
    """Best accuracy so far; long logs are ordered in ranges."""
    return O.with_ranged_sum(epochs.select("epoch", "accuracy"), [F.col("epoch")], {}, {"best_accuracy": F.col("accuracy")})


def metric_series(epochs: DataFrame, *metrics: str) -> DataFrame:
    """Metrics per epoch in one pass; missing values and missing metrics are 0."""
    return epochs.select("epoch", *[
        (F.coalesce(F.col(m), F.lit(0.0)) if m in epochs.columns else F.lit(0.0)).alias(m) for m in metrics])


def quality_gate(metrics: DataFrame, *, min_accuracy: float = rules.MIN_ACCURACY,
                 max_fnr: float = rules.MAX_FNR) -> DataFrame:
    """Accuracy high enough and few enough misses; an absent FNR counts as 1."""
    fnr = F.coalesce(F.col("false_negative_rate"), F.lit(1.0))
    return metrics.withColumn(
        "passed", (F.coalesce(F.col("accuracy"), F.lit(0.0)) >= min_accuracy) & (fnr <= max_fnr))
