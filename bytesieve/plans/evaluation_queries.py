"""Evaluation queries over the derived predictions table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.operators import evaluation as ev
from bytesieve.plans.registry import query
from bytesieve.plans.tables import cte, given, table

P = cte("predictions")
_CM = P + """, cm as (select count(*) filter (y_true = 0 and y_pred = 0) as tn, count(*) filter (y_true = 0 and y_pred = 1) as fp,
  count(*) filter (y_true = 1 and y_pred = 0) as fn, count(*) filter (y_true = 1 and y_pred = 1) as tp from predictions)
"""
_CLS = P + """, c as (select l.label, count(*) filter (y_true = l.label) as support, count(*) filter (y_pred = l.label) as predicted,
    count(*) filter (y_true = l.label and y_pred = l.label) as hits
  from predictions, (values (0), (1)) l(label) group by 1),
  m as (select label, coalesce(hits / nullif(predicted, 0)::double, 0) as "precision", coalesce(hits / nullif(support, 0)::double, 0) as recall,
    coalesce(2 * hits / nullif(support + predicted, 0)::double, 0) as f1, support, hits from c)
"""
_ROC = P + """, g as (select y_prob as threshold, count(*) filter (y_true = 1) as pos, count(*) filter (y_true = 0) as neg
    from predictions group by 1),
  r as (select threshold, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n
    from g window w as (order by threshold desc rows unbounded preceding))
"""


def preds(spark, sf) -> DataFrame:
    return table(spark, sf, "predictions")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("confusion", _CM + "select * from cm")
def confusion(spark, sf):
    return ev.confusion(preds(spark, sf))


@query("basic_metrics", _CLS + """select round(sum(hits) / sum(support)::double, 6) as accuracy,
  round(sum(f1 * support) / sum(support), 6) as f1, round(sum("precision" * support) / sum(support), 6) as "precision",
  round(sum(recall * support) / sum(support), 6) as recall from m""")
def basic_metrics(spark, sf):
    return rounded(ev.basic_metrics(preds(spark, sf)))


@query("class_f1", _CLS + """select round(max(f1) filter (label = 0), 6) as f1_benign,
  round(max(f1) filter (label = 1), 6) as f1_malicious from m""")
def class_f1(spark, sf):
    return rounded(ev.class_f1(preds(spark, sf)))


@query("error_rates", _CM + """select round(coalesce(fp / nullif(fp + tn, 0)::double, 0), 6) as false_positive_rate,
  round(coalesce(fn / nullif(fn + tp, 0)::double, 0), 6) as false_negative_rate,
  round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as true_positive_rate,
  round(coalesce(tn / nullif(tn + fp, 0)::double, 0), 6) as true_negative_rate from cm""")
def error_rates(spark, sf):
    return rounded(ev.error_rates(preds(spark, sf)))


@query("mcc", _CM + """select round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6)
  as mcc from cm""")
def mcc(spark, sf):
    return rounded(ev.mcc(preds(spark, sf)))


@query("auc_roc", P + """, pr as (select y_true, rank() over (order by y_prob) as lo, count(*) over (partition by y_prob) as ties from predictions),
  s as (select sum(lo + (ties - 1) / 2.0::double) filter (y_true = 1) as rs, count(*) filter (y_true = 1)::double as p,
    count(*) filter (y_true = 0)::double as n from pr)
  select round(coalesce((rs - p * (p + 1) / 2) / nullif(p * n, 0), 0), 6) as auc_roc from s""")
def auc_roc(spark, sf):
    return rounded(ev.auc_roc(preds(spark, sf)))


@query("avg_precision", _ROC + "select round(sum(pos * tp / (tp + fp)::double) / sum(pos), 6) as average_precision from r")
def avg_precision(spark, sf):
    return rounded(ev.average_precision(preds(spark, sf)))


@query("roc_curve", _ROC + "select threshold, round(fp / n::double, 6) as fpr, round(tp / p::double, 6) as tpr from r")
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(preds(spark, sf)))


@query("best_threshold", _ROC + """select threshold, round(fp / n::double, 6) as fpr, round(tp / p::double, 6) as tpr
  from r order by round(tp / p::double - fp / n::double, 12) desc, threshold desc limit 1""")
def best_threshold(spark, sf):
    return rounded(ev.best_threshold(preds(spark, sf)))


@query("confusion_norm", P + """select y_true, y_pred, count(*) as n,
  round(count(*) / sum(count(*)) over (partition by y_true)::double, 6) as share from predictions group by 1, 2""")
def confusion_norm(spark, sf):
    return rounded(ev.normalized_confusion(preds(spark, sf)))


@query("class_report", _CLS + """
  select label::varchar as "row", round("precision", 6) as "precision", round(recall, 6) as recall, round(f1, 6) as f1, support from m
  union all select 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from m
  union all select 'weighted avg', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from m""")
def class_report(spark, sf):
    return rounded(ev.class_report(preds(spark, sf)))


# One epoch row per user: shares and means over that user's events.
_EPOCHS = """with epochs as (select user_id as epoch, round(avg(value) / 490, 6) as loss,
    round(count(*) filter (value > 100) / count(*)::double, 2) as accuracy,
    case when user_id % 5 = 0 then null else round(count(*) filter (event_type = 'error') / count(*)::double, 6) end as false_negative_rate
  from events group by user_id)
"""


def epochs(spark, sf) -> DataFrame:
    return given(spark, sf, "events").groupBy(F.col("user_id").alias("epoch")).agg(
        F.round(F.avg("value") / 490, 6).alias("loss"),
        F.round(F.count(F.when(F.col("value") > 100, 1)) / F.count("*"), 2).alias("accuracy"),
        F.when(F.col("user_id") % 5 != 0, F.round(
            F.count(F.when(F.col("event_type") == "error", 1)) / F.count("*"), 6)).alias("false_negative_rate"))


@query("epoch_best", _EPOCHS + "select * from epochs order by accuracy desc, epoch limit 1")
def epoch_best(spark, sf):
    return ev.best_epoch(epochs(spark, sf))


@query("epoch_running_best", _EPOCHS + """select epoch, accuracy,
  max(accuracy) over (order by epoch rows unbounded preceding) as best_accuracy from epochs""")
def epoch_running_best(spark, sf):
    return ev.running_best(epochs(spark, sf))


@query("metric_series", _EPOCHS + """select epoch, coalesce(false_negative_rate, 0) as false_negative_rate, loss,
  0.0::double as f1 from epochs""")
def metric_series(spark, sf):
    return ev.metric_series(epochs(spark, sf), "false_negative_rate", "loss", "f1")


@query("quality_gate", _EPOCHS + """select epoch, accuracy, false_negative_rate,
  accuracy >= 0.8 and coalesce(false_negative_rate, 1) <= 0.2 as passed from epochs""")
def quality_gate(spark, sf):
    return ev.quality_gate(epochs(spark, sf).drop("loss"), min_accuracy=0.8, max_fnr=0.2)
