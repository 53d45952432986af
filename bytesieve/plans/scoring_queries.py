"""Training and scoring queries over the labelled and logit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve import session
from bytesieve.operators import curation as cu
from bytesieve.operators import evaluation as ev
from bytesieve.operators import scoring as sc
from bytesieve.plans import registry
from bytesieve.plans.curation_queries import _BUCKET, KEY, _L, clean, labelled
from bytesieve.plans.evaluation_queries import rounded
from bytesieve.plans.registry import query
from bytesieve.plans.tables import cte, given, table

_P = cte("logits") + """, p as (select *, exp(l0 - greatest(l0, l1)) as e0, exp(l1 - greatest(l0, l1)) as e1 from logits),
  s as (select id, l0, l1, e0 / (e0 + e1) as benign_prob, e1 / (e0 + e1) as malicious_prob from p)
"""


def probs(spark, sf):
    return sc.with_softmax(table(spark, sf, "logits"))


@query("softmax_predict", _P + """select id, round(benign_prob, 6) as benign_prob, round(malicious_prob, 6) as malicious_prob,
  case when malicious_prob > benign_prob then 1 else 0 end as pred, round(greatest(benign_prob, malicious_prob), 6) as confidence,
  case when malicious_prob > benign_prob then 'MALICIOUS' else 'BENIGN' end as verdict from s""")
def softmax_predict(spark, sf):
    return rounded(probs(spark, sf).select("id", "benign_prob", "malicious_prob", "pred", "confidence", "verdict"))


@query("threshold_verdict", _P + """select id, case when malicious_prob >= 0.85 then 'BLOCK' else 'PASS' end as action from s""")
def threshold_verdict(spark, sf):
    return probs(spark, sf).select("id", sc.threshold_action(F.col("malicious_prob")).alias("action"))


@query("score_validity", _P + """select count(*) as rows, bool_and(benign_prob >= 0 and malicious_prob >= 0) as non_negative,
  bool_and(benign_prob <= 1 and malicious_prob <= 1) as at_most_one, bool_and(abs(benign_prob + malicious_prob - 1) <= 1e-5) as sums_to_one,
  bool_and(not isnan(l0) and not isnan(l1)) as no_nan, bool_and(not isinf(l0) and not isinf(l1)) as no_inf from s""")
def score_validity(spark, sf):
    return sc.score_validity(probs(spark, sf))


@query("score_diff", _P + """select count(*) as rows, round(max(greatest(abs(benign_prob - benign_prob::float::double),
    abs(malicious_prob - malicious_prob::float::double))), 9) as max_diff,
  max(greatest(abs(benign_prob - benign_prob::float::double), abs(malicious_prob - malicious_prob::float::double))) < 1e-4 as matches from s""")
def score_diff(spark, sf):
    """Double-precision scores against the same scores in single precision."""
    cols = ["benign_prob", "malicious_prob"]
    a = probs(spark, sf).select("id", *cols)
    b = a.select("id", *[F.col(c).cast("float").cast("double").alias(c) for c in cols])
    return rounded(sc.score_diff(a, b, "id", cols), 9)


@query("latency_stats", """select round(avg(value), 6) as mean_ms, min(value) as min_ms, count(value) as runs,
  round(quantile_cont(value, 0.95), 6) as p95_ms, avg(value) < 100 as mean_ok, quantile_cont(value, 0.95) < 200 as p95_ok from events""")
def latency_stats(spark, sf):
    return rounded(sc.latency_stats(given(spark, sf, "events").select(F.col("value").alias("ms"))))


_W = """with w as (select p_partkey as slot, 1 / (1 + exp(-((p_retailprice - 1000) / 100) / 2.0::double)) as importance from part)
"""


def weights(spark, sf):
    w = (F.col("p_retailprice") - 1000) / 100
    return given(spark, sf, "part").select(
        F.col("p_partkey").alias("slot"), sc.importance(w, 2.0).alias("importance"))


@query("feature_importance", _W + "select slot, round(importance, 6) as importance from w")
def feature_importance(spark, sf):
    return rounded(weights(spark, sf))


@query("top_features", _W + "select slot, round(importance, 6) as importance from w order by w.importance desc, slot limit 20")
def top_features(spark, sf):
    return rounded(sc.top_features(weights(spark, sf)))


def _newton_sql(width: int, steps: int = 8, ridge: float = 1.0) -> str:
    """CTEs w0 to w{steps}: weights of the logistic model after each step over tr (x with a leading 1, y, c); systems are
    solved by Gauss-Jordan elimination, a row of the matrix to a table row."""
    d = width + 1
    out = f"""w0 as (select list_transform(range(0, {d}), lambda i: 0.0::double) as w)"""
    for k in range(steps):
        out += f""",
  p{k} as (select x, c * (p - y) as g, c * p * (1 - p) as h
    from (select x, y, c, 1 / (1 + exp(-list_dot_product(x, w))) as p from tr, w{k})),
  e{k} as (select i, j, sum(x[i] * case when j > {d} then g else x[j] * h end) as v
    from p{k}, range(1, {d + 1}) t(i), range(1, {d + 2}) u(j) group by i, j),
  a{k} as (select i, list(v + case when i = 1 then 0 when i = j then {ridge} when j > {d} then {ridge} * w[i] else 0 end order by j) as r
    from e{k}, w{k} group by i),
  g{k} as (select 0 as n, i, r from a{k} union all
    select n + 1, i, case when i = n + 1 then list_transform(r, lambda v: v / top[n + 1])
        else list_transform(list_zip(r, top), lambda z: z[1] - r[n + 1] / top[n + 1] * z[2]) end
    from (select *, max(case when i = n + 1 then r end) over () as top from g{k} where n < {d})),
  w{k + 1} as (select list(w[i] - r[{d + 1}] order by i) as w from g{k}, w{k} where n = {d})"""
    return out


# classes weigh the same in sum: rows / (classes * rows of the class)
_FIT = _L.replace("with ", "with recursive ", 1) + f""",
  sp as ({registry.ORACLES["split_stratified"].replace(_L, "")}),
  k as (select label, count(*) as n from sp where split = 'train' group by 1),
  tr as (select list_concat([1.0::double], f) as x, s.label as y, (select sum(n) from k)::double / ((select count(*) from k) * k.n) as c
    from s join sp using (id) join k on k.label = s.label where split = 'train'),
  {_newton_sql(64)},
  h as (select id, s.label, 1 / (1 + exp(-list_dot_product(list_concat([1.0::double], f), w))) as score
    from s join sp using (id), w8 where split = 'test')
"""
def fitted(spark, sf):
    """Class-weighted Newton fit on the training split, and the scored rows held out for the test."""
    split = cu.split_stratified(labelled(spark, sf).select("id", "label"), ["id"], "label", F.expr(KEY), F.expr(_BUCKET))
    df = clean(spark, sf).join(split.select("id", "split"), "id")
    path = session.new_path(spark, "split")
    df.write.partitionBy("split").parquet(path)
    train, test = (spark.read.parquet(path).where(F.col("split") == part).drop("split") for part in ("train", "test"))
    return sc.linear_score(test, sc.newton(sc.with_class_weight(train), weight="weight"))


def judged(spark, sf):
    return fitted(spark, sf).select(F.col("label").alias("y_true"), (F.col("score") >= 0.5).cast("int").alias("y_pred"), "score")


@query("train_classifier", _FIT + "select label, (score >= 0.5)::int as predicted, count(*) as rows from h group by 1, 2")
def train_classifier(spark, sf):
    """Split, fit on the training rows, count (label, prediction) on the held-out ones."""
    return judged(spark, sf).groupBy(F.col("y_true").alias("label"), F.col("y_pred").alias("predicted")).agg(F.count("*").alias("rows"))


@query("held_out_gate", _FIT + """, m as (select count(*) filter (label = (score >= 0.5)::int) / count(*)::double as accuracy,
    count(*) filter (label = 1 and score < 0.5) / nullif(count(*) filter (label = 1), 0)::double as false_negative_rate from h)
  select round(accuracy, 6) as accuracy, round(coalesce(false_negative_rate, 0), 6) as false_negative_rate,
    accuracy >= 0.95 and coalesce(false_negative_rate, 0) <= 0.02 as passed from m""")
def held_out_gate(spark, sf):
    """Split, fit, score, metrics and gate in one run."""
    c = ev.confusion(judged(spark, sf))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    metrics = c.select(((F.col("tn") + F.col("tp")) / n).alias("accuracy"),
                       F.coalesce(F.col("fn") / F.nullif(F.col("fn") + F.col("tp"), F.lit(0)), F.lit(0.0)).alias("false_negative_rate"))
    return rounded(ev.quality_gate(metrics))


@query("train_mlp")
def train_mlp(spark, sf):
    df = clean(spark, sf)
    out = sc.score(df, sc.train(df, model="mlp"))
    return out.groupBy("label", (F.col("score") >= 0.5).cast("int").alias("predicted")).agg(F.count("*").alias("rows"))


@query("score_table", _FIT + "select id, round(score, 6) as score, case when score >= 0.85 then 'BLOCK' else 'PASS' end as action from h")
def score_table(spark, sf):
    """Held-out rows with their scores and actions."""
    return rounded(fitted(spark, sf).select("id", "score", sc.threshold_action(F.col("score")).alias("action")))


@query("score_external", cte("labelled") + """, s as (select id, list_transform(features, lambda x: case when isnan(x) then 0.0::double
      else greatest(least(x, 1.0::double), 0.0::double) end) as f from labelled)
  select id, round(list_sum(f[1:32]), 2) as l0, round(list_sum(f[33:64]), 2) as l1 from s""")
def score_external(spark, sf):
    """A supplied scorer on whole batches: sums of the two vector halves."""
    def load():
        return lambda x: __import__("numpy").stack([x[:, :32].sum(axis=1), x[:, 32:].sum(axis=1)], axis=1)
    return rounded(sc.score_with(clean(spark, sf), load).select("id", "l0", "l1"), 2)
