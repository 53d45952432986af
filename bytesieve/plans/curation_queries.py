"""Dataset-curation queries over the derived labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesieve.operators import curation as cu
from bytesieve.plans.evaluation_queries import rounded
from bytesieve.plans.registry import query
from bytesieve.plans.tables import cte, given, table

# Arithmetic shuffle key: DuckDB cannot repeat Spark's hash.
KEY = "(id * 7919 + 13) % 10007"
_L = cte("labelled") + """,
  v as (select id, label, unnest(features) as x from labelled),
  c as (select label, count(*) as n from labelled group by 1),
  o as (select count(*) as n, (select count(*) from v where isnan(x)) as missing, count(*) * 65 as cells,
      (select min(x) from v where not isnan(x)) as low, (select max(x) from v where not isnan(x)) as high from labelled),
  s as (select id, label, list_transform(features, lambda x: case when isnan(x) then 0.0::double
      else greatest(least(x, 1.0::double), 0.0::double) end) as f from labelled),
  r as (select id, label, row_number() over (order by (id * 7919 + 13) % 10007, id) as position,
      row_number() over (partition by label order by (id * 7919 + 13) % 10007, id) as class_position,
      count(*) over () as n, count(*) over (partition by label) as nc from labelled)
"""
_SIZE = """select 'Minimum samples' as "check", case when n < 100 then 'error' else 'pass' end as status,
  case when n < 100 then concat('Need 100, got ', n) else concat(n, ' samples') end as detail from o"""
_LABELS = """select 'Valid label values' as "check", case when bool_or(label not in (0, 1)) then 'error' else 'pass' end as status,
  concat('Found: {', string_agg(label::varchar, ', ' order by label), '}') as detail from c"""
_BALANCE = """select case when n < 10 then concat('Minimum samples for class ', label) else concat('Class ', label, ' sample count') end as "check",
    case when n < 10 then 'error' else 'pass' end as status,
    case when n < 10 then concat('Got ', n, ', need 10') else concat(n, ' samples') end as detail from c
  union all select case when max(n) / min(n)::double > 100 then 'Class imbalance' else 'Class balance' end,
    case when max(n) / min(n)::double > 100 then 'warning' else 'pass' end,
    concat('Ratio: ', printf('%.1f', max(n) / min(n)::double), ':1', case when max(n) / min(n)::double > 100 then ' (threshold: 100.0:1)' else '' end)
  from c having count(*) >= 2"""
_MISSING = """select case when missing > 0 then 'Missing values' else 'No missing values' end as "check",
  case when missing / cells::double > 0.01 then 'error' when missing > 0 then 'warning' else 'pass' end as status,
  case when missing > 0 then concat(missing, ' NaN values (', printf('%.2f', missing * 100 / cells::double), '% of data)') else '' end as detail from o"""
_RANGES = """select 'Feature range minimum' as "check", case when low < -0.01 then 'warning' else 'pass' end as status,
    case when low < -0.01 then concat('Min value ', printf('%.4f', low), ' below expected 0.0') else concat('Min: ', printf('%.4f', low)) end as detail from o
  union all select 'Feature range maximum', case when high > 1.01 then 'warning' else 'pass' end,
    case when high > 1.01 then concat('Max value ', printf('%.4f', high), ' above expected 1.0') else concat('Max: ', printf('%.4f', high)) end from o"""
_DUPS = """select case when count(*) > count(distinct (features, label)) then 'Duplicate rows' else 'No duplicate rows' end as "check",
  case when count(*) > count(distinct (features, label)) then 'warning' else 'pass' end as status,
  case when count(*) > count(distinct (features, label)) then concat(count(*) - count(distinct (features, label)), ' duplicates') else '' end as detail
  from labelled"""
_REPORT = f"""{_L}, chk as (select 'Column ''label'' exists' as "check", 'pass' as status, '' as detail
  union all {_SIZE} union all {_LABELS} union all {_BALANCE} union all {_MISSING} union all {_RANGES} union all {_DUPS})
"""


def labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "labelled")


def rows_only(spark, sf) -> DataFrame:
    return labelled(spark, sf).select("features", "label")


def clean(spark, sf) -> DataFrame:
    return labelled(spark, sf).withColumn("features", cu.sanitized(F.col("features")))


def overall(spark, sf):
    prof = cu.profile(rows_only(spark, sf))
    return prof, cu._overall(prof, "label")


@query("val_columns", _L + """select 'Column ''label'' exists' as "check", 'pass' as status, '' as detail, n as rows from o""")
def val_columns(spark, sf):
    df = rows_only(spark, sf)
    return cu.column_checks(df).withColumn("rows", df.agg(F.count("*").alias("n")).scalar())


@query("val_min_samples", _L + _SIZE)
def val_min_samples(spark, sf):
    return cu.size_check(overall(spark, sf)[1])


@query("val_labels", _L + _LABELS)
def val_labels(spark, sf):
    return cu.label_check(overall(spark, sf)[1])


@query("val_labels_raw", """with c as (select label from embeddings group by 1)
  select 'Valid label values' as "check", 'error' as status, concat('Invalid labels: {',
    string_agg(label::varchar, ', ' order by label::varchar) filter (label not in (0, 1)), '}. Expected: {0, 1}') as detail from c""")
def val_labels_raw(spark, sf):
    """Ten-class labels must fail the two-class check."""
    df = given(spark, sf, "embeddings").select(F.col("embedding").alias("features"), "label")
    return cu.label_check(cu._overall(cu.profile(df), "label"))


@query("val_class_balance", _L + _BALANCE)
def val_class_balance(spark, sf):
    return cu.balance_checks(*overall(spark, sf))


@query("val_missing", _L + _MISSING)
def val_missing(spark, sf):
    return cu.missing_check(overall(spark, sf)[1])


@query("val_ranges", _L + _RANGES)
def val_ranges(spark, sf):
    return cu.range_checks(overall(spark, sf)[1])


@query("val_duplicates", """with d as (select count(*) as n, count(*) - count(distinct (text, lang)) as d from documents)
  select case when d > 0 then 'Duplicate rows' else 'No duplicate rows' end as "check",
    case when d > 0 then 'warning' else 'pass' end as status,
    case when d / n::double > 0.1 then concat(d, ' duplicates (', printf('%.1f', d * 100 / n::double), '%)')
      when d > 0 then concat(d, ' duplicates') else '' end as detail from d""")
def val_duplicates(spark, sf):
    return cu.duplicate_check(given(spark, sf, "documents").select("text", "lang"))


@query("val_stats", _L + """select sum(n)::bigint as total_samples, 65 as total_columns, sum(n) filter (label = 0)::bigint as benign_count,
  sum(n) filter (label = 1)::bigint as malicious_count,
  round(sum(n) filter (label = 1) / sum(n) filter (label = 0)::double, 3) as imbalance_ratio, 64 as feature_count from c""")
def val_stats(spark, sf):
    df = rows_only(spark, sf)
    width = df.agg(F.max(F.size("features"))).scalar()
    return cu.dataset_stats(df, feature_count=width, column_count=width + len(df.columns) - 1)


@query("val_matrix", _L + """select 'Shape match' as "check", 'pass' as status, concat('X ', n, ', y ', n) as detail from o
  union all select 'No NaN in features', case when missing > 0 then 'error' else 'pass' end, '' from o
  union all select 'No Inf in features', 'pass', ''
  union all select 'Valid labels', 'pass', '0 invalid'
  union all select 'Minimum samples', case when n < 100 then 'error' else 'pass' end, concat(n, ' samples') from o""")
def val_matrix(spark, sf):
    df = labelled(spark, sf)
    return cu.validate_matrix(df.select("id", "features"), df.select("id", "label"))


@query("val_report", _REPORT + """select "check", status, detail, bool_and(status <> 'error') over () as is_valid from chk""")
def val_report(spark, sf):
    # A dozen rows: the unpartitioned window is over the report, not the data.
    return cu.validate(rows_only(spark, sf)).withColumn(
        "is_valid", F.bool_and(F.col("status") != "error").over(Window.partitionBy(F.lit(0))))


@query("val_all_splits", cte("labelled") + """,
  v as (select ['train', 'val', 'test'][cast(id % 3 as int) + 1] as split, label, features from labelled),
  u as (select split, unnest(features) as x from v),
  n as (select split, count(*) filter (isnan(x)) / (count(*) * 65 / 64)::double as share from u group by 1),
  c as (select split, label, count(*) as n from v group by 1, 2),
  t as (select split, sum(n) as n, min(n) as least_class from c group by 1),
  r as (select split, n >= 100 and least_class >= 10 and share <= 0.01 as is_valid from t join n using (split))
  select split, is_valid from r union all select 'all', bool_and(is_valid) from r""")
def val_all_splits(spark, sf):
    df = labelled(spark, sf).select(
        F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("id") % 3 + 1).cast("int")).alias("split"),
        "features", "label")
    per = cu.is_valid(cu.validate(df, keys=["split"]), ["split"])
    return per.unionByName(per.agg(F.lit("all").alias("split"), F.bool_and("is_valid").alias("is_valid")))


def _of_split(name: str, which: str) -> str:
    """The whole report of one part of the table."""
    start = cte("labelled")
    body = start[len("with labelled as ("):].rstrip()
    part = f"with labelled as (select * from ({body[:-1]}) where {which}), " + _REPORT[len(start):].lstrip(" ,\n")
    return f"""select '{name}' as split, * from ({part} select "check", status, detail from chk where "check" not like 'Column%')"""


@query("val_splits_report", " union all ".join(_of_split(n, w) for n, w in (
    ("train", "id % 3 = 0"), ("val", "id % 3 = 1"), ("test", "id % 3 = 2"), ("total", "true"))))
def val_splits_report(spark, sf):
    """Every check of every split and of all rows, from one profile by grouping sets and one pass for repeats."""
    df = labelled(spark, sf).select(
        F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("id") % 3 + 1).cast("int")).alias("split"),
        "features", "label")
    return cu.validate(df, keys=["split"], total="total")


@query("sanitize", _L + """select id, round(list_sum(f), 6) as total, round(list_min(f), 6) as low, round(list_max(f), 6) as high,
  len(list_filter(f, lambda x: x = 0)) as zeros from s""")
def sanitize(spark, sf):
    df = clean(spark, sf)
    return rounded(df.select(
        "id", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_min("features").alias("low"),
        F.array_max("features").alias("high"), F.size(F.filter("features", lambda x: x == 0)).cast("long").alias("zeros")))


@query("class_weights", _L + """select label, n as count, round(sum(n) over () / ((max(label) over () + 1) * n)::double, 6) as weight from c""")
def class_weights(spark, sf):
    return rounded(cu.class_weights(labelled(spark, sf)))


@query("class_weights_multi", """with c as (select label + (label >= 3)::int as label, count(*) as n from embeddings group by 1)
  select g.label::int as label, coalesce(n, 0) as count, coalesce(round((select sum(n) from c) / (11 * n)::double, 6), 0) as weight
  from generate_series(0, 10) g(label) left join c on g.label = c.label""")
def class_weights_multi(spark, sf):
    """Eleven classes, of which one, in the middle, is empty."""
    moved = given(spark, sf, "embeddings").withColumn("label", F.col("label") + F.when(F.col("label") >= 3, 1).otherwise(0))
    return rounded(cu.class_weights(moved))


@query("loader_stats", _L + """select count(*) filter (id % 3 = 0) as train_samples, count(*) filter (id % 3 = 1) as val_samples,
  count(*) filter (id % 3 = 2) as test_samples, count(*) as total_samples, 64 as feature_size, 2 as num_classes,
  (select string_agg(printf('%.6f', (select count(*) from labelled where id % 3 = 0) / (2 * n)::double), ',' order by label)
   from (select label, count(*) as n from labelled where id % 3 = 0 group by 1)) as class_weights from labelled""")
def loader_stats(spark, sf):
    df = labelled(spark, sf).withColumn("split", F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test"))
    return cu.loader_stats(df).withColumn("class_weights", F.array_join(F.transform("class_weights", lambda w: F.format_string("%.6f", w)), ","))


_BUCKET = "floor(_k / 64)"


@query("shuffle", _L + "select id, position from r")
def shuffle(spark, sf):
    return cu.with_position(labelled(spark, sf).select("id"), ["id"], F.expr(KEY), F.expr(_BUCKET))


@query("split_simple", _L + """select id, case when position <= floor(n * 0.70::double) then 'train'
  when position <= floor(n * 0.70::double) + floor(n * 0.15::double) then 'val' else 'test' end as split from r""")
def split_simple(spark, sf):
    return cu.split_simple(labelled(spark, sf).select("id"), ["id"], F.expr(KEY), F.expr(_BUCKET))


@query("split_stratified", _L + """select id, label, case when class_position <= round(nc * 0.70::double) then 'train'
  when class_position <= round(nc * 0.85::double) then 'val' else 'test' end as split from r""")
def split_stratified(spark, sf):
    return cu.split_stratified(labelled(spark, sf).select("id", "label"), ["id"], "label", F.expr(KEY), F.expr(_BUCKET))


def _bounds(df: DataFrame, *keep: str) -> DataFrame:
    inside = (F.array_min("features") >= 0) & (F.array_max("features") <= 1)
    return df.select(*keep, F.size("features").cast("long").alias("width"), inside.alias("in_range"))


@query("augment", _L + """select id, g.copy::int as copy, g.copy > 0 as augmented, 64::bigint as width, true as in_range, true as effective
  from labelled, generate_series(0, 3) g(copy)""")
def augment(spark, sf):
    """Originals as they were, and copies of which nearly all differ from them."""
    base = clean(spark, sf).withColumn("was", F.col("features"))  # copies carry what they were made of
    out = cu.augment(base, ["id"])
    out = out.withColumn("diff", F.zip_with("features", "was", lambda a, b: a.cast("double") - b))
    moved = F.avg(F.when(F.col("augmented"), _moved().cast("double")))
    kept = F.max(F.when(~F.col("augmented"), _moved().cast("int"))) == 0
    return _bounds(out, "id", "copy", "augmented").withColumn("effective", out.agg(kept & (moved > 0.8)).scalar())


@query("augment_strategies")
def augment_strategies(spark, sf):
    """Copies per strategy, with the mean change each one makes."""
    base = clean(spark, sf).withColumn("was", F.col("features"))
    out = cu.augment(base, ["id"]).where("augmented")
    change = F.aggregate(F.zip_with("features", "was", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("was")
    return out.groupBy("strategy").agg(F.count("*").alias("copies"), F.round(F.avg(change), 6).alias("mean_change"))


def _lawful(out: DataFrame, base: DataFrame, law, effect) -> DataFrame:
    """Per row: width, range, whether each change obeys the strategy; and whether the changes of all rows together have
    the size they should, which leaving the values alone has not."""
    both = out.select("id", F.transform("features", lambda x: x.cast("double")).alias("features")).join(
        base.select("id", F.col("features").alias("was")), "id")
    both = both.withColumn("diff", F.zip_with("features", "was", lambda a, b: a - b))
    ok = both.agg(effect).scalar()
    inside = (F.array_min("features") >= 0) & (F.array_max("features") <= 1)
    return both.select("id", F.size("features").cast("long").alias("width"), inside.alias("in_range"),
                       law.alias("lawful"), ok.alias("effective"))


_TWIN = _L + "select id, 64::bigint as width, true as in_range, true as lawful, true as effective from labelled"
_SAME = 1e-5


def _moved():
    return F.exists("diff", lambda d: F.abs(d) > _SAME)


def _share_moved():
    return F.avg(_moved().cast("double"))


def _spread(values, least: float):
    return F.coalesce(F.array_max(values) - F.array_min(values) < least, F.lit(True))


def _total(per_row):
    return F.sum(F.aggregate(per_row, F.lit(0.0), lambda a, x: a + x))


def _law(strategy: str):
    """(law per row, effect over all rows) of a strategy."""
    free = F.filter(F.arrays_zip("features", "was", "diff"),
                    lambda z: (z["features"] > 0) & (z["features"] < 1) & (z["was"] > 0.01))
    if strategy == "noise":
        squares = _total(F.transform(free, lambda z: z["diff"] * z["diff"]))
        return (~F.exists("diff", lambda d: F.abs(d) > 0.4),
                F.sqrt(squares / F.sum(F.size(free))).between(0.03, 0.06) & (_share_moved() > 0.99))
    if strategy == "dropout":
        gone = F.sum(F.size(F.filter("diff", lambda d: d < -_SAME))) / F.sum(F.size(F.filter("was", lambda w: w > _SAME)))
        return (~F.exists(F.arrays_zip("features", "diff"), lambda z: (z["features"] != 0) & (F.abs(z["diff"]) > _SAME)),
                gone.between(0.02, 0.09))
    if strategy == "shift":
        steps = F.transform(free, lambda z: z["diff"] * 255)
        whole = ~F.exists(steps, lambda x: (F.abs(x - F.round(x)) > 0.01) | (F.abs(x) > 8.01))
        return _spread(steps, 0.01) & whole, _share_moved() > 0.7
    ratios = F.transform(free, lambda z: z["features"] / z["was"])
    return _spread(ratios, 1e-3) & ~F.exists(ratios, lambda x: (x < 0.949) | (x > 1.051)), _share_moved() > 0.9


def _strategy_query(name: str, strategy: str):
    @query(name, _TWIN)
    def run(spark, sf):
        base = clean(spark, sf)
        return _lawful(cu.with_strategy(base, ["id"], strategy), base, *_law(strategy))
    return run


for _n, _s in (("aug_noise", "noise"), ("aug_dropout", "dropout"), ("aug_shift", "shift"), ("aug_scale", "scale")):
    _strategy_query(_n, _s)


@query("aug_partial_shuffle", _TWIN)
def aug_partial_shuffle(spark, sf):
    """The same values at other places, and not at more than a tenth of them."""
    base = clean(spark, sf)
    moved = F.size(F.filter("diff", lambda d: F.abs(d) > _SAME))
    same = F.forall(F.zip_with(F.array_sort("features"), F.array_sort("was"), lambda a, b: F.abs(a - b)), lambda d: d < _SAME)
    return _lawful(cu.with_partial_shuffle(base, ["id"]), base, same & (moved <= 6), F.avg((moved > 0).cast("double")) > 0.5)


@query("balance_oversample", _L + """select label, (select max(n) from c) as rows, n as originals from c""")
def balance_oversample(spark, sf):
    out = cu.oversample(labelled(spark, sf).select("id", "label"), ["id"])
    return out.groupBy("label").agg(F.count("*").alias("rows"), F.count(F.when(~F.col("oversampled"), 1)).alias("originals"))


@query("augment_dataset", _L + """select label, (select max(n) from c) * 4 as rows, n as originals, n * 3 as copies,
  (select max(n) * 4 * count(*) from c)::bigint as last_position from c""")
def augment_dataset(spark, sf):
    """Augmented, balanced and shuffled in one job."""
    out = cu.augment_dataset(clean(spark, sf), ["id"])
    per = out.groupBy("label").agg(
        F.count("*").alias("rows"), F.count(F.when(~F.col("augmented") & ~F.col("oversampled"), 1)).alias("originals"),
        F.count(F.when(F.col("augmented") & ~F.col("oversampled"), 1)).alias("copies"), F.max("position").alias("_p"))
    return per.withColumn("last_position", per.agg(F.max("_p")).scalar()).drop("_p")


@query("aug_stats", _L + """select n as original_size, n * 4 as augmented_size, 3 as augmentation_factor, 4.0::double as expansion_ratio from o""")
def aug_stats(spark, sf):
    return cu.augmentation_stats(labelled(spark, sf))


@query("tf_noise_dropout", _TWIN)
def tf_noise_dropout(spark, sf):
    base = clean(spark, sf)
    small = ~F.exists(F.arrays_zip("features", "diff"), lambda z: (z["features"] != 0) & (F.abs(z["diff"]) > 0.1))
    return _lawful(cu.with_train_noise(base, ["id"]), base, small, _share_moved().between(0.4, 0.85))


@query("tf_normalize", _L + """, u as (select id, unnest(f) as x, unnest(generate_series(1, 64)) as i from s),
  m as (select i, avg(x) as mean, stddev_samp(x) as sd from u group by 1)
  select id, round(sum((x - mean) / (sd + 1e-8)), 5) as total, round(max((x - mean) / (sd + 1e-8)), 5) as high
  from u join m using (i) group by id""")
def tf_normalize(spark, sf):
    df = clean(spark, sf)
    z = cu.normalized(df, cu.feature_moments(df))
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return z.select("id", F.round(total, 5).alias("total"), F.round(F.array_max("features"), 5).alias("high"))
