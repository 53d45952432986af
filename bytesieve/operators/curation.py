"""Labelled tables: checks, cleaning, splits, weights, augmentation, balance."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import ordered as O
from bytesieve.functions import perturb

ORDER_BUCKETS = 4096
PIECE = 1 << 16


# ------------------------------------------------------------ column choice

def loader_columns(df: DataFrame, label: str = "label") -> list[str]:
    """Training columns: everything but the label and the file name."""
    return [c for c in df.columns if c not in (label, "filename")]


def validator_columns(df: DataFrame) -> list[str]:
    """Checked columns: those named ``f_*``."""
    return [c for c in df.columns if c.startswith("f_")]


def as_array(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Fold wide feature columns into one array column."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, however many classes there are."""
    return df.groupBy(label).agg(F.count("*").alias("class_rows"))


# ------------------------------------------------------------ checks

def _row(check, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check") if isinstance(check, str) else check.alias("check"),
                    status.alias("status"), detail.alias("detail"))


def _status(bad: Column, level: str) -> Column:
    return F.when(bad, F.lit(level)).otherwise(F.lit("pass"))


def _fmt(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def column_checks(df: DataFrame, required: tuple[str, ...] = ("label",)) -> DataFrame:
    """Required columns are present: known from the schema, no scan."""
    rows = [(f"Column '{c}' exists", "pass" if c in df.columns else "error",
             "" if c in df.columns else f"Available: {df.columns}") for c in required]
    return df.sparkSession.createDataFrame(rows, "check string, status string, detail string")


def _grouped(df: DataFrame, keys: list[str], by: str, total: str | None):
    """Groups per (keys, by); with ``total`` also per ``by`` alone, from the same rows by grouping sets."""
    if total is None or not keys:
        return df.groupBy(*keys, by)
    return df.groupingSets([[*keys, by], [by]], *keys, by)


def _named_total(df: DataFrame, keys: list[str], total: str | None) -> DataFrame:
    """The keys of the rows over all groups read ``total``; needs ``_set``, the grouping id."""
    if total is None or not keys:
        return df
    return df.withColumns({k: F.when(F.col("_set") == 0, F.col(k)).otherwise(F.lit(total)) for k in keys}).drop("_set")


def _grouping_id(keys: list[str], total: str | None) -> list[Column]:
    return [F.grouping_id().alias("_set")] if total is not None and keys else []


def profile(df: DataFrame, features: str | None = "features", label: str = "label", keys: list[str] = (),
            total: str | None = None) -> DataFrame:
    """One scan: rows, missing cells, cells and feature extremes per class (and per ``keys``, and in total).

    The result is a row per class; it is written once, for every check reads it."""
    keys = list(keys)
    src = df if features else as_array(df, validator_columns(df))
    arr = F.col(features or "features")
    extra = len([c for c in src.columns if c not in (features or "features", *keys)])
    missing = F.coalesce(F.size(F.filter(arr, lambda x: x.isNull() | F.isnan(x))), F.lit(0))
    for c in src.columns:
        if c not in (features or "features", *keys):
            missing = missing + F.col(c).isNull().cast("int")
    seen = F.filter(arr, lambda x: x.isNotNull() & ~F.isnan(x))
    facts = src.select(*keys, label, missing.alias("_missing"), (F.coalesce(F.size(arr), F.lit(0)) + extra).alias("_cells"),
                       arr.isNull().alias("_absent"), F.size(arr).alias("_width"),
                       F.array_min(seen).alias("_low"), F.array_max(seen).alias("_high"))
    out = _grouped(facts, keys, label, total).agg(
        F.count("*").alias("n"), F.sum("_missing").alias("missing"), F.sum("_cells").alias("cells"),
        F.count(F.when(F.col("_absent"), 1)).alias("absent"), F.max("_width").alias("width"),
        F.min("_low").alias("low"), F.max("_high").alias("high"), *_grouping_id(keys, total))
    return O.written(_named_total(out, keys, total), "profile")


LISTED = 20


def _overall(prof: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """One row (per ``keys``) of a profile: sums over classes, and the labels, at most ``LISTED`` of either kind."""
    keys = list(keys)
    bad = ~F.coalesce(F.col(label).isin(rules.VALID_LABELS), F.lit(False))
    o = prof.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        # a NULL vector lacks as many cells as the others have
        (F.sum("missing") + F.sum("absent") * F.coalesce(F.max("width"), F.lit(0))).alias("missing"),
        (F.sum("cells") + F.sum("absent") * F.coalesce(F.max("width"), F.lit(0))).alias("cells"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count("*").alias("classes"),
        F.count(F.when(bad, F.col(label))).alias("invalid_labels"))
    named = prof.where(F.col(label).isNotNull()).select(*keys, F.col(label).cast("string").alias("_text"), bad.alias("_bad"))
    first = named.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_bad").orderBy("_text"))).where(F.col("_at") <= LISTED)
    some = lambda which: F.array_join(F.sort_array(F.collect_list(F.when(which, F.col("_text")))), ", ")
    lists = first.withColumn("_one", F.lit(0)).groupBy(*keys, "_one").agg(
        some(~F.col("_bad")).alias("labels"), some(F.col("_bad")).alias("invalid"))
    out = O.null_safe_join(o.withColumn("_one", F.lit(0)), lists, [*keys, "_one"], "left").drop("_one")
    more = F.when(F.col("invalid_labels") > LISTED, F.format_string(" and %d more", F.col("invalid_labels") - LISTED)).otherwise("")
    return out.withColumn("invalid", F.concat(F.coalesce("invalid", F.lit("")), more)).fillna("", ["labels"])


def _size_rows(minimum: int) -> Column:
    bad = F.col("n") < minimum
    return F.array(_row("Minimum samples", _status(bad, "error"), F.when(
        bad, _fmt(f"Need {minimum}, got %d", F.col("n"))).otherwise(_fmt("%d samples", F.col("n")))))


def size_check(o: DataFrame, minimum: int = rules.MIN_SAMPLES, keys: list[str] = ()) -> DataFrame:
    return o.select(*keys, F.inline(_size_rows(minimum)))


def _label_rows() -> Column:
    bad = F.col("invalid_labels") > 0
    return F.array(_row("Valid label values", _status(bad, "error"), F.when(
        bad, _fmt("Invalid labels: {%s}. Expected: {0, 1}", F.col("invalid"))).otherwise(
        _fmt("Found: {%s}", F.col("labels")))))


def label_check(o: DataFrame, keys: list[str] = ()) -> DataFrame:
    return o.select(*keys, F.inline(_label_rows()))


def class_checks(prof: DataFrame, label: str = "label", keys: list[str] = ()) -> DataFrame:
    small = F.col("n") < rules.MIN_SAMPLES_PER_CLASS
    return prof.select(*keys, F.inline(F.array(_row(
        F.when(small, _fmt("Minimum samples for class %s", F.col(label).cast("string"))).otherwise(
            _fmt("Class %s sample count", F.col(label).cast("string"))), _status(small, "error"),
        F.when(small, _fmt(f"Got %d, need {rules.MIN_SAMPLES_PER_CLASS}", F.col("n"))).otherwise(
            _fmt("%d samples", F.col("n")))))))


def _ratio_rows() -> Column:
    ratio = F.col("largest") / F.col("smallest")
    text = _fmt("%.1f", F.bround(ratio, 1))
    wide = ratio > rules.MAX_IMBALANCE
    rows = F.array(_row(
        F.when(wide, F.lit("Class imbalance")).otherwise(F.lit("Class balance")), _status(wide, "warning"),
        F.when(wide, F.concat(F.lit("Ratio: "), text, F.lit(f":1 (threshold: {rules.MAX_IMBALANCE}:1)")))
        .otherwise(F.concat(F.lit("Ratio: "), text, F.lit(":1")))))
    return F.filter(rows, lambda _: F.col("classes") >= 2)


def balance_checks(prof: DataFrame, o: DataFrame, label: str = "label", keys: list[str] = ()) -> DataFrame:
    return class_checks(prof, label, keys).unionByName(o.select(*keys, F.inline(_ratio_rows())))


def _missing_rows() -> Column:
    share = F.coalesce(F.col("missing") / F.nullif(F.col("cells"), F.lit(0)), F.lit(0.0))
    some = F.col("missing") > 0
    return F.array(_row(
        F.when(some, F.lit("Missing values")).otherwise(F.lit("No missing values")),
        F.when(share > rules.MAX_NAN_FRACTION, "error").when(some, "warning").otherwise("pass"),
        F.when(some, F.concat(_fmt("%d NaN values (", F.col("missing")), _fmt("%.2f", F.bround(share * 100, 2)),
                              F.lit("% of data)"))).otherwise(F.lit(""))))


def missing_check(o: DataFrame, keys: list[str] = ()) -> DataFrame:
    return o.select(*keys, F.inline(_missing_rows()))


def _range_rows() -> Column:
    low, high = rules.FEATURE_RANGE
    four = lambda c: _fmt("%.4f", F.bround(F.col(c), 4))
    under, over = F.col("low") < low, F.col("high") > high
    return F.when(F.col("low").isNull(), F.array(
        _row("Feature columns", F.lit("warning"), F.lit("No columns starting with 'f_' found")))).otherwise(F.array(
            _row("Feature range minimum", _status(under, "warning"), F.when(
                under, F.concat(F.lit("Min value "), four("low"), F.lit(" below expected 0.0"))).otherwise(
                F.concat(F.lit("Min: "), four("low")))),
            _row("Feature range maximum", _status(over, "warning"), F.when(
                over, F.concat(F.lit("Max value "), four("high"), F.lit(" above expected 1.0"))).otherwise(
                F.concat(F.lit("Max: "), four("high"))))))


def range_checks(o: DataFrame, keys: list[str] = ()) -> DataFrame:
    return o.select(*keys, F.inline(_range_rows()))


def duplicate_counts(df: DataFrame, keys: list[str] = (), total: str | None = None) -> DataFrame:
    """Rows and full-row repeats.

    Rows are compared by a 128-bit hash of an encoding that tells NULL from a
    value and one array from the next, so the shuffle carries 16 bytes per row,
    and repeats collapse before it.
    """
    keys = list(keys)
    cols = [c for c in df.columns if c not in keys]
    hashed = df.select(*keys, F.unhex(F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).cast("binary"))).alias("_h"))
    same = _grouped(hashed, keys, "_h", total).agg(F.count("*").alias("n"), *_grouping_id(keys, total))
    return _named_total(same, keys, total).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("duplicates"))


def duplicate_check(df: DataFrame, keys: list[str] = (), total: str | None = None) -> DataFrame:
    d, share = F.col("duplicates"), F.col("duplicates") / F.col("n")
    return duplicate_counts(df, keys, total).select(*keys, F.inline(F.array(_row(
        F.when(d > 0, F.lit("Duplicate rows")).otherwise(F.lit("No duplicate rows")), _status(d > 0, "warning"),
        F.when(share > 0.1, F.concat(_fmt("%d duplicates (", d), _fmt("%.1f", F.bround(share * 100, 1)), F.lit("%)")))
        .when(d > 0, _fmt("%d duplicates", d)).otherwise(F.lit(""))))))


def validate(df: DataFrame, features: str | None = "features", label: str = "label", *,
             minimum: int = rules.MIN_SAMPLES, keys: list[str] = (), total: str | None = None) -> DataFrame:
    """Every check as rows of (check, status, detail), per ``keys`` if given, and with ``total`` over all groups too (their
    keys then read ``total``).

    Two scans: one profile per class, whose few rows every check but the last reads, and one hash pass for repeats.
    """
    if label not in df.columns:
        return column_checks(df, (label,))
    keys = list(keys)
    prof = profile(df, features, label, keys, total)
    o = _overall(prof, label, keys)
    whole = o.select(*keys, F.inline(F.concat(_size_rows(minimum), _label_rows(), _ratio_rows(), _missing_rows(), _range_rows())))
    out = whole.unionByName(class_checks(prof, label, keys)).unionByName(duplicate_check(df, keys, total))
    return out if keys else column_checks(df, (label,)).unionByName(out)


def is_valid(checks: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Valid iff no check is an error."""
    return checks.groupBy(*keys).agg(F.bool_and(F.col("status") != "error").alias("is_valid"))


def dataset_stats(df: DataFrame, feature_count, column_count, label: str = "label") -> DataFrame:
    """Counts of rows, columns and classes; the two widths are numbers or scalar columns."""
    number = lambda v: v if isinstance(v, Column) else F.lit(v)
    c = lambda v: F.count(F.when(F.col(label) == v, 1))
    s = df.agg(F.count("*").alias("total_samples"), c(0).alias("benign_count"), c(1).alias("malicious_count"))
    return s.select(
        "total_samples", number(column_count).alias("total_columns"), "benign_count", "malicious_count",
        F.bround(F.col("malicious_count") / F.nullif("benign_count", F.lit(0)), 3).alias("imbalance_ratio"),
        number(feature_count).alias("feature_count"))


def validate_matrix(x: DataFrame, y: DataFrame, key: str = "id", minimum: int = rules.MIN_SAMPLES) -> DataFrame:
    """Feature rows and label rows: same keys, finite values, valid labels, enough rows."""
    joined = x.join(y, key, "full_outer")
    one = joined.agg(
        F.count("features").alias("xs"), F.count("label").alias("ys"),
        F.coalesce(F.bool_or(F.exists("features", lambda v: F.isnan(v))), F.lit(False)).alias("nan"),
        F.coalesce(F.bool_or(F.exists("features", lambda v: F.abs(v) == float("inf"))), F.lit(False)).alias("inf"),
        F.count(F.when(~F.col("label").isin(rules.VALID_LABELS), 1)).alias("bad"))
    return one.select(F.inline(F.array(
        _row("Shape match", _status(F.col("xs") != F.col("ys"), "error"), _fmt("X %d, y %d", F.col("xs"), F.col("ys"))),
        _row("No NaN in features", _status(F.col("nan"), "error"), F.lit("")),
        _row("No Inf in features", _status(F.col("inf"), "error"), F.lit("")),
        _row("Valid labels", _status(F.col("bad") > 0, "error"), _fmt("%d invalid", F.col("bad"))),
        _row("Minimum samples", _status(F.col("xs") < minimum, "error"), _fmt("%d samples", F.col("xs"))))))


# ------------------------------------------------------------ cleaning and weights

def sanitized(features: Column, *, clip: bool = True) -> Column:
    """NaN and NULL to 0, +Inf to 1, -Inf to 0, then clip to [0, 1]."""
    def fix(x: Column) -> Column:
        v = F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))
        if clip:
            return F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
        return F.when(v == float("inf"), F.lit(1.0)).when(v == float("-inf"), F.lit(0.0)).otherwise(v)
    return F.transform(features, fix)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """rows / (classes * class rows); classes = largest label + 1, empty class 0.  Absent labels come from a range, so a
    stray large label makes many rows but no large one."""
    counts = O.written(df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("n")), "class-sizes")
    total, classes = counts.agg(F.sum("n"), F.max("label") + 1).first()
    every = df.sparkSession.range(classes or 0).select(F.col("id").alias("label"))
    kind = df.schema[label].dataType
    return every.join(counts, "label", "left").select(
        F.col("label").cast(kind).alias("label"), F.coalesce("n", F.lit(0)).alias("count"),
        F.coalesce(F.lit(total) / (F.lit(classes) * F.col("n")), F.lit(0.0)).alias("weight"))


def loader_stats(splits: DataFrame, split: str = "split", label: str = "label", most_classes: int = 10_000) -> DataFrame:
    """Rows per split, total, vector width, classes and class weights of the training split (one cell lists the weights,
    so more than ``most_classes`` are refused)."""
    n = lambda s: F.count(F.when(F.col(split) == s, 1))
    one = splits.agg(
        n("train").alias("train_samples"), n("val").alias("val_samples"), n("test").alias("test_samples"),
        F.count("*").alias("total_samples"),
        F.max(F.when(F.col(split) == "train", F.size("features"))).alias("feature_size"),
        (F.max(F.when(F.col(split) == "train", F.col(label))) + 1).alias("num_classes"))
    weights = class_weights(splits.where(F.col(split) == "train").select(label), label)
    if weights.count() > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    listed = weights.agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "weight"))), lambda w: w["weight"]).alias("w"))
    return one.withColumn("class_weights", listed.scalar())


# ------------------------------------------------------------ order and splits

def shuffle_key(*ids: str, seed: int = 42) -> Column:
    return O.hash_unit(*[F.col(i) for i in ids], seed=seed)


def with_position(df: DataFrame, ids: list[str], key: Column, bucket: Column, per: list[str] = (),
                  out: str = "position", total: str | None = None) -> DataFrame:
    """1-based position in ``key`` order, per group if given; ``total`` adds the rows of the group.

    Counted bucket by bucket, so neither the whole table nor a class holding a
    third of it is ever sorted in one task.
    """
    staged = df.withColumn("_k", key).withColumn("_one", F.lit(1).cast("long"))
    ranked = O.with_running_sum(
        staged, list(per), [F.col("_k"), *[F.col(i) for i in ids]], {out: F.col("_one")}, bucket,
        totals={total: F.col("_one")} if total else None)
    return ranked.drop("_k", "_one")


def unit_bucket(key: str = "_k", buckets: int = ORDER_BUCKETS) -> Column:
    return F.floor(F.col(key) * buckets)


def shuffled(df: DataFrame, *ids: str, seed: int = 42) -> DataFrame:
    """A full shuffle that depends only on ids and seed (one range exchange)."""
    return df.orderBy(shuffle_key(*ids, seed=seed), *ids)


def split_simple(df: DataFrame, ids: list[str], key: Column | None = None, bucket: Column | None = None, *,
                 ratios=rules.SPLIT_RATIOS, seed: int = 42) -> DataFrame:
    """First int(n*train) of the shuffled rows, next int(n*val), the rest."""
    _check_ratios(ratios)
    k = shuffle_key(*ids, seed=seed) if key is None else key
    ranked = with_position(df, ids, k, unit_bucket() if bucket is None else bucket)
    n = df.agg(F.count("*").alias("n")).scalar()
    train = F.floor(n * ratios[0])
    val = train + F.floor(n * ratios[1])
    return ranked.withColumn(
        "split", F.when(F.col("position") <= train, "train").when(F.col("position") <= val, "val").otherwise("test")
    ).drop("position")


def split_stratified(df: DataFrame, ids: list[str], label: str = "label", key: Column | None = None,
                     bucket: Column | None = None, *, ratios=rules.SPLIT_RATIOS, seed: int = 42) -> DataFrame:
    """The same cut inside every class, so class shares carry over."""
    _check_ratios(ratios)
    k = shuffle_key(*ids, seed=seed) if key is None else key
    ranked = with_position(df, ids, k, unit_bucket() if bucket is None else bucket, [label], total="class_rows")
    n = F.col("class_rows")
    train, val = F.round(n * ratios[0]), F.round(n * (ratios[0] + ratios[1]))
    return ranked.withColumn(
        "split", F.when(F.col("position") <= train, "train").when(F.col("position") <= val, "val").otherwise("test")
    ).drop("position", "class_rows")


def _check_ratios(ratios) -> None:
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1")


# ------------------------------------------------------------ augmentation

def augment(df: DataFrame, ids: list[str], features: str = "features", *, factor: int = rules.AUGMENT_FACTOR,
            seed: int = 42, noise_level: float = rules.NOISE_LEVEL) -> DataFrame:
    """Every row plus ``factor`` changed copies, flagged in ``augmented``."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    row_key = F.xxhash64(*[F.col(i) for i in ids], F.col("copy"), F.lit(seed))
    pick = F.element_at(F.array(*[F.lit(s) for s in rules.STRATEGIES]),
                        (F.pmod(row_key, F.lit(len(rules.STRATEGIES))) + 1).cast("int"))
    changed = (
        copies.withColumn("_key", row_key).withColumn("strategy", pick)
        .withColumn(features, perturb.augmented(F.col(features), F.col("_key"), F.col("strategy"), noise_level))
        .withColumn("augmented", F.lit(True)).drop("_key")
    )
    kept = df.select(
        *[F.col(c).cast("array<float>").alias(c) if c == features else c for c in df.columns],
        F.lit(0).alias("copy"), F.lit("original").alias("strategy"), F.lit(False).alias("augmented"))
    return kept.unionByName(changed)


def with_strategy(df: DataFrame, ids: list[str], strategy: str, features: str = "features", *,
                  seed: int = 42, noise_level: float = rules.NOISE_LEVEL) -> DataFrame:
    """One named strategy on every row."""
    key = F.xxhash64(*[F.col(i) for i in ids], F.lit(seed))
    return df.withColumn(features, perturb.augmented(F.col(features), key, F.lit(strategy), noise_level))


def with_partial_shuffle(df: DataFrame, ids: list[str], features: str = "features", *, share: float = 0.1,
                         seed: int = 42) -> DataFrame:
    key = F.xxhash64(*[F.col(i) for i in ids], F.lit(seed))
    return df.withColumn(features, perturb.partly_shuffled(F.col(features), key, share))


def with_train_noise(df: DataFrame, ids: list[str], features: str = "features", *, seed: int = 42, **kw) -> DataFrame:
    key = F.xxhash64(*[F.col(i) for i in ids], F.lit(seed))
    return df.withColumn(features, perturb.train_time(F.col(features), key, **kw))


def oversample(df: DataFrame, ids: list[str], label: str = "label", *, seed: int = 42) -> DataFrame:
    """Grow every class to the largest one by sampling with replacement.

    Each row of a class draws its even share of the class's extra picks, in
    pieces of bounded length, so draws are spread over all tasks even where one
    row must fill a large class.  Draws are counted per (class, position)
    before they are shuffled and meet each row once.
    """
    largest = class_sizes(df, label).agg(F.max("class_rows").alias("n")).scalar()
    ranked = with_position(df, ids, shuffle_key(*ids, seed=seed), unit_bucket(), [label], total="class_rows")
    n, extra = F.col("class_rows"), largest - F.col("class_rows")
    first = F.floor((F.col("position") - 1) * extra / n)
    last = F.floor(F.col("position") * extra / n)
    # a row of a rare class draws very often: its draws are numbered in pieces, each exploded in a task of its own
    pieces = (ranked.where(last > first).select(label, "class_rows", first.alias("_from"), last.alias("_to"))
              .select(label, "class_rows", "_to", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1, F.lit(PIECE))).alias("_from"))
              .repartition(label, "_from"))
    draws = pieces.select(label, "class_rows", F.explode(F.sequence(
        F.col("_from") + 1, F.least(F.col("_from") + PIECE, F.col("_to")))).alias("_j"))
    position = (F.floor(O.hash_unit(F.col(label), F.col("_j"), seed=seed) * F.col("class_rows")) + 1).alias("position")
    # how often each row was drawn, summed before it is shuffled; then repeated in pieces
    times = draws.select(label, position).groupBy(label, "position").agg(F.count("*").alias("_times"))
    drawn = O.null_safe_join(ranked.drop("class_rows"), times, [label, "position"])
    drawn = drawn.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(PIECE))))
    drawn = drawn.withColumn("_copy", F.explode(F.sequence(F.col("_piece"), F.least(F.col("_piece") + PIECE, F.col("_times")) - 1)))
    return df.withColumn("oversampled", F.lit(False)).unionByName(
        drawn.select(*df.columns, F.lit(True).alias("oversampled")))


def augment_dataset(df: DataFrame, ids: list[str], label: str = "label", features: str = "features", *, balance: bool = True,
                    shuffle: bool = True, seed: int = 42, **kw) -> DataFrame:
    """Augment, then balance the classes, then number the rows in a shuffled order, as one job.

    Adds ``copy, strategy, augmented, oversampled`` and, if shuffled, ``position``.
    """
    out = augment(df, ids, features, seed=seed, **kw)
    keys = [*ids, "copy"]
    out = oversample(out, keys, label, seed=seed) if balance else out.withColumn("oversampled", F.lit(False))
    return with_position(out, keys, shuffle_key(*keys, seed=seed + 1), unit_bucket()) if shuffle else out


def augmentation_stats(df: DataFrame, factor: int = rules.AUGMENT_FACTOR) -> DataFrame:
    n = df.agg(F.count("*").alias("original_size"))
    big = F.col("original_size") * (1 + factor)
    return n.select("original_size", big.alias("augmented_size"), F.lit(factor).alias("augmentation_factor"),
                    (big / F.col("original_size")).alias("expansion_ratio"))


def feature_moments(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: mean and sample standard deviation per slot."""
    s = df.agg(Summarizer.metrics("mean", "std").summary(array_to_vector(F.col(features))).alias("s"))
    return s.select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"))


def normalized(df: DataFrame, moments: DataFrame, features: str = "features") -> DataFrame:
    """(x - mean) / (std + 1e-8) with given one-row moments."""
    staged = df.withColumn("_mean", moments.select("mean").scalar()).withColumn("_std", moments.select("std").scalar())
    centred = F.zip_with(features, "_mean", lambda x, m: x - m)
    scaled = F.zip_with(centred, "_std", lambda x, s: x / (s + 1e-8))
    return staged.withColumn(features, scaled).drop("_mean", "_std")
