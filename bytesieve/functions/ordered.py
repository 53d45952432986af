"""Ordered operations that survive hot keys.

A plain ``Window.partitionBy(key)`` sorts one key in one task.  The helpers
here cut a key's rows into buckets along the order column, work inside each
(key, bucket), and carry a one-row-per-bucket summary across buckets.  The
summary holds one row per (key, bucket), not one per input row, so the final
window per key is short even when one key owns a third of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesieve import session


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL with NULL; keeps the left keys."""
    named = right.select(*[F.col(k).alias("_r" + k) if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col("_r" + k))
        on = same if on is None else on & same
    return left.join(named, on, how).drop(*["_r" + k for k in keys])


def lookup(big: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Join a one-row-per-key table onto many rows per key.

    A key that owns more than a quarter of a task's fair share of the rows is salted by ``spread_by`` in proportion to
    its size.  There are at most four such keys per shuffle partition and as many salts again, so their list is bounded
    and may be broadcast; all other keys join unsalted, without copies.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = big.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    salts = F.ceil(F.col("_n") * 4 * parts / total).cast("int")
    hot = F.broadcast(sizes.where(F.col("_n") * 4 * parts > total).select(*keys, salts.alias("_salts")))
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.col("_salts")).cast("int"), F.lit(0))
    wide = null_safe_join(big, hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    copies = null_safe_join(per_key, hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return null_safe_join(wide, copies, [*keys, "_salt"]).drop("_salt")


ROWS_PER_BUCKET = 10_000


def with_density_bucket(df: DataFrame, key: str, order: str, out: str = "_bucket",
                        rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add a bucket number along ``order`` that splits each key's span into as many equal parts as the key has
    multiples of ``rows`` rows: a dense key gets many, a sparse key one.  NULL order values come first."""
    stats = written(df.groupBy(key).agg(F.count("*").alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high")), "spans")
    width = F.greatest((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") / rows), F.lit(1.0))
    out = F.coalesce(F.floor((F.col(order) - F.col("_low")) / F.col("_width")).cast("long"), F.lit(-1)).alias(out)
    met = lookup(df, stats.select(key, "_low", width.alias("_width")), [key], [order], stats.select(key, "_n"))
    return met.select(*df.columns, out)


def _grouped(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Add ``_g`` (the keys as a struct, so NULL keys join too) and ``_b`` (never NULL).

    Joins and windows on these two share one partitioning: one shuffle.
    """
    return df.withColumn("_g", F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))).withColumn(
        "_b", F.coalesce(bucket.cast("long"), F.lit(-(1 << 62))))


def with_previous(
    df: DataFrame, key: str, order: list[str], values: list[str], *, rows_per_bucket: int = ROWS_PER_BUCKET,
    prefix: str = "prev_",
) -> DataFrame:
    """Add the previous row's ``values`` within ``key``, ordered by ``order``.

    ``order[0]`` must be a whole number; it is bucketed by the key's density.
    """
    rows = _grouped(with_density_bucket(df, key, order[0], rows=rows_per_bucket), [key], F.col("_bucket"))
    last = rows.groupBy("_g", "_b").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    carry = last.select("_g", "_b", F.lag("_last").over(Window.partitionBy("_g").orderBy("_b")).alias("_carry"))
    inside = Window.partitionBy("_g", "_b").orderBy(*order)
    cols = [
        F.when(F.row_number().over(inside) == 1, F.col(f"_carry.{v}"))
        .otherwise(F.lag(v).over(inside)).alias(prefix + v)
        for v in values
    ]
    return rows.join(carry, ["_g", "_b"], "left").select(*df.columns, *cols)


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[Column], amounts: dict[str, Column], bucket: Column,
    maxima: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums (and maxima) along ``order``, and ``totals`` of each key; ``bucket`` must follow the order.

    ``bucket`` is a whole number that never decreases along ``order``.  The
    across-bucket window sees one row per bucket of a key.
    """
    maxima, totals = maxima or {}, totals or {}
    rows = _grouped(df, keys, bucket)
    per = rows.groupBy("_g", "_b").agg(*[F.sum(c).alias("_t_" + n) for n, c in (amounts | totals).items()],
                                       *[F.max(c).alias("_t_" + n) for n, c in maxima.items()])
    across = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(
        "_g", "_b", *[F.coalesce(F.sum("_t_" + n).over(across), F.lit(0)).alias("_p_" + n) for n in amounts],
        *[F.max("_t_" + n).over(across).alias("_p_" + n) for n in maxima],
        *[F.sum("_t_" + n).over(Window.partitionBy("_g")).alias(n) for n in totals])
    inside = Window.partitionBy("_g", "_b").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return rows.join(before, ["_g", "_b"]).select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.col("_p_" + n)).alias(n) for n, c in amounts.items()],
        *[F.greatest(F.max(c).over(inside), F.col("_p_" + n)).alias(n) for n, c in maxima.items()], *totals,
    )


ROWS_PER_RANGE = 100_000


def with_ranged_sum(df: DataFrame, order: list[Column], amounts: dict[str, Column], maxima: dict[str, Column] | None = None,
                    rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Inclusive running sums (and maxima) of a whole table along ``order``, whatever its size and values.

    Two levels: a range exchange into as many parts as the table has multiples of ``rows`` rows, sums inside each, and one
    summary row per part carried across.  The table is written once, so that the second look at it meets the same parts;
    a table of one part is ordered in one task without an exchange by range.
    """
    spark, maxima = df.sparkSession, maxima or {}
    kept = written(df, "ordered")
    parts = max(1, -(-kept.count() // rows))
    if parts > 1:
        kept = written(kept.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    else:
        kept = kept.withColumn("_part", F.lit(0))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = [*[F.sum(c).over(inside).alias(n) for n, c in amounts.items()], *[F.max(c).over(inside).alias(n) for n, c in maxima.items()]]
    if parts == 1:
        return kept.select(*df.columns, *local)
    per = kept.groupBy("_part").agg(*[F.sum(c).alias("_t_" + n) for n, c in amounts.items()],
                                    *[F.max(c).alias("_t_" + n) for n, c in maxima.items()])
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_part", *[F.coalesce(F.sum("_t_" + n).over(across), F.lit(0)).alias("_p_" + n) for n in amounts],
                        *[F.max("_t_" + n).over(across).alias("_p_" + n) for n in maxima])
    if parts <= 1 << 20:  # as many rows
        before = F.broadcast(before)
    # parts stay apart: a hash of so few values would lay several on one task
    whole = kept.repartitionByRange(parts, "_part").select("*", *local).join(before, "_part")
    return whole.select(*df.columns, *[(F.col(n) + F.col("_p_" + n)).alias(n) for n in amounts],
                        *[F.greatest(n, "_p_" + n).alias(n) for n in maxima])


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written once below the work folder and read again."""
    path = session.new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_tree(col: Column, cuts: list[float]) -> Column:
    """Index of the bucket a value falls in, as a balanced CASE tree."""
    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col <= F.lit(cuts[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(cuts)) if cuts else F.lit(0)


def value_cuts(df: DataFrame, col: str, buckets: int = 64) -> list[float]:
    """Cut points that spread the rows of ``col`` evenly: one row to the driver."""
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(col, shares, 1000).alias("c")).first()
    return sorted(set(row["c"] or []))


def hash_unit(*cols: Column, seed: int = 42) -> Column:
    """Uniform value in [0, 1) that depends only on the row and the seed."""
    h = F.xxhash64(*cols, F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def hash_normal(*cols: Column, seed: int = 42) -> Column:
    """Standard normal value by Box-Muller on two hashed uniforms."""
    u1 = F.greatest(hash_unit(*cols, seed=seed), F.lit(1e-12))
    u2 = hash_unit(*cols, seed=seed + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
