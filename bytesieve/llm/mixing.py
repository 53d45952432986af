"""A mix of sources by target weights, cut at exact word budgets.

Every row gets a hash-random key from its id. Within a source the keys are cut into even ranges, a window sums the words of
one range along the key, and a second window over one row per (source, range) carries the sums across ranges, so a source
with a third of all rows is spread over many tasks. A source takes whole epochs as often as its budget holds them, then
the rows along the key until the budget is spent; the row on the border gives its first words only. DataFrame functions
alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesieve.functions.ordered import null_safe_join
from bytesieve.llm.tables import stored, tasks

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WEIGHTS = (5, 2, 1)
RANGES_PER_TASK = 4


def word_count(text):
    """Words of a text without an array of them: each word with the space after it becomes one letter."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+", "")
    return F.length(F.regexp_replace(bare, f"{WORD}++{SPACE}*+", "x")).cast("long")


def random_key(id_col, seed: int):
    """60 bits of the id's digest: the same on every run, in every engine that has md5. A null id counts as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def with_rank(sources: DataFrame) -> DataFrame:
    """rank: place of each source (distinct; null last) from 0 along code points, by ranges, so that no task sees all of
    them."""
    order = [F.col("source").isNull(), "source"]
    parts = stored(sources.repartitionByRange(tasks(sources.sparkSession), *order).withColumn("part", F.spark_partition_id()),
                   "source-ranges")
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order)
    return parts.withColumn("inside", F.row_number().over(inside) - 1).join(before, "part").withColumn(
        "rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def targets(sources: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """(source, rows, source_size) with weight and target. Sources share `percent` of all words by weight; none gets
    more than `most` times its size, and what is over goes to the others by weight, until none is above. Each round is
    one aggregate of one row over the sources; a round that changes nothing is the last."""
    of_rank = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(with_rank(sources).withColumn("weight", of_rank.cast("long")), "sources")
    total, heavy = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, held = percent * total, -1  # hundredths of words still to share by weight
    full = F.lit(False)
    while heavy:
        # a source is full where most * size < weight * left / (100 * heavy)
        full = F.lit(100 * most) * F.col("source_size").cast("decimal(19,0)") * F.lit(heavy) < (
            F.col("weight").cast("decimal(10,0)") * F.lit(left).cast("decimal(22,0)"))
        n, size, weight = ranked.where(full).agg(
            F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == held:
            break
        held, left = n, percent * total - 100 * most * size
        heavy = ranked.agg(F.sum("weight")).first()[0] - weight
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(100 * heavy).cast("double") if heavy else F.lit(0.0)
    return ranked.withColumn("target", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(share))


def taken(sized: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 13) -> DataFrame:
    """sized (id, source, size) with source_size, target, epochs (whole passes) and taken (words, repeats counted).

    A source's budget is its target to the nearest word; the words taken of a source add up to it exactly. Rows of
    one id are neighbours, the smaller first; equal rows are interchangeable. A source without words takes none. An empty
    table gives no rows."""
    of_source = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    per = targets(stored(of_source, "source-sizes"), weights, percent, most)
    budget = F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    all_rows = per.agg(F.sum("rows")).first()[0] or 1
    ranges = F.ceil(F.col("rows") * (RANGES_PER_TASK * tasks(sized.sparkSession)) / all_rows)
    per = per.withColumn("budget", budget.cast("long")).withColumn("epochs", epochs).select(
        "source", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"),
        ranges.cast("long").alias("ranges"))
    per = stored(per, "targets")
    keyed = null_safe_join(sized.withColumn("key", random_key(F.col("id"), seed)), per.select("source", "ranges"), ["source"])
    place = F.least(F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("ranges")), F.col("ranges") - 1)
    # null sources meet like any other
    keyed = keyed.select("id", "source", "size", "key", F.struct("source").alias("of"), place.cast("long").alias("range"))
    sums = keyed.groupBy("of", "range").agg(F.sum("size").alias("words"))
    carried = sums.select("of", "range", (F.sum("words").over(
        Window.partitionBy("of").orderBy("range")) - F.col("words")).alias("carried"))
    carried = carried.join(per.select(F.struct("source").alias("of"), "source_size", "target", "epochs", "rest"), "of")
    inside = Window.partitionBy("of", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("up_to", F.sum("size").over(inside)).join(carried, ["of", "range"])
    before = F.col("carried") + F.col("up_to") - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - before))
    return placed.select("id", "source", "size", "source_size", "target", "epochs",
                         (F.col("epochs") * F.col("size") + part).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 13) -> DataFrame:
    """Per row of docs: id, source, size (words), source_size, target, epochs, taken.

    A null, empty or blank text has size 0 and gives nothing. A null source is a source of its own, last in order. Rows
    that repeat an id or a text are rows of their own. Long texts are counted without a list of their words. Other columns
    of docs are not looked at."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                        word_count(F.col(text_col).cast("string")).alias("size"))
    return taken(stored(sized, "sizes"), weights, percent, most, seed)


def mixed_texts(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: (id, epoch from 0, text), one row per repeat of a document; the last repeat may be a text cut after
    its last word taken, with the space between its words as it was. ids must be unique and not null here."""
    times = plan.where("taken > 0").select(F.col("id").alias("_id"), "size", "taken")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(times, "_id")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    parts = F.regexp_extract_all("_text", F.lit(f"{SPACE}*{WORD}+"), F.lit(0))
    cut = F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")
    return rows.select(F.col("_id").alias("id"), "epoch", F.when(words < F.col("size"), cut).otherwise(F.col("_text")).alias("text"))
