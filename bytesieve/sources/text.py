"""CSV, playlist, probe and resume-state text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def labelled_schema(width: int, label: str = "label", filename: bool = False) -> T.StructType:
    fields = [T.StructField(f"f_{i}", T.DoubleType()) for i in range(width)] + [T.StructField(label, T.IntegerType())]
    if filename:
        fields.append(T.StructField("filename", T.StringType()))
    return T.StructType(fields)


def labelled_csv(spark: SparkSession, path: str, width: int, **kw) -> DataFrame:
    """Labelled feature CSV with a stated schema: one pass, nothing inferred."""
    return spark.read.csv(path, header=True, schema=labelled_schema(width, **kw))


RECORD_END = "\x1e"  # ends a text among many in a file; Spark splits a large file there, so no task needs all of it


def packed(df: DataFrame, text: Column, path: str) -> None:
    """Texts written many to a file, for as many files as tasks whatever the number of texts."""
    whole = F.when(F.contains(text, F.lit(RECORD_END)), F.raise_error("a text holds the record separator")).otherwise(text)
    df.select(whole.alias("value")).write.option("lineSep", RECORD_END).text(path)


def packed_playlists(spark: SparkSession, path: str) -> DataFrame:
    """One row per playlist of :func:`packed` files, each playlist after a line with its URL."""
    value = spark.read.option("lineSep", RECORD_END).text(path)
    return value.select(F.substring_index("value", "\n", 1).alias("base_url"),
                        F.expr("substring(value, instr(value, '\n') + 1)").alias("content"))


def playlist_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per playlist file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("base_url"), F.col("value").alias("content"))


def _json_value(text: Column, key: str) -> Column:
    """First value of a key: a quoted string, or digits and dots up to another character."""
    quoted = F.regexp_extract(text, rf'"{key}":\s*"([^"]*)"', 1)
    first = F.regexp_extract(text, rf'(?s)"{key}":\s*(.)', 1)
    bare = F.regexp_extract(text, rf'"{key}":\s*([0-9.]*)[^0-9.]', 1)
    return F.when(first == '"', quoted).otherwise(bare)


def media_probe(df: DataFrame, text: str = "probe") -> DataFrame:
    """Duration, kbit/s, size and first codec from media-probe JSON text."""
    t = F.col(text)
    number = lambda key, kind, pattern: F.coalesce(
        F.when(F.rlike(_json_value(t, key), F.lit(pattern)), _json_value(t, key).cast(kind)), F.lit(0).cast(kind))
    whole = r"^\+?\d{1,18}$"
    return df.select(
        *[c for c in df.columns if c != text],
        number("duration", "double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$").alias("duration_secs"),
        F.floor(number("bit_rate", "long", whole) / 1000).alias("bitrate_kbps"),
        number("width", "int", whole).alias("width"), number("height", "int", whole).alias("height"),
        _json_value(t, "codec_name").alias("video_codec"))


def resume_states(df: DataFrame, text: str = "value") -> DataFrame:
    """Saved positions from ``bytes=`` / ``path=`` / ``timestamp=`` lines; bad numbers are 0."""
    lines = F.split(text, "\n")
    last = lambda key: F.regexp_replace(
        F.element_at(F.filter(lines, lambda x: F.startswith(x, F.lit(key + "="))), -1), f"^{key}=", "")
    number = lambda key: F.coalesce(
        F.when(F.rlike(last(key), F.lit(r"^\+?\d{1,18}$")), last(key).cast("long")), F.lit(0))
    has = F.exists(lines, lambda x: F.startswith(x, F.lit("bytes=")))
    has_ts = F.exists(lines, lambda x: F.startswith(x, F.lit("timestamp=")))
    has_path = F.exists(lines, lambda x: F.startswith(x, F.lit("path=")))
    return df.select(
        *[c for c in df.columns if c != text],
        F.when(has_path, last("path")).alias("output_path"),
        F.when(has, number("bytes")).otherwise(F.lit(0)).alias("bytes_downloaded"),
        F.when(has_ts, number("timestamp")).otherwise(F.lit(0)).alias("saved_at"))


def resume_files(spark: SparkSession, path: str, pack: bool = False) -> DataFrame:
    """States of a folder: one to a file, or many to a file (:func:`packed`), for outputs too many for a file each."""
    if pack:
        return resume_states(spark.read.option("lineSep", RECORD_END).text(path))
    return resume_states(spark.read.text(path, wholetext=True))
