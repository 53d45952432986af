"""Playlist text: entries, variants and kinds, parsed inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INF = "#EXTINF:"
_VARIANT = "#EXT-X-STREAM-INF:"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _is_url(line: Column) -> Column:
    return (line != "") & ~F.startswith(line, F.lit("#"))


def _resolve(line: Column, base_url: Column) -> Column:
    base = F.regexp_replace(base_url, "/[^/]*$", "")
    return F.when(F.startswith(line, F.lit("http")), line).otherwise(F.concat(base, F.lit("/"), line))


def _duration(line: Column) -> Column:
    text = F.substring_index(F.regexp_replace(line, f"^(?:{_INF})+", ""), ",", 1)
    return F.when(F.rlike(text, F.lit(_NUMBER)), text.cast("double")).otherwise(F.lit(0.0))


def entries(df: DataFrame, content: str = "content", base_url: str = "base_url") -> DataFrame:
    """One row per URL line: index, resolved URL and the duration just before it.

    With other comment lines dropped, the line before a URL is its EXTINF or
    another URL, so one look back inside the array is enough.
    """
    keep = [c for c in df.columns if c not in (content, base_url)]
    marked = df.withColumn("_l", F.filter(
        _lines(F.col(content)), lambda x: _is_url(x) | F.startswith(x, F.lit(_INF))))
    pairs = F.filter(
        F.transform("_l", lambda x, i: F.struct(
            x.alias("url"), F.when(i > 0, F.get("_l", i - 1)).alias("before"))),
        lambda p: _is_url(p["url"]))
    rows = marked.select(*keep, base_url, F.posexplode(pairs).alias("idx", "_e"))
    return rows.select(
        *keep, F.col("idx").cast("long").alias("idx"), _resolve(F.col("_e.url"), F.col(base_url)).alias("url"),
        F.when(F.startswith("_e.before", F.lit(_INF)), _duration(F.col("_e.before"))).otherwise(F.lit(0.0)).alias("duration"))


def durations(df: DataFrame, key: str, content: str = "content", base_url: str = "base_url") -> DataFrame:
    """Total seconds and segment count per playlist, without exploding it."""
    lines = F.filter(_lines(F.col(content)), lambda x: _is_url(x) | F.startswith(x, F.lit(_INF)))
    marked = df.select(key, lines.alias("_l"))
    per = F.transform("_l", lambda x, i: F.when(
        _is_url(x) & (i > 0) & F.startswith(F.get("_l", i - 1), F.lit(_INF)), _duration(F.get("_l", i - 1)))
        .otherwise(F.lit(0.0)))
    return marked.select(
        key, F.size(F.filter("_l", _is_url)).cast("long").alias("segments"),
        F.aggregate(per, F.lit(0.0), lambda a, x: a + x).alias("total_duration"))


def _bandwidth(line: Column) -> Column:
    part = F.get(F.filter(F.split(line, ","), lambda s: F.contains(s, F.lit("BANDWIDTH="))), F.lit(0))
    value = F.get(F.split(part, "="), F.lit(1))
    return F.coalesce(F.when(F.rlike(value, F.lit(r"^\+?\d{1,18}$")), value.cast("long")), F.lit(0).cast("long"))


def best_variant(content: Column, base_url: Column) -> Column:
    """URL after the variant with the strictly largest bandwidth; NULL if none."""
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).cast("long").alias("best"), none.alias("url"), F.lit(False).alias("next"))

    def step(s: Column, line: Column) -> Column:
        bw = _bandwidth(line)
        better = F.startswith(line, F.lit(_VARIANT)) & (bw > s["best"])
        take = s["next"] & _is_url(line)
        return F.struct(
            F.when(better, bw).otherwise(s["best"]).alias("best"),
            F.when(take, line).otherwise(s["url"]).alias("url"),
            F.when(better, F.lit(True)).when(take, F.lit(False)).otherwise(s["next"]).alias("next"))

    found = F.aggregate(_lines(content), start, step)["url"]
    return _resolve(found, base_url)


def is_master(content: Column) -> Column:
    return F.contains(content, F.lit("#EXT-X-STREAM-INF"))


def resolve(playlists: DataFrame, content: str = "content", base_url: str = "base_url") -> DataFrame:
    """Kind of each playlist and the media playlist URL to read next."""
    master = is_master(F.col(content))
    return playlists.withColumn("kind", F.when(master, "master").otherwise("media")).withColumn(
        "media_url", F.when(master, best_variant(F.col(content), F.col(base_url))).otherwise(F.col(base_url)))
