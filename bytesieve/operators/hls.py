"""Streams cleaned from their playlist on: resolve, fetch, filter, order, account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import ordered as O
from bytesieve.operators import playlists, segments

MAX_HOPS = 8


def media_playlists(streams: DataFrame, documents: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(stream_id, base_url, content, hops) of every stream's media playlist.

    ``streams`` has stream_id and url, ``documents`` url and content.  A master playlist leads to its best variant, which may
    be a master again: streams that still point at one take another hop until none does, each hop one join of the streams
    left.  Content is NULL where a playlist could not be fetched or no variant is valid, and for streams that are not done
    after ``max_hops`` (masters that lead in a circle).
    """
    at = streams.select("stream_id", "url", F.lit(0).alias("hops"))
    done = None
    for hop in range(max_hops + 1):
        met = O.written(at.join(documents.select("url", "content"), "url", "left"), "hop")
        master = F.coalesce(playlists.is_master(F.col("content")), F.lit(False))
        ended = met.where(~master).select("stream_id", F.col("url").alias("base_url"), "content", "hops")
        done = ended if done is None else done.unionByName(ended)
        left = met.where(master)
        if left.isEmpty():
            return done
        at = left.select("stream_id", playlists.best_variant(F.col("content"), F.col("url")).alias("url"), F.lit(hop + 1).alias("hops"))
    return done.unionByName(left.select(
        "stream_id", F.col("url").alias("base_url"), F.lit(None).cast("string").alias("content"), "hops"))


def cleaned(streams: DataFrame, documents: DataFrame, bodies: DataFrame, rule_set=rules.FILTER_RULES, repair: bool = True) -> DataFrame:
    """Every entry of every stream with what became of it: stream_id, idx, url, duration, state (clean, blocked or failed),
    issues, clean_data (NULL where the fetch failed).  Written once: counters and output read the same rows.

    ``bodies`` has url and data; an entry without one is a failed fetch.  ``repair`` as in :func:`segments.filter_segments`.
    """
    listed = playlists.entries(media_playlists(streams, documents).where(F.col("content").isNotNull()).drop("hops"))
    fetched = listed.join(bodies.select("url", "data"), "url", "left")
    out = segments.filter_segments(fetched, rule_set, repair=repair)
    failed = F.col("data").isNull()
    return O.written(out.select(
        "stream_id", "idx", "url", "duration",
        F.when(failed, "failed").when(F.col("is_clean"), "clean").otherwise("blocked").alias("state"),
        F.coalesce(F.col("is_clean") & ~failed, F.lit(False)).alias("is_clean"),
        F.when(failed, F.array(F.lit("Fetch failed"))).otherwise(F.col("issues")).alias("issues"), "clean_data"), "hls")


def output_parts(entries: DataFrame) -> DataFrame:
    """Clean entries in their place: stream_id, idx, length, offset, digest."""
    clean = entries.where("state = 'clean'").select(
        "stream_id", "idx", F.octet_length("clean_data").cast("long").alias("length"), F.md5("clean_data").alias("digest"))
    return segments.with_offsets(clean)


def stats(streams: DataFrame, entries: DataFrame) -> DataFrame:
    """Counters of every stream, one without a media playlist included: failed entries count as blocked, with no bytes."""
    per = segments.hls_stats(entries).join(
        entries.groupBy("stream_id").agg(F.count(F.when(F.col("state") == "failed", 1)).alias("failed_fetches")), "stream_id")
    zero = [c for c, t in per.dtypes if t in ("bigint", "double") and c != "stream_id"]
    return streams.select("stream_id").join(per, "stream_id", "left").fillna(0, zero)
