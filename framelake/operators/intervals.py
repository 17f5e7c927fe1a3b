"""Joins of half-open intervals, through buckets of the line so that they stay equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: int) -> Column:
    """Numbers of the buckets that [start, end) touches."""
    low = F.floor(start / width).cast("long")
    high = F.floor((end - 1) / width).cast("long")
    return F.when(end > start, F.sequence(low, high))


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], width: int, ls: str = "start", le: str = "end", rs: str = "r_start", re: str = "r_end") -> DataFrame:
    """Pairs of intervals of a key that overlap, with ``from`` and ``to`` of what they share.

    Both sides go to the buckets that they touch; a pair counts only in the bucket where the overlap starts, so
    no distinct is needed. ``width`` should be about the mean length of the intervals.
    """
    own = left.withColumn("_bucket", F.explode(_buckets(F.col(ls), F.col(le), width)))
    other = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys), F.explode(_buckets(F.col(rs), F.col(re), width)).alias("_r_bucket"))
    same = F.col("_bucket") == F.col("_r_bucket")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    start, end = F.greatest(ls, rs), F.least(le, re)
    met = own.join(other, same).where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.floor(start / width) == F.col("_bucket")))
    return met.withColumn("from", start).withColumn("to", end).drop("_bucket", "_r_bucket", *(f"_r_{k}" for k in keys))


def not_contained(samples: DataFrame, ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Samples [offset, offset + size) of a key that lie in none of its ranges [r_start, r_end).

    Ranges are merged first, so the one that starts last at or before a sample decides: an as-of lookup by a window over the union, where a
    sample meets no more than one range.
    """
    from pyspark.sql import Window

    points = samples.select(F.struct("*").alias("_row"), *keys, F.col("offset").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"))
    spans = ranges.select(F.lit(None).cast(points.schema["_row"].dataType).alias("_row"), *keys, F.col("r_start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("r_end").cast("long").alias("_end"))
    upto = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # Ranges of a file do not overlap; of nested ones the furthest end decides.
    merged = points.unionByName(spans).withColumn("_reach", F.max("_end").over(upto))
    out = merged.where((F.col("_kind") == 1) & (F.col("_reach").isNull() | (F.col("_row.offset") + F.col("_row.size") > F.col("_reach"))))
    return out.select("_row.*")


def shift_edits(edits: DataFrame, offset: Column) -> DataFrame:
    """Edits [start, end) moved by an offset and cut at 0; what ends at or before 0 goes. media_start moves along, null stays."""
    start, end = F.col("start") + offset, F.col("end") + offset
    cut = F.greatest(-start, F.lit(0))
    return edits.withColumn("_s", start).withColumn("_e", end).withColumn("media_start", F.col("media_start") + cut).where("_e > 0").withColumn("start", F.greatest("_s", F.lit(0)).cast("long")).withColumn("end", F.col("_e").cast("long")).drop("_s", "_e")


def map_requests(requests: DataFrame, edits: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """Requests [start, end) against edits [e_start, e_end): ``output_offset``, ``media_start`` and ``media_end`` (null: silence)."""
    met = overlap_join(requests, edits, keys, width, rs="e_start", re="e_end")
    base = F.col("media_start") + F.col("from") - F.col("e_start")
    return met.withColumn("output_offset", F.col("from") - F.col("start")).withColumn("media_end", base + F.col("to") - F.col("from")).withColumn("media_start", base)


def packets_for_range(requests: DataFrame, packets: DataFrame, keys: tuple[str, ...], width: int, preroll: int = 0) -> DataFrame:
    """First and last packet that a request needs, and where decoding starts ``preroll`` packets before: one row per request."""
    spans = packets.select(*keys, "packet_no", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = overlap_join(requests, spans, keys, width)
    grouped = met.groupBy(*requests.columns).agg(F.min("packet_no").alias("first_packet"), F.max("packet_no").alias("last_packet"))
    return grouped.withColumn("decode_start", F.greatest(F.col("first_packet") - preroll, F.lit(0)).cast("long"))
