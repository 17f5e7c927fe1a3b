"""Audio: contiguity, gapless and edited presentation, and assembling requested samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.intervals import overlap_join, shift_edits

TRACK = ("track_id",)


def packet_breaks(packets: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Packets that are empty or do not start where the one before ends, the first at 0. Adds ``expected``."""
    expected = F.coalesce(F.lag("end").over(Window.partitionBy(*keys).orderBy("packet_no")), F.lit(0))
    return packets.withColumn("expected", expected.cast("long")).where((F.col("start") != F.col("expected")) | (F.col("end") <= F.col("start")))


def edit_breaks(edits: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Edits that are empty, overlap the one before, or reach into priming, padding or beyond the track.

    Edits carry ``priming``, ``padding`` and ``decoded_length`` of their track.
    """
    before = F.coalesce(F.lag("end").over(Window.partitionBy(*keys).orderBy("edit_no")), F.lit(0))
    media_end = F.col("media_start") + F.col("end") - F.col("start")
    outside = F.col("media_start").isNotNull() & ((F.col("media_start") < F.col("priming")) | (media_end > F.col("decoded_length") - F.col("padding")))
    return edits.withColumn("_before", before).where((F.col("start") < F.col("_before")) | (F.col("end") <= F.col("start")) | outside).drop("_before")


def gapless_length(packets: DataFrame, priming: str = "priming", padding: str = "padding", offset: str = "track_offset", keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Presented samples without edits: keys, ``decoded_length``, ``presentation_length``; null where trimming exceeds the track."""
    total = packets.groupBy(*keys, priming, padding, offset).agg(F.max("end").alias("decoded_length"))
    length = F.col("decoded_length") - F.col(priming) - F.col(padding)
    shown = length + F.col(offset)
    return total.withColumn("presentation_length", F.when((length >= 0) & (shown >= 0), shown).cast("long"))


def gapless_edit(priming: Column, padding: Column, offset: Column, decoded_length: Column) -> Column:
    """The one edit that a track without edits amounts to: struct(start, end, media_start)."""
    start = F.greatest(offset, F.lit(0))
    media = priming + F.greatest(-offset, F.lit(0))
    return F.struct(start.cast("long").alias("start"), (start + F.greatest(decoded_length - padding - media, F.lit(0))).cast("long").alias("end"), media.cast("long").alias("media_start"))


def edited_length(edits: DataFrame, offset: Column, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Where the last shifted edit ends: keys, ``presentation_length``."""
    return shift_edits(edits, offset).groupBy(*keys).agg(F.max("end").alias("presentation_length"))


def assemble(requests: DataFrame, edits: DataFrame, packets: DataFrame, channels: int = 1, keys: tuple[str, ...] = TRACK, width: int = 1024) -> DataFrame:
    """The samples of each request (request_no, start, end): ``samples``, silence where no edit or packet has any.

    ``edits``: start, end, media_start (already shifted); ``packets``: packet_no, start, end, samples (interleaved).
    Requests, edits and packets meet in bucketed joins; a request's parts are joined by position.
    """
    spans = edits.select(*keys, F.col("start").alias("e_start"), F.col("end").alias("e_end"), "media_start").where("media_start IS NOT NULL")
    wanted = overlap_join(requests.select(*keys, "request_no", "start", "end"), spans, keys, width, rs="e_start", re="e_end")
    base = F.col("media_start") - F.col("e_start")
    media = wanted.select(*keys, "request_no", (F.col("from") + base).alias("m_start"), (F.col("to") + base).alias("m_end"), (F.col("from") - F.col("start")).alias("out"))
    stored = packets.select(*keys, F.col("start").alias("p_start"), F.col("end").alias("p_end"), "samples")
    parts = overlap_join(media, stored, keys, width, ls="m_start", le="m_end", rs="p_start", re="p_end")
    n, first = F.col("to") - F.col("from"), F.col("from") - F.col("p_start")
    piece = F.struct((F.col("out") + F.col("from") - F.col("m_start")).cast("int").alias("at"), F.slice("samples", (first * channels + 1).cast("int"), (n * channels).cast("int")).alias("samples"))
    grouped = parts.groupBy(*keys, "request_no").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    joined = requests.select(*keys, "request_no", "start", "end").join(grouped, [*keys, "request_no"], "left")
    silence = lambda k: F.array_repeat(F.lit(0.0).cast("float"), k)
    grown = lambda a, p: F.concat(a, silence(p["at"] * channels - F.size(a)), p["samples"].cast("array<float>"))
    body = F.aggregate(F.coalesce("parts", F.array().cast(grouped.schema["parts"].dataType)), F.array().cast("array<float>"), grown)
    length = ((F.col("end") - F.col("start")) * channels).cast("int")
    return joined.withColumn("_body", body).select(*keys, "request_no", "start", "end", F.concat("_body", silence(length - F.size("_body"))).alias("samples"))
