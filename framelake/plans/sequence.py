"""From HEVC byte streams to their pictures: units, headers in their sets, access units, order counts and order of output.

A composition of the walkers and window operators; what is left out is the reconstruction of samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import blocks, pictures
from framelake.session import materialise
from framelake.sources import nal
from framelake.sources import parameter_sets as PS

#: Unit types whose order of output starts anew wherever they stand: with leading pictures dropped, and whole refreshes.
BROKEN_LINKS = (16, 17, 18)


def sequence_pictures(streams: DataFrame, key: str = "track_id", data: str = "data") -> DataFrame:
    """One row per picture of byte streams (key, data): ``n`` in decoding order, ``nal_type``, ``cvs``, ``poc``, the place ``turn`` in
    order of output and ``left_at``, the picture whose decoding lets it out (null: the end), at the depth of its sequence set.

    Pictures whose header names sets that are not there, or is malformed, are left out; ``PS.slice_rows`` shows them.
    """
    units = materialise(nal.unit_rows(streams.select(F.col(key).alias("track_id"), F.col(data).alias("data")), key="track_id").where("kind IS NULL"), "units")
    heads = PS.slice_rows(units, key="track_id").where("first AND error_kind IS NULL")
    layers = units.where("layer_id = 0").select("track_id", "unit_no", "temporal_id")
    order = Window.partitionBy("track_id").orderBy("unit_no")
    found = heads.join(layers, ["track_id", "unit_no"]).withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    random = F.col("nal_type").between(16, 23)
    resets = F.col("nal_type").isin(*pictures.IDR, *BROKEN_LINKS) | (random & (F.col("n") == 0))
    found = found.select("track_id", "n", "unit_no", "nal_type", "reorder", F.coalesce("poc_lsb", F.lit(0)).cast("long").alias("poc_lsb"), "max_poc_lsb", resets.alias("resets"), pictures.carries_order(F.col("nal_type"), F.col("temporal_id")).alias("carries"))
    placed = materialise(pictures.picture_order(pictures.coded_sequences(found)), "pictures")
    turns = blocks.reordered(placed.select("track_id", "n", "cvs", "poc", F.col("reorder").alias("depth")))
    return placed.join(turns, ["track_id", "n"]).select(F.col("track_id").alias(key), "n", "unit_no", "nal_type", "cvs", "poc", "turn", "left_at")
