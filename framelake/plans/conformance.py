"""Conformance of decoders: golden digests under several access patterns, and checks of what an encoder wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.reader import read_frames
from framelake.operators.samples import access_pattern

PATTERNS = ("sequential", "reverse", "alternating")


def requests_for(samples: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Requests of every frame of every track under each pattern, one after another: track_id, request_no, presentation_index, pattern."""
    out = None
    for n, name in enumerate(patterns):
        size = F.count("*").over(Window.partitionBy("track_id"))
        one = access_pattern(samples.select("track_id", "presentation_index"), name).select("track_id", (F.col("turn") + n * size).alias("request_no"), "presentation_index", F.lit(name).alias("pattern"))
        out = one if out is None else out.unionByName(one)
    return out


def run_vectors(samples: DataFrame, golden: DataFrame, codec: str = "gray8", options: dict | None = None) -> DataFrame:
    """Per track and pattern: frames asked for, those whose digest is the golden one, errors, and the reader's last counters.

    ``golden``: track_id, presentation_index, digest. Every pattern must give every digest.
    """
    asked = requests_for(samples)
    got = read_frames(samples, asked.drop("pattern"), codec, options).withColumn("got", F.sha2("frame", 256))
    met = got.join(asked, ["track_id", "request_no", "presentation_index"]).join(golden, ["track_id", "presentation_index"], "left")
    return met.groupBy("track_id", "pattern").agg(
        F.count("*").alias("frames"),
        F.count_if(F.col("got") == F.col("digest")).alias("matching"),
        F.count("kind").alias("errors"),
        F.max("submitted").alias("submitted"),
        F.max("resets").alias("resets"),
    )


def identity_errors(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Identities that only one side has, or one has more often: keys and ``side``."""
    l, r = left.select(*keys), right.select(*keys)
    return l.exceptAll(r).withColumn("side", F.lit("left")).unionByName(r.exceptAll(l).withColumn("side", F.lit("right")))


def packet_errors(packets: DataFrame, frames: DataFrame) -> DataFrame:
    """What is wrong with an encoder's packets (track_id, packet_no, pts, dts, is_sync): track_id and ``problem``.

    One packet a frame, the first one sync, presentation times unique, decode times strictly increasing.
    """
    order = Window.partitionBy("track_id").orderBy("packet_no")
    p = packets.withColumn("_before", F.lag("dts").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    facts = p.groupBy("track_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("pts").alias("times"),
        F.count_if(F.col("dts") <= F.col("_before")).alias("back"),
        F.count_if(F.col("_first") & F.col("is_sync")).alias("opened"),
    )
    wanted = frames.groupBy("track_id").agg(F.count("*").alias("wanted"))
    checks = F.array(
        F.when(~F.col("n").eqNullSafe(F.col("wanted")), "one packet per frame is required"),
        F.when(F.col("opened") == 0, "the first packet must be a sync sample"),
        F.when(F.col("times") < F.col("n"), "presentation times must be unique"),
        F.when(F.col("back") > 0, "decode times must increase"),
    )
    return facts.join(wanted, "track_id", "full").select("track_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("problem"))
