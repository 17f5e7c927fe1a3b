"""Media views over the driver tables, each as a DataFrame and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators import samples as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of tracks: an event is a sample, a user a track."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = e.select(
        F.col("user_id").alias("track_id"),
        (F.row_number().over(order) - 1).cast("long").alias("decode_index"),
        ((F.col("event_id") % 3 + 1) * 100).cast("long").alias("duration"),
        (((F.col("event_id") * 37) % 11 - 5) * 100).cast("long").alias("cto"),
        F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("size"),
        "event_id",
        "event_type",
    )
    df = df.withColumn("is_sync", (F.col("decode_index") == 0) | F.coalesce(F.col("event_type") == "signup", F.lit(False)))
    return S.decode_times(df).withColumn("pts", F.col("dts") + F.col("cto")).drop("event_type")


SAMPLES = """
samples0 AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS decode_index,
    ((event_id % 3 + 1) * 100)::BIGINT AS duration, (((event_id * 37) % 11 - 5) * 100)::BIGINT AS cto,
    round(coalesce(value, 0.0) * 100)::BIGINT AS size, event_id, event_type FROM events),
samples1 AS (SELECT * EXCLUDE (event_type), decode_index = 0 OR coalesce(event_type = 'signup', false) AS is_sync,
    (sum(duration) OVER (PARTITION BY track_id ORDER BY decode_index) - duration)::BIGINT AS dts FROM samples0),
samples AS (SELECT *, dts + cto AS pts FROM samples1)"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in decoding order: an event is a picture; a signup starts a sequence anew."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("track_id"),
        (F.row_number().over(order) - 1).cast("long").alias("n"),
        F.when(F.col("event_type") == "signup", 0).otherwise((F.col("event_id") * 7) % 16).cast("long").alias("poc_lsb"),
        F.lit(16).cast("long").alias("max_poc_lsb"),
        F.coalesce(F.col("event_type") == "signup", F.lit(False)).alias("resets"),
        (F.col("event_id") % 5 != 0).alias("carries"),
        "event_id",
    )


PICTURES = """
pictures AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
    CASE WHEN event_type = 'signup' THEN 0 ELSE (event_id * 7) % 16 END::BIGINT AS poc_lsb, 16::BIGINT AS max_poc_lsb,
    coalesce(event_type = 'signup', false) AS resets, event_id % 5 <> 0 AS carries, event_id FROM events)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of 8 x 8: the components of a vector as 8-bit samples."""
    e = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND size(embedding) = 64")
    gray = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("int"))
    return e.select(F.col("vec_id").alias("frame_id"), gray.alias("gray"), "label")


IMAGES = """
images AS (SELECT vec_id AS frame_id, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 1) * 127.5)))::INTEGER) AS gray, label
    FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio packets: a turn of a conversation, as long as its text."""
    c = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    n = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")
    df = c.select(F.col("conv_id").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("packet_no"), n.alias("n"))
    upto = Window.partitionBy("track_id").orderBy("packet_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))


PACKETS = """
packets0 AS (SELECT conv_id AS track_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS packet_no,
    greatest(length(coalesce(text, '')), 1)::BIGINT AS n FROM conversations),
packets1 AS (SELECT *, sum(n) OVER (PARTITION BY track_id ORDER BY packet_no)::BIGINT AS "end" FROM packets0),
packets AS (SELECT *, "end" - n AS start FROM packets1)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels: columns of line items as 8-bit components."""
    i = table(spark, sf_dir, "lineitem")
    part = lambda c, m: F.call_function("mod", F.col(c).cast("long") * m, F.lit(256).cast("long")).cast("int")
    return i.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        part("l_partkey", 7).alias("r"), part("l_suppkey", 13).alias("g"), part("l_orderkey", 3).alias("b"),
    )


PIXELS = """
pixels AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ((l_partkey * 7) % 256)::INTEGER AS r, ((l_suppkey * 13) % 256)::INTEGER AS g,
    ((l_orderkey * 3) % 256)::INTEGER AS b FROM lineitem)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit lists: an order is an edit of its customer's track, a third of them empty."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    df = o.select(F.col("o_custkey").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("edit_no"), (F.col("o_orderkey") % 50 + 10).cast("long").alias("n"), "o_orderkey")
    upto = Window.partitionBy("track_id").orderBy("edit_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("end", F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
    return df.withColumn("media_start", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 1000).cast("long")).drop("o_orderkey", "n")


EDITS = """
edits0 AS (SELECT o_custkey AS track_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS edit_no, (o_orderkey % 50 + 10)::BIGINT AS n, o_orderkey FROM orders),
edits1 AS (SELECT *, sum(n) OVER (PARTITION BY track_id ORDER BY edit_no)::BIGINT AS "end" FROM edits0),
edits AS (SELECT track_id, edit_no, "end", "end" - n AS start, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 1000 END::BIGINT AS media_start FROM edits1)"""
