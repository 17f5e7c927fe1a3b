"""Queries over the driver tables and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake import errors, views
from framelake.functions import codecs as C
from framelake.functions import pixels as P
from framelake.functions import timeline as T
from framelake.operators import audio, frames, intervals, pictures
from framelake.operators import samples as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *with_: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL over the named views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ",".join(with_) + "\n" if with_ else "") + sql
        return f

    return add


def joined(values: Column) -> Column:
    """An array as text, so that both engines hash the same value; a missing entry is x."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",", "x")


def _joined(sql: str) -> str:
    return f"array_to_string(list_transform({sql}, lambda v: coalesce(v::VARCHAR, 'x')), ',')"


# --- timeline -------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_partkey, l_linenumber, (l_partkey - 50 * l_linenumber) // gcd(l_partkey - 50 * l_linenumber, l_suppkey + 1) AS num,
    (l_suppkey + 1) // gcd(l_partkey - 50 * l_linenumber, l_suppkey + 1) AS den FROM lineitem""")
def rational_gcd(spark, sf):
    i = views.table(spark, sf, "lineitem")
    r = T.rational(F.col("l_partkey") - 50 * F.col("l_linenumber"), F.col("l_suppkey") + 1)
    return i.select("l_orderkey", "l_partkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_partkey", "l_linenumber", "r.num", "r.den")


_RATIO = """r AS (SELECT p_partkey, p_size::BIGINT AS a, p_partkey % 90 + 1 AS b, p_partkey % 7 - 3 AS c, p_size::BIGINT + 2 AS d FROM part)"""


@query("""SELECT p_partkey, (a * d + c * b) // gcd(a * d + c * b, b * d) AS add_num, b * d // gcd(a * d + c * b, b * d) AS add_den,
    (a * d - c * b) // gcd(a * d - c * b, b * d) AS sub_num, b * d // gcd(a * d - c * b, b * d) AS sub_den,
    a * c // gcd(a * c, b * d) AS mul_num, b * d // gcd(a * c, b * d) AS mul_den,
    CASE WHEN c <> 0 THEN a * d * sign(c) // gcd(a * d, b * c) END::BIGINT AS div_num, CASE WHEN c <> 0 THEN b * abs(c) // gcd(a * d, b * c) END::BIGINT AS div_den,
    a * d < c * b AS less FROM r""", _RATIO)
def rational_arithmetic(spark, sf):
    p = views.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 90 + 1).alias("b"), (F.col("p_partkey") % 7 - 3).alias("c"), (F.col("p_size").cast("long") + 2).alias("d"))
    x, y = T.rational(F.col("a"), F.col("b")), T.rational(F.col("c"), F.col("d"))
    p = p.withColumn("x", x).withColumn("y", y)
    x, y = F.col("x"), F.col("y")
    p = p.select("p_partkey", T.rational_add(x, y).alias("add"), T.rational_sub(x, y).alias("sub"), T.rational_mul(x, y).alias("mul"), T.rational_div(x, y).alias("div"), T.rational_less(x, y).alias("less"))
    return p.select("p_partkey", *(F.col(f"{o}.{t}").alias(f"{o}_{t}") for o in ("add", "sub", "mul", "div") for t in ("num", "den")), "less")


@query("""SELECT track_id, decode_index, decode_index * 48000 * 1001 // 30000 AS start, (decode_index + 1) * 48000 * 1001 // 30000 AS "end" FROM samples""", views.SAMPLES)
def frame_audio_interval(spark, sf):
    s = views.samples(spark, sf)
    span = T.audio_interval_for_frame(F.col("decode_index"), F.lit(48000), F.lit(30000), F.lit(1001))
    return s.select("track_id", "decode_index", span.alias("i")).select("track_id", "decode_index", "i.start", "i.end")


@query("SELECT track_id, decode_index, ((dts + 1) * 30000 - 1) // (48000 * 1001) AS frame FROM samples", views.SAMPLES)
def audio_sample_to_frame(spark, sf):
    s = views.samples(spark, sf)
    return s.select("track_id", "decode_index", T.frame_for_audio_sample(F.col("dts"), F.lit(48000), F.lit(30000), F.lit(1001)).alias("frame"))


@query("SELECT track_id, sum(duration)::BIGINT * 1000 // 90000 AS scaled FROM samples GROUP BY track_id", views.SAMPLES)
def scale_duration(spark, sf):
    d = S.mux_duration(views.samples(spark, sf))
    return d.select("track_id", T.scale_duration(F.col("duration"), F.lit(90000), F.lit(1000)).alias("scaled"))


@query("SELECT event_id, event_id + cto AS moved FROM (SELECT event_id, CASE WHEN event_id + cto >= 0 THEN cto END AS cto FROM samples)", views.SAMPLES)
def signed_offset(spark, sf):
    return views.samples(spark, sf).select("event_id", T.add_signed(F.col("event_id"), F.col("cto")).alias("moved"))


@query("SELECT DISTINCT 8000 * (p_size::BIGINT) AS rate, 8000 * (p_size::BIGINT) // 5 AS ahead, 8000 * (p_size::BIGINT) // 20 AS preroll FROM part")
def playback_window(spark, sf):
    rates = views.table(spark, sf, "part").select((F.col("p_size").cast("long") * 8000).alias("rate")).distinct()
    w = T.schedule_window(F.col("rate"))
    return rates.select("rate", w["ahead"].alias("ahead"), w["preroll"].alias("preroll"))


# --- sample tables --------------------------------------------------------------------------


@query("SELECT track_id, decode_index, dts, pts, row_number() OVER (PARTITION BY track_id ORDER BY pts, dts, decode_index) - 1 AS presentation_index FROM samples", views.SAMPLES)
def presentation_order(spark, sf):
    return S.presentation_order(views.samples(spark, sf)).select("track_id", "decode_index", "dts", "pts", "presentation_index")


_RAP = """rap AS (SELECT track_id, decode_index, coalesce(max(CASE WHEN is_sync THEN decode_index END) OVER (PARTITION BY track_id ORDER BY decode_index), 0) AS rap FROM samples)"""


@query("SELECT track_id, decode_index, rap FROM rap", views.SAMPLES, _RAP)
def nearest_random_access(spark, sf):
    return S.nearest_random_access(views.samples(spark, sf)).select("track_id", "decode_index", "rap")


@query("SELECT track_id, decode_index, rap, decode_index - rap + 1 AS work, decode_index - rap + 1 > 32 AS too_long FROM rap", views.SAMPLES, _RAP)
def decode_work(spark, sf):
    return S.decode_work(views.samples(spark, sf), most=32).select("track_id", "decode_index", "rap", "work", "too_long")


def _runs(value: str) -> str:
    return f"""SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY f) - 1 AS run_no, count, value FROM (
    SELECT track_id, {value} AS value, count(*) AS count, min(decode_index) AS f FROM (
        SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY decode_index) - row_number() OVER (PARTITION BY track_id, {value} ORDER BY decode_index) AS island FROM samples)
    GROUP BY track_id, {value}, island)"""


@query(_runs("duration"), views.SAMPLES)
def duration_runs(spark, sf):
    return S.compress_runs(views.samples(spark, sf), "duration")


@query(_runs("cto"), views.SAMPLES)
def offset_runs(spark, sf):
    return S.compress_runs(views.samples(spark, sf), "cto")


@query("SELECT track_id, decode_index AS i, duration AS value FROM samples", views.SAMPLES)
def runs_round_trip(spark, sf):
    return S.expand_runs(S.compress_runs(views.samples(spark, sf), "duration"))


@query("""SELECT track_id, start + k AS i, packet_no AS value FROM (SELECT track_id, packet_no, n % 9 AS c, (sum(n % 9) OVER (PARTITION BY track_id ORDER BY packet_no) - n % 9)::BIGINT AS start FROM packets) p,
    range(0, 9) t(k) WHERE k < c""", views.PACKETS)
def rle_expand(spark, sf):
    runs = views.packets(spark, sf).select("track_id", F.col("packet_no").alias("run_no"), (F.col("n") % 9).alias("count"), F.col("packet_no").alias("value"))
    return S.expand_runs(runs)


_ENTRIES = """entries AS (SELECT track_id, packet_no * 3 + 1 AS first_chunk, n % 5 + 1 AS samples_per_chunk FROM packets),
chunks AS (SELECT track_id, packet_no + 1 AS chunk_no FROM packets)"""


@query("""SELECT track_id, chunk_no, samples_per_chunk, (sum(samples_per_chunk) OVER (PARTITION BY track_id ORDER BY chunk_no) - samples_per_chunk)::BIGINT AS first_sample FROM (
    SELECT c.track_id, c.chunk_no, e.samples_per_chunk FROM chunks c ASOF JOIN entries e ON c.track_id = e.track_id AND c.chunk_no >= e.first_chunk)""", views.PACKETS, _ENTRIES)
def chunk_map(spark, sf):
    p = views.packets(spark, sf)
    entries = p.select("track_id", (F.col("packet_no") * 3 + 1).alias("first_chunk"), (F.col("n") % 5 + 1).alias("samples_per_chunk"))
    chunks = p.select("track_id", (F.col("packet_no") + 1).alias("chunk_no"))
    return S.chunk_samples(S.chunk_map(chunks, entries)).select("track_id", "chunk_no", "samples_per_chunk", "first_sample")


@query("""SELECT track_id, decode_index, decode_index // 10 AS chunk_no, ((decode_index // 10) * 100000 + sum(size) OVER (PARTITION BY track_id, decode_index // 10 ORDER BY decode_index) - size)::BIGINT AS "offset" FROM samples""", views.SAMPLES)
def sample_offsets(spark, sf):
    s = views.samples(spark, sf).withColumn("chunk_no", F.call_function("div", F.col("decode_index"), F.lit(10).cast("long"))).withColumn("chunk_offset", F.col("chunk_no") * 100000)
    return S.sample_offsets(s).select("track_id", "decode_index", "chunk_no", "offset")


@query("SELECT track_id, decode_index + 1 AS sample_no FROM samples s WHERE is_sync AND EXISTS (SELECT 1 FROM samples t WHERE t.track_id = s.track_id AND NOT t.is_sync)", views.SAMPLES)
def sync_table(spark, sf):
    return S.sync_table(views.samples(spark, sf))


@query("SELECT track_id, decode_index, is_sync FROM samples", views.SAMPLES)
def sync_round_trip(spark, sf):
    s = views.samples(spark, sf)
    return S.is_sync(s.select("track_id", "decode_index"), S.sync_table(s)).select("track_id", "decode_index", "is_sync")


@query("SELECT track_id, packet_no + 1 AS sample_no FROM packets p WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.track_id = p.track_id AND s.decode_index = p.packet_no)", views.SAMPLES, views.PACKETS)
def sync_table_check(spark, sf):
    return S.bad_sync(views.samples(spark, sf), views.packets(spark, sf).select("track_id", (F.col("packet_no") + 1).alias("sample_no")))


@query("SELECT track_id, greatest(max(dts + duration), max(event_id * 10))::BIGINT AS duration FROM samples GROUP BY track_id", views.SAMPLES)
def track_duration(spark, sf):
    return S.track_duration(views.samples(spark, sf).withColumn("declared", F.col("event_id") * 10), declared="declared")


@query("""SELECT m.track_id, m.duration, p.presentation_end, p.presentation_end * 1000 // 90000 AS movie FROM
    (SELECT track_id, arg_max(dts + duration, decode_index) AS duration FROM samples GROUP BY track_id) m JOIN (SELECT track_id, max(pts + duration) AS presentation_end FROM samples GROUP BY track_id) p USING (track_id)""", views.SAMPLES)
def mux_durations(spark, sf):
    s = views.samples(spark, sf)
    joined = S.mux_duration(s).join(S.presentation_end(s), "track_id")
    return joined.withColumn("movie", T.scale_duration(F.col("presentation_end"), F.lit(90000), F.lit(1000)))


_PERTURBED = "moved AS (SELECT track_id, decode_index, duration, dts + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS dts FROM samples)"


@query("""SELECT track_id, decode_index, dts, expected FROM (SELECT *, coalesce(lag(dts + duration) OVER (PARTITION BY track_id ORDER BY decode_index), 0) AS expected FROM moved) WHERE dts <> expected""", views.SAMPLES, _PERTURBED)
def dts_contiguity(spark, sf):
    s = views.samples(spark, sf).withColumn("dts", F.col("dts") + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0))
    return S.dts_breaks(s).select("track_id", "decode_index", "dts", "expected")


@query("""SELECT track_id, decode_index, expected FROM (SELECT track_id, event_id, decode_index, coalesce(lag(decode_index) OVER (PARTITION BY track_id ORDER BY decode_index) + 1, 0) AS expected
    FROM samples WHERE event_id % 7 <> 3) WHERE decode_index <> expected""", views.SAMPLES)
def consecutive_index(spark, sf):
    s = views.samples(spark, sf).where("event_id % 7 <> 3")
    return S.index_breaks(s, "decode_index", "decode_index").select("track_id", "decode_index", "expected")


@query("SELECT track_id, pts, count(*) AS n FROM samples GROUP BY track_id, pts HAVING count(*) > 1", views.SAMPLES)
def duplicate_identity(spark, sf):
    return S.duplicate_identities(views.samples(spark, sf), "pts")


_PRESENTED = "presented AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pts, dts, decode_index) - 1 AS p FROM samples), sized AS (SELECT *, max(p) OVER (PARTITION BY track_id) AS last FROM presented)"


@query("SELECT track_id, p AS presentation_index, p AS sequential, last - p AS reverse, CASE WHEN last - p <= p THEN 2 * (last - p) ELSE 2 * p + 1 END AS alternating FROM sized", views.SAMPLES, _PRESENTED)
def access_patterns(spark, sf):
    out = S.presentation_order(views.samples(spark, sf))
    for name in ("sequential", "reverse", "alternating"):
        out = S.access_pattern(out, name).withColumnRenamed("turn", name)
    return out.select("track_id", "presentation_index", "sequential", "reverse", "alternating")


@query("""SELECT track_id, decode_index, total, total > 100000 AS over FROM (SELECT track_id, decode_index, sum(size) OVER (PARTITION BY track_id ORDER BY decode_index)::BIGINT AS total FROM samples)""", views.SAMPLES)
def sample_budget(spark, sf):
    return S.budget_breach(views.samples(spark, sf), 100_000).select("track_id", "decode_index", "total", "over")


_FRAGMENTS = """frag AS (SELECT track_id, decode_index // 8 AS fragment_no, track_id AS traf_no, (decode_index % 8) // 4 AS run_no, decode_index % 4 AS i, event_id,
    CASE WHEN event_id % 3 <> 0 THEN duration END AS duration, CASE WHEN event_id % 4 <> 0 THEN size + 1 END AS size, CASE WHEN event_id % 5 = 0 THEN 65536 END AS flags, cto,
    decode_index // 8 * 5000 AS decode_time, (track_id % 2) * 300 AS default_duration, (track_id % 3) * 50 AS default_size, decode_index // 8 * 100000 AS moof_start, decode_index // 8 * 100000 + 7 AS base,
    CASE WHEN (decode_index % 8) // 4 = 0 OR track_id % 2 = 0 THEN 40 END AS data_offset, CASE WHEN decode_index % 8 < 4 THEN 33554432 END AS first_flags FROM samples),
res AS (SELECT *, coalesce(duration, nullif(default_duration, 0), 200) AS d, coalesce(size, nullif(default_size, 0), 60) AS z, coalesce(flags, CASE WHEN i = 0 THEN first_flags END, 16842752) AS f FROM frag),
cum AS (SELECT *, sum(d) OVER w - d AS bd, sum(z) OVER w - z AS bz FROM res WINDOW w AS (PARTITION BY fragment_no, traf_no ORDER BY run_no, i)),
anc AS (SELECT *, first_value(bz) OVER (PARTITION BY fragment_no, traf_no, CASE WHEN data_offset IS NOT NULL THEN run_no ELSE 0 END ORDER BY run_no, i) AS had FROM cum)"""


@query("""SELECT track_id, fragment_no, run_no, i, d AS duration, z AS size, (decode_time + bd)::BIGINT AS dts, (decode_time + bd + cto)::BIGINT AS pts,
    (base + 40 + bz - had)::BIGINT AS "offset", f & 65536 = 0 AS is_sync, CASE WHEN (f >> 20) & 255 = 0 THEN CASE WHEN f & 65536 = 0 THEN 2 ELSE 1 END ELSE (f >> 24) & 3 END::INTEGER AS depends_on FROM anc""", views.SAMPLES, _FRAGMENTS)
def fragment_defaults(spark, sf):
    s = views.samples(spark, sf)
    div = lambda c, n: F.call_function("div", c, F.lit(n).cast("long"))
    no = div(F.col("decode_index"), 8)
    run = div(F.col("decode_index") % 8, 4)
    rows = s.select(
        F.lit("f").alias("file_id"), "track_id", no.alias("fragment_no"), F.col("track_id").alias("traf_no"), run.alias("run_no"), (F.col("decode_index") % 4).alias("i"),
        (no * 100000).alias("moof_start"), (no * 100000 + 7).alias("base"), (no * 5000).alias("decode_time"), ((F.col("track_id") % 2) * 300).alias("default_duration"), ((F.col("track_id") % 3) * 50).alias("default_size"),
        F.lit(0).alias("default_flags"), F.when((run == 0) | (F.col("track_id") % 2 == 0), 40).alias("data_offset"), F.when(F.col("decode_index") % 8 < 4, 33554432).alias("first_flags"),
        F.when(F.col("event_id") % 3 != 0, F.col("duration")).alias("duration"), F.when(F.col("event_id") % 4 != 0, F.col("size") + 1).alias("size"), F.when(F.col("event_id") % 5 == 0, 65536).alias("flags"), "cto",
    )
    trex = s.select("track_id").distinct().select(F.lit("f").alias("file_id"), "track_id", F.lit(200).alias("duration"), F.lit(60).alias("size"), F.lit(16842752).alias("flags"))
    out = S.fragment_samples(rows, trex)
    return out.select("track_id", "fragment_no", "run_no", "i", "duration", "size", "dts", "pts", "offset", "is_sync", F.col("dependency.depends_on").cast("int").alias("depends_on"))


@query("""SELECT track_id, decode_index, ((event_id % 4) * 64 + (event_id % 3) * 16 + (event_id % 2) * 4 + event_id % 4) AS packed, event_id % 4 AS is_leading, event_id % 3 AS depends_on, event_id % 2 AS is_depended_on, event_id % 4 AS has_redundancy FROM samples""", views.SAMPLES)
def dependency_flags(spark, sf):
    s = views.samples(spark, sf)
    e = F.col("event_id")
    s = s.withColumn("packed", P.pack_dependency(e % 4, e % 3, e % 2, e % 4))
    return s.select("track_id", "decode_index", "packed", P.unpack_dependency(F.col("packed")).alias("u")).select("track_id", "decode_index", "packed", "u.*")


@query("SELECT s.track_id, s.decode_index FROM samples s WHERE NOT (s.dts % 1000 + s.size <= 900 AND s.size > 0)", views.SAMPLES)
def sample_outside_media(spark, sf):
    s = views.samples(spark, sf).select("track_id", "decode_index", F.col("dts").alias("offset"), "size")
    top = s.groupBy("track_id").agg(F.call_function("div", F.max("offset"), F.lit(1000).cast("long")).alias("last"))
    ranges = top.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("k")).select("track_id", (F.col("k") * 1000).alias("r_start"), (F.col("k") * 1000 + 900).alias("r_end"))
    empty = s.where("size <= 0")
    return intervals.not_contained(s.where("size > 0"), ranges, ("track_id",)).unionByName(empty).select("track_id", "decode_index")


# --- audio ----------------------------------------------------------------------------------


@query("""SELECT track_id, packet_no, expected FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY track_id ORDER BY packet_no), 0) AS expected FROM (SELECT track_id, packet_no, start, "end" + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS e FROM packets))
    WHERE start <> expected OR e <= start""", views.PACKETS)
def packet_contiguity(spark, sf):
    p = views.packets(spark, sf).withColumn("end", F.col("end") + F.when(F.col("n") % 11 == 0, 1).otherwise(0))
    return audio.packet_breaks(p).select("track_id", "packet_no", "expected")


_TRIM = """trim AS (SELECT track_id, track_id % 400 AS priming, track_id % 37 AS padding, track_id % 21 - 10 AS track_offset, max("end") AS decoded_length FROM packets GROUP BY track_id)"""


@query("""SELECT track_id, decoded_length, CASE WHEN decoded_length - priming - padding >= 0 AND decoded_length - priming - padding + track_offset >= 0 THEN decoded_length - priming - padding + track_offset END AS presentation_length,
    greatest(track_offset, 0) AS start, greatest(track_offset, 0) + greatest(decoded_length - padding - priming - greatest(-track_offset, 0), 0) AS "end", priming + greatest(-track_offset, 0) AS media_start FROM trim""", views.PACKETS, _TRIM)
def gapless_trim(spark, sf):
    p = views.packets(spark, sf).withColumn("priming", F.col("track_id") % 400).withColumn("padding", F.col("track_id") % 37).withColumn("track_offset", F.col("track_id") % 21 - 10)
    out = audio.gapless_length(p)
    span = audio.gapless_edit(F.col("priming"), F.col("padding"), F.col("track_offset"), F.col("decoded_length"))
    return out.select("track_id", "decoded_length", "presentation_length", span.alias("s")).select("track_id", "decoded_length", "presentation_length", "s.*")


_SHIFTED = """shifted AS (SELECT track_id, edit_no, greatest(start - 25, 0) AS start, "end" - 25 AS "end", media_start + greatest(25 - start, 0) AS media_start FROM edits WHERE "end" - 25 > 0)"""


@query('SELECT track_id, edit_no, start, "end", media_start FROM shifted', views.EDITS, _SHIFTED)
def edit_shift(spark, sf):
    return intervals.shift_edits(views.edits(spark, sf), F.lit(-25)).select("track_id", "edit_no", "start", "end", "media_start")


_REQUESTS = """requests AS (SELECT track_id, k AS request_no, k * 64 AS start, k * 64 + 100 AS "end" FROM (SELECT track_id, unnest(range(0, (max("end") + 63) // 64)) AS k FROM edits GROUP BY track_id))"""


@query("""SELECT r.track_id, r.request_no, e.edit_no, greatest(r.start, e.start) - r.start AS output_offset, e.media_start + greatest(r.start, e.start) - e.start AS media_start,
    e.media_start + least(r."end", e."end") - e.start AS media_end FROM requests r JOIN edits e ON r.track_id = e.track_id AND r.start < e."end" AND e.start < r."end" """, views.EDITS, _REQUESTS)
def edit_mapping(spark, sf):
    e = views.edits(spark, sf)
    last = F.call_function("div", F.max("end") - 1, F.lit(64).cast("long"))
    r = e.groupBy("track_id").agg(last.alias("last")).select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("request_no"))
    r = r.withColumn("start", F.col("request_no") * 64).withColumn("end", F.col("start") + 100)
    e = e.withColumnRenamed("start", "e_start").withColumnRenamed("end", "e_end")
    out = intervals.map_requests(r, e, ("track_id",), 64)
    return out.select("track_id", "request_no", "edit_no", "output_offset", "media_start", "media_end")


_RANGES = """asked AS (SELECT DISTINCT track_id, 100 + track_id % 300 AS s, 400 + track_id % 300 AS e FROM packets)"""


@query("""SELECT a.track_id, min(packet_no) AS first_packet, max(packet_no) AS last_packet, greatest(min(packet_no) - 1, 0) AS decode_start FROM asked a JOIN packets p ON a.track_id = p.track_id AND p.start < a.e AND a.s < p."end" GROUP BY a.track_id""", views.PACKETS, _RANGES)
def packets_for_range(spark, sf):
    p = views.packets(spark, sf)
    r = p.select("track_id").distinct().select("track_id", (F.col("track_id") % 300 + 100).alias("start"), (F.col("track_id") % 300 + 400).alias("end"))
    return intervals.packets_for_range(r, p.select("track_id", "packet_no", "start", "end"), ("track_id",), 256, 1).select("track_id", "first_packet", "last_packet", "decode_start")


@query("""SELECT track_id, request_no, count(*) AS n, sum(CASE WHEN x >= 50 AND x - 30 < len THEN (x - 30) % 1000 ELSE 0 END)::BIGINT AS total FROM (
    SELECT track_id, len, request_no, request_no * 300 + unnest(range(0, 300)) AS x FROM (SELECT track_id, max("end") AS len, unnest(range(0, (max("end") + 100 + 299) // 300)) AS request_no FROM packets GROUP BY track_id))
    GROUP BY track_id, request_no""", views.PACKETS)
def assembled_audio(spark, sf):
    """Every track in pieces of 300 samples, from silence before its edit to silence behind it."""
    p = views.packets(spark, sf)
    stored = p.withColumn("samples", F.transform(F.sequence("start", F.col("end") - 1), lambda i: (i % 1000).cast("float")))
    tracks = p.groupBy("track_id").agg(F.max("end").alias("len"))
    last = F.call_function("div", F.col("len") + 99, F.lit(300).cast("long"))
    requests = tracks.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("request_no"))
    requests = requests.withColumn("start", F.col("request_no") * 300).withColumn("end", F.col("start") + 300)
    edits = tracks.select("track_id", F.lit(50).cast("long").alias("start"), (F.col("len") + 30).alias("end"), F.lit(20).cast("long").alias("media_start"))
    out = audio.assemble(requests, edits, stored, width=256)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return out.select("track_id", "request_no", F.size("samples").cast("long").alias("n"), total.cast("long").alias("total"))


# --- pictures -------------------------------------------------------------------------------


@query("SELECT track_id, n, (sum(CASE WHEN resets AND n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY n))::BIGINT AS cvs FROM pictures", views.PICTURES)
def coded_sequences(spark, sf):
    return pictures.coded_sequences(views.pictures(spark, sf)).select("track_id", "n", "cvs")


_POC = """poc0 AS (SELECT *, sum(resets::INT) OVER (PARTITION BY track_id ORDER BY n) AS stretch, coalesce(last_value(CASE WHEN carries THEN poc_lsb END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM pictures),
poc1 AS (SELECT *, CASE WHEN resets THEN 0 WHEN poc_lsb < prev AND prev - poc_lsb >= 8 THEN 16 WHEN poc_lsb > prev AND poc_lsb - prev > 8 THEN -16 ELSE 0 END AS step FROM poc0),
poc AS (SELECT track_id, n, poc_lsb, (coalesce(sum(CASE WHEN carries THEN step END) OVER (PARTITION BY track_id, stretch ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + step)::BIGINT AS poc_msb FROM poc1)"""


@query("SELECT track_id, n, poc_msb, poc_msb + poc_lsb AS poc FROM poc", views.PICTURES, _POC)
def picture_order(spark, sf):
    return pictures.picture_order(views.pictures(spark, sf)).select("track_id", "n", "poc_msb", "poc")


@query("""SELECT track_id, n, row_number() OVER (PARTITION BY track_id ORDER BY cvs, poc, n) - 1 AS output_index FROM (SELECT p.track_id, p.n, poc_msb + p.poc_lsb AS poc, event_id % 6 <> 0 AS output,
    sum(CASE WHEN resets AND p.n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p.track_id ORDER BY p.n) AS cvs FROM pictures p JOIN poc q ON p.track_id = q.track_id AND p.n = q.n) WHERE output""", views.PICTURES, _POC)
def output_order(spark, sf):
    p = pictures.picture_order(pictures.coded_sequences(views.pictures(spark, sf))).withColumn("output", F.col("event_id") % 6 != 0)
    w = Window.partitionBy("track_id").orderBy("cvs", "poc", "n")
    return p.where("output").select("track_id", "n", (F.row_number().over(w) - 1).cast("long").alias("output_index"))


_SETS = """rps AS (SELECT track_id, n, resets, poc_msb + poc_lsb AS poc FROM pictures JOIN poc USING (track_id, n, poc_lsb))"""


@query("""SELECT track_id, n, CASE WHEN resets THEN '' ELSE (poc - 1)::VARCHAR END AS st_curr_before, CASE WHEN resets THEN '' ELSE (poc + 2)::VARCHAR END AS st_curr_after, CASE WHEN resets THEN '' ELSE (poc - 3)::VARCHAR END AS st_foll,
    CASE WHEN resets THEN '' ELSE (5 + poc - 16 - (poc & 15))::VARCHAR END AS lt_curr, CASE WHEN resets THEN '' ELSE '9' END AS lt_foll FROM rps""", views.PICTURES, _POC, _SETS)
def reference_sets(spark, sf):
    p = pictures.picture_order(views.pictures(spark, sf))
    st = "array<struct<delta:bigint,used:boolean>>"
    neg = F.array(F.struct(F.lit(-1), F.lit(True)), F.struct(F.lit(-3), F.lit(False))).cast(st)
    pos = F.array(F.struct(F.lit(2), F.lit(True))).cast(st)
    far = F.array(F.struct(F.lit(5), F.lit(True), F.lit(1), F.lit(True)), F.struct(F.lit(9), F.lit(False), F.lit(0), F.lit(False))).cast("array<struct<lsb:bigint,has_msb:boolean,msb_cycle:bigint,used:boolean>>")
    r = pictures.reference_sets(F.col("resets"), F.col("poc"), F.col("max_poc_lsb"), neg, pos, far)
    names = ("st_curr_before", "st_curr_after", "st_foll", "lt_curr", "lt_foll")
    return p.select("track_id", "n", r.alias("r")).select("track_id", "n", *(joined(F.col(f"r.{x}")).alias(x) for x in names))


@query(f"""SELECT track_id, n, {_joined('list_transform(range(0, active), lambda i: CASE WHEN len(once) = 0 THEN NULL ELSE once[i % len(once) + 1] END)')} AS list0 FROM
    (SELECT track_id, n, n % 5 + 1 AS active, list_concat(CASE WHEN n % 3 > 0 THEN [n - 1] ELSE []::BIGINT[] END, CASE WHEN n % 4 > 1 THEN [n + 1, n + 2] ELSE []::BIGINT[] END) AS once FROM pictures)""", views.PICTURES)
def reference_list(spark, sf):
    p = views.pictures(spark, sf)
    none = F.array().cast("array<bigint>")
    first = F.when(F.col("n") % 3 > 0, F.array(F.col("n") - 1)).otherwise(none)
    second = F.when(F.col("n") % 4 > 1, F.array(F.col("n") + 1, F.col("n") + 2)).otherwise(none)
    active = (F.col("n") % 5 + 1).cast("int")
    return p.select("track_id", "n", joined(pictures.reference_list(first, second, none, active, F.lit(0))).alias("list0"))


_UNITS = "units AS (SELECT track_id, decode_index AS unit_no, CASE WHEN is_sync OR event_id % 4 = 0 THEN 'set' ELSE 'slice' END AS kind, event_id % 2 AS id FROM samples)"


@query("""SELECT s.track_id, s.unit_no, max(p.unit_no) AS set_no FROM units s LEFT JOIN units p ON s.track_id = p.track_id AND s.id = p.id AND p.kind = 'set' AND p.unit_no <= s.unit_no WHERE s.kind = 'slice' GROUP BY s.track_id, s.unit_no""", views.SAMPLES, _UNITS)
def active_parameter_sets(spark, sf):
    s = views.samples(spark, sf)
    units = s.select("track_id", F.col("decode_index").alias("unit_no"), F.when(F.col("is_sync") | (F.col("event_id") % 4 == 0), "set").otherwise("slice").alias("kind"), (F.col("event_id") % 2).alias("id"))
    return pictures.active_parameter_sets(units).select("track_id", "unit_no", "set_no")


# --- pixels and frames ----------------------------------------------------------------------

_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"SELECT {_KEY}, 16 + (r * 219 + 127) // 255 AS limited, least(255, (greatest(g - 16, 0) * 255 + 109) // 219) AS full_range FROM pixels", views.PIXELS)
def range_conversion(spark, sf):
    return views.pixels(spark, sf).select(*_KEY.split(", "), P.full_to_limited(F.col("r")).cast("int").alias("limited"), P.limited_to_full(F.col("g")).cast("int").alias("full_range"))


@query(f"SELECT {_KEY}, (77 * r + 150 * g + 29 * b + 128) >> 8 AS gray FROM pixels", views.PIXELS)
def gray_convert(spark, sf):
    return views.pixels(spark, sf).select(*_KEY.split(", "), P.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


@query(f"""SELECT {_KEY}, least(235, greatest(16, ((66 * r + 129 * g + 25 * b + 128) >> 8) + 16)) AS y,
    least(240, greatest(16, (-152 * r - 296 * g + 448 * b + 131584) // 1024)) AS u, least(240, greatest(16, (448 * r - 376 * g - 72 * b + 131584) // 1024)) AS v FROM pixels""", views.PIXELS)
def rgb_to_yuv(spark, sf):
    p = views.pixels(spark, sf)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    c = P.rgb_sums_to_chroma(4 * r, 4 * g, 4 * b)
    return p.select(*_KEY.split(", "), P.rgb_to_luma(r, g, b).alias("y"), c["u"].alias("u"), c["v"].alias("v"))


def _mh(a: str, k: int) -> str:
    return f"floor(({a})::BIGINT * {k} / 65536.0)::BIGINT"


@query(f"""SELECT {_KEY}, least(255, greatest(0, {_mh('r*8-128', 9539)} + {_mh('b*8-1024', 13075)}))::INTEGER AS red,
    least(255, greatest(0, {_mh('r*8-128', 9539)} + {_mh('g*8-1024', -3209)} + {_mh('b*8-1024', -6660)}))::INTEGER AS green,
    least(255, greatest(0, {_mh('r*8-128', 9539)} + {_mh('g*8-1024', 16525)}))::INTEGER AS blue FROM pixels""", views.PIXELS)
def yuv_to_rgb(spark, sf):
    c = P.yuv_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return views.pixels(spark, sf).select(*_KEY.split(", "), c["r"].alias("red"), c["g"].alias("green"), c["b"].alias("blue"))


@query(f"SELECT frame_id, y, {_joined('list_transform(range(0, 5), lambda x: gray[(y * 8 // 5) * 8 + x * 8 // 5 + 1])')} AS row FROM images, range(0, 5) t(y)", views.IMAGES)
def nearest_scale(spark, sf):
    i = views.images(spark, sf).select("frame_id", "gray", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("y"))
    at = lambda x: (P.nearest_source(F.col("y"), F.lit(5).cast("long"), F.lit(8).cast("long")) * 8 + P.nearest_source(x, F.lit(5).cast("long"), F.lit(8).cast("long"))).cast("int")
    return i.select("frame_id", "y", joined(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda x: F.get("gray", at(x)))).alias("row"))


@query("SELECT frame_id, y AS row_no, list_sum(gray[(CASE WHEN frame_id % 2 = 0 THEN 7 - y ELSE y END) * 8 + 1 : (CASE WHEN frame_id % 2 = 0 THEN 7 - y ELSE y END) * 8 + 8])::BIGINT AS total FROM images, range(0, 8) t(y)", views.IMAGES)
def flip(spark, sf):
    i = views.images(spark, sf).select("frame_id", "gray", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("row_no"))
    side = F.when(F.col("frame_id") % 2 == 0, "BottomLeft").otherwise("TopLeft")
    stored = P.stored_row(F.col("row_no"), 8, side)
    return i.select("frame_id", "row_no", F.aggregate(F.slice("gray", (stored * 8 + 1).cast("int"), F.lit(8)), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""SELECT a.frame_id, round(CASE WHEN s = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025.0 * 64 / s) END, 6) AS psnr FROM (SELECT x.frame_id, list_sum(list_transform(list_zip(x.gray, y.gray), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s
    FROM images x JOIN images y ON y.frame_id = x.frame_id + 1) a""", views.IMAGES)
def image_psnr(spark, sf):
    i = views.images(spark, sf)
    other = i.select((F.col("frame_id") - 1).alias("frame_id"), F.col("gray").alias("next"))
    return i.join(other, "frame_id").select("frame_id", F.round(frames.psnr(F.col("gray"), F.col("next")), 6).alias("psnr"))


@query("SELECT label, min(p) AS min_psnr FROM (SELECT x.label, CASE WHEN s = 0 THEN NULL ELSE round(10 * log10(65025.0 * 64 / s), 6) END AS p FROM (SELECT x.label, list_sum(list_transform(list_zip(x.gray, y.gray), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM images x JOIN images y ON y.frame_id = x.frame_id + 1) x) GROUP BY label", views.IMAGES)
def least_psnr(spark, sf):
    i = views.images(spark, sf)
    other = i.select((F.col("frame_id") - 1).alias("frame_id"), F.col("gray").alias("next"))
    p = i.join(other, "frame_id").select("label", frames.psnr(F.col("gray"), F.col("next")).alias("p"))
    return p.groupBy("label").agg(F.min(F.when(F.col("p") < float("inf"), F.round("p", 6))).alias("min_psnr"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, regexp_full_match(sha256(coalesce(text, '')), '[0-9a-fA-F]{64}') AS valid FROM documents")
def text_digest(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", C.digest_hex(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    return d.withColumn("valid", C.is_digest(F.col("digest")))


@query("""SELECT frame_id, sha256(unhex('00000008000000080300' || '01' || list_aggregate(list_transform(gray, lambda v: lpad(hex(v), 2, '0')), 'string_agg', ''))) AS digest FROM images""", views.IMAGES)
def frame_digest(spark, sf):
    # Rows lie 16 bytes apart: padding must not reach the digest.
    i = views.images(spark, sf)
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    row = lambda y: F.concat(F.array_join(F.transform(F.slice("gray", (y * 8 + 1).cast("int"), F.lit(8)), two), ""), F.lit("AB" * 8))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), row), ""))
    f = i.select("frame_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("Gray8").alias("pixel_format"), F.lit("Full").alias("color_range"), F.array(F.struct(data.alias("data"), F.lit(16).alias("stride"))).alias("planes"))
    return f.select("frame_id", frames.frame_digest().alias("digest"))


@query("""SELECT p_partkey, CASE WHEN w = 0 OR h = 0 THEN 'InvalidInput' WHEN w > 8192 OR h > 8192 THEN 'ResourceLimit' WHEN s < w * 4 THEN 'InvalidInput' WHEN l < s * h THEN 'InvalidInput' END AS kind FROM
    (SELECT p_partkey, p_partkey % 5 AS w, CASE WHEN p_partkey % 13 = 0 THEN 9000 ELSE p_partkey % 3 END AS h, p_partkey % 7 + 9 AS s, 2 * (p_partkey % 9) + 10 AS l FROM part)""")
def frame_validation(spark, sf):
    k = F.col("p_partkey")
    p = views.table(spark, sf, "part").select("p_partkey", (k % 5).cast("int").alias("width"), F.when(k % 13 == 0, 9000).otherwise(k % 3).cast("int").alias("height"), F.lit("Rgba8").alias("pixel_format"),
        F.array(F.struct(F.repeat(F.lit("x"), (2 * (k % 9) + 10).cast("int")).cast("binary").alias("data"), (k % 7 + 9).cast("int").alias("stride"))).alias("planes"))
    return p.select("p_partkey", frames.frame_error()["kind"].alias("kind"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'RepackStride' END, CASE WHEN p_partkey % 3 = 0 THEN 'Scale' END, CASE WHEN p_partkey % 5 = 0 THEN 'FlipVertical' END, CASE WHEN p_partkey % 7 = 0 THEN 'ConvertPixelFormat' END,
    CASE WHEN p_partkey % 11 = 0 THEN 'ConvertColor' END], lambda s: s IS NOT NULL), ',') AS stages FROM part""")
def transfer_plan(spark, sf):
    k = F.col("p_partkey")
    p = views.table(spark, sf, "part")
    pick = lambda n, a, b: F.when(k % n == 0, b).otherwise(a)
    one = F.struct(F.lit(64).alias("stride"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("TopLeft").alias("orientation"), F.lit("Rgba8").alias("pixel_format"), F.lit("Full").alias("color_range"))
    two = F.struct(pick(2, 64, 32).alias("stride"), pick(3, 8, 4).alias("width"), F.lit(8).alias("height"), pick(5, "TopLeft", "BottomLeft").alias("orientation"), pick(7, "Rgba8", "Bgra8").alias("pixel_format"), pick(11, "Full", "Limited").alias("color_range"))
    return p.select("p_partkey", one.alias("source"), two.alias("target")).select("p_partkey", joined(frames.transfer_plan()).alias("stages"))


# --- codec strings and codes ----------------------------------------------------------------


@query("""SELECT p_partkey, printf('av01.%d.%02d%s.%02d.%d.%d%d%d', p_partkey % 3, p_partkey % 24, CASE WHEN p_partkey % 2 = 1 THEN 'H' ELSE 'M' END,
    CASE WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 3 = 2 AND p_partkey % 5 = 1 THEN 12 ELSE 10 END ELSE 8 END, (p_partkey % 6 = 1)::INT, (p_partkey % 7 = 1)::INT, (p_partkey % 8 = 1)::INT, p_partkey % 4) AS codec FROM part""")
def codec_string_av1(spark, sf):
    k = F.col("p_partkey")
    bit = lambda n: (k % n == 1).cast("int")
    return views.table(spark, sf, "part").select("p_partkey", C.av1_string(k % 3, k % 24, bit(2), bit(4), bit(5), bit(6), bit(7), bit(8), k % 4).alias("codec"))


@query("""SELECT p_partkey, 'hev1.' || ['', 'A', 'B', 'C'][p_partkey % 4 + 1] || (p_partkey % 3)::VARCHAR || '.' || upper(to_hex(p_partkey * 4096 + 1)) || '.' || CASE WHEN p_partkey % 2 = 1 THEN 'H' ELSE 'L' END || (p_partkey % 190)::VARCHAR ||
    CASE WHEN p_partkey % 5 > 0 THEN '.B0' || '.00' || '.' || lpad(upper(to_hex(p_partkey % 5)), 2, '0') ELSE CASE WHEN p_partkey % 2 = 0 THEN '.B0' ELSE '.B0' END END AS codec, CASE WHEN p_partkey % 3 = 2 THEN 'HevcMain10' ELSE 'HevcMain' END AS profile FROM part""")
def codec_string_hevc(spark, sf):
    k = F.col("p_partkey")
    zero = F.lit(0).cast("long")
    tail = F.array(F.lit(0xB0).cast("long"), zero, k % 5, zero, zero, zero)
    return views.table(spark, sf, "part").select("p_partkey", C.hevc_string(k % 4, k % 3, k * 4096 + 1, k % 2, k % 190, tail).alias("codec"), C.hevc_profile(k % 3).alias("profile"))


@query("""SELECT p_partkey, CASE WHEN x <= 36864 THEN 30 WHEN x <= 122880 THEN 60 WHEN x <= 245760 THEN 63 WHEN x <= 552960 THEN 90 WHEN x <= 983040 THEN 93 WHEN x <= 2228224 THEN 120 WHEN x <= 8912896 THEN 150 WHEN x <= 35651584 THEN 180 ELSE 186 END AS level
    FROM (SELECT p_partkey, p_partkey * p_partkey * 37 AS x FROM part)""")
def level_for_size(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", C.level_for(F.col("p_partkey") * F.col("p_partkey") * 37).alias("level"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'MALFORMED_MEDIA' WHEN 'view' THEN 'IO' WHEN 'click' THEN 'CANCELLED' WHEN 'purchase' THEN 'RESOURCE_LIMIT' END AS code FROM events""")
def error_code(spark, sf):
    e = views.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "MalformedMedia").when(F.col("event_type") == "view", "Io").when(F.col("event_type") == "click", "Cancelled").when(F.col("event_type") == "purchase", "ResourceLimit").otherwise("Other")
    return e.select("event_id", errors.error_code(kind).alias("code"))
