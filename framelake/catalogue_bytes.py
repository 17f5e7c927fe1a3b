"""Queries over byte streams, files, readers and players; those that undo themselves have SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake import views
from framelake.catalogue import _POC, joined, query
from framelake.functions import blocks as B
from framelake.functions.bits import Bits, BitWriter, insert_emulation, leb128, put_leb128, strip_emulation
from framelake.functions.codecs import byte_at
from framelake.operators import frames
from framelake.operators import guards as G
from framelake.operators.audio import edit_breaks
from framelake.operators.reader import cache_statistics, read_frames
from framelake.operators.samples import access_pattern, presentation_order
from framelake.plans import conformance
from framelake.plans.sequence import sequence_pictures
from framelake.session import materialise
from framelake.sources import mp4, nal, obu
from framelake.sources import parameter_sets as PS
from framelake.streaming.playback import play_batch


def _map(df: DataFrame, schema: str, row: Callable[..., list[tuple]]) -> DataFrame:
    """Rows to rows in Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [r for x in p.itertuples(index=False) for r in row(*x)]
            yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})

    return df.mapInPandas(run, schema)


@query("SELECT event_id, event_id AS value, CASE WHEN event_id < 128 THEN 1 WHEN event_id < 16384 THEN 2 WHEN event_id < 2097152 THEN 3 ELSE 4 END::BIGINT AS used FROM events")
def leb128_round_trip(spark, sf):
    def row(i):
        return [(i, *leb128(put_leb128(i)))]

    return _map(views.table(spark, sf, "events").select("event_id"), "event_id long, value long, used long", row)


@query("SELECT event_id, event_id AS unsigned, event_id % 1001 - 500 AS signed, event_id % 32 AS plain FROM events")
def exp_golomb_round_trip(spark, sf):
    def row(i):
        data = BitWriter().ue(i).se(i % 1001 - 500).u(i % 32, 5).trailing().bytes()
        b = Bits(data)
        return [(i, b.ue(), b.se(), b.u(5))]

    return _map(views.table(spark, sf, "events").select("event_id"), "event_id long, unsigned long, signed long, plain long", row)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, true AS clean FROM documents")
def emulation_round_trip(spark, sf):
    """Bytes with runs of zeros: after insertion no start code is left, and stripping undoes it."""

    def row(i, t):
        import hashlib

        data = (t or "").encode()
        spread = data.replace(b" ", b"\0\0\1").replace(b"e", b"\0\0\0\3")
        coded = insert_emulation(spread)
        same = strip_emulation(coded) == spread
        clean = b"\0\0\1" not in coded and b"\0\0\0" not in coded and b"\0\0\2" not in coded
        return [(i, hashlib.sha256(data).hexdigest() if same else None, clean)]

    return _map(views.table(spark, sf, "documents").select("doc_id", "text"), "doc_id long, digest string, clean boolean", row)


@query("""SELECT doc_id, k AS unit_no, sha256(substr(t, k * 50 + 1, 50)) AS digest FROM (SELECT doc_id, t, unnest(range(0, (length(t) + 49) // 50)) AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def nal_split(spark, sf):
    """Every piece of a text as a NAL unit of a byte stream, walked back."""
    d = views.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))

    def pack(i, t):
        units = [bytes([32 << 1, 1]) + insert_emulation(t[at : at + 50].encode() + b"\x80") for at in range(0, len(t), 50)]
        return [(i, nal.join_annexb(units))] if units else []

    streams = _map(d, "stream_id long, data binary", pack)
    u = nal.unit_rows(streams)
    body = u["rbsp"].substr(F.lit(1), F.octet_length("rbsp") - 1)
    return u.select(F.col("stream_id").alias("doc_id"), "unit_no", F.sha2(body, 256).alias("digest"))


@query("""SELECT doc_id, k + 1 AS unit_no, 'Metadata' AS obu_type, strlen(substr(t, k * 70 + 1, 70))::BIGINT AS n FROM (SELECT doc_id, t, unnest(range(0, (length(t) + 69) // 70)) AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
    UNION ALL SELECT doc_id, 0, 'TemporalDelimiter', 0 FROM documents""")
def obu_walk(spark, sf):
    """Every piece of a text as a metadata unit behind a temporal delimiter, walked back."""
    d = views.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))

    def pack(i, t):
        return [(i, obu.unit(2, b"") + b"".join(obu.unit(5, t[at : at + 70].encode()) for at in range(0, len(t), 70)))]

    u = obu.unit_rows(_map(d, "stream_id long, data binary", pack))
    return u.select(F.col("stream_id").alias("doc_id"), "unit_no", "obu_type", F.octet_length("payload").cast("long").alias("n"))


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, md5(coalesce(text, '')) AS digest FROM documents")
def sei_walk(spark, sf):
    """A text as the payload of an unregistered message, whose size takes runs of 255."""
    d = views.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))

    def row(i, t):
        import hashlib

        data = t.encode()
        unit = b"\x05" + b"\xff" * (len(data) // 255) + bytes([len(data) % 255]) + data + b"\x80"
        (_, n, _, payload), *_ = nal.parse_sei(unit)
        return [(i, n, hashlib.md5(payload).hexdigest())]

    return _map(d, "doc_id long, n long, digest string", row)


def _written(spark, sf) -> DataFrame:
    """A file for every track of the view: its samples, with their event ids as payload."""
    s = views.samples(spark, sf)
    rows = s.select(
        F.concat(F.lit("track"), F.col("track_id")).alias("file_id"), F.lit(1).cast("long").alias("track_id"), F.col("decode_index").alias("write_no"), "dts", "pts", "duration", "is_sync",
        F.when(F.col("is_sync"), 0x20).otherwise(0x10).alias("sdtp"), F.concat(F.lit("sample "), F.col("event_id")).cast("binary").alias("data"),
    )
    config = bytes([0, 0, 0, 12]) + b"av1C" + bytes([0x81, 4, 0, 0])
    tracks = rows.select("file_id").distinct().select("file_id", F.lit(1).cast("long").alias("track_id"), F.lit("Video").alias("kind"), F.lit("Av1").alias("codec"), F.lit(1000).alias("timescale"), F.lit(64).alias("width"), F.lit(48).alias("height"), F.lit(config).alias("decoder_config"))
    return mp4.write_files(rows, tracks)


@query("""SELECT 'track' || track_id AS file_id, decode_index, dts, pts, duration, is_sync, row_number() OVER (PARTITION BY track_id ORDER BY pts, dts, decode_index) - 1 AS presentation_index, sha256('sample ' || event_id) AS digest FROM samples""", views.SAMPLES)
def mp4_round_trip(spark, sf):
    """Written files, walked, their tables composed into the sample index, and the payloads read through it."""
    files = materialise(_written(spark, sf), "files")
    tables = mp4.split_tables(mp4.tables_of(files.select(F.col("file_id").alias("path"), "content"), "all"))
    found = mp4.payloads(mp4.sample_index(tables), files)
    return found.select("file_id", "decode_index", "dts", "pts", "duration", "is_sync", "presentation_index", F.sha2("data", 256).alias("digest"))


@query("SELECT 'track' || track_id AS file_id, 'Video' AS kind, 'Av1' AS codec, 1000::BIGINT AS timescale, 64 AS width, 48 AS height, sum(duration)::BIGINT AS duration FROM samples GROUP BY track_id", views.SAMPLES)
def mp4_tracks(spark, sf):
    content = _written(spark, sf).select(F.col("file_id").alias("path"), "content")
    return mp4.tables_of(content, "tracks").select("file_id", "kind", "codec", "timescale", "width", "height", "duration")


@query("SELECT DISTINCT 'track' || track_id AS file_id, path, depth::INTEGER AS depth FROM samples, (VALUES ('ftyp', 0), ('mdat', 0), ('moov', 0), ('moov/mvhd', 1), ('moov/trak', 1), ('moov/trak/mdia/minf/stbl/stts', 5)) t(path, depth)", views.SAMPLES)
def box_walk(spark, sf):
    content = _written(spark, sf).select(F.col("file_id").alias("path"), "content")
    shown = ("ftyp", "mdat", "moov", "moov/mvhd", "moov/trak", "moov/trak/mdia/minf/stbl/stts")
    return mp4.tables_of(content, "boxes").where(F.col("path").isin(*shown)).select("file_id", "path", "depth")


@query("SELECT 'track' || track_id AS file_id, true AS probed FROM samples GROUP BY track_id", views.SAMPLES)
def mp4_probe(spark, sf):
    """The native form of the probe: a size of 0, 1 or at least 8, and a known code."""
    f = _written(spark, sf)
    size = F.conv(F.hex(F.substring("content", 1, 4)), 16, 10).cast("long")
    ok = (F.octet_length("content") >= 8) & ((size <= 1) | (size >= 8)) & F.decode(F.substring("content", 5, 4), "ISO-8859-1").isin("ftyp", "moov")
    return f.select("file_id", ok.alias("probed"))


def _gray(spark, sf) -> DataFrame:
    """Images as gray tracks of up to ten frames, shown in another order than they are decoded."""
    i = views.images(spark, sf)
    place = F.col("frame_id") % 10
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    return i.select(
        F.call_function("div", F.col("frame_id"), F.lit(10).cast("long")).alias("track_id"), place.alias("decode_index"), F.when(place % 2 == 0, place + 1).otherwise(place - 1).alias("presentation_index"),
        (place % 4 == 0).alias("random_access"), F.unhex(F.array_join(F.transform("gray", two), "")).alias("data"),
    )


@query("""SELECT frame_id // 10 AS track_id, CASE WHEN frame_id % 2 = 0 THEN frame_id % 10 + 1 ELSE frame_id % 10 - 1 END AS presentation_index, sha256(unhex(list_aggregate(list_transform(gray, lambda v: lpad(hex(v), 2, '0')), 'string_agg', ''))) AS digest FROM images""", views.IMAGES)
def gray8_reader(spark, sf):
    """Every frame asked for in reverse through the exact-frame reader."""
    s = _gray(spark, sf)
    asked = s.select("track_id", (F.lit(10) - F.col("presentation_index")).alias("request_no"), "presentation_index")
    return read_frames(s, asked, "gray8", {"width": 8, "height": 8}).select("track_id", "presentation_index", F.sha2("frame", 256).alias("digest"))


@query("""SELECT frame_id // 10 AS track_id, pattern, count(*) AS frames, count(*) AS matching, 0::BIGINT AS errors FROM images, (VALUES ('sequential'), ('reverse'), ('alternating')) t(pattern) GROUP BY ALL""", views.IMAGES)
def conformance_patterns(spark, sf):
    s = _gray(spark, sf)
    golden = s.select("track_id", "presentation_index", F.sha2("data", 256).alias("digest"))
    return conformance.run_vectors(s, golden, "gray8", {"width": 8, "height": 8}).select("track_id", "pattern", "frames", "matching", "errors")


@query()
def cache_hits(spark, sf):
    """Hits of a cache of 32 frames with and without touching, when each track is asked for in order, in reverse and alternately."""
    asked = conformance.requests_for(presentation_order(views.samples(spark, sf)))
    lru, fifo = cache_statistics(asked, 32), cache_statistics(asked, 32, touch=False)
    return lru.join(fifo.select("track_id", F.col("hits").alias("fifo_hits")), "track_id")


@query()
def playback_ticks(spark, sf):
    """Players driven by events: signups start, purchases seek, the rest present; the clock runs on with each."""
    s = views.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    w = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1")
    c = s.select(F.col("user_id").alias("player_id"), w.cast("long").alias("command_no"), "event_id", "event_type")
    command = F.when((F.col("command_no") == 0) | (F.col("event_type") == "signup"), "play").when(F.col("event_type") == "purchase", "seek").otherwise("present")
    return play_batch(c.select("player_id", "command_no", command.alias("command"), (F.col("event_id") % 500).alias("argument"), (F.col("command_no") * 1700).alias("clock")), length=1_000_000)


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, [16 + (b * 219 + 127) // 255, 16 + (g * 219 + 127) // 255, 16 + (r * 219 + 127) // 255]::VARCHAR AS bgr FROM pixels", views.PIXELS)
def transfer_execute(spark, sf):
    """One RGBA pixel, stored bottom up, to limited-range BGRA with another stride."""
    p = views.pixels(spark, sf)
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    side = lambda f, r, o, n: F.struct(F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(f).alias("pixel_format"), F.lit(r).alias("color_range"), F.lit(o).alias("orientation"), F.lit(n).alias("stride"))
    data = F.unhex(F.concat(two(F.col("r")), two(F.col("g")), two(F.col("b")), F.lit("FF00")))
    out = frames.execute_transfers(p.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", data.alias("data"), side("Rgba8", "Full", "BottomLeft", 5).alias("source"), side("Bgra8", "Limited", "TopLeft", 8).alias("target")))
    three = F.concat(F.lit("["), F.array_join(F.array(*(byte_at(F.col("result"), i).cast("string") for i in (1, 2, 3))), ", "), F.lit("]"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", three.alias("bgr"))


# --- codec arithmetic and guards --------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN s > 63 THEN s - 64 ELSE 63 - s END AS state, (s > 63)::INTEGER AS mps FROM (SELECT p_partkey,
    least(126, greatest(1, floor((((p_partkey % 256) // 16) * 5 - 45) * least(51, greatest(0, p_partkey % 70 - 9)) / 16.0)::BIGINT + (p_partkey % 16) * 8 - 16)) AS s FROM part)""")
def context_state(spark, sf):
    k = F.col("p_partkey")
    c = B.context_state(k % 256, k % 70 - 9)
    return views.table(spark, sf, "part").select("p_partkey", c["state"].alias("state"), c["mps"].alias("mps"))


@query("""SELECT p_partkey, n, CASE p_partkey % 3 WHEN 0 THEN n * n WHEN 1 THEN n * (n // 4) + n * (n * 3 // 4) ELSE 4 * (n // 2) * (n // 2) END AS area, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS parts
    FROM (SELECT p_partkey, 8::BIGINT << (p_partkey % 4)::INTEGER AS n FROM part)""")
def unit_partitions(spark, sf):
    k = F.col("p_partkey")
    p = views.table(spark, sf, "part").select("p_partkey", F.call_function("shiftleft", F.lit(8).cast("long"), (k % 4).cast("int")).alias("n"))
    mode = F.element_at(F.array(F.lit("2Nx2N"), F.lit("2NxnU"), F.lit("NxN")), (k % 3 + 1).cast("int"))
    parts = B.unit_parts(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("n"), mode)
    return p.withColumn("r", parts).select("p_partkey", "n", F.aggregate("r", F.lit(0).cast("long"), lambda a, r: a + r["w"] * r["h"]).alias("area"), F.size("r").alias("parts"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(0, t), lambda i: ((i + 1) * b // t - i * b // t)::VARCHAR), ',') AS sizes FROM (SELECT p_partkey, p_partkey % 40 + 8 AS b, p_partkey % 7 + 1 AS t FROM part)""")
def tile_sizes(spark, sf):
    k = F.col("p_partkey")
    return views.table(spark, sf, "part").select("p_partkey", joined(B.uniform_tiles(k % 40 + 8, k % 7 + 1)).alias("sizes"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN abs(g - b) <= abs(r - b) AND abs(g - b) <= abs(r + g - 2 * b) THEN r WHEN abs(r - b) <= abs(r + g - 2 * b) THEN g ELSE b END AS predicted, ((r + g + b + 1) // 3)::BIGINT AS mean FROM pixels""", views.PIXELS)
def block_prediction(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    mean = B.dc_prediction(F.array(*(c.cast("long") for c in (r, g, b))))
    return views.pixels(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", B.paeth(b, r, g).alias("predicted"), mean.alias("mean"))


@query("SELECT frame_id, list_sum(gray)::BIGINT AS total FROM images", views.IMAGES)
def hadamard_round_trip(spark, sf):
    """The forward lifting steps undone by the inverse transform, over each sixteen samples of an image."""

    def forward(v):
        sums = B.let(v, lambda x: F.struct((x[0] + x[1]).alias("a"), (x[3] - x[2]).alias("d"), x[1].alias("b"), x[2].alias("c")))
        turned = B.let(sums, lambda s: F.struct(s["a"].alias("a"), s["d"].alias("d"), (F.shiftright(s["a"] - s["d"], 1) - s["c"]).alias("c"), (F.shiftright(s["a"] - s["d"], 1) - s["b"]).alias("b")))
        return B.let(turned, lambda s: F.array(s["a"] - s["c"], s["c"], s["d"] + s["b"], s["b"]))

    four = lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), f)
    turn = lambda m: four(lambda i: F.array(*(F.get(m[k], i) for k in range(4))))
    blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size("gray"), F.lit(16)).cast("int") - 1), lambda k: F.slice("gray", k * 16 + 1, F.lit(16)))
    i = views.images(spark, sf).select("frame_id", F.explode(blocks).alias("block"))
    i = i.withColumn("columns", F.transform(four(lambda c: F.array(*(F.get("block", c + 4 * r).cast("int") for r in range(4)))), forward))
    i = i.withColumn("coded", F.flatten(F.transform(turn(F.col("columns")), forward)))
    back = B.inverse_hadamard(F.col("coded"))
    same = F.aggregate(F.zip_with(back, F.col("block"), lambda a, b: F.abs(a - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    total = F.aggregate(back, F.lit(0).cast("long"), lambda a, x: a + x)
    found = i.select("frame_id", same.alias("same"), total.alias("total")).groupBy("frame_id").agg(F.sum("same").alias("same"), F.sum("total").alias("total"))
    return found.select("frame_id", F.when(F.col("same") == 0, F.col("total")).alias("total"))


@query("SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) AND c_acctbal >= 0 THEN c_acctbal::BIGINT END AS n, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS even FROM customer")
def safe_integers(spark, sf):
    c = views.table(spark, sf, "customer")
    text = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("9007199254740992"), F.col("c_custkey")))
    return c.select("c_custkey", B.safe_integer(F.col("c_acctbal").cast("string")).alias("n"), B.safe_integer(text).alias("even"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'UnsupportedCodec' WHEN p_partkey % 3 = 0 THEN 'UnsupportedProfile' WHEN p_partkey % 5 = 0 THEN 'HardwareUnavailable' WHEN p_partkey % 7 = 0 THEN 'InvalidConfiguration' ELSE 'Supported' END AS hevc,
    CASE WHEN p_partkey % 2 = 1 THEN 'UnsupportedCodec' WHEN p_partkey % 3 > 0 THEN 'UnsupportedProfile' WHEN p_partkey % 7 > 0 THEN 'InvalidConfiguration' WHEN p_partkey % 5 = 0 THEN 'HardwareUnavailable' ELSE 'Supported' END AS gray FROM part""")
def decoder_capability(spark, sf):
    k = F.col("p_partkey")
    p = views.table(spark, sf, "part").select(
        "p_partkey", F.when(k % 2 == 0, "UncompressedVideo").otherwise("Hevc").alias("codec"), F.when(k % 3 == 0, "UncompressedGray8").otherwise("HevcMain").alias("profile"), F.when(k % 5 == 0, "Require").otherwise("Any").alias("hardware"),
        F.when(k % 7 == 0, "Gray8").otherwise("Rgba8").alias("output_format"), F.lit("Limited").alias("color_range"), F.lit(0).alias("config_bytes"),
    )
    return p.select("p_partkey", G.decoder_support("hevc").alias("hevc"), G.decoder_support("uncompressed").alias("gray"))


@query("""SELECT track_id, packet_no, CASE WHEN packet_no % 5 = 0 THEN 'ResourceLimit' WHEN packet_no % 7 = 0 THEN 'InvalidInput' END AS kind FROM packets""", views.PACKETS)
def audio_validation(spark, sf):
    p = views.packets(spark, sf)
    n = F.col("packet_no")
    p = p.withColumn("sample_rate", F.when(n % 5 == 0, 0).otherwise(48000)).withColumn("channels", F.lit(2)).withColumn("n_samples", F.col("n") * 2 + F.when(n % 7 == 0, 1).otherwise(0))
    return p.select("track_id", "packet_no", G.audio_error()["kind"].alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 6 = 0 OR p_partkey % 7 = 0 THEN 'InvalidInput' END AS kind FROM part""")
def track_validation(spark, sf):
    k = F.col("p_partkey")
    body = F.concat(F.unhex(F.lpad(F.hex(F.when(k % 6 == 0, 13).otherwise(12)), 8, "0")), F.when(k % 7 == 0, "hvcC").otherwise("av1C").cast("binary"), F.unhex(F.lit("81040000")))
    p = views.table(spark, sf, "part").select("p_partkey", F.when(k % 5 == 0, 0).otherwise(1000).alias("timescale"), F.lit("Video").alias("kind"), F.lit("Av1").alias("codec"), body.alias("decoder_config"))
    return p.select("p_partkey", G.track_error()["kind"].alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'MalformedMedia' WHEN p_partkey % 5 = 0 THEN 'Unsupported' END AS kind FROM part""")
def unit_allow_list(spark, sf):
    k = F.col("p_partkey")
    types = F.array(F.lit("TemporalDelimiter"), F.lit("SequenceHeader"), F.when(k % 4 == 0, "Metadata").otherwise("Frame"), F.when(k % 5 == 0, "TileList").otherwise("Padding"))
    return views.table(spark, sf, "part").select("p_partkey", G.unit_list_error(types)["kind"].alias("kind"))


# --- units, sets and guards that the queries above do not reach ---


def _pieces(t: str, n: int) -> list[str]:
    return [t[at : at + n] for at in range(0, len(t), n)]


@query("""SELECT doc_id, (length(t) + 89) // 90 AS units, strlen(t)::BIGINT AS n, sha256(t) AS digest FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def nal_prefixed(spark, sf):
    """Every piece of a text as a unit behind its length, walked back."""

    def row(i, t):
        import hashlib

        units = [bytes([39 << 1, 1]) + p.encode() for p in _pieces(t or "", 90)]
        found = [u[2:] for u in nal.split_prefixed(nal.join_prefixed(units, 2), 2)] if units else []
        return [(i, len(found), sum(map(len, found)), hashlib.sha256(b"".join(found)).hexdigest())]

    return _map(views.table(spark, sf, "documents").select("doc_id", "text"), "doc_id long, units long, n long, digest string", row)


@query("""SELECT p_partkey, p_partkey % 32 AS profile, p_partkey % 200 AS level, p_partkey % 4 AS chroma, p_partkey % 8 + 8 AS depth, p_partkey % 5 AS units FROM part""")
def configuration_hevc(spark, sf):
    """Decoder configurations with parameter sets, parsed."""

    def row(k):
        arrays = b"".join(bytes([32 + i % 3]) + (1).to_bytes(2, "big") + (3).to_bytes(2, "big") + bytes([64 + 2 * (i % 3), 1, i]) for i in range(k % 5))
        fixed = bytes([1, k % 32]) + bytes(10) + bytes([k % 200]) + bytes(3) + bytes([0xFC | k % 4, 0xF8 | k % 8, 0xF8 | k % 8]) + bytes(2) + bytes([3, k % 5])
        c = nal.parse_hvcc(fixed + arrays)
        return [(k, c["profile"], c["level"], c["chroma_format"], c["bit_depth_luma"], len(c["units"]))]

    return _map(views.table(spark, sf, "part").select("p_partkey"), "p_partkey long, profile long, level long, chroma long, depth long, units long", row)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 < 3 THEN p_partkey % 7 END AS profile, CASE WHEN p_partkey % 7 < 3 THEN p_partkey % 24 END AS level, p_partkey % 7 >= 3 AS refused FROM part""")
def configuration_av1(spark, sf):
    """Configuration records, parsed; reserved profiles are refused."""
    from framelake.errors import MediaError

    def row(k):
        record = bytes([0, 0, 0, 12]) + b"av1C" + bytes([0x81, (k % 7) << 5 | k % 24, 0, 0])
        try:
            c = obu.parse_av1c(record)
        except MediaError:
            return [(k, None, None, True)]
        return [(k, c["profile"], c["level"], False)]

    return _map(views.table(spark, sf, "part").select("p_partkey"), "p_partkey long, profile long, level long, refused boolean", row)


@query("""SELECT doc_id, k::BIGINT AS tile, strlen(CASE WHEN k < 3 THEN substr(t, k * (length(t) // 4) + 1, length(t) // 4) ELSE substr(t, 3 * (length(t) // 4) + 1) END)::BIGINT AS n
    FROM (SELECT doc_id, text AS t FROM documents WHERE length(text) >= 4), range(0, 4) r(k)""")
def tile_groups(spark, sf):
    """A text cut into four tiles of a group, the last without a size, walked back."""

    def row(i, t):
        q = len(t) // 4
        tiles = [t[q * k : q * (k + 1)].encode() for k in range(3)] + [t[3 * q :].encode()]
        payload = bytes([0]) + b"".join((len(x) - 1).to_bytes(4, "little") + x for x in tiles[:3]) + tiles[3]
        return [(i, tile, len(data)) for tile, data in obu.tile_group(payload, 1, 1, 4)]

    return _map(views.table(spark, sf, "documents").where("length(text) >= 4").select("doc_id", "text"), "doc_id long, tile long, n long", row)


@query("""SELECT doc_id, k AS part, sha256(CASE WHEN k < (length(t) + 299) // 300 - 1 THEN substr(t, k * 300 + 1, 300) ELSE substr(t, k * 300 + 1) END) AS digest
    FROM (SELECT doc_id, t, unnest(range(0, greatest(1, (length(t) + 299) // 300))) AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def slice_substreams(spark, sf):
    """Pieces of a text as substreams, whose entry points count the bytes with emulation prevention."""

    def row(i, t):
        import hashlib

        pieces = [p.encode() for p in _pieces(t or "", 300)] or [b""]
        spread = [p.replace(b"e", b"\0\0\1") for p in pieces]
        data = b"".join(spread)
        escaped, ends, at = insert_emulation(data), [], 0
        for p in spread[:-1]:
            at += len(p)
            # Bytes of the escaped stream up to the one that stands for the next piece's first.
            ends.append(len(insert_emulation(data[: at + 1])) - 1)
        points = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        found = nal.split_substreams(data, escaped, points)
        return [(i, k, hashlib.sha256(x.replace(b"\0\0\1", b"e")).hexdigest()) for k, x in enumerate(found)]

    return _map(views.table(spark, sf, "documents").select("doc_id", "text"), "doc_id long, part long, digest string", row)


@query("""SELECT p_partkey, 16 * (p_partkey % 100 + 1) AS width, 8 * (p_partkey % 60 + 1) - 2 * (p_partkey % 3) AS height, p_partkey % 16 AS id, p_partkey % 4 AS reorder, (16 << (p_partkey % 13)::INTEGER)::BIGINT AS poc_lsb,
    concat_ws(',', -(p_partkey % 5 + 1), -(p_partkey % 5 + 2), p_partkey % 7 + 1) AS pictures FROM part""")
def sequence_sets(spark, sf):
    """Sequence sets written and read back."""

    def row(k):
        sets = [{"before": 2, "after": 1, "earlier": [{"step": k % 5, "used": 1}, {"step": 0}], "later": [{"step": k % 7}]}]
        values = {"profile": {"profile": 1}, "id": k % 16, "chroma": 1, "width": 16 * (k % 100 + 1), "height": 8 * (k % 60 + 1), "cropped": 1, "crop_top": k % 3, "poc_bits": k % 13, "ordering": [{"reorder": k % 4}], "set_count": 1, "sets": sets}
        found = PS.read(PS.sequence_set, PS.write(PS.sequence_set, values))
        facts = PS.sequence_facts(found)
        return [(k, facts["width"], facts["height"], found["id"], facts["reorder"], facts["poc_lsb"], ",".join(str(d) for d, _ in found["sets"][0]["pictures"]))]

    return _map(views.table(spark, sf, "part").select("p_partkey"), "p_partkey long, width long, height long, id long, reorder long, poc_lsb long, pictures string", row)


@query("""SELECT track_id, n + 2 AS unit_no, poc_lsb, ['B', 'P', 'I'][event_id % 3 + 1] AS kind, event_id % 21 - 10 AS qp, (event_id % 40)::INTEGER AS address FROM pictures""", views.PICTURES)
def slice_headers(spark, sf):
    """Streams of a sequence set, a picture set and a slice for each picture: the headers in their sets."""
    sps = PS.write(PS.sequence_set, {"profile": {"profile": 1}, "chroma": 1, "width": 128, "height": 80, "ordering": [{}], "set_count": 1, "sets": [{"before": 1, "earlier": [{"used": 1}]}]})
    pps = PS.write(PS.picture_set, {"refs1": 1})
    sets = ({0: PS.read(PS.picture_set, pps)}, {0: PS.read(PS.sequence_set, sps)})

    def row(track, n, poc, e):
        header = {"first": int(e % 40 == 0), "address": e % 40, "type": e % 3, "poc_lsb": poc, "from_sequence": 1, "qp": e % 21 - 10}
        return [(track, n + 2, 1, PS.write(PS.slice_header, header, 1, *sets))]

    p = views.pictures(spark, sf)
    slices = _map(p.select("track_id", "n", "poc_lsb", "event_id"), "track_id long, unit_no long, nal_type int, rbsp binary", row)
    first = p.select("track_id").distinct()
    heads = [first.select("track_id", F.lit(i).cast("long").alias("unit_no"), F.lit(k).alias("nal_type"), F.lit(d).alias("rbsp")) for i, (k, d) in enumerate(((PS.SPS, sps), (PS.PPS, pps)))]
    found = PS.slice_rows(slices.unionByName(heads[0]).unionByName(heads[1]), key="track_id")
    return found.select("track_id", "unit_no", "poc_lsb", F.col("type").alias("kind"), F.col("qp").cast("long").alias("qp"), "address")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'context lost' WHEN p_partkey % 3 = 0 THEN 'context not current' WHEN p_partkey % 5 = 0 THEN 'resource made for another graphics interface'
    WHEN p_partkey % 7 = 0 THEN 'resource made in another context' WHEN p_partkey % 11 = 0 THEN 'resource held by another owner' END AS fault FROM part""")
def graphics_resources(spark, sf):
    k = F.col("p_partkey")
    return views.table(spark, sf, "part").select("p_partkey", G.resource_error(k % 2 == 0, k % 3 != 0, k % 5 != 0, k % 7 != 0, k % 11 != 0)["message"].alias("fault"))


@query("""SELECT track_id, decode_index AS frame, 'left' AS side FROM samples WHERE event_id % 9 = 0 UNION ALL SELECT track_id, decode_index + 1000000, 'right' FROM samples WHERE event_id % 9 = 0""", views.SAMPLES)
def frame_identities(spark, sf):
    """Frames that a decoder was asked for and those that it gave, where a ninth comes under another number."""
    s = views.samples(spark, sf)
    asked = s.select("track_id", F.col("decode_index").alias("frame"))
    given = s.select("track_id", F.when(F.col("event_id") % 9 == 0, F.col("decode_index") + 1000000).otherwise(F.col("decode_index")).alias("frame"))
    return conformance.identity_errors(asked, given, ("track_id", "frame"))


_PACKETS = """p AS (SELECT track_id, decode_index, pts, dts - (event_id % 13) * 100 AS dts, is_sync AND event_id % 4 > 0 AS sync FROM samples),
q AS (SELECT *, lag(dts) OVER (PARTITION BY track_id ORDER BY decode_index) AS b FROM p),
f AS (SELECT track_id, count(*) AS n, count(DISTINCT pts) AS times, count(*) FILTER (dts <= b) AS back, count(*) FILTER (decode_index = 0 AND sync) AS opened FROM q GROUP BY track_id)"""


@query("""SELECT track_id, unnest(list_filter([CASE WHEN track_id % 5 = 0 THEN 'one packet per frame is required' END, CASE WHEN opened = 0 THEN 'the first packet must be a sync sample' END,
    CASE WHEN times < n THEN 'presentation times must be unique' END, CASE WHEN back > 0 THEN 'decode times must increase' END], lambda x: x IS NOT NULL)) AS problem FROM f""", views.SAMPLES, _PACKETS)
def encoder_packets(spark, sf):
    s = views.samples(spark, sf)
    packets = s.select("track_id", F.col("decode_index").alias("packet_no"), "pts", (F.col("dts") - F.col("event_id") % 13 * 100).alias("dts"), (F.col("is_sync") & (F.col("event_id") % 4 > 0)).alias("is_sync"))
    frames_ = s.select("track_id").unionByName(s.select("track_id").distinct().where("track_id % 5 = 0"))
    return conformance.packet_errors(packets, frames_)


@query("""SELECT track_id, edit_no FROM (SELECT *, lag("end") OVER (PARTITION BY track_id ORDER BY edit_no) AS b FROM (SELECT track_id, edit_no, start - CASE WHEN edit_no % 4 = 3 THEN 5 ELSE 0 END AS start, "end", media_start FROM edits))
    WHERE start < coalesce(b, 0) OR "end" <= start OR (media_start IS NOT NULL AND (media_start < 20 OR media_start + "end" - start > 900))""", views.EDITS)
def edit_order(spark, sf):
    """Edits that overlap the one before, are empty, or reach outside what the track decodes to."""
    e = views.edits(spark, sf).withColumn("start", F.col("start") - F.when(F.col("edit_no") % 4 == 3, 5).otherwise(0))
    e = e.withColumn("priming", F.lit(20)).withColumn("padding", F.lit(100)).withColumn("decoded_length", F.lit(1000))
    return edit_breaks(e).select("track_id", "edit_no")


def _fragmented(spark, sf) -> DataFrame:
    """A file per track whose samples are in fragments of three."""
    from framelake.sources.boxes import box, full_box

    def pack(track, rows):
        import struct

        rows = [tuple(int(v) for v in r.values()) for r in rows]
        config = box(b"av1C", bytes([0x81, 4, 0, 0]))
        entry = bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HH", 2, 2) + bytes(50)
        empty = lambda kind, *head: full_box(kind, 0, 0, *head, bytes(4))
        stbl = box(b"stbl", full_box(b"stsd", 0, 0, struct.pack(">I", 1), box(b"av01", entry, config)), empty(b"stts"), empty(b"stsc"), full_box(b"stsz", 0, 0, bytes(8)), empty(b"stco"))
        mdhd = full_box(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 1000, 0), bytes(4))
        tkhd = full_box(b"tkhd", 0, 3, struct.pack(">III", 0, 0, 1), bytes(68))
        elst = box(b"edts", full_box(b"elst", 0, 0, struct.pack(">I", 2), struct.pack(">IiHH", 40, -1, 1, 0), struct.pack(">IiHH", 60, 7, 1, 0)))
        hdlr = full_box(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13))
        trak = box(b"trak", tkhd, elst, box(b"mdia", mdhd, hdlr, box(b"minf", stbl)))
        mvex = box(b"mvex", full_box(b"trex", 0, 0, struct.pack(">IIIII", 1, 1, 100, 8, 0)))
        out = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", full_box(b"mvhd", 0, 0, struct.pack(">IIII", 0, 0, 1000, 0), bytes(80)), trak, mvex)
        at = 0
        for first in range(0, len(rows), 3):
            part = rows[first : first + 3]
            entries = b"".join(struct.pack(">Ii", n, shift) for n, shift, _ in part)
            make = lambda start: box(b"moof", full_box(b"mfhd", 0, 0, struct.pack(">I", first)), box(b"traf", full_box(b"tfhd", 0, 0x20000, struct.pack(">I", 1)), full_box(b"tfdt", 1, 0, struct.pack(">Q", at)), full_box(b"trun", 1, 0x901, struct.pack(">Ii", len(part), start), entries)))  # noqa: B023, E731
            out += make(len(make(0)) + 8) + box(b"mdat", b"".join(event.to_bytes(8, "big") for _, _, event in part))
            at += sum(n for n, _, _ in part)
        return [(f"f{track}", out)]

    rows = views.samples(spark, sf).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("decode_index", "duration", "cto", "event_id"))).alias("rows"))
    return _map(rows.select("track_id", F.transform("rows", lambda r: F.struct(r["duration"].alias("n"), r["cto"].alias("shift"), r["event_id"].alias("held"))).alias("rows")), "path string, content binary", pack)


@query("""SELECT 'f' || track_id AS file_id, decode_index, dts, pts, duration, event_id AS held FROM samples""", views.SAMPLES)
def mp4_fragments(spark, sf):
    """Samples of fragmented files, with the number that each sample's bytes hold."""
    files = materialise(_fragmented(spark, sf), "files")
    tables = mp4.split_tables(mp4.tables_of(files, "all"))
    found = mp4.payloads(mp4.sample_index(tables), files.withColumnRenamed("path", "file_id"))
    return found.select("file_id", "decode_index", "dts", "pts", "duration", F.conv(F.hex("data"), 16, 10).cast("long").alias("held"))


@query("""SELECT DISTINCT 'f' || track_id AS file_id, edit_no, segment_duration, media_time FROM samples, (VALUES (0::BIGINT, 40::BIGINT, -1::BIGINT), (1, 60, 7)) t(edit_no, segment_duration, media_time)""", views.SAMPLES)
def mp4_edits(spark, sf):
    return mp4.tables_of(_fragmented(spark, sf), "edits").select("file_id", "edit_no", "segment_duration", "media_time")


@query("SELECT track_id, n, poc_msb + poc_lsb AS poc FROM poc", views.PICTURES, _POC)
def stream_pictures(spark, sf):
    """Byte streams of sets and slices, from their bytes to the order counts of their pictures."""
    sps = PS.write(PS.sequence_set, {"profile": {"profile": 1}, "chroma": 1, "width": 64, "height": 64, "ordering": [{"reorder": 2}], "set_count": 1, "sets": [{"before": 1, "earlier": [{"used": 1}]}]})
    pps = PS.write(PS.picture_set, {})
    sets = ({0: PS.read(PS.picture_set, pps)}, {0: PS.read(PS.sequence_set, sps)})

    def pack(track, rows):
        units = [bytes([PS.SPS << 1, 1]) + insert_emulation(sps), bytes([PS.PPS << 1, 1]) + insert_emulation(pps)]
        for r in rows:
            _, low, resets, carries = r.values()
            kind = 19 if resets else 1
            header = PS.write(PS.slice_header, {"first": 1, "type": 2, "poc_lsb": int(low), "from_sequence": 1}, kind, *sets)
            units.append(bytes([kind << 1, 1 if carries else 2]) + insert_emulation(header + b"\x80"))
        return [(track, nal.join_annexb(units))]

    rows = views.pictures(spark, sf).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("n", "poc_lsb", "resets", "carries"))).alias("rows"))
    streams = _map(rows, "track_id long, data binary", pack)
    return sequence_pictures(streams).select("track_id", "n", "poc")
