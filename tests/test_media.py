"""Operators, files, readers and players against literal cases."""

import struct

import pytest
from pyspark.sql import functions as F

from framelake.errors import MediaError
from framelake.limits import Limits
from framelake.operators import audio, frames, intervals, pictures
from framelake.operators import samples as S
from framelake.operators.reader import Recent, cache_statistics, plan_reads, read_frames
from framelake.sources import mp4, nal, obu
from framelake.sources.boxes import Parser, box, compact_sizes, full_box, probe
from framelake.streaming import playback
from framelake.streaming.playback import play_stream


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_runs_round_trip_and_order(spark):
    data = [(1, i, v) for i, v in enumerate([5, 5, 7, 7, 7, 5])]
    df = spark.createDataFrame(data, "track_id long, decode_index long, v long").repartition(5)
    runs = S.compress_runs(df, "v")
    assert rows(runs, "run_no") == [(1, 0, 2, 5), (1, 1, 3, 7), (1, 2, 1, 5)]
    assert rows(S.expand_runs(runs), "i") == data
    assert S.run_errors(runs, spark.createDataFrame([(1, 5)], "track_id long, n long")).count() == 1


def test_random_access_and_chunks(spark):
    df = spark.createDataFrame([(1, i, i in (0, 3)) for i in range(5)], "track_id long, decode_index long, is_sync boolean")
    assert [r[-2] for r in rows(S.decode_work(df, most=2), "decode_index")] == [1, 2, 3, 1, 2]
    chunks = spark.createDataFrame([(1, c) for c in range(1, 6)], "track_id long, chunk_no long")
    entries = spark.createDataFrame([(1, 1, 2), (1, 4, 1)], "track_id long, first_chunk long, samples_per_chunk long")
    mapped = S.chunk_samples(S.chunk_map(chunks, entries)).select("chunk_no", "samples_per_chunk", "first_sample")
    assert rows(mapped, "chunk_no") == [(1, 2, 0), (2, 2, 2), (3, 2, 4), (4, 1, 6), (5, 1, 7)]


def test_intervals(spark):
    s = spark.createDataFrame([("f", 0, 0, 5), ("f", 1, 8, 4), ("f", 2, 20, 5), ("g", 0, 0, 1)], "file_id string, decode_index long, offset long, size long")
    r = spark.createDataFrame([("f", 0, 10), ("f", 20, 30)], "file_id string, r_start long, r_end long")
    assert rows(intervals.not_contained(s, r, ("file_id",)).select("file_id", "decode_index"), "file_id") == [("f", 1), ("g", 0)]
    a = spark.createDataFrame([(1, 0, 100), (1, 50, 50), (1, -30, -10)], "k long, start long, end long")
    b = spark.createDataFrame([(1, 90, 110), (1, 100, 120), (1, -20, 5)], "k long, r_start long, r_end long")
    got = intervals.overlap_join(a, b, ("k",), 16).select("start", "r_start", "from", "to")
    assert rows(got, "start", "r_start") == [(-30, -20, -20, -10), (0, -20, 0, 5), (0, 90, 90, 100)]


AUDIO = "track_id long, packet_no long, start long, end long, samples array<float>"


def _packets(spark):
    return spark.createDataFrame([(1, i, 4 * i, 4 * i + 4, [float(v) for v in range(4 * i, 4 * i + 4)]) for i in range(3)], AUDIO)


def test_gapless_audio(spark):
    p = _packets(spark).withColumn("priming", F.lit(2)).withColumn("padding", F.lit(2)).withColumn("track_offset", F.lit(1))
    length = audio.gapless_length(p)
    assert length.first()["presentation_length"] == 9
    span = length.select("track_id", audio.gapless_edit(F.col("priming"), F.col("padding"), F.col("track_offset"), F.col("decoded_length")).alias("e")).select("track_id", "e.*")
    asked = spark.createDataFrame([(1, 0, 0, 9)], "track_id long, request_no long, start long, end long")
    assert audio.assemble(asked, span, _packets(spark), width=4).first()["samples"] == [0, 2, 3, 4, 5, 6, 7, 8, 9]


def test_edited_audio(spark):
    edits = spark.createDataFrame([(1, 0, 0, 2, None), (1, 1, 2, 5, 4)], "track_id long, edit_no long, start long, end long, media_start long")
    shifted = intervals.shift_edits(edits, F.lit(1))
    assert audio.edited_length(edits, F.lit(1)).first()["presentation_length"] == 6
    asked = spark.createDataFrame([(1, 0, 0, 6)], "track_id long, request_no long, start long, end long")
    assert audio.assemble(asked, shifted, _packets(spark), width=4).first()["samples"] == [0, 0, 0, 4, 5, 6]
    bad = edits.withColumn("priming", F.lit(5)).withColumn("padding", F.lit(1)).withColumn("decoded_length", F.lit(12))
    assert [r["edit_no"] for r in audio.edit_breaks(bad).collect()] == [1]
    assert audio.packet_breaks(_packets(spark)).count() == 0


def fragmented() -> bytes:
    """Two samples in a fragment: decode order is not presentation order."""
    entry = box(b"av01", bytes(78), box(b"av1C", bytes([0x81, 4, 0, 0])))
    stbl = box(b"stbl", full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry), *(full_box(k, 0, 0, bytes(4)) for k in (b"stts", b"stsc", b"stco")), full_box(b"stsz", 0, 0, bytes(8)))
    mdhd = full_box(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 1000, 0), bytes(4))
    hdlr = full_box(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13))
    tkhd = full_box(b"tkhd", 0, 3, struct.pack(">IIIII", 0, 0, 1, 0, 0), bytes(52), struct.pack(">II", 2 << 16, 2 << 16))
    moov = box(
        b"moov",
        full_box(b"mvhd", 0, 0, struct.pack(">IIII", 0, 0, 1000, 0), bytes(80)),
        box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", stbl))),
        box(b"mvex", full_box(b"trex", 0, 0, struct.pack(">IIIII", 1, 1, 1000, 4, 0))),
    )

    def moof(at: int) -> bytes:
        trun = full_box(b"trun", 1, 0x801, struct.pack(">Ii", 2, at), struct.pack(">ii", 1000, -1000))
        return box(b"moof", box(b"traf", full_box(b"tfhd", 0, 0, struct.pack(">I", 1)), full_box(b"tfdt", 0, 0, bytes(4)), trun))

    size = len(moof(0))
    return box(b"ftyp", b"isom", bytes(4)) + moov + moof(size + 8) + box(b"mdat", b"AAAABBBB")


def test_fragments(spark):
    data = fragmented()
    content = spark.createDataFrame([("x/f", bytearray(data))], "path string, content binary")
    tables = {t: mp4.tables_of(content, t) for t in ("stts", "ctts", "stsc", "sizes", "chunks", "sync", "sdtp", "trex", "frag_samples")}
    found = mp4.payloads(mp4.sample_index(tables), content.select(F.lit("f").alias("file_id"), "content"))
    got = rows(found.select("decode_index", "dts", "pts", "presentation_index", "size", "data"), "decode_index")
    assert got == [(0, 0, 1000, 1, 4, b"AAAA"), (1, 1000, 0, 0, 4, b"BBBB")]


def test_truncations_never_crash():
    data = fragmented()
    whole = 0
    for n in range(len(data) + 1):
        try:
            Parser().movie(data[:n])
            whole += 1
        except MediaError as e:
            assert e.kind in ("MalformedMedia", "ResourceLimit", "Unsupported")
    assert whole >= 1
    for size in range(8):
        try:
            Parser().movie(struct.pack(">I4s", size, b"moov") + data)
        except MediaError:
            pass
    assert list(mp4.file_rows("errors", "f", data[:50]))[0][1] == "MalformedMedia"
    assert probe(data[:8]) and not probe(data[:7]) and not probe(b"\0\0\0\5ftyp")


def test_compact_sizes():
    assert compact_sizes(b"\x12\x30", 4, 3) == [1, 2, 3]
    assert compact_sizes(b"\1\2\xff", 8, 3) == [1, 2, 255]
    assert compact_sizes(b"\0\1\1\0", 16, 2) == [1, 256]


def test_written_file(spark, tmp_path):
    config = bytes([0, 0, 0, 12]) + b"av1C" + bytes([0x81, 4, 0, 0])
    esds = bytes([0, 0, 0, 12]) + b"esds" + bytes(4)
    tracks = [
        {"track_id": 1, "kind": "Video", "codec": "Av1", "timescale": 1000, "width": 2, "height": 2, "decoder_config": config},
        {"track_id": 2, "kind": "Audio", "codec": "Aac", "timescale": 48000, "channels": 2, "decoder_config": esds, "priming": 1024, "padding": 0},
    ]
    sample = lambda t, dts, pts, n, sync, dep, data: {"track_id": t, "dts": dts, "pts": pts, "duration": n, "is_sync": sync, "sdtp": dep, "data": data}
    samples = [sample(1, 0, 1000, 1000, True, 0x20, b"V\0"), sample(1, 1000, 0, 1000, False, 0x10, b"V\1"), sample(2, 0, 0, 1024, True, 0x20, b"A\0"), sample(2, 1024, 1024, 2016, True, 0x20, b"A\1")]
    data = mp4.build_file(tracks, samples)
    movie = Parser().movie(data)
    video, sound = movie.tracks
    assert video.ctts == [(1, 1000), (1, -1000)] and video.sync == [1] and video.dependencies == [0x20, 0x10]
    assert sound.edits == [(42, 1024, 1, 0)] and sound.sync is None and sound.channels == 2
    (tmp_path / "a.mp4").write_bytes(data)
    (tmp_path / "broken.mp4").write_bytes(data[:100])
    found = mp4.open_files(spark, str(tmp_path))
    assert rows(found.where("track_id = 1").select("decode_index", "pts", "presentation_index"), "decode_index") == [(0, 1000, 1), (1, 0, 0)]
    assert [r["file_id"] for r in mp4.read_table(spark, str(tmp_path), "errors").collect()] == ["broken.mp4"]
    for broken in ({"duration": 0}, {"data": b""}, {"dts": 5}):
        with pytest.raises(MediaError):
            mp4.build_file(tracks, [samples[0] | broken])


def test_many_files(spark, monkeypatch):
    """Tables of many files come in batches of bounded rows, and no join of the index is a broadcast, small as a table's bytes are."""
    files = [(f"f{i}", fragmented()) for i in range(50)]
    monkeypatch.setattr(mp4, "AT_ONCE", 7)
    found = list(mp4.table_batches("all", iter([*files, ("broken", b"\0")])))
    assert max(b.num_rows for b in found) <= 7
    got = [r for b in found for r in b.to_pylist()]
    want = [r for f in [*files, ("broken", b"\0")] for r in mp4.file_rows("all", *f)]
    key = lambda r: [str(v) for v in r]
    assert sorted((tuple(r.values()) for r in got), key=key) == sorted(want, key=key)
    content = spark.createDataFrame([(n, bytearray(d)) for n, d in files], "path string, content binary")
    index = mp4.payloads(mp4.sample_index(mp4.split_tables(mp4.tables_of(content, "all"))), content.withColumnRenamed("path", "file_id"))
    plan = index._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


PACKETS = [(0, 10, True), (3, 40, False), (1, 20, False), (2, 30, False), (4, 50, True), (6, 70, False), (5, 60, False)]


def packets(spark):
    return spark.createDataFrame([(1, i, p, r, bytearray([v])) for i, (p, v, r) in enumerate(PACKETS)], "track_id long, decode_index long, presentation_index long, random_access boolean, data binary")


def asked(spark, *frames):
    return spark.createDataFrame([(1, n, i) for n, i in enumerate(frames)], "track_id long, request_no long, presentation_index long")


def test_exact_reader(spark):
    got = read_frames(packets(spark), asked(spark, 1, 2, 3, 5, 99), "reordering", limits=Limits(max_cached_frames=3))
    found = rows(got.select("request_no", "frame", "resets", "kind"), "request_no")
    assert [(bytes(f)[0] if f else None, k) for _, f, _, k in found] == [(20, None), (30, None), (40, None), (60, None), (None, "InvalidInput")]
    assert [r for _, _, r, _ in found[:2]] == [1, 1]
    short = read_frames(packets(spark), asked(spark, 3), "reordering", limits=Limits(max_cached_frames=3, max_decode_samples_per_seek=2)).first()
    assert short["kind"] == "ResourceLimit" and short["submitted"] == 2 and short["frame"] is None


def test_reader_commands_and_faults(spark):
    told = spark.createDataFrame([(1, 0, "get", 1), (1, 1, "drain", None), (1, 2, "get", 6), (1, 3, "reset", None), (1, 4, "get", 6), (2, 0, "get", 0)], "track_id long, request_no long, command string, presentation_index long")
    plan = plan_reads(packets(spark), told, "reordering", {"depth": 2}, Limits(max_cached_frames=32))
    got = {(r["track_id"], r["request_no"]): r for r in plan.collect()}
    assert [got[1, n]["drains"] for n in range(5)] == [0, 1, 2, 2, 3]
    assert [got[1, n]["resets"] for n in range(5)] == [1, 1, 2, 3, 4]
    assert (got[1, 2]["first"], got[1, 2]["last"]) == (4, 7) and got[2, 0]["kind"] == "InvalidInput"
    late = spark.createDataFrame([(1, 0, 0, False, bytearray(1)), (2, 0, 0, True, bytearray(1)), (2, 1, 0, True, bytearray(1)), (3, 0, 0, True, bytearray(2))], packets(spark).schema)
    wants = spark.createDataFrame([(t, 0, 0) for t in (1, 2, 3)], asked(spark, 0).schema)
    assert {r["track_id"]: r["kind"] for r in read_frames(late, wants, "gray8", {"width": 1, "height": 1}).collect()} == {1: "InvalidInput", 2: "InvalidInput", 3: "MalformedMedia"}


def test_reader_equals_a_plain_decoder(spark):
    """Counters and frames against a decoder that is run sample by sample, over requests at random."""
    import random

    rng = random.Random(3)
    order = [b * 8 + i for b in range(12) for i in rng.sample(range(8), 8)]
    samples = [(1, n, p, n % 8 == 0, bytearray([p])) for n, p in enumerate(order)]
    turns = [rng.randrange(96) for _ in range(300)]
    got = read_frames(spark.createDataFrame(samples, packets(spark).schema), asked(spark, *turns), "reordering", {"depth": 3}, Limits(max_cached_frames=5))
    found = [(bytes(r["frame"])[0], r["cache_hits"], r["resets"], r["submitted"], r["drains"]) for r in got.orderBy("request_no").collect()]
    cache, at, held, counts, want = [], None, [], [0, 0, 0, 0], []
    for t in turns:
        if t in cache:
            counts[0] += 1
            cache.remove(t)
            cache.append(t)
        else:
            place = order.index(t)
            if at is None or not place - place % 8 <= at <= place:
                at, held = place - place % 8, []
                counts[1] += 1
            out = []
            while t not in out:
                if at == len(order):
                    out += sorted(held)
                    held = []
                    counts[3] += 1
                else:
                    held.append(order[at])
                    at += 1
                    counts[2] += 1
                    if len(held) > 3:
                        out.append(min(held))
                        held.remove(min(held))
            for f in out:
                if f in cache:
                    cache.remove(f)
                cache = [*cache, f][-5:]
            cache.remove(t)
            cache.append(t)
        want.append((t, *counts))
    assert found == want


def test_reader_rows_and_caches(spark):
    wanted = asked(spark, 6, 0, 9, 3)
    got = rows(read_frames(packets(spark), wanted, "reordering", {"depth": 2}).select("request_no", "frame", "kind"), "request_no")
    assert [(bytes(f)[0] if f else None, k) for _, f, k in got] == [(70, None), (10, None), (None, "InvalidInput"), (40, None)]
    touched, plain = Recent(2), Recent(2, touch=False)
    for c in (touched, plain):
        c.hold(1), c.hold(2), c.use(1), c.hold(3)
    assert touched.use(1) and not plain.use(1)
    assert rows(cache_statistics(wanted, 2).select("hits", "misses"), "hits") == [(0, 4)]
    import random

    turns = [random.Random(5).randrange(9) for _ in range(1)] + [random.Random(i).randrange(9) for i in range(200)]
    for touch in (True, False):
        held, hits = [], 0
        for t in turns:
            hits += t in held
            if t not in held:
                held = [*held, t][-4:]
            elif touch:
                held = [*(x for x in held if x != t), t]
        assert rows(cache_statistics(asked(spark, *turns), 4, touch).select("hits", "misses"), "hits") == [(hits, len(turns) - hits)]


def test_player():
    s = playback.settings_of(48000, 30, 1, 1 << 40, 3200, 800)
    state, events = playback.step(s, playback.State(), "play", 0, 100)
    assert events == [("start", 0, 0, None), ("schedule", 0, 3200, None)]
    state, events = playback.step(s, state, "present", 0, 3400)
    assert events[-1] == ("frame", 2, 2, None)
    assert ("schedule", 3300, 6500, None) in playback.step(s, playback.State(running=True, scheduled=3200), "present", 0, 3300)[1]
    assert playback.step(s, state, "seek", 10, 3500)[1][:2] == [("cancel", 1, 1, None), ("preroll", 15200, 16000, None)]
    assert playback.step(s._replace(length=10), playback.State(), "seek", 10, 0)[1][0][0] == "error"
    assert playback.step(s._replace(length=1600), playback.State(), "seek", 1, 0)[1][0][0] == "cancel"
    assert playback.step(s, playback.State(), "present", 0, 0)[1][0].error.startswith("InvalidState")
    assert playback.step(s, state, "stop", 0, 0)[1] == [("stop", 0, 0, None)] and playback.step(s, playback.State(), "stop", 0, 0)[1] == []


def test_player_stream(spark, tmp_path):
    schema = "player_id long, command_no long, command string, argument long, clock long"
    for i, batch in enumerate([[(1, 0, "play", 0, 0)], [(1, 1, "present", 0, 3300), (1, 2, "present", 0, 3301)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            events = play_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
            q = events.writeStream.format("memory").queryName("played").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    got = rows(spark.table("played").where("event IN ('frame', 'same')").select("command_no", "event", "start"), "command_no")
    assert got == [(1, "frame", 2), (2, "same", 2)]


def test_frames(spark):
    plane = "struct<data:binary,stride:int>"
    schema = f"id int, width int, height int, pixel_format string, color_range string, planes array<{plane}>"
    data = [
        (0, 2, 2, "Rgba8", "Full", [(bytearray(16), 8)]),
        (1, 2, 2, "Rgba8", "Full", [(bytearray(14), 8)]),
        (2, 3, 3, "Yuv420p8", "Full", [(bytearray(9), 3), (bytearray(4), 2), (bytearray(4), 2)]),
        (3, 0, 2, "Gray8", "Full", [(bytearray(2), 1)]),
        (4, 9000, 2, "Gray8", "Full", [(bytearray(2), 1)]),
    ]
    df = spark.createDataFrame(data, schema)
    assert [r[1] for r in rows(df.select("id", frames.frame_error()["kind"]), "id")] == [None, "InvalidInput", None, "InvalidInput", "ResourceLimit"]
    tight = spark.createDataFrame([(0, 1, 2, "Gray8", "Full", [(bytearray(b"ab"), 1)]), (1, 1, 2, "Gray8", "Full", [(bytearray(b"a!b!"), 2)])], schema)
    a, b = (r[1] for r in rows(tight.select("id", frames.frame_digest()), "id"))
    assert a == b
    assert frames.transfer(bytes([255, 0, 0, 255, 0, 255, 0, 255]), {"width": 1, "height": 2, "pixel_format": "Rgba8", "color_range": "Full", "orientation": "BottomLeft", "stride": 4}, {"width": 1, "height": 1, "pixel_format": "Bgra8", "color_range": "Full", "orientation": "TopLeft", "stride": 4}) == bytes([0, 255, 0, 255])
    limited = frames.transfer(bytes([0, 255, 128, 255]), {"width": 1, "height": 1, "pixel_format": "Rgba8", "color_range": "Full", "orientation": "TopLeft", "stride": 4}, {"width": 1, "height": 1, "pixel_format": "Rgba8", "color_range": "Limited", "orientation": "TopLeft", "stride": 4})
    assert limited == bytes([16, 235, 126, 255])
    plan = spark.range(1).select(frames.transfer_capability(F.lit("Shared"), F.lit(None).cast("string"), F.array(F.lit("Scale"))).alias("c")).first()["c"]
    assert plan["mode"] == "Unsupported" and "sharing" in plan["reason"]


def test_pictures(spark):
    lsb = [0, 4, 8, 12, 0, 4, 14]
    df = spark.createDataFrame([(1, i, v, 16, i == 0, True) for i, v in enumerate(lsb)], "track_id long, n long, poc_lsb long, max_poc_lsb long, resets boolean, carries boolean")
    assert [r[0] for r in rows(pictures.picture_order(df).select("poc", "n"), "n")] == [0, 4, 8, 12, 16, 20, 14]
    units = spark.createDataFrame([(1, i, t, f) for i, (t, f) in enumerate([(32, False), (33, False), (19, True), (1, False), (1, True), (33, False), (1, True)])], "track_id long, unit_no long, nal_type int, first_slice boolean")
    assert [r[1] for r in rows(pictures.access_units(units).select("unit_no", "access_unit"), "unit_no")] == [0, 0, 0, 0, 1, 2, 2]


def test_streams(spark):
    u = [bytes([32 << 1, 1]) + b"abc", bytes([33 << 1, 1]) + b"\1\2"]
    assert nal.split_annexb(b"\xff" + nal.join_annexb(u)) == u
    assert nal.split_prefixed(nal.join_prefixed(u, 2), 2) == u
    for bad in (b"abc", b"\0\0"):
        with pytest.raises(MediaError):
            nal.split_annexb(bad)
    assert [r["kind"] for r in nal.unit_rows(spark.createDataFrame([(1, bytearray(b"zz"))], "stream_id long, data binary")).collect()] == ["MalformedMedia"]
    av1c = bytes([0, 0, 0, 12]) + b"av1C" + bytes([0x81, 4, 0, 0])
    assert obu.parse_av1c(av1c)["level"] == 4
    for bad in (av1c[:11], av1c[:4] + b"hvcC" + av1c[8:], av1c[:8] + bytes([0x80, 4, 0, 0])):
        with pytest.raises(MediaError):
            obu.parse_av1c(bad)
    stream = obu.unit(2, b"") + obu.unit(5, b"\1xyz") + obu.unit(2, b"") + obu.unit(15, b"\0")
    assert [len(t) for t in obu.temporal_units(stream)] == [8, 5]
    for n in range(1, len(stream)):
        try:
            list(obu.units(stream[:n]))
        except MediaError:
            pass
    hvcc = bytes([1, 1, 0x60, 0, 0, 0, 0xB0, 0, 0, 0, 0, 0, 93, 0, 0, 0, 1, 0, 0, 0, 0, 3, 1, 32, 0, 1, 0, 3]) + u[0][:3]
    assert nal.parse_hvcc(hvcc)["units"] == [u[0][:3]] and nal.parse_hvcc(hvcc)["length_size"] == 4


def test_playback_equals_a_plain_walk(spark):
    """The registered query against one loop over each player's commands."""
    import __spark_entry__ as entry

    sf, rate, ahead, preroll, length = "/root/testdata/sf0.001", 48000, 9600, 2400, 1_000_000
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type").collect()
    got = sorted((r["player_id"], r["command_no"], r["step"], r["event"], r["start"], r["end"], bool(r["error"])) for r in entry.queries()["playback_ticks"](spark, sf).collect())
    want = []
    for player in {e["user_id"] for e in events}:
        own = sorted((e for e in events if e["user_id"] == player), key=lambda e: (e["ts"], e["event_id"]))
        anchor = zero = queued = seeks = 0
        shown, on = None, False
        for n, e in enumerate(own):
            clock, out = n * 1700, []

            def fill(clock=clock, out=out):
                nonlocal queued
                now = anchor + max(0, clock - zero)
                queued = max(queued, now, anchor - preroll)
                while queued < min(now + ahead, length):
                    end = min(queued + ahead, now + ahead, length)
                    out.append(("schedule", queued, end, False))
                    queued = end

            if n == 0 or e["event_type"] == "signup":
                if not on:
                    on, zero = True, clock
                    out.append(("start", anchor, anchor, False))
                    fill()
            elif e["event_type"] == "purchase":
                target = e["event_id"] % 500 * rate // 30
                if target > length:
                    out.append(("error", 0, 0, True))
                else:
                    seeks, anchor, zero, queued, shown = seeks + 1, target, clock, target, None
                    out.append(("cancel", seeks, seeks, False))
                    if target:
                        out.append(("preroll", max(0, target - preroll), target, False))
                    if on:
                        out.append(("start", target, target, False))
                        fill()
            elif not on:
                out.append(("error", 0, 0, True))
            else:
                fill()
                sample = anchor + max(0, clock - zero)
                frame = ((sample + 1) * 30 - 1) // rate
                told = "finished" if sample >= length else "same" if frame == shown else "frame"
                shown = frame if told == "frame" else shown
                out.append((told, frame, frame, False))
            want += [(player, n, i, *x) for i, x in enumerate(out)]
    assert got == sorted(want)
