"""Indexed output sessions, limits from options, cancellation, sinks and picture hashes."""

import hashlib
import threading
import time

import pytest

from framelake.errors import MediaError
from framelake.limits import DEFAULT, Limits
from framelake.operators import output
from framelake.session import cancellable
from framelake.sources import nal
from framelake.sources.bytesink import MemorySink

WRITES = "session_id long, write_no long, kind string, index long, start long, end long, samples long"


def test_sessions(spark):
    audio = lambda n, i, k: (n, i, "audio", k, *output.interval(k, 48000, 30, 1), 1)
    video = lambda n, i, k, samples=1: (n, i, "video", k, None, None, samples)
    finish = lambda n, i: (n, i, "finish", None, None, None, None)
    writes = [
        video(1, 0, 0), video(1, 1, 0), video(1, 2, 2), audio(1, 3, 0), video(1, 4, 1), finish(1, 5), audio(1, 6, 1), finish(1, 7), video(1, 8, 2),
        video(2, 0, 0), (2, 1, "audio", 0, 0, 5, 1), finish(2, 2),
        finish(3, 0),
        video(4, 0, 0, 65), video(4, 1, 0), finish(4, 2),
        video(5, 0, 0, None), finish(5, 1),
    ]
    answers = output.write_sessions(spark.createDataFrame(writes, WRITES), 48000, 30)
    got = {(r["session_id"], r["write_no"]): r["error_kind"] for r in answers.collect()}
    bad, state = "InvalidInput", "InvalidState"
    assert [got[1, n] for n in range(9)] == [None, bad, bad, None, None, state, None, None, state]
    assert [got[2, n] for n in range(3)] == [None, bad, state] and got[3, 0] is None
    assert [got[4, n] for n in range(3)] == ["ResourceLimit", state, state] and [got[5, n] for n in range(2)] == ["Codec", state]
    samples = spark.createDataFrame([(s, n, b"x") for s, n, *_ in writes], "session_id long, write_no long, data binary")
    assert {(r["session_id"], r["write_no"]) for r in output.taken_samples(samples, answers).collect()} == {(1, n) for n in (0, 3, 4, 6, 7)} | {(3, 0)}


def test_limits_from_options():
    assert Limits.of({}) == DEFAULT and Limits.of({"max_tracks": "3", "max_width": 16.0}).max_tracks == 3
    for options, kind in (({"max_track": 1}, "InvalidInput"), ({"max_tracks": "x"}, "InvalidInput"), ({"max_tracks": 1.5}, "InvalidInput"), ({"max_tracks": None}, "InvalidInput"), ({"max_cached_frames": 0}, "ResourceLimit")):
        with pytest.raises(MediaError) as e:
            Limits.of(options)
        assert e.value.kind == kind


def test_cancellation(spark):
    from pyspark.sql import functions as F

    with cancellable(spark, "quick") as _:
        assert spark.range(10).count() == 10
    slow = F.udf(lambda i: time.sleep(0.2) or i, "long")
    with pytest.raises(MediaError) as e:
        with cancellable(spark, "slow") as cancel:
            threading.Timer(1.5, cancel).start()
            spark.range(0, 400, 1, 4).select(slow("id").alias("i")).agg(F.sum("i")).collect()
    assert e.value.kind == "Cancelled"
    assert spark.range(10).count() == 10


def test_memory_sink():
    sink = MemorySink()
    sink.write(b"abc")
    sink.seek(5)
    sink.write(b"de")
    sink.seek(1)
    sink.write(b"XY")
    assert sink.bytes() == b"aXY\0\0de" and sink.position == 3


def test_picture_hashes():
    planes = [(bytes(range(12)), 4, 3), (b"\1\2", 2, 1), (b"\3\4", 2, 1)]
    md5 = [hashlib.md5(p).digest() for p, *_ in planes]
    message = bytes([132, 49, 0]) + b"".join(md5) + b"\x80"
    (kind, _, name, payload), = nal.parse_sei(message, suffix=True)
    assert kind == 132 and name != "reserved"
    found = nal.picture_hashes(payload, 3)
    assert found == ("md5", md5) and nal.plane_hashes("md5", planes) == md5
    for method, code in (("crc", 1), ("checksum", 2)):
        values = nal.plane_hashes(method, planes)
        assert nal.picture_hashes(bytes([code]) + b"".join(values), 3) == (method, values)
        assert nal.plane_hashes(method, [(b"\0" * 12, 4, 3), *planes[1:]]) != values
    # CRC of no bytes and two zero bytes that flush it, by the rule bit by bit
    crc = 0xFFFF
    for b in bytes(range(12)):
        for k in range(7, -1, -1):
            crc = (crc << 1 | b >> k & 1) ^ (0x1021 if crc >> 15 & 1 else 0)
            crc &= 0xFFFF
    for _ in range(16):
        crc = (crc << 1) ^ (0x1021 if crc >> 15 & 1 else 0)
        crc &= 0xFFFF
    assert nal.plane_hashes("crc", planes)[0] == crc.to_bytes(2, "big")
    with pytest.raises(MediaError):
        nal.picture_hashes(b"\0abc", 3)
