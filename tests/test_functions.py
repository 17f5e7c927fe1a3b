"""Column functions against literal values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.errors import MediaError
from framelake.functions import bits, codecs, pixels, timeline


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(n):
    return F.lit(n).cast("long")


@pytest.mark.parametrize(("num", "den", "want"), [(6, -8, (-3, 4)), (0, -9, (0, 1)), (5, 0, None), (-7, 7, (-1, 1))])
def test_rational(spark, num, den, want):
    got = value(spark, timeline.rational(lit(num), lit(den)))
    assert (tuple(got) if got else got) == want


def test_rational_arithmetic(spark):
    a, b = timeline.rational(lit(1), lit(2)), timeline.rational(lit(1), lit(3))
    ops = [timeline.rational_add, timeline.rational_sub, timeline.rational_mul, timeline.rational_div]
    assert [tuple(value(spark, f(a, b))) for f in ops] == [(5, 6), (1, 6), (1, 6), (3, 2)]
    assert value(spark, timeline.rational_less(b, a))
    assert value(spark, timeline.rational_div(a, timeline.rational(lit(0), lit(1)))) is None
    big = timeline.rational(lit((1 << 63) - 1), lit(1))
    assert value(spark, timeline.rational_add(big, big)) is None


def test_audio_intervals(spark):
    def span(n, rate, num, den):
        return tuple(value(spark, timeline.audio_interval_for_frame(lit(n), F.lit(rate), F.lit(num), F.lit(den))))

    assert span(5, 44100, 30, 1) == (7350, 8820)
    assert span(0, 48000, 30000, 1001) == (0, 1601)
    assert span(2, 48000, 30000, 1001)[1] == 4804
    frame = lambda s: value(spark, timeline.frame_for_audio_sample(lit(s), F.lit(48000), F.lit(30000), F.lit(1001)))
    assert (frame(1600), frame(1601)) == (0, 1)
    assert value(spark, timeline.audio_interval_for_frame(lit((1 << 63) - 1), F.lit(48000), F.lit(30000), F.lit(1001))) is None
    assert value(spark, timeline.add_signed(lit(3), lit(-4))) is None
    assert tuple(value(spark, timeline.schedule_window(lit(48000)))) == (9600, 2400)


def test_pixels(spark):
    full = [value(spark, pixels.full_to_limited(lit(v))) for v in (0, 255, 127)]
    assert full == [16, 235, 125]
    assert [value(spark, pixels.limited_to_full(lit(v))) for v in (0, 16, 235, 255)] == [0, 0, 255, 255]
    assert value(spark, pixels.unpack_dependency(pixels.pack_dependency(lit(1), lit(2), lit(3), lit(0)))) == (1, 2, 3, 0)
    sync = value(spark, pixels.fragment_flags(lit(0)))
    assert sync["is_sync"] and sync["dependency"]["depends_on"] == 2
    delta = value(spark, pixels.fragment_flags(lit(0x10000)))
    assert not delta["is_sync"] and delta["dependency"]["depends_on"] == 1


def test_codec_strings(spark):
    byte = F.array(*(F.lit(0).cast("long") for _ in range(6)))
    one = F.array(F.lit(0xB0).cast("long"), *(F.lit(0).cast("long") for _ in range(5)))
    assert value(spark, codecs.hevc_string(lit(0), lit(1), lit(0x60000000), lit(0), lit(93), byte)) == "hev1.1.60000000.L93"
    assert value(spark, codecs.hevc_string(lit(0), lit(2), lit(0x60000000), lit(0), lit(120), one)) == "hev1.2.60000000.L120.B0"
    zero = lit(0)
    assert value(spark, codecs.av1_string(zero, lit(4), zero, zero, zero, zero, zero, zero, zero)) == "av01.0.04M.08.0.000"
    assert value(spark, codecs.level_for(lit(36865))) == 60
    assert value(spark, codecs.level_for_tiles(lit(3), lit(2))) == 93


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 31) - 1), st.integers(-(1 << 30), 1 << 30), st.integers(1, 40))
def test_bit_codes_undo(u, s, n):
    b = bits.Bits(bits.BitWriter().ue(u).se(s).u(u % (1 << n), n).trailing().bytes())
    assert (b.ue(), b.se(), b.u(n)) == (u, s, u % (1 << n))
    assert bits.leb128(bits.put_leb128(u)) == (u, len(bits.put_leb128(u)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 2, 3, 4, 255]), max_size=60))
def test_emulation_undoes(values):
    data = bytes(values)
    coded = bits.insert_emulation(data)
    assert bits.strip_emulation(coded) == data
    assert not any(x in coded for x in (b"\0\0\0", b"\0\0\1", b"\0\0\2"))


def test_bits_errors():
    with pytest.raises(MediaError):
        bits.Bits(bytes(8)).ue()
    with pytest.raises(MediaError):
        bits.leb128(b"\x80" * 9)
    with pytest.raises(MediaError):
        bits.Bits(b"\1").u(9)
