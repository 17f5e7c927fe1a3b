"""Ordered checks of configurations, buffers and units, each as the first error that holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.errors import first_error
from framelake.limits import DEFAULT, Limits


def decoder_support(kind: str = "hevc") -> Column:
    """How a decoder answers a configuration (codec, profile, output_format, color_range, hardware, config_bytes).

    The order of the checks differs between decoders: the uncompressed one looks at the
    configuration before the hardware, the HEVC one after it.
    """
    hardware = F.col("hardware") == "Require"
    if kind == "hevc":
        bad = (F.col("output_format") != "Rgba8") | (F.col("color_range") != "Limited")
        return (
            F.when(F.col("codec") != "Hevc", "UnsupportedCodec")
            .when(F.col("profile") != "HevcMain", "UnsupportedProfile")
            .when(hardware, "HardwareUnavailable")
            .when(bad, "InvalidConfiguration")
            .otherwise("Supported")
        )
    bad = (F.col("output_format") != "Gray8") | (F.col("config_bytes") > 0)
    return (
        F.when(F.col("codec") != "UncompressedVideo", "UnsupportedCodec")
        .when(F.col("profile") != "UncompressedGray8", "UnsupportedProfile")
        .when(bad, "InvalidConfiguration")
        .when(hardware, "HardwareUnavailable")
        .otherwise("Supported")
    )


def audio_error(limits: Limits = DEFAULT) -> Column:
    """The first fault of an audio buffer (start, end, sample_rate, channels, n_samples)."""
    expected = (F.col("end") - F.col("start")) * F.col("channels")
    return first_error(
        ((F.col("sample_rate") <= 0) | (F.col("sample_rate") > limits.max_sample_rate), "ResourceLimit", "sample rate not allowed: zero or above the limit"),
        ((F.col("channels") <= 0) | (F.col("channels") > limits.max_channels), "ResourceLimit", "channels not allowed: none or above the limit"),
        (F.col("n_samples") != expected, "InvalidInput", "the samples do not fill the range in every channel"),
        (expected * 4 > limits.max_allocation, "ResourceLimit", "buffer larger than the allocation limit"),
    )


def track_error() -> Column:
    """The first fault of a track to be written (timescale, kind, codec, decoder_config)."""
    config = F.col("decoder_config")
    declared = F.conv(F.hex(F.substring(config, 1, 4)), 16, 10).cast("long")
    kind = F.decode(F.substring(config, 5, 4), "ISO-8859-1")
    wanted = F.when(F.col("codec") == "Hevc", "hvcC").when(F.col("codec") == "Av1", "av1C").when(F.col("codec") == "Aac", "esds")
    video = F.col("codec").isin("Hevc", "Av1")
    return first_error(
        (F.col("timescale") <= 0, "InvalidInput", "time scale of zero"),
        (F.octet_length(config) < 8, "InvalidInput", "the decoder configuration holds less than one box"),
        (declared != F.octet_length(config), "InvalidInput", "the decoder configuration differs in length from its box"),
        (wanted.isNull(), "InvalidInput", "no sample entry is known for this codec"),
        (kind != wanted, "InvalidInput", "the decoder configuration is of another codec"),
        (video != (F.col("kind") == "Video"), "InvalidInput", "this codec does not belong in a track of this kind"),
    )


def unit_list_error(types: Column) -> Column:
    """The first fault of an intra unit's list of unit types: one sequence header, one frame, and only harmless others."""
    count = lambda t: F.size(F.filter(types, lambda x: x == t))
    allowed = ["SequenceHeader", "Frame", "TemporalDelimiter", "Metadata", "Padding"]
    return first_error(
        ((count("SequenceHeader") != 1) | (count("Frame") != 1), "MalformedMedia", "not exactly one sequence header and one frame in the unit"),
        (F.exists(types, lambda x: ~x.isin(*allowed)), "Unsupported", "unit type not supported here"),
    )


def resource_error(lost: Column, current: Column, api: Column, context: Column, owner: Column) -> Column:
    """The first fault of a graphics resource; the last three say whether it matches the adapter."""
    return first_error(
        (lost, "Graphics", "context lost"),
        (~current, "Graphics", "context not current"),
        (~api, "Graphics", "resource made for another graphics interface"),
        (~context, "Graphics", "resource made in another context"),
        (~owner, "Graphics", "resource held by another owner"),
    )
