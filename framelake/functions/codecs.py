"""Codec strings, digests and level tables as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most luma samples of a level and its number; beyond them 186.
LUMA_LEVELS = [(36_864, 30), (122_880, 60), (245_760, 63), (552_960, 90), (983_040, 93), (2_228_224, 120), (8_912_896, 150), (35_651_584, 180)]
#: Most tile columns and rows of a level and its number; beyond them 180.
TILE_LEVELS = [(1, 1, 30), (2, 2, 90), (3, 3, 93), (5, 5, 120), (10, 11, 150), (20, 22, 180)]


def fourcc(content: Column, at: int = 5) -> Column:
    """The four-character code at a 1-based place."""
    return F.decode(F.substring(content, at, 4), "ISO-8859-1")


def byte_at(content: Column, at: Column | int) -> Column:
    """The byte at a 1-based place, as an int."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(content.substr(at, F.lit(1))), 16, 10).cast("int")


def hevc_string(space: Column, profile: Column, compatibility: Column, tier: Column, level: Column, constraints: Column) -> Column:
    """From profile space 0-3, profile, 32 compatibility bits (as they are stored), tier flag, level and six constraint bytes."""
    letter = F.element_at(F.array(*map(F.lit, ("", "A", "B", "C"))), space.cast("int") + 1)
    last = F.array_max(F.transform(constraints, lambda b, i: F.when(b != 0, i + 1).otherwise(0)))
    tail = F.array_join(F.transform(F.slice(constraints, F.lit(1), last), lambda b: F.concat(F.lit("."), F.lpad(F.hex(b), 2, "0"))), "")
    return F.concat(F.lit("hev1."), letter, profile.cast("string"), F.lit("."), F.hex(compatibility), F.lit("."), F.when(tier == 1, "H").otherwise("L"), level.cast("string"), tail)


def hevc_profile(profile: Column) -> Column:
    return F.when(profile == 2, "HevcMain10").otherwise("HevcMain")


def av1_string(profile: Column, level: Column, tier: Column, high: Column, twelve: Column, mono: Column, sub_x: Column, sub_y: Column, position: Column) -> Column:
    depth = F.when(high == 1, F.when((profile == 2) & (twelve == 1), 12).otherwise(10)).otherwise(8)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        F.lit("av01."), profile.cast("string"), F.lit("."), two(level), F.when(tier == 1, "H").otherwise("M"), F.lit("."), two(depth), F.lit("."),
        mono.cast("string"), F.lit("."), sub_x.cast("string"), sub_y.cast("string"), position.cast("string"),
    )


def level_for(luma: Column) -> Column:
    """The least level that a picture's luma samples fit."""
    out = F.lit(186)
    for most, level in reversed(LUMA_LEVELS):
        out = F.when(luma <= most, level).otherwise(out)
    return out


def level_for_tiles(columns: Column, rows: Column) -> Column:
    """The least level that a grid of tiles fits."""
    out = F.lit(180)
    for wide, high, level in reversed(TILE_LEVELS):
        out = F.when((columns <= wide) & (rows <= high), level).otherwise(out)
    return out


def digest_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def is_digest(text: Column) -> Column:
    """Whether a text is 64 hex digits."""
    return F.coalesce(text.rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))
