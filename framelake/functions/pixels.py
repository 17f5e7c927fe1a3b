"""Pixel arithmetic on integer components, and packed flag fields, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: int | Column) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def shr(a: Column, n: int) -> Column:
    """Arithmetic shift right."""
    return F.shiftright(a, n)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def full_to_limited(v: Column) -> Column:
    """8-bit full range to limited range."""
    return F.lit(16) + div(v * 219 + 127, 255)


def limited_to_full(v: Column) -> Column:
    return F.least(F.lit(255), div(F.greatest(v - 16, F.lit(0)) * 255 + 109, 219))


def gray(r: Column, g: Column, b: Column) -> Column:
    return shr(77 * r + 150 * g + 29 * b + 128, 8)


def nearest_source(target: Column, target_size: Column | int, source_size: Column | int) -> Column:
    """The source row or column that a target one takes."""
    source_size = source_size if isinstance(source_size, Column) else F.lit(source_size)
    return div(target * source_size, target_size)


def stored_row(row: Column, height: Column | int, orientation: Column) -> Column:
    """Where a row lies in memory: bottom-left images are stored upside down."""
    height = height if isinstance(height, Column) else F.lit(height)
    return F.when(orientation == "BottomLeft", height - 1 - row).otherwise(row)


def _high(a: Column, factor: int) -> Column:
    return shr(a * factor, 16)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """Limited-range BT.601 to RGB; every product is shifted on its own before the sum."""
    y, u, v = y * 8 - 128, u * 8 - 1024, v * 8 - 1024
    luma = _high(y, 9539)
    red, green, blue = luma + _high(v, 13075), luma + _high(u, -3209) + _high(v, -6660), luma + _high(u, 16525)
    return F.struct(clamp(red, 0, 255).alias("r"), clamp(green, 0, 255).alias("g"), clamp(blue, 0, 255).alias("b"))


def rgb_to_luma(r: Column, g: Column, b: Column) -> Column:
    return clamp(shr(66 * r + 129 * g + 25 * b + 128, 8) + 16, 16, 235)


def rgb_sums_to_chroma(r: Column, g: Column, b: Column) -> Column:
    """u and v of the sums over a 2x2 block."""
    u = shr(-38 * r - 74 * g + 112 * b + 131584, 10)
    v = shr(112 * r - 94 * g - 18 * b + 131584, 10)
    return F.struct(clamp(u, 16, 240).alias("u"), clamp(v, 16, 240).alias("v"))


def pack_dependency(leading: Column, depends: Column, depended: Column, redundancy: Column) -> Column:
    """Four 2-bit fields in a byte, the first highest."""
    return leading * 64 + depends * 16 + depended * 4 + redundancy


def unpack_dependency(byte: Column) -> Column:
    names = ("is_leading", "depends_on", "is_depended_on", "has_redundancy")
    return F.struct(*(shr(byte, 6 - 2 * i).bitwiseAND(F.lit(3)).alias(n) for i, n in enumerate(names)))


def fragment_flags(flags: Column) -> Column:
    """Sync mark and dependencies of 32-bit fragment flags; all-zero dependencies follow the sync mark."""
    flags = flags.cast("long")
    sync = flags.bitwiseAND(F.lit(0x10000).cast("long")) == 0
    byte = shr(flags, 20).bitwiseAND(F.lit(0xFF).cast("long")).cast("int")
    byte = F.when(byte != 0, byte).otherwise(F.when(sync, F.lit(0x20)).otherwise(F.lit(0x10)))
    return F.struct(sync.alias("is_sync"), unpack_dependency(byte).alias("dependency"))
