"""Exact rational and timeline arithmetic as column functions.

Rationals are struct(num, den) of longs in lowest terms with a positive denominator.
Products of longs go through decimal(38,0). A result that does not fit a long, or
a zero denominator, is null; guards beside the functions say which.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
#: Steps that Euclid's algorithm needs at most for each decimal digit of the smaller number.
STEPS = 5
#: Terms up to which products are worked out in longs.
NARROW = 1 << 62


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quotient(a: Column, b: Column) -> Column:
    """Floor of a/b for a >= 0 and b > 0 in decimals, as a long; null if it does not fit or b is 0."""
    a, b = a.cast(WIDE), b.cast(WIDE)
    whole = F.when(b != 0, ((a - a % b) / b).cast(WIDE))
    return whole.try_cast("long")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two numbers of one type; gcd(0, 0) is 0."""
    start = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    steps = F.length(F.least(F.abs(a), F.abs(b)).cast("string")) * STEPS
    return F.aggregate(F.sequence(F.lit(0), steps), start, step, lambda s: s["x"])


def rational(num: Column, den: Column) -> Column:
    """num/den of longs in lowest terms; null for a zero denominator."""
    num, den = num.cast("long"), den.cast("long")
    sign = F.when(den < 0, -1).otherwise(1)
    lowest = let(F.greatest(gcd(num, den), F.lit(1).cast("long")), lambda g: F.struct((sign * F.call_function("div", num, g)).alias("num"), (sign * F.call_function("div", den, g)).alias("den")))
    return F.when(den != 0, lowest)


def _wide_rational(num: Column, den: Column) -> Column:
    """Lowest terms of a decimal fraction with den > 0, back in longs; null where a term does not fit."""

    def wide(f: Column) -> Column:
        n, d = f["n"], f["d"]
        terms = let(
            F.greatest(gcd(n, d), F.lit(1).cast(WIDE)),
            lambda g: F.struct(((n - n % g) / g).cast(WIDE).try_cast("long").alias("num"), ((d - d % g) / g).cast(WIDE).try_cast("long").alias("den")),
        )
        return F.when(terms["num"].isNotNull() & terms["den"].isNotNull(), terms)

    def lowest(f: Column) -> Column:
        narrow = f["n"].between(-NARROW, NARROW) & f["d"].between(-NARROW, NARROW)
        return F.when(narrow, rational(f["n"].try_cast("long"), f["d"].try_cast("long"))).otherwise(wide(f))

    return let(F.struct(num.alias("n"), den.alias("d")), lowest)


def _terms(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(x.cast("decimal(19,0)") for x in (a["num"], a["den"], b["num"], b["den"]))


def rational_add(a: Column, b: Column) -> Column:
    n, d, m, e = _terms(a, b)
    return _wide_rational((n * e + m * d).cast(WIDE), (d * e).cast(WIDE))


def rational_sub(a: Column, b: Column) -> Column:
    n, d, m, e = _terms(a, b)
    return _wide_rational((n * e - m * d).cast(WIDE), (d * e).cast(WIDE))


def rational_mul(a: Column, b: Column) -> Column:
    n, d, m, e = _terms(a, b)
    return _wide_rational((n * m).cast(WIDE), (d * e).cast(WIDE))


def rational_div(a: Column, b: Column) -> Column:
    """Null for a division by zero."""
    n, d, m, e = _terms(a, b)
    sign = F.when(m < 0, -1).otherwise(1).cast("decimal(1,0)")
    return F.when(m != 0, _wide_rational((n * e * sign).cast(WIDE), (d * m * sign).cast(WIDE)))


def rational_less(a: Column, b: Column) -> Column:
    n, d, m, e = _terms(a, b)
    return (n * e).cast(WIDE) < (m * d).cast(WIDE)


def audio_interval_for_frame(n: Column, rate: Column, fps_num: Column, fps_den: Column) -> Column:
    """Samples [start, end) that play during frame n; null where an end does not fit a long."""
    unit = (rate.cast("decimal(10,0)") * fps_den.cast("decimal(10,0)")).cast("decimal(18,0)")
    start = quotient((n.cast("decimal(20,0)") * unit).cast(WIDE), fps_num)
    end = quotient(((n.cast("decimal(20,0)") + 1) * unit).cast(WIDE), fps_num)
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def frame_for_audio_sample(s: Column, rate: Column, fps_num: Column, fps_den: Column) -> Column:
    """The frame that shows while sample s plays: the last whose interval starts at or before it."""
    up = ((s.cast("decimal(20,0)") + 1) * fps_num.cast("decimal(10,0)") - 1).cast(WIDE)
    return quotient(up, (rate.cast("decimal(10,0)") * fps_den.cast("decimal(10,0)")).cast("decimal(18,0)"))


def scale_duration(value: Column, source: Column, target: Column) -> Column:
    """A duration in another time scale, rounded down."""
    return quotient((value.cast("decimal(20,0)") * target.cast("decimal(10,0)")).cast(WIDE), source)


def add_signed(base: Column, delta: Column) -> Column:
    """base + delta for a non-negative base; null below 0 or beyond a long."""
    total = F.try_add(base.cast("long"), delta.cast("long"))
    return F.when(total >= 0, total)


def schedule_window(rate: Column) -> Column:
    """How far audio is scheduled ahead, and the preroll after a seek, in samples."""
    return F.struct(F.call_function("div", rate, F.lit(5)).alias("ahead"), F.call_function("div", rate, F.lit(20)).alias("preroll"))
