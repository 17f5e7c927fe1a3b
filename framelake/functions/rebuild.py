"""Arithmetic of picture reconstruction on integers: scans, motion, quantisers, edges, offsets, interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.blocks import let
from framelake.functions.pixels import clamp, div, shr

# --- scans and addresses ---


def scan_kind(mode: Column, log2_size: Column, luma: Column, full_chroma: Column) -> Column:
    """``vertical``, ``horizontal`` or ``diagonal``: how the coefficients of an intra block are scanned."""
    small = (log2_size == 2) | ((log2_size == 3) & (luma | full_chroma))
    return F.when(small & mode.between(6, 14), "vertical").when(small & mode.between(22, 30), "horizontal").otherwise("diagonal")


def z_order(x: Column, y: Column, bits: int = 8) -> Column:
    """The place of a cell in z-scan: the bits of x and y in turn, x lowest."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, c in enumerate((x, y)):
            out = out + F.call_function("shiftleft", shr(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), F.lit(2 * i + k))
    return out


def available(here: Column, there: Column) -> Column:
    """Whether a neighbour may be used: it exists, comes earlier in z-scan and is of the same slice and tile.

    Both are struct(place, slice, tile); a neighbour outside the picture is null.
    """
    return F.coalesce((there["place"] <= here["place"]) & (there["slice"] == here["slice"]) & (there["tile"] == here["tile"]), F.lit(False))


# --- motion ---


def signed16(value: Column) -> Column:
    """The low 16 bits as a signed number."""
    return F.pmod(value.cast("long") + 32768, F.lit(65536).cast("long")) - 32768


def add_motion(vector: Column, change: Column, whole: Column) -> Column:
    """A vector component and its coded change, which counts full samples where ``whole``; wraps to 16 bits."""
    return signed16(vector + F.when(whole, change * 4).otherwise(change))


def scaled_motion(vector: Column, there: Column, here: Column) -> Column:
    """A vector component that spans ``there`` order counts, for a span of ``here``."""
    td, tb = clamp(there, -128, 127).cast("long"), clamp(here, -128, 127).cast("long")
    factor = clamp(shr(tb * div(16384 + div(F.abs(td), F.lit(2).cast("long")), td) + 32, 6), -4096, 4095)
    return let(factor * vector, lambda p: clamp(F.signum(p.cast("double")).cast("long") * shr(F.abs(p) + 127, 8), -32768, 32767))


def merge_candidates(spatial: Column, temporal: Column, zeros: Column, most: Column) -> Column:
    """Spatial candidates without nulls and repeats, then the temporal one, then zeros, ``most`` in all."""
    known = F.array_distinct(F.filter(spatial, lambda c: c.isNotNull()))
    return F.slice(F.concat(F.slice(known, 1, 4), F.filter(F.array(temporal), lambda c: c.isNotNull()), zeros), F.lit(1), most)


def predictor_candidates(first: Column, second: Column, temporal: Column, zero: Column) -> Column:
    """Two predictors of a motion vector: the spatial ones that there are and differ, the temporal one where fewer than two are, zeros behind."""
    spatial = F.array_distinct(F.filter(F.array(first, second), lambda c: c.isNotNull()))
    late = F.when(F.size(spatial) < 2, F.filter(F.array(temporal), lambda c: c.isNotNull())).otherwise(F.slice(spatial, 1, 0))
    return F.slice(F.concat(spatial, late, F.array(zero, zero)), 1, 2)


# --- quantisers ---


def predicted_qp(left: Column, above: Column, before: Column) -> Column:
    """Rounded mean of the neighbours in the same tree block; a missing one counts as the one coded before."""
    return shr(F.coalesce(left, before) + F.coalesce(above, before) + 1, 1)


def coded_qp(predicted: Column, change: Column, offset: Column) -> Column:
    """The quantiser of a change, which wraps in the range of -offset to 51."""
    return F.pmod(predicted + change + 52 + 2 * offset, 52 + offset) - offset


#: Chroma quantisers of 4:2:0 from 30 to 43.
CHROMA_QP = [29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37, 37]


def chroma_qp(index: Column, subsampled: Column) -> Column:
    table = F.element_at(F.lit(CHROMA_QP), F.greatest(F.lit(1), F.least(F.lit(len(CHROMA_QP)), index - 29)).cast("int"))
    return F.when(~subsampled, F.least(index, F.lit(51))).when(index < 30, index).when(index > 43, index - 6).otherwise(table)


# --- edges ---

#: How often each clipping limit stands in the table of 54, from 0 upwards.
LIMIT_RUNS = [(0, 18), (1, 9), (2, 4), (3, 4), (4, 3), (5, 2), (6, 2), (7, 1), (8, 1), (9, 1), (10, 1), (11, 1), (13, 1), (14, 1), (16, 1), (18, 1), (20, 1), (22, 1), (24, 1)]
LIMITS = [value for value, times in LIMIT_RUNS for _ in range(times)]


def edge_threshold(q: Column) -> Column:
    """Beta of a quantiser of 0 to 51."""
    return F.when(q < 16, 0).when(q < 29, q - 10).otherwise(2 * q - 38)


def edge_limit(q: Column) -> Column:
    """tC of a quantiser of 0 to 53."""
    return F.element_at(F.lit(LIMITS), (clamp(q, 0, 53) + 1).cast("int"))


def _far(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) >= 4) | (F.abs(a["y"] - b["y"]) >= 4)


def boundary_strength(intra: Column, coded: Column, p: Column, q: Column) -> Column:
    """0, 1 or 2 of an edge; ``coded``: a transform edge with coefficients; p and q: arrays of struct(ref, x, y), one or two.

    Motion compares by the pictures referred to, in any order.
    """
    refs = lambda m: F.array_sort(F.transform(m, lambda v: v["ref"]))
    straight, crossed = _far(F.get(p, F.lit(0)), F.get(q, F.lit(0))) | _far(F.get(p, F.lit(1)), F.get(q, F.lit(1))), _far(F.get(p, F.lit(0)), F.get(q, F.lit(1))) | _far(F.get(p, F.lit(1)), F.get(q, F.lit(0)))
    same_ref = F.get(p, F.lit(0))["ref"] == F.get(p, F.lit(1))["ref"]
    two = F.when(same_ref, straight & crossed).when(F.get(p, F.lit(0))["ref"] == F.get(q, F.lit(0))["ref"], straight).otherwise(crossed)
    moved = F.when(refs(p) != refs(q), True).when(F.size(p) == 1, _far(F.get(p, F.lit(0)), F.get(q, F.lit(0)))).otherwise(two)
    return F.when(intra, 2).when(coded, 1).when(moved, 1).otherwise(0)


def luma_edge(rows: Column, beta: Column, limit: Column) -> Column:
    """Four rows of eight samples across an edge (p3 p2 p1 p0 q0 q1 q2 q3), filtered: strongly, normally or not at all."""
    at = lambda r, i: F.get(F.get(rows, F.lit(r)), F.lit(i))
    bend = lambda r, side: F.abs(at(r, 1 if side == "p" else 6) - 2 * at(r, 2 if side == "p" else 5) + at(r, 3 if side == "p" else 4))
    dp, dq = bend(0, "p") + bend(3, "p"), bend(0, "q") + bend(3, "q")
    flat = lambda r: (2 * (bend(r, "p") + bend(r, "q")) < shr(beta, 2)) & (F.abs(at(r, 0) - at(r, 3)) + F.abs(at(r, 4) - at(r, 7)) < shr(beta, 3)) & (F.abs(at(r, 3) - at(r, 4)) < shr(5 * limit + 1, 1))
    side = shr(beta + shr(beta, 1), 3)
    more_p, more_q = dp < side, dq < side

    def strong(r: Column) -> Column:
        p3, p2, p1, p0, q0, q1, q2, q3 = (F.get(r, F.lit(i)) for i in range(8))
        near = lambda new, old: F.greatest(old - 2 * limit, F.least(old + 2 * limit, new))
        return F.array(
            p3, near(shr(2 * p3 + 3 * p2 + p1 + p0 + q0 + 4, 3), p2), near(shr(p2 + p1 + p0 + q0 + 2, 2), p1), near(shr(p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4, 3), p0),
            near(shr(p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4, 3), q0), near(shr(p0 + q0 + q1 + q2 + 2, 2), q1), near(shr(p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4, 3), q2), q3,
        )

    def normal(r: Column) -> Column:
        p3, p2, p1, p0, q0, q1, q2, q3 = (F.get(r, F.lit(i)) for i in range(8))
        d = shr(9 * (q0 - p0) - 3 * (q1 - p1) + 8, 4)
        c, half = F.greatest(-limit, F.least(limit, d)), shr(limit, 1)
        bounded = lambda x: F.greatest(-half, F.least(half, x))
        new_p1 = F.when(more_p, clamp(p1 + bounded(shr(shr(p2 + p0 + 1, 1) - p1 + c, 1)), 0, 255)).otherwise(p1)
        new_q1 = F.when(more_q, clamp(q1 + bounded(shr(shr(q2 + q0 + 1, 1) - q1 - c, 1)), 0, 255)).otherwise(q1)
        return F.when(F.abs(d) < limit * 10, F.array(p3, p2, new_p1, clamp(p0 + c, 0, 255), clamp(q0 - c, 0, 255), new_q1, q2, q3)).otherwise(r)

    return F.when(dp + dq >= beta, rows).when(flat(0) & flat(3), F.transform(rows, strong)).otherwise(F.transform(rows, normal))


def chroma_edge(p1: Column, p0: Column, q0: Column, q1: Column, limit: Column) -> Column:
    """struct(p0, q0) of a chroma line across an edge of strength 2."""
    d = F.greatest(-limit, F.least(limit, shr((q0 - p0) * 4 + p1 - q1 + 4, 3)))
    return F.struct(clamp(p0 + d, 0, 255).alias("p0"), clamp(q0 - d, 0, 255).alias("q0"))


# --- sample offsets ---


def band_offset(sample: Column, first: Column, offsets: Column) -> Column:
    """A sample with the offset of its band: four bands of eight values from ``first``."""
    band = shr(sample, 3) - first
    return clamp(sample + F.when(band.between(0, 3), F.get(offsets, F.greatest(F.lit(0), F.least(F.lit(3), band)).cast("int"))).otherwise(0), 0, 255)


def edge_offset(sample: Column, before: Column, after: Column, offsets: Column) -> Column:
    """A sample with the offset of its place between two neighbours: valley, two kinds of corner, or peak; none where one is missing."""
    side = F.signum((sample - before).cast("double")) + F.signum((sample - after).cast("double"))
    place = F.when(side == -2, 0).when(side == -1, 1).when(side == 1, 2).when(side == 2, 3)
    return clamp(sample + F.coalesce(F.get(offsets, place), F.lit(0)), 0, 255)


# --- interpolation ---

#: Taps of luma samples at quarters, and of chroma samples at eighths up to the half; the others are mirrored.
LUMA_TAPS = {0: [0, 0, 0, 64, 0, 0, 0, 0], 1: [-1, 4, -10, 58, 17, -5, 1, 0], 2: [-1, 4, -11, 40, 40, -11, 4, -1]}
CHROMA_TAPS = {0: [0, 64, 0, 0], 1: [-2, 58, 10, -2], 2: [-4, 54, 16, -2], 3: [-6, 46, 28, -4], 4: [-4, 36, 36, -4]}


def taps(kind: str, part: int) -> list[int]:
    table, whole = (LUMA_TAPS, 4) if kind == "luma" else (CHROMA_TAPS, 8)
    return table[part] if part in table else table[whole - part][::-1]


def interpolated(samples: Column, part: Column, kind: str = "luma") -> Column:
    """The sum of the taps over eight (luma) or four (chroma) samples, for a fraction of a sample."""
    whole = 4 if kind == "luma" else 8
    rows = F.lit([taps(kind, p) for p in range(whole)])
    chosen = F.get(rows, part.cast("int"))
    return F.aggregate(F.zip_with(samples, chosen, lambda s, t: (s * t).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def weighted(value: Column, weight: Column, log2_denominator: Column, offset: Column) -> Column:
    """Explicit weighting of a 14-bit prediction of 8-bit samples."""
    shift = log2_denominator + 6
    scaled = F.floor((value * weight + F.pow(F.lit(2.0), shift - 1)) / F.pow(F.lit(2.0), shift)).cast("long")
    return clamp(scaled + offset, 0, 255)


def mean_prediction(a: Column, b: Column) -> Column:
    """The rounded mean of two 14-bit predictions, as 8-bit samples."""
    return clamp(shr(a + b + 64, 7), 0, 255)


# --- palettes ---


def next_palette(own: Column, before: Column, reused: Column, most: int) -> Column:
    """The predictor after a unit: its own palette, then what it did not reuse of the one before, ``most`` entries."""
    left = F.transform(F.filter(F.arrays_zip(before.alias("entry"), reused.alias("used")), lambda e: ~F.coalesce(e["used"], F.lit(False))), lambda e: e["entry"])
    return F.slice(F.concat(own, left), 1, most)


def palette_samples(palette: Column, indexes: Column, escapes: Column) -> Column:
    """Samples of an index map: an index behind the palette takes the next escaped value."""
    n = F.size(palette)
    nth = lambda i: F.size(F.filter(F.slice(indexes, F.lit(1), i + 1), lambda v: v >= n)) - 1
    return F.transform(indexes, lambda v, i: F.when(v < n, F.get(palette, v)).otherwise(F.get(escapes, nth(i))))


# --- AV1 blocks ---


def intra_block(mode: Column, top: Column, left: Column, corner: Column) -> Column:
    """Rows of a square block predicted from its neighbours: ``DC``, ``V``, ``H`` or ``PAETH``; null for another mode."""
    from framelake.functions.blocks import dc_prediction, paeth

    mean = dc_prediction(F.concat(top, left).cast("array<bigint>"))
    same = lambda value: F.transform(left, lambda l: F.transform(top, lambda t: value(t, l)))
    return (
        F.when(mode == "DC", F.transform(left, lambda _: F.transform(top, lambda _: mean.cast("long"))))
        .when(mode == "V", same(lambda t, l: t.cast("long")))
        .when(mode == "H", same(lambda t, l: l.cast("long")))
        .when(mode == "PAETH", same(lambda t, l: paeth(corner, t, l).cast("long")))
    )
