"""Block arithmetic of the codecs that stands on its own: contexts, partitions, tiles, scans, small transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.pixels import clamp, div, shr


def context_state(init_value: Column, qp: Column) -> Column:
    """State index and most probable symbol that an arithmetic-coding context starts with."""
    slope = shr(init_value, 4) * 5 - 45
    offset = init_value.bitwiseAND(F.lit(15)) * 8 - 16
    start = clamp(shr(slope * clamp(qp, 0, 51), 4) + offset, 1, 126)
    likely = (start > 63).cast("int")
    return F.struct(F.when(start > 63, start - 64).otherwise(63 - start).alias("state"), likely.alias("mps"))


#: How a coding unit of size 4 falls into parts (x, y, width, height), in quarters.
PARTS = {
    "2Nx2N": [(0, 0, 4, 4)],
    "2NxN": [(0, 0, 4, 2), (0, 2, 4, 2)],
    "Nx2N": [(0, 0, 2, 4), (2, 0, 2, 4)],
    "2NxnU": [(0, 0, 4, 1), (0, 1, 4, 3)],
    "2NxnD": [(0, 0, 4, 3), (0, 3, 4, 1)],
    "nLx2N": [(0, 0, 1, 4), (1, 0, 3, 4)],
    "nRx2N": [(0, 0, 3, 4), (3, 0, 1, 4)],
    "NxN": [(0, 0, 2, 2), (2, 0, 2, 2), (0, 2, 2, 2), (2, 2, 2, 2)],
}


def unit_parts(x: Column, y: Column, size: Column, mode: Column) -> Column:
    """The prediction rectangles of a coding unit; null for an unknown mode."""
    out = F.lit(None).cast("array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>")
    quarter = lambda n: div(size.cast("long") * n, F.lit(4).cast("long"))
    for name, parts in PARTS.items():
        rects = [F.struct((x + quarter(a)).alias("x"), (y + quarter(b)).alias("y"), quarter(w).alias("w"), quarter(h).alias("h")) for a, b, w, h in parts]
        out = F.when(mode == name, F.array(*rects)).otherwise(out)
    return out


def uniform_tiles(blocks: Column, tiles: Column) -> Column:
    """Sizes of evenly spaced tile columns or rows."""
    blocks, tiles = blocks.cast("long"), tiles.cast("long")
    at = lambda i: div(i * blocks, tiles)
    return F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda i: at(i + 1) - at(i))


def explicit_tiles(blocks: Column, given: Column) -> Column:
    """Sizes given for all tiles but the last, which takes the rest; null if nothing is left for it."""
    rest = blocks.cast("long") - F.aggregate(given, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(rest > 0, F.concat(given, F.array(rest)))


def scan_order(size: int, kind: str) -> list[tuple[int, int]]:
    """Positions (x, y) of a square block in scan order: diagonal, horizontal, vertical or traverse."""
    cells = [(x, y) for y in range(size) for x in range(size)]
    keys = {
        "diagonal": lambda c: (c[0] + c[1], c[0]),  # up along each anti-diagonal
        "horizontal": lambda c: (c[1], c[0]),
        "vertical": lambda c: (c[0], c[1]),
        "traverse": lambda c: (c[1], -c[0] if c[1] % 2 else c[0]),
    }
    return sorted(cells, key=keys[kind])


def paeth(corner: Column, top: Column, left: Column) -> Column:
    """Of top, left and corner the one nearest to top + left - corner, in that order of preference."""
    base = top + left - corner
    to_top, to_left, to_corner = F.abs(base - top), F.abs(base - left), F.abs(base - corner)
    return F.when((to_top <= to_left) & (to_top <= to_corner), top).when(to_left <= to_corner, left).otherwise(corner)


def dc_prediction(neighbours: Column) -> Column:
    """Rounded mean of the neighbours; mid-gray without any."""
    total = F.aggregate(neighbours, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size(neighbours).cast("long")
    return F.when(n > 0, div(total + div(n, F.lit(2).cast("long")), n)).otherwise(128)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lift(v: Column) -> Column:
    """One lifting pass over an array of four values (a, c, d, b)."""
    sums = let(v, lambda x: F.struct((x[0] + x[1]).alias("a"), (x[2] - x[3]).alias("d"), x[1].alias("c"), x[3].alias("b")))
    turned = let(sums, lambda s: F.struct(s["a"].alias("a"), s["d"].alias("d"), (shr(s["a"] - s["d"], 1) - s["b"]).alias("b"), (shr(s["a"] - s["d"], 1) - s["c"]).alias("c")))
    return let(turned, lambda s: F.array(s["a"] - s["b"], s["b"], s["c"], s["d"] + s["c"]))


def inverse_hadamard(coefficients: Column) -> Column:
    """The lossless 4x4 inverse Walsh-Hadamard transform of an array of sixteen: rows, then columns."""
    four = lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), f)
    turn = lambda m: four(lambda i: F.array(*(m[k][i] for k in range(4))))
    half = four(lambda r: _lift(F.slice(coefficients, r * 4 + 1, F.lit(4))))
    columns = let(half, lambda h: let(turn(h), lambda t: F.transform(t, _lift)))
    return F.transform(F.flatten(let(columns, turn)), lambda x: clamp(x, -32768, 32767))


def safe_integer(text: Column, signed: bool = False) -> Column:
    """A text as a number that a double holds exactly; null otherwise."""
    # 28 digits leave room for a common type with the ten decimal places: at 38 the comparison would drop them.
    n = text.try_cast("decimal(28,10)")
    most = F.lit((1 << 53) - 1).cast("decimal(18,0)")
    low = -most if signed else F.lit(0).cast("decimal(18,0)")
    return F.when((n % 1 == 0) & (n <= most) & (n >= low), n.cast("long"))
