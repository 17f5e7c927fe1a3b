"""Relations between blocks, pictures and references: fills, prefix sums, joins on grids, and what a picture buffer holds."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.pixels import shr


def substituted(samples: DataFrame, keys: tuple[str, ...], order: str = "n", value: str = "value", middle: int = 128) -> DataFrame:
    """Reference samples without gaps: a missing one takes the last before it, those at the start the first there is, else mid-gray."""
    by = Window.partitionBy(*keys).orderBy(order)
    before = F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return samples.withColumn(value, F.coalesce(before, first, F.lit(middle)))


def accumulated(residuals: DataFrame, keys: tuple[str, ...], along: str, across: str, value: str = "value") -> DataFrame:
    """Adds ``total``: residuals of a block summed along its rows or columns."""
    return residuals.withColumn("total", F.sum(value).over(Window.partitionBy(*keys, across).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)))


def tile_scan(blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds ``raster`` and ``coded``: places of tree blocks (x, y, tile_x, tile_y) in the picture and in tile order, from 0."""
    whole = Window.partitionBy(*keys)
    return blocks.withColumn("raster", F.row_number().over(whole.orderBy("y", "x")) - 1).withColumn("coded", F.row_number().over(whole.orderBy("tile_y", "tile_x", "y", "x")) - 1)


def found_references(wanted: DataFrame, held: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pictures held (poc, mark, layer) for the references wanted (ref_no, poc, long_term, max_lsb, layer): adds ``found``, its poc or null.

    A short-term reference needs the exact order count and mark; a long-term one any mark, and only the low part of the
    count where ``max_lsb`` is given. Of several the least count is taken.
    """
    h = held.select(*(F.col(k).alias(f"h_{k}") for k in keys), F.col("poc").alias("h_poc"), F.col("mark").alias("h_mark"), F.col("layer").alias("h_layer"))
    same = F.col("layer") == F.col("h_layer")
    for k in keys:
        same = same & (F.col(k) == F.col(f"h_{k}"))
    exact = wanted.where("max_lsb IS NULL").join(h, same & (F.col("poc") == F.col("h_poc")), "left").where("long_term OR h_mark = 'short' OR h_poc IS NULL")
    low = lambda c: F.pmod(F.col(c), F.col("max_lsb"))
    masked = wanted.where("max_lsb IS NOT NULL").join(h, same & (low("poc") == low("h_poc")), "left")
    found = exact.unionByName(masked).groupBy(*keys, "ref_no").agg(F.min("h_poc").alias("found"))
    return wanted.join(found, [*keys, "ref_no"], "left")


def collocated(blocks: DataFrame, cells: DataFrame, keys: tuple[str, ...], log2_tree: int = 4) -> DataFrame:
    """Adds ``motion`` from the collocated picture's cells (cell_x, cell_y in 16 samples; motion): below right of a block
    (x, y, w, h), if that is in the same row of tree blocks, else at its centre."""
    grid = lambda c: shr(c, 4)
    corner_x, corner_y = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    inside = shr(corner_y, log2_tree) == shr(F.col("y"), log2_tree)
    asked = blocks.withColumn("_cx", F.when(inside, grid(corner_x))).withColumn("_cy", F.when(inside, grid(corner_y)))
    asked = asked.withColumn("_mx", grid(F.col("x") + shr(F.col("w"), 1))).withColumn("_my", grid(F.col("y") + shr(F.col("h"), 1)))

    def cell(name: str, x: str, y: str) -> tuple[DataFrame, Column]:
        c = cells.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.col("cell_x").alias(f"{name}_x"), F.col("cell_y").alias(f"{name}_y"), F.col("motion").alias(f"{name}_motion"))
        on = (F.col(x) == F.col(f"{name}_x")) & (F.col(y) == F.col(f"{name}_y"))
        for k in keys:
            on = on & (F.col(k) == F.col(f"{name}_{k}"))
        return c, on

    met = asked.join(*cell("c", "_cx", "_cy"), "left").join(*cell("m", "_mx", "_my"), "left")
    return met.select(*blocks.columns, F.coalesce("c_motion", "m_motion").alias("motion"))


def kept_until(pictures: DataFrame, references: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per picture (n, poc, cvs): ``last``, the last picture up to which the buffer keeps it as a reference without a break.

    ``references``: (n, poc), the order counts that picture n keeps. A picture left out once is gone.
    """
    by = Window.partitionBy(*keys, "cvs").orderBy("n")
    numbered = pictures.withColumn("at", F.row_number().over(by))
    later = numbered.select(*keys, "cvs", F.col("n").alias("r_n"), F.col("at").alias("r_at"))
    uses = references.withColumnRenamed("n", "r_n").join(later, [*keys, "r_n"]).withColumnRenamed("poc", "r_poc")
    same = F.lit(True)
    for k in (*keys, "cvs"):
        same = same & (F.col(f"p_{k}") == F.col(k))
    own = numbered.select(*(F.col(k).alias(f"p_{k}") for k in (*keys, "cvs")), "n", "poc", "at")
    met = own.join(uses, same & (F.col("poc") == F.col("r_poc")) & (F.col("r_at") > F.col("at")))
    # Kept by every picture since: the k-th use is k pictures later.
    turn = Window.partitionBy(*(f"p_{k}" for k in keys), "n").orderBy("r_at")
    unbroken = met.withColumn("_k", F.row_number().over(turn)).where(F.col("r_at") - F.col("at") == F.col("_k"))
    last = unbroken.groupBy(*(F.col(f"p_{k}").alias(k) for k in keys), "n").agg(F.max("r_n").alias("last"))
    return pictures.join(last, [*keys, "n"], "left").withColumn("last", F.coalesce("last", "n"))


def reordered(pictures: DataFrame, depth: int | None = None) -> DataFrame:
    """When each picture (track_id, n, cvs, poc) leaves a reorder buffer of ``depth`` pictures: ``left_at``, the n at which it
    goes out (null: when the stream ends), and ``turn``, its place among all that go out. Without a depth the pictures' own holds.

    A fold over numbers in decoding order, tracks in parallel.
    """

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        held: list[tuple] = []
        out = []
        for n, cvs, poc, most in own.sort_values("n")[["n", "cvs", "poc", "depth"]].itertuples(index=False, name=None):
            heapq.heappush(held, (cvs, poc, n))
            while len(held) > most:
                out.append((*heapq.heappop(held), n))
        while held:
            out.append((*heapq.heappop(held), None))
        return pd.DataFrame([(key[0], n, left, turn) for turn, (_, _, n, left) in enumerate(out)], columns=["track_id", "n", "left_at", "turn"]).astype({"left_at": "Int64"})

    most = F.col("depth") if depth is None else F.lit(depth)
    return pictures.select("track_id", "n", "cvs", "poc", most.alias("depth")).groupBy("track_id").applyInPandas(run, "track_id long, n long, left_at long, turn long")


def merged_offsets(blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds ``from_x`` and ``from_y``: the block whose offsets a tree block (x, y, slice, merge_left, merge_up) takes.

    A block takes those of its left neighbour, or else of the one above, in the same slice. A run that merges left takes
    what its first block has; that block's own or what is above it, row by row.
    """
    row = Window.partitionBy(*keys, "y").orderBy("x")
    left = F.coalesce(F.col("merge_left") & (F.lag("slice").over(row) == F.col("slice")) & (F.lag("x").over(row) == F.col("x") - 1), F.lit(False))
    runs = blocks.withColumn("_first", F.max(F.when(~left, F.col("x"))).over(row.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_left", left)
    names = [f.name for f in blocks.schema.fields]

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple, tuple] = {}
        slices = {(x, y): s for x, y, s in own[["x", "y", "slice"]].itertuples(index=False, name=None)}
        for x, y, s, first, is_left, up in own.sort_values(["y", "x"])[["x", "y", "slice", "_first", "_left", "merge_up"]].itertuples(index=False, name=None):
            above = up and not is_left and slices.get((x, y - 1)) == s
            found[x, y] = found[int(first), y] if is_left else found[x, y - 1] if above else (x, y)
        own = own[names].copy()
        own["from_x"], own["from_y"] = zip(*(found[x, y] for x, y in zip(own["x"], own["y"], strict=True)), strict=True)
        return own

    schema = blocks.schema.simpleString()[7:-1].replace(":", " ") + ", from_x long, from_y long"
    return runs.groupBy(*keys).applyInPandas(run, schema)


def block_budget(units: DataFrame, keys: tuple[str, ...], most: int, order: str = "n", blocks: str = "blocks") -> DataFrame:
    """Adds ``total`` (blocks decoded so far) and ``over`` where that exceeds ``most``."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("total", F.sum(blocks).over(by)).withColumn("over", F.col("total") > most)


def valid_slots(slots: DataFrame, signalled: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Reference slots (slot, order_hint) that an error-resilient frame leaves: those whose hint is the one signalled for the slot."""
    s = signalled.select(*keys, "slot", F.col("order_hint").alias("_hint"))
    return slots.join(s, [*keys, "slot"]).where(F.col("order_hint") == F.col("_hint")).drop("_hint")


def referred_slots(frames: DataFrame, slots: Column, indexes: Column, width: Column, height: Column) -> DataFrame:
    """Adds ``refs`` (the slots that a frame's indexes name) and ``error``: an empty slot is malformed, another size unsupported."""
    refs = F.transform(indexes, lambda i: F.get(slots, i))
    kind = F.when(F.exists(refs, lambda r: r.isNull()), "MalformedMedia").when(F.exists(refs, lambda r: (r["width"] != width) | (r["height"] != height)), "Unsupported")
    return frames.withColumn("refs", refs).withColumn("error", kind)
