"""Picture order counts, coded sequences and reference lists as windows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: NAL unit types of random-access pictures, and of those whose output flag resets the order.
IRAP = range(16, 24)
IDR = (19, 20)
#: Types that never are the picture before: RASL, RADL, and sub-layer non-reference pictures.
RASL, RADL, NON_REFERENCE = (8, 9), (6, 7), (0, 2, 4, 10, 12, 14)


def carries_order(nal_type: Column, temporal_id: Column) -> Column:
    """Whether later pictures derive their order from this one."""
    return (temporal_id == 0) & ~nal_type.isin(*RASL, *RADL, *NON_REFERENCE)


def coded_sequences(pictures: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Adds ``cvs``: from 0, one more at each picture with ``resets`` after the first."""
    upto = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("n")) == 1
    return pictures.withColumn("_new", (F.col("resets") & ~first).cast("long")).withColumn("cvs", F.sum("_new").over(upto)).drop("_new")


def picture_order(pictures: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Adds ``poc_msb`` and ``poc`` from n, poc_lsb, max_poc_lsb, ``resets`` (an IRAP whose order starts anew) and ``carries``.

    The high part changes by one period wherever the low part wraps against the last picture that carries the
    order; so it is a running sum of steps among those, per stretch since a reset.
    """
    order = Window.partitionBy(*keys).orderBy("n")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    df = pictures.withColumn("_stretch", F.sum(F.col("resets").cast("long")).over(upto))
    seen = F.last(F.when(F.col("carries"), F.col("poc_lsb")), ignorenulls=True).over(before)
    low, high = F.col("poc_lsb"), F.col("max_poc_lsb")
    df = df.withColumn("_last", F.coalesce(seen, F.lit(0)))
    half = F.call_function("div", high, F.lit(2))
    up = (low < F.col("_last")) & (F.col("_last") - low >= half)
    down = (low > F.col("_last")) & (low - F.col("_last") > half)
    df = df.withColumn("_step", F.when(F.col("resets"), 0).when(up, high).when(down, -high).otherwise(0))
    within = Window.partitionBy(*keys, "_stretch").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # A reset picture that does not carry the order leaves the high part before it in force.
    carried = F.coalesce(F.sum(F.when(F.col("carries"), F.col("_step"))).over(within), F.lit(0))
    df = df.withColumn("poc_msb", (carried + F.col("_step")).cast("long"))
    return df.withColumn("poc", F.col("poc_msb") + low).drop("_stretch", "_last", "_step")


def reference_sets(is_idr: Column, poc: Column, max_lsb: Column, negative: Column, positive: Column, long_term: Column) -> Column:
    """Order counts of the five reference sets.

    ``negative`` and ``positive``: arrays of struct(delta, used); ``long_term``: array of struct(lsb, has_msb, msb_cycle, used).
    """
    used = lambda xs: F.transform(F.filter(xs, lambda x: x["used"]), lambda x: poc + x["delta"])
    idle = lambda xs: F.transform(F.filter(xs, lambda x: ~x["used"]), lambda x: poc + x["delta"])
    far = lambda x: x["lsb"] + F.when(x["has_msb"], poc - x["msb_cycle"] * max_lsb - poc.bitwiseAND(max_lsb - 1)).otherwise(0)
    sets = F.struct(
        used(negative).alias("st_curr_before"),
        used(positive).alias("st_curr_after"),
        F.concat(idle(negative), idle(positive)).alias("st_foll"),
        F.transform(F.filter(long_term, lambda x: x["used"]), far).alias("lt_curr"),
        F.transform(F.filter(long_term, lambda x: ~x["used"]), far).alias("lt_foll"),
    )
    none = F.array().cast("array<bigint>")
    return F.when(is_idr, F.struct(*(none.alias(n) for n in ("st_curr_before", "st_curr_after", "st_foll", "lt_curr", "lt_foll")))).otherwise(sets)


def reference_list(first: Column, second: Column, long_term: Column, active: Column, total: Column, entries: Column | None = None) -> Column:
    """A reference list: the sets in turn, repeated to the greater of ``active`` and ``total``, then cut or picked by ``entries``.

    List 1 swaps the first two. Without any reference all entries are null.
    """
    once = F.concat(first, second, long_term)
    length = F.greatest(active, total)
    times = F.when(F.size(once) > 0, F.ceil(length / F.size(once)).cast("int")).otherwise(0)
    temp = F.slice(F.flatten(F.array_repeat(once, times)), F.lit(1), length)
    places = F.sequence(F.lit(0), active - 1)
    if entries is not None:
        places = F.when(entries.isNull(), places).otherwise(F.slice(entries, F.lit(1), active))
    return F.transform(places, lambda i: F.get(temp, i))


def output_order(pictures: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Adds ``output_index`` of the pictures that are output: by coded sequence, then order count."""
    shown = pictures.where("output")
    return shown.withColumn("output_index", (F.row_number().over(Window.partitionBy(*keys).orderBy("cvs", "poc")) - 1).cast("long"))


def active_parameter_sets(units: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Adds to each slice the last parameter set of its id before it: units (unit_no, kind, id), kind ``set`` or ``slice``; null if there is none."""
    before = Window.partitionBy(*keys, "id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
    found = units.withColumn("set_no", F.last(F.when(F.col("kind") == "set", F.col("unit_no")), ignorenulls=True).over(before))
    return found.where("kind = 'slice'")


def access_units(units: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Adds ``access_unit``: a new one starts at a first slice or a parameter set, after a slice."""
    order = Window.partitionBy(*keys).orderBy("unit_no")
    opens = F.col("first_slice") | F.col("nal_type").isin(32, 33, 34)
    is_slice = F.col("nal_type") < 32
    sealed = F.last(F.when(opens | is_slice, is_slice), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = opens & F.coalesce(sealed, F.lit(False))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("_start", start.cast("long")).withColumn("access_unit", F.sum("_start").over(upto)).drop("_start")
