"""Sample tables: decode and presentation order, runs, chunks, offsets, fragments.

All keyed by ``track_id`` (with ``file_id`` in front where several files meet); the
order is always a column, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framelake.functions.pixels import fragment_flags

TRACK = ("track_id",)


def _by(keys: tuple[str, ...], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def decode_times(samples: DataFrame, keys: tuple[str, ...] = TRACK, order: str = "decode_index", duration: str = "duration") -> DataFrame:
    """Adds ``dts``: the sum of the durations before."""
    before = _by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("dts", F.coalesce(F.sum(duration).over(before), F.lit(0)).cast("long"))


def presentation_order(samples: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds ``presentation_index``: the rank by (pts, dts, decode_index), from 0."""
    return samples.withColumn("presentation_index", (F.row_number().over(_by(keys, "pts", "dts", "decode_index")) - 1).cast("long"))


def nearest_random_access(samples: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds ``rap``: the last sync sample at or before each sample in decode order, else 0."""
    upto = _by(keys, "decode_index").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("rap", F.coalesce(F.max(F.when(F.col("is_sync"), F.col("decode_index"))).over(upto), F.lit(0)).cast("long"))


def decode_work(samples: DataFrame, keys: tuple[str, ...] = TRACK, most: int | None = None) -> DataFrame:
    """Adds ``work``: samples to decode from the nearest random-access point; ``too_long`` if that exceeds ``most``."""
    out = nearest_random_access(samples, keys).withColumn("work", F.col("decode_index") - F.col("rap") + 1)
    return out if most is None else out.withColumn("too_long", F.col("work") > most)


def compress_runs(rows: DataFrame, value: str, order: str = "decode_index", keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Maximal runs of equal values in order: keys, ``run_no`` (from 0), ``count``, ``value``."""
    place = F.row_number().over(_by(keys, order))
    island = place - F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    runs = rows.withColumn("_at", place).withColumn("_island", island).groupBy(*keys, value, "_island").agg(F.count("*").alias("count"), F.min("_at").alias("_first"))
    return runs.select(*keys, (F.row_number().over(_by(keys, "_first")) - 1).cast("long").alias("run_no"), "count", F.col(value).alias("value"))


def expand_runs(runs: DataFrame, keys: tuple[str, ...] = TRACK, order: str = "run_no") -> DataFrame:
    """The values of runs (count, value) one by one: keys, ``i`` (from 0), ``value``. A run of zero gives none."""
    before = _by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    first = runs.withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long"))
    steps = F.when(F.col("count") > 0, F.sequence(F.lit(0).cast("long"), F.col("count").cast("long") - 1))
    return first.select(*keys, "value", "_first", F.explode(steps).alias("_step")).select(*keys, (F.col("_first") + F.col("_step")).alias("i"), "value")


def run_errors(runs: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Tracks whose runs do not add up to their number of samples: keys, ``total``, ``n``."""
    total = runs.groupBy(*keys).agg(F.sum("count").cast("long").alias("total"))
    return total.join(sizes.select(*keys, "n"), list(keys), "full").where(~F.col("total").eqNullSafe(F.col("n")))


def chunk_map(chunks: DataFrame, entries: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Chunks (chunk_no from 1) with first_chunk and samples_per_chunk of the last entry at or before; none, no row.

    One window over chunks and entries together: as many rows as both have, whatever their numbers in a track.
    """
    others = [c for c in chunks.columns if c not in keys and c != "chunk_no"]
    left = chunks.select(*keys, F.col("chunk_no").alias("_at"), F.lit(1).alias("_side"), F.struct(*others, F.lit(0).alias("_")).alias("_row"), F.lit(None).cast("long").alias("_per"))
    right = entries.select(*keys, F.col("first_chunk").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("samples_per_chunk").cast("long").alias("_per"))
    # An entry comes before the chunk of its number; of entries of one number the last given counts, as they are equal.
    upto = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_at").alias("first_chunk"), F.col("_per").alias("samples_per_chunk"))), ignorenulls=True).over(upto)
    met = left.unionByName(right).withColumn("_entry", entry).where((F.col("_side") == 1) & F.col("_entry").isNotNull())
    return met.select(*keys, F.col("_at").alias("chunk_no"), *(F.col("_row").getField(c).alias(c) for c in others), "_entry.*")


def chunk_samples(mapped: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds ``first_sample`` (from 0) of each mapped chunk."""
    before = _by(keys, "chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return mapped.withColumn("first_sample", F.coalesce(F.sum("samples_per_chunk").over(before), F.lit(0)).cast("long"))


def sample_offsets(samples: DataFrame, keys: tuple[str, ...] = TRACK, chunk: str = "chunk_no") -> DataFrame:
    """Adds ``offset``: the chunk's offset and the sizes before in the chunk."""
    before = _by((*keys, chunk), "decode_index").rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("offset", (F.col("chunk_offset") + F.coalesce(F.sum("size").over(before), F.lit(0))).cast("long"))


def sync_table(samples: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Sync samples numbered from 1; none for a track whose every sample is one."""
    all_sync = F.min(F.col("is_sync").cast("int")).over(Window.partitionBy(*keys))
    return samples.withColumn("_all", all_sync).where(F.col("is_sync") & (F.col("_all") == 0)).select(*keys, (F.col("decode_index") + 1).cast("long").alias("sample_no"))


def is_sync(samples: DataFrame, sync: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds ``is_sync`` from a sync table; a track without one is all sync."""
    marked = sync.select(*keys, (F.col("sample_no") - 1).alias("decode_index"), F.lit(True).alias("_in"))
    tracks = sync.select(*keys).distinct().withColumn("_has", F.lit(True))
    joined = samples.join(marked, [*keys, "decode_index"], "left").join(tracks, list(keys), "left")
    return joined.withColumn("is_sync", F.coalesce("_in", F.col("_has").isNull())).drop("_in", "_has")


def bad_sync(samples: DataFrame, sync: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Sync numbers that no sample has."""
    return sync.join(samples.select(*keys, (F.col("decode_index") + 1).alias("sample_no")), [*keys, "sample_no"], "left_anti")


def track_duration(samples: DataFrame, keys: tuple[str, ...] = TRACK, declared: str | None = None) -> DataFrame:
    """The end of the last sample, or the declared duration if that is later: keys, ``duration``."""
    end = F.max(F.col("dts") + F.col("duration"))
    if declared:
        end = F.greatest(end, F.max(declared))
    return samples.groupBy(*keys).agg(end.cast("long").alias("duration"))


def mux_duration(samples: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Last dts and its duration: keys, ``duration``."""
    return samples.groupBy(*keys).agg(F.max_by(F.col("dts") + F.col("duration"), F.col("decode_index")).cast("long").alias("duration"))


def presentation_end(samples: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    return samples.groupBy(*keys).agg(F.max(F.col("pts") + F.col("duration")).cast("long").alias("presentation_end"))


def dts_breaks(samples: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Samples whose dts is not where the one before ends; the first must be 0. Adds ``expected``."""
    expected = F.coalesce(F.lag(F.col("dts") + F.col("duration")).over(_by(keys, "decode_index")), F.lit(0))
    return samples.withColumn("expected", expected.cast("long")).where(F.col("dts") != F.col("expected"))


def index_breaks(rows: DataFrame, index: str, order: str, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Rows whose index is not one more than the one before, or 0 at first. Adds ``expected``."""
    expected = F.coalesce(F.lag(index).over(_by(keys, order)) + 1, F.lit(0))
    return rows.withColumn("expected", expected.cast("long")).where(F.col(index) != F.col("expected"))


def duplicate_identities(rows: DataFrame, identity: str, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Identities that occur more than once in a track: keys, identity, ``n``."""
    return rows.groupBy(*keys, identity).agg(F.count("*").alias("n")).where("n > 1")


def access_pattern(samples: DataFrame, pattern: str, keys: tuple[str, ...] = TRACK, index: str = "presentation_index") -> DataFrame:
    """Adds ``turn``: when each frame is asked for, ``sequential``, ``reverse`` or ``alternating`` (last, first, last but one, ...)."""
    i = F.col(index)
    last = F.max(index).over(Window.partitionBy(*keys))
    from_end = last - i
    turn = {
        "sequential": i,
        "reverse": from_end,
        "alternating": F.when(from_end <= i, 2 * from_end).otherwise(2 * i + 1),
    }[pattern]
    return samples.withColumn("turn", turn.cast("long"))


def budget_breach(samples: DataFrame, most: int, size: str = "size", keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds the running ``total`` of sizes in decode order, and ``over`` where it exceeds ``most``."""
    upto = _by(keys, "decode_index").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("total", F.sum(size).over(upto).cast("long")).withColumn("over", F.col("total") > most)


def fragment_samples(rows: DataFrame, trex: DataFrame, most_tracks: int = 64) -> DataFrame:
    """Resolve fragment samples against run, fragment and movie defaults.

    ``rows``: file_id, fragment_no, traf_no, run_no, i, track_id, moof_start, base, decode_time, default_duration,
    default_size, default_flags, data_offset, first_flags, duration, size, flags, cto. ``trex``: file_id, track_id,
    duration, size, flags. A default of 0 counts as absent. Adds the resolved columns, dts, pts, offset, is_sync, dependency
    and ``error``.
    """
    none = lambda c: F.when(F.col(c) != 0, F.col(c))
    known = trex.select("file_id", "track_id", *(F.col(c).alias(f"trex_{c}") for c in ("duration", "size", "flags")))
    df = rows.join(known, ["file_id", "track_id"], "left")
    df = df.withColumn("duration", F.coalesce("duration", none("default_duration"), none("trex_duration"))).withColumn("size", F.coalesce("size", none("default_size"), none("trex_size")))
    flags = F.coalesce("flags", F.when(F.col("i") == 0, F.col("first_flags")), none("default_flags"), F.coalesce("trex_flags", F.lit(0)))
    df = df.withColumn("flags", flags.cast("long"))
    missing = F.when(F.col("duration").isNull(), "no duration for a fragment's sample").when(F.col("size").isNull(), "no size for a fragment's sample")
    df = df.withColumn("error", missing)
    traf = Window.partitionBy("file_id", "fragment_no", "traf_no").orderBy("run_no", "i")
    before = traf.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("dts", (F.coalesce("decode_time", F.lit(0)) + F.coalesce(F.sum("duration").over(before), F.lit(0))).cast("long"))
    # A run without an offset goes on where the one before ended, the first at the fragment.
    df = df.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    starts = F.when((F.col("i") == 0) & F.col("data_offset").isNotNull(), F.struct((F.col("base") + F.col("data_offset")).alias("at"), F.col("_before").alias("had")))
    anchor = F.last(starts, ignorenulls=True).over(traf.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_anchor", anchor).withColumn("offset", (F.coalesce(F.col("_anchor.at"), F.col("moof_start")) + F.col("_before") - F.coalesce(F.col("_anchor.had"), F.lit(0))).cast("long"))
    flag = fragment_flags(F.col("flags"))
    return df.withColumn("pts", F.col("dts") + F.col("cto")).withColumn("is_sync", flag["is_sync"]).withColumn("dependency", flag["dependency"]).drop("_before", "_anchor", "trex_duration", "trex_size", "trex_flags")
