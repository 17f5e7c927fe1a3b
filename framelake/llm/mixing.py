"""Mix sources to target weights, by a multivariate-hypergeometric splitting tree.

A source's documents fall into ``BLOCKS`` blocks by a hash, which an affine map
permutes. A target of p.r times the source's size takes every block p times and
then a prefix of the permuted blocks; the last few blocks, of at least
``EDGE_ROWS`` documents where there are so many, are filled document by
document: half of what they owe in permuted order (nothing where they are few), the rest by the
largest that fits. That fixes an exact quota of block draws for
each source. A binary tree over the output shards splits the vector of quotas by
multivariate-hypergeometric draws, so each shard holds a fixed number of draws
from each source, and consecutive permuted draws go to consecutive shards:
draws are disjoint and cover the quota. Rows are shuffled inside a shard only.

The driver plans source by source, in code-point order, from a stream of sums per source and block; it keeps one number
for each source and the plans of at most ``GROUP`` sources, which share a splitting tree. So the number of sources has
no bound but eight bytes each. Everything that touches rows is a DataFrame expression. The documents that fill the last blocks
are not drawn at random: of those that fit the largest go first, which favours long documents within these blocks.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, the last; a source of size 0 has target 0; rows that repeat
are drawn on their own; an empty table gives an empty mix. Columns of the input
stay inside ``row``, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import WORD, broadcast_if_small, literal_table, text_or_empty
from framelake.session import materialise, shared_folder

BLOCKS = 1024
EDGE_ROWS = 512
#: Rounds of filling what is left of a target with documents that still fit.
ROUNDS = 6
#: Sources that are planned together; plans of more are written as a table.
GROUP = 4096

PLAN = T.StructType(
    [
        T.StructField("plan_source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("passes", T.IntegerType()),
        T.StructField("factor", T.IntegerType()),
        T.StructField("shift", T.IntegerType()),
        T.StructField("whole", T.IntegerType()),
        T.StructField("edge", T.IntegerType()),
        T.StructField("gap", T.DoubleType()),
        T.StructField("lead", T.DoubleType()),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def target_sizes(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Targets in proportion to the weights; what exceeds ``most`` times a size is dealt again to the rest."""
    targets, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        for i in over or open_:
            targets[i] = float(most * sizes[i]) if over else weights[i] * unit
        if not over:
            break
        left = max(0.0, left - sum(targets[i] for i in over))
        open_ -= over
    return targets


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source in each shard: a tree of multivariate-hypergeometric splits.

    A node's draws go left in proportion to the shards below; the split only
    depends on the seed and the node, so reruns agree.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64), 1)]
    while stack:
        first, last, q, node = stack.pop()
        if last - first == 1:
            out[first] = q
            continue
        middle = (first + last) // 2
        take = int(q.sum()) * (middle - first) // (last - first)
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(q, take, method="marginals") if len(q) else q
        stack += [(first, middle, left, 2 * node), (middle, last, q - left, 2 * node + 1)]
    return out


def _order(source: int, seed: int) -> tuple[int, int]:
    """An affine permutation of the blocks: an odd factor and a shift."""
    rng = np.random.default_rng([seed, 7, source])
    return int(rng.integers(0, BLOCKS // 2)) * 2 + 1, int(rng.integers(0, BLOCKS))


def _plan_source(name: str | None, target: float, size: np.ndarray, rows: np.ndarray, most: int) -> dict:
    """What is drawn of a source, from the sizes and rows of its blocks in permuted order."""
    total = int(size.sum())
    passes = min(most, math.floor(target / total + 1e-12)) if total else 0
    rest = max(0.0, target - passes * total) if passes < most else 0.0
    grown = np.cumsum(size)
    whole = int(np.searchsorted(grown, rest, side="right")) if rest > 0 else 0
    edge = whole
    while rest > 0 and edge < BLOCKS and rows[whole:edge].sum() < EDGE_ROWS:
        edge += 1
    while rest > 0 and whole and rows[whole:edge].sum() < EDGE_ROWS:  # few documents: all of them are filled one by one
        whole -= 1
    gap = rest - (float(grown[whole - 1]) if whole else 0.0)
    lead = 0.5 if rows[whole:edge].sum() >= EDGE_ROWS / 4 else 0.0
    return {"plan_source": name, "source_size": total, "target": target, "passes": passes, "whole": whole, "edge": edge, "gap": gap, "lead": lead}


def plan_mix(sums: Callable[[], Iterable], weights: tuple[float, ...], share: float, most: int, shards: int, seed: int) -> Iterator[list[dict]]:
    """Plans of ``GROUP`` sources at a time. ``sums`` streams rows (source, block, size, n) in order of the source, null last."""
    totals = [sum(r["size"] for r in rows) for _, rows in groupby(sums(), key=lambda r: r["source"])]
    targets = target_sizes(totals, [weights[i % len(weights)] for i in range(len(totals))], share, most)
    plan: list[dict] = []
    for i, (name, blocks) in enumerate(groupby(sums(), key=lambda r: r["source"])):
        factor, shift = _order(i, seed)
        size, rows = np.zeros(BLOCKS, dtype=np.int64), np.zeros(BLOCKS, dtype=np.int64)
        for r in blocks:
            place = (factor * r["block"] + shift) % BLOCKS
            size[place], rows[place] = r["size"], r["n"]
        plan.append(_plan_source(name, targets[i], size, rows, most) | {"factor": factor, "shift": shift})
        if len(plan) == GROUP or i + 1 == len(totals):
            quotas = np.array([p["passes"] * BLOCKS + p["edge"] for p in plan], dtype=np.int64)
            ends = split_quotas(quotas, shards, seed + i).cumsum(axis=0)
            yield [p | {"ends": [int(x) for x in ends[:, j]]} for j, p in enumerate(plan)]
            plan = []


def _plan_table(spark: SparkSession, plans: Iterator[list[dict]]) -> DataFrame:
    """The plans as a table: a broadcast literal if one group holds them all, else written group by group."""
    first, second = next(plans, []), next(plans, None)
    if second is None:
        return F.broadcast(literal_table(spark, first, PLAN))
    path = shared_folder(spark, "plans")
    for part in chain([first, second], plans):
        literal_table(spark, part, PLAN).write.mode("append").parquet(path)
    return broadcast_if_small(spark.read.schema(PLAN).parquet(path))


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    most: int = 3,
    shards: int = 64,
    seed: int = 42,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """One row per input row: ``row`` (the input), ``size``, ``source_size``, ``target`` and ``shards``.

    ``shards`` lists the output shard of each time the row is drawn, so its length
    is how often the mix takes the row: 0 to ``most`` times.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.col(source))
    base = docs.select(
        F.struct("*").alias("row"),
        F.col(source).cast("string").alias("source"),
        (word_count("text") if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))).alias("size"),
        hashed.alias("hash"),
        F.pmod(hashed, F.lit(BLOCKS)).cast("int").alias("block"),
    )
    sums = materialise(base.groupBy("source", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "sums")
    # Strings sort by their bytes, which is by code point.
    ordered = sums.orderBy(F.asc_nulls_last("source"))
    plan = _plan_table(spark, plan_mix(ordered.toLocalIterator, weights, share, most, shards, seed))
    placed = base.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn(
        "place", F.pmod(F.col("factor") * F.col("block") + F.col("shift"), F.lit(BLOCKS)).cast("int")
    )
    in_edge = (F.col("place") >= F.col("whole")) & (F.col("place") < F.col("edge"))
    plain = placed.where(~in_edge).withColumn("more", F.col("place") < F.col("whole"))
    # The blocks at the edge of each target: a few hundred rows a source, or the share 1/BLOCKS of it.
    filled = placed.where(in_edge).withColumn("more", F.col("size") < 0)
    order = Window.partitionBy("source").orderBy("hash", "size", "block").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    large = Window.partitionBy("source").orderBy(F.desc("size"), "hash", "block").rowsBetween(Window.unboundedPreceding, 0)
    for i in range(ROUNDS):
        # Half of the gap goes to documents in permuted order, unless they are few, the rest to the largest that still fit.
        left = F.col("gap") * (F.lit(1.0) if i else F.col("lead")) - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).over(whole)
        filled = filled.withColumn("left", left).withColumn("fits", ~F.col("more") & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
        filled = filled.withColumn("upto", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(large if i else order))
        filled = filled.withColumn("more", F.col("more") | (F.col("fits") & (F.col("upto") <= F.col("left")))).drop("left", "fits", "upto")
    # One document more where overshooting by it leaves a smaller error.
    left = F.col("gap") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).over(whole)
    filled = filled.withColumn("left", left).withColumn("off", F.when(~F.col("more") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("left")), F.abs(F.col("left") - F.col("size"))))
    filled = filled.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("off"), "hash", "size", "block")))
    filled = filled.withColumn("more", F.col("more") | ((F.col("nth") == 1) & F.col("off").isNotNull())).drop("left", "off", "nth")
    drawn = plain.unionByName(filled)
    times = F.when(F.col("size") > 0, F.col("passes") + F.col("more").cast("int")).otherwise(0)
    draws = F.slice(F.array(*(F.lit(i) for i in range(most + 1))), F.lit(1), times)
    shard = F.transform(draws, lambda t: F.least(F.lit(shards - 1), F.size(F.filter("ends", lambda e: e <= t * BLOCKS + F.col("place")))))
    return drawn.select("row", "size", "source_size", "target", shard.alias("shards"))


def drawn_rows(mixed: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: each row as often as it is drawn, dealt by shard and shuffled inside each shard."""
    fields = mixed.schema["row"].dataType.names
    rows = mixed.select("row", F.posexplode("shards").alias("draw", "shard"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), F.hash("row"), F.col("draw")))
    shards = max(1, int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "order")
    return dealt.select(*(F.col("row").getField(f).alias(f) for f in fields))
