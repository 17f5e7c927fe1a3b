"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import materialise, release

ROUNDS = 60


def _star(edges: DataFrame, *, small: bool) -> DataFrame:
    """One step over edges (u, v): link the neighbours of u to the least of them and u."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:  # neighbours not above u: every edge points from its larger end
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("k"))
    if small:
        out = met.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v, both long): the least node that it reaches.

    Each round is written to the shared folder, which cuts lineage. Nulls and
    self-links are ignored; no link gives no row.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        mark = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("count_if(u <= v)")).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        before, edges = edges, materialise(_star(_star(edges, small=False), small=True), "links")
        release(before)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
