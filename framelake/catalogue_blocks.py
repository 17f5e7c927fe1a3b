"""Queries over reconstruction arithmetic and the relations between blocks and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake import views
from framelake.catalogue import joined, query
from framelake.functions import rebuild as R
from framelake.functions.blocks import explicit_tiles, scan_order
from framelake.functions.pixels import div
from framelake.operators import blocks as O
from framelake.operators import pictures
from framelake.operators import residuals as RS


def _part(spark, sf) -> DataFrame:
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))


_K = "k AS (SELECT p_partkey AS k FROM part)"


# --- scans ---


@query(f"""WITH {_K} SELECT k, CASE WHEN (b = 2 OR (b = 3 AND (k % 3 = 0 OR k % 7 = 0))) AND m BETWEEN 6 AND 14 THEN 'vertical'
    WHEN (b = 2 OR (b = 3 AND (k % 3 = 0 OR k % 7 = 0))) AND m BETWEEN 22 AND 30 THEN 'horizontal' ELSE 'diagonal' END AS scan FROM (SELECT k, k % 35 AS m, k // 35 % 4 + 2 AS b FROM k)""")
def scan_kinds(spark, sf):
    k = _part(spark, sf)
    return k.select("k", R.scan_kind(F.col("k") % 35, div(F.col("k"), F.lit(35).cast("long")) % 4 + 2, F.col("k") % 3 == 0, F.col("k") % 7 == 0).alias("scan"))


@query(f"""WITH {_K} SELECT k, list_sum(list_transform(range(0, 8), lambda i: (((k % 256) >> i) & 1) * 4 ** i + (((k // 7 % 256) >> i) & 1) * 2 * 4 ** i))::BIGINT AS place FROM k""")
def z_scan(spark, sf):
    return _part(spark, sf).select("k", R.z_order(F.col("k") % 256, div(F.col("k"), F.lit(7).cast("long")) % 256).alias("place"))


@query(f"""WITH {_K} SELECT k, k % 16 <= k // 3 % 16 AND k % 2 = k // 2 % 2 AND k % 3 = k // 3 % 3 AND k % 11 > 0 AS available FROM k""")
def neighbour_availability(spark, sf):
    d = lambda n: div(F.col("k"), F.lit(n).cast("long"))
    side = lambda p, s, t: F.struct(p.alias("place"), s.alias("slice"), t.alias("tile"))
    here, there = side(d(3) % 16, F.col("k") % 2, F.col("k") % 3), F.when(F.col("k") % 11 > 0, side(F.col("k") % 16, d(2) % 2, d(3) % 3))
    return _part(spark, sf).select("k", R.available(here, there).alias("available"))


@query("SELECT size::INTEGER AS size, kind, n::INTEGER AS n, x::INTEGER AS x, y::INTEGER AS y FROM (" + """
    SELECT size, kind, row_number() OVER (PARTITION BY size, kind ORDER BY CASE kind WHEN 'diagonal' THEN x + y WHEN 'vertical' THEN x ELSE y END,
    CASE kind WHEN 'diagonal' THEN x WHEN 'vertical' THEN y WHEN 'horizontal' THEN x ELSE CASE WHEN y % 2 = 1 THEN -x ELSE x END END) - 1 AS n, x, y
    FROM (SELECT unnest([2, 4, 8]) AS size), (SELECT unnest(['diagonal', 'horizontal', 'vertical', 'traverse']) AS kind), range(0, 8) a(x), range(0, 8) b(y) WHERE x < size AND y < size)""")
def scan_orders(spark, sf):
    rows = [(size, kind, n, x, y) for size in (2, 4, 8) for kind in ("diagonal", "horizontal", "vertical", "traverse") for n, (x, y) in enumerate(scan_order(size, kind))]
    return spark.createDataFrame(rows, "size int, kind string, n int, x int, y int")


@query(f"""WITH {_K}, b AS (SELECT k, k // 64 AS picture, k % 8 AS x, k % 64 // 8 AS y FROM k)
SELECT k, row_number() OVER (PARTITION BY picture ORDER BY y, x) - 1 AS raster, row_number() OVER (PARTITION BY picture ORDER BY y // 5, x // 3, y, x) - 1 AS coded FROM b""")
def tile_scan(spark, sf):
    b = _part(spark, sf).select("k", div(F.col("k"), F.lit(64).cast("long")).alias("picture"), (F.col("k") % 8).alias("x"), div(F.col("k") % 64, F.lit(8).cast("long")).alias("y"))
    b = b.withColumn("tile_x", div(F.col("x"), F.lit(3).cast("long"))).withColumn("tile_y", div(F.col("y"), F.lit(5).cast("long")))
    return O.tile_scan(b, ("picture",)).select("k", F.col("raster").cast("long").alias("raster"), F.col("coded").cast("long").alias("coded"))


@query(f"""WITH {_K} SELECT k, CASE WHEN k % 40 > k % 7 + k % 5 THEN concat_ws(',', k % 7, k % 5, k % 40 - k % 7 - k % 5) END AS sizes FROM k""")
def tile_sizes_given(spark, sf):
    return _part(spark, sf).select("k", joined(explicit_tiles(F.col("k") % 40, F.array(F.col("k") % 7, F.col("k") % 5))).alias("sizes")).select("k", "sizes")


# --- motion ---


@query(f"""WITH {_K}, v AS (SELECT k, (k * 37) % 65536 - 32768 + ((k * 91) % 4001 - 2000) * CASE WHEN k % 2 = 0 THEN 4 ELSE 1 END AS s FROM k)
SELECT k, ((s + 32768) % 65536 + 65536) % 65536 - 32768 AS moved FROM v""")
def motion_sums(spark, sf):
    return _part(spark, sf).select("k", R.add_motion((F.col("k") * 37) % 65536 - 32768, (F.col("k") * 91) % 4001 - 2000, F.col("k") % 2 == 0).alias("moved"))


@query(f"""WITH {_K}, v AS (SELECT k, (k * 37) % 2001 - 1000 AS v, CASE WHEN k % 17 = 8 THEN 9 ELSE k % 17 - 8 END AS td, k % 13 - 6 AS tb FROM k),
f AS (SELECT k, v, greatest(-4096, least(4095, floor((tb * trunc((16384 + abs(td) // 2) / td::DOUBLE) + 32) / 64.0))) AS f FROM v)
SELECT k, greatest(-32768, least(32767, sign(f * v) * floor((abs(f * v) + 127) / 256.0)))::BIGINT AS scaled FROM f""")
def motion_scaled(spark, sf):
    return _part(spark, sf).select("k", R.scaled_motion((F.col("k") * 37) % 2001 - 1000, F.when(F.col("k") % 17 == 8, 9).otherwise(F.col("k") % 17 - 8).cast("long"), F.col("k") % 13 - 6).cast("long").alias("scaled"))


@query(f"""WITH {_K}, c AS (SELECT k, list_filter([k % 4, k % 3, CASE WHEN k % 5 > 0 THEN k % 2 END, k % 6], lambda x: x IS NOT NULL) AS l FROM k),
o AS (SELECT k, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM c)
SELECT k, array_to_string((l || CASE WHEN k % 3 = 0 THEN [9] ELSE [] END || [0, 0, 0, 0, 0])[1:k % 5 + 1], ',') AS merged FROM o""")
def merge_lists(spark, sf):
    spatial = F.array(F.col("k") % 4, F.col("k") % 3, F.when(F.col("k") % 5 > 0, F.col("k") % 2), F.col("k") % 6)
    merged = R.merge_candidates(spatial, F.when(F.col("k") % 3 == 0, F.lit(9).cast("long")), F.array(*[F.lit(0).cast("long")] * 5), (F.col("k") % 5 + 1).cast("int"))
    return _part(spark, sf).select("k", joined(merged).alias("merged"))


_GRID = f"""{_K}, b AS (SELECT k, k // 64 AS picture, k % 8 * 8 AS x, k % 64 // 8 * 8 AS y, 8 * (k % 2 + 1) AS w, 8 * (k % 3 + 1) AS h FROM k),
c AS (SELECT DISTINCT k // 64 AS picture, k % 5 AS cx, k % 64 // 13 AS cy FROM k WHERE k % 4 < 3)"""


@query(f"""WITH {_GRID}
SELECT b.k, coalesce(c.cx * 100 + c.cy, m.cx * 100 + m.cy) AS motion FROM b
LEFT JOIN c ON c.picture = b.picture AND (y + h) // 16 = y // 16 AND c.cx = (x + w) // 16 AND c.cy = (y + h) // 16
LEFT JOIN c m ON m.picture = b.picture AND m.cx = (x + w // 2) // 16 AND m.cy = (y + h // 2) // 16""")
def collocated_motion(spark, sf):
    d = lambda c, n: div(c, F.lit(n).cast("long"))
    p = _part(spark, sf).withColumn("picture", d(F.col("k"), 64))
    b = p.select("k", "picture", (F.col("k") % 8 * 8).alias("x"), (d(F.col("k") % 64, 8) * 8).alias("y"), (8 * (F.col("k") % 2 + 1)).alias("w"), (8 * (F.col("k") % 3 + 1)).alias("h"))
    c = p.where(F.col("k") % 4 < 3).select("picture", (F.col("k") % 5).alias("cell_x"), d(F.col("k") % 64, 13).alias("cell_y")).distinct()
    return O.collocated(b, c.withColumn("motion", F.col("cell_x") * 100 + F.col("cell_y")), ("picture",)).select("k", "motion")


# --- quantisers and edges ---


@query(f"""WITH {_K}, q AS (SELECT k, floor((coalesce(CASE WHEN k % 3 > 0 THEN k % 52 END, k % 40) + coalesce(CASE WHEN k % 4 > 0 THEN k * 7 % 52 END, k % 40) + 1) / 2.0)::BIGINT AS p,
    k % 53 - 26 AS d, k % 3 * 6 AS o FROM k)
SELECT k, p AS predicted, ((p + d + 52 + 2 * o) % (52 + o) + 52 + o) % (52 + o) - o AS qp FROM q""")
def quantisers(spark, sf):
    p = R.predicted_qp(F.when(F.col("k") % 3 > 0, F.col("k") % 52), F.when(F.col("k") % 4 > 0, F.col("k") * 7 % 52), F.col("k") % 40)
    return _part(spark, sf).select("k", p.alias("predicted"), R.coded_qp(p, F.col("k") % 53 - 26, F.col("k") % 3 * 6).alias("qp"))


@query(f"""WITH {_K} SELECT k, CASE WHEN k % 2 = 1 THEN least(i, 51) WHEN i < 30 THEN i WHEN i > 43 THEN i - 6 ELSE [29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37, 37][i - 29] END AS chroma,
    CASE WHEN q < 16 THEN 0 WHEN q < 29 THEN q - 10 ELSE 2 * q - 38 END AS beta,
    CASE WHEN q < 18 THEN 0 WHEN q < 27 THEN 1 WHEN q < 31 THEN 2 WHEN q < 35 THEN 3 WHEN q < 38 THEN 4 WHEN q < 40 THEN 5 WHEN q < 42 THEN 6 WHEN q < 47 THEN q - 35 WHEN q = 47 THEN 13 WHEN q < 52 THEN 14 + 2 * (q - 48) ELSE 2 * q - 82 END AS limit_
    FROM (SELECT k, k % 58 AS i, k % 52 AS q FROM k)""")
def edge_tables(spark, sf):
    return _part(spark, sf).select("k", R.chroma_qp(F.col("k") % 58, F.col("k") % 2 == 0).cast("long").alias("chroma"), R.edge_threshold(F.col("k") % 52).cast("long").alias("beta"), R.edge_limit(F.col("k") % 52).cast("long").alias("limit_"))


@query(f"""WITH {_K}, m AS (SELECT k, [k % 2, k // 2 % 2] AS pr, [k // 4 % 2, k // 8 % 2] AS qr, [k % 7, k % 5] AS px, [k % 11, k % 3] AS qx, k % 3 = 0 AS one FROM k),
f AS (SELECT *, abs(px[1] - qx[1]) >= 4 AS f11, abs(px[2] - qx[2]) >= 4 AS f22, abs(px[1] - qx[2]) >= 4 AS f12, abs(px[2] - qx[1]) >= 4 AS f21 FROM m)
SELECT k, CASE WHEN k % 13 = 0 THEN 2 WHEN k % 17 = 0 THEN 1
    WHEN one THEN CASE WHEN pr[1] <> qr[1] OR f11 THEN 1 ELSE 0 END
    WHEN list_sort(pr) <> list_sort(qr) THEN 1
    WHEN pr[1] = pr[2] THEN CASE WHEN (f11 OR f22) AND (f12 OR f21) THEN 1 ELSE 0 END
    WHEN pr[1] = qr[1] THEN CASE WHEN f11 OR f22 THEN 1 ELSE 0 END ELSE CASE WHEN f12 OR f21 THEN 1 ELSE 0 END END AS strength FROM f""")
def edge_strength(spark, sf):
    d = lambda n: div(F.col("k"), F.lit(n).cast("long"))
    v = lambda r, x: F.struct(r.alias("ref"), x.alias("x"), F.lit(0).cast("long").alias("y"))
    n = F.when(F.col("k") % 3 == 0, 1).otherwise(2)
    p, q = F.slice(F.array(v(F.col("k") % 2, F.col("k") % 7), v(d(2) % 2, F.col("k") % 5)), F.lit(1), n), F.slice(F.array(v(d(4) % 2, F.col("k") % 11), v(d(8) % 2, F.col("k") % 3)), F.lit(1), n)
    return _part(spark, sf).select("k", R.boundary_strength(F.col("k") % 13 == 0, F.col("k") % 17 == 0, p, q).alias("strength"))


@query()
def luma_edges(spark, sf):
    """Four rows of each image as samples across an edge, at a quantiser of its own; held against plain Python in a test."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("gray", r * 8 + 1, F.lit(8)))
    q = F.pmod(F.col("frame_id"), F.lit(52))
    out = R.luma_edge(rows, R.edge_threshold(q), R.edge_limit(q))
    return views.images(spark, sf).select("frame_id", joined(F.flatten(out)).alias("samples"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0, least(255, g + d)) AS p0, greatest(0, least(255, b - d)) AS q0 FROM (
    SELECT *, greatest(-t, least(t, floor(((b - g) * 4 + r - (r + g) // 2 + 4) / 8.0)))::INTEGER AS d FROM (SELECT *, l_partkey % 25 AS t FROM pixels))""", views.PIXELS)
def chroma_edges(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    e = R.chroma_edge(r, g, b, div(r + g, F.lit(2)), F.col("l_partkey") % 25)
    return views.pixels(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", e["p0"].cast("int").alias("p0"), e["q0"].cast("int").alias("q0"))


_CELLS = "cells AS (SELECT frame_id, unnest(range(0, 64)) AS i, unnest(gray) AS v FROM images)"


def _cells(spark, sf) -> DataFrame:
    return views.images(spark, sf).select("frame_id", F.posexplode("gray").alias("i", "v"))


@query("""SELECT frame_id, i::INTEGER AS i, greatest(0, least(255, v + CASE WHEN v // 8 - frame_id % 29 BETWEEN 0 AND 3 THEN [7, -3, 2, -6][(v // 8 - frame_id % 29 + 1)::INTEGER] ELSE 0 END))::INTEGER AS band,
    greatest(0, least(255, v + coalesce(CASE sign(v - a) + sign(v - z) WHEN -2 THEN 4 WHEN -1 THEN 2 WHEN 1 THEN -2 WHEN 2 THEN -4 END, 0)))::INTEGER AS edge
    FROM (SELECT *, lag(v) OVER (PARTITION BY frame_id, i // 8 ORDER BY i) AS a, lead(v) OVER (PARTITION BY frame_id, i // 8 ORDER BY i) AS z FROM cells)""", views.IMAGES, _CELLS)
def sample_offsets_applied(spark, sf):
    """Band offsets, and edge offsets between the neighbours in a row."""
    row = "PARTITION BY frame_id, i div 8 ORDER BY i"
    c = _cells(spark, sf).select("*", F.expr(f"lag(v) OVER ({row})").alias("a"), F.expr(f"lead(v) OVER ({row})").alias("z"))
    band = R.band_offset(F.col("v"), F.col("frame_id") % 29, F.lit([7, -3, 2, -6]))
    edge = F.when(F.col("a").isNull() | F.col("z").isNull(), F.col("v")).otherwise(R.edge_offset(F.col("v"), F.col("a"), F.col("z"), F.lit([4, 2, -2, -4])))
    return c.select("frame_id", "i", band.cast("int").alias("band"), edge.cast("int").alias("edge"))


@query()
def merged_offsets(spark, sf):
    """Where each tree block of 8 x 8 gets its offsets from; held against a plain walk in a test."""
    b = _part(spark, sf).select("k", div(F.col("k"), F.lit(64).cast("long")).alias("picture"), (F.col("k") % 8).alias("x"), div(F.col("k") % 64, F.lit(8).cast("long")).alias("y"))
    b = b.withColumn("slice", div(F.col("y") * 8 + F.col("x"), F.lit(27).cast("long"))).withColumn("merge_left", F.col("k") % 3 == 0).withColumn("merge_up", F.col("k") % 2 == 0)
    return O.merged_offsets(b, ("picture",)).select("k", "from_x", "from_y")


# --- interpolation, weights, prediction ---


@query("""SELECT frame_id, y::INTEGER AS y, list_sum(list_transform(list_zip(r, CASE frame_id % 4 WHEN 0 THEN [0, 0, 0, 64, 0, 0, 0, 0] WHEN 1 THEN [-1, 4, -10, 58, 17, -5, 1, 0]
    WHEN 2 THEN [-1, 4, -11, 40, 40, -11, 4, -1] ELSE [0, 1, -5, 17, 58, -10, 4, -1] END), lambda p: p[1] * p[2]))::BIGINT AS luma,
    list_sum(list_transform(list_zip(r[1:4], CASE frame_id % 8 WHEN 0 THEN [0, 64, 0, 0] WHEN 1 THEN [-2, 58, 10, -2] WHEN 2 THEN [-4, 54, 16, -2] WHEN 3 THEN [-6, 46, 28, -4]
    WHEN 4 THEN [-4, 36, 36, -4] WHEN 5 THEN [-4, 28, 46, -6] WHEN 6 THEN [-2, 16, 54, -4] ELSE [-2, 10, 58, -2] END), lambda p: p[1] * p[2]))::BIGINT AS chroma
    FROM (SELECT frame_id, y, gray[y * 8 + 1:y * 8 + 8] AS r FROM images, range(0, 8) t(y))""", views.IMAGES)
def fractional_samples(spark, sf):
    rows = views.images(spark, sf).select("frame_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("gray", y * 8 + 1, F.lit(8)))).alias("y", "r"))
    return rows.select("frame_id", "y", R.interpolated(F.col("r"), F.col("frame_id") % 4).alias("luma"), R.interpolated(F.slice("r", 1, 4), F.col("frame_id") % 8, "chroma").alias("chroma"))


@query(f"""WITH {_K}, v AS (SELECT k, k * 13 % 16384 AS a, k * 29 % 16384 AS b, k % 129 - 64 AS w, k % 7 AS d, k % 41 - 20 AS o FROM k)
SELECT k, greatest(0, least(255, floor((a * w + 2.0 ** (d + 5)) / 2.0 ** (d + 6)) + o))::BIGINT AS weighted, greatest(0, least(255, (a + b + 64) // 128))::BIGINT AS mean FROM v""")
def weighted_prediction(spark, sf):
    a, b = F.col("k") * 13 % 16384, F.col("k") * 29 % 16384
    return _part(spark, sf).select("k", R.weighted(a, F.col("k") % 129 - 64, F.col("k") % 7, F.col("k") % 41 - 20).cast("long").alias("weighted"), R.mean_prediction(a, b).cast("long").alias("mean"))


@query("""SELECT frame_id, array_to_string(flatten(list_transform(l, lambda a: list_transform(t, lambda b: CASE frame_id % 4 WHEN 0 THEN (list_sum(t || l) + 4) // 8 WHEN 1 THEN b WHEN 2 THEN a
    ELSE CASE WHEN abs(a - c) <= abs(b - c) AND abs(a - c) <= abs(a + b - 2 * c) THEN b WHEN abs(b - c) <= abs(a + b - 2 * c) THEN a ELSE c END END::BIGINT))), ',') AS samples
    FROM (SELECT frame_id, gray[2:5] AS t, [gray[9], gray[17], gray[25], gray[33]] AS l, gray[1] AS c FROM images)""", views.IMAGES)
def intra_blocks(spark, sf):
    mode = F.element_at(F.lit(["DC", "V", "H", "PAETH"]), (F.col("frame_id") % 4 + 1).cast("int"))
    g = lambda i: F.get("gray", F.lit(i))
    return views.images(spark, sf).select("frame_id", joined(F.flatten(R.intra_block(mode, F.slice("gray", 2, 4), F.array(g(8), g(16), g(24), g(32)), g(0)))).alias("samples"))


@query(f"""WITH {_K} SELECT k, array_to_string(([k % 7, k % 11] || list_filter([k % 5 + 20, CASE WHEN k % 3 > 0 THEN k % 3 + 30 END, k % 2 + 40], lambda x, i: CASE i WHEN 1 THEN k % 2 > 0 WHEN 2 THEN k % 3 > 0 ELSE k % 5 > 0 END))[1:4], ',') AS palette,
    concat_ws(',', CASE WHEN a < 3 THEN 10 * (a + 1) ELSE 100 + k % 50 END, CASE WHEN b < 3 THEN 10 * (b + 1) ELSE 100 + k % 50 + (a >= 3)::INTEGER END,
    CASE WHEN c < 3 THEN 10 * (c + 1) ELSE 100 + k % 50 + (a >= 3)::INTEGER + (b >= 3)::INTEGER END) AS samples
    FROM (SELECT k, k % 4 AS a, k // 2 % 4 AS b, k // 3 % 4 AS c FROM k)""")
def palettes(spark, sf):
    d = lambda n: div(F.col("k"), F.lit(n).cast("long"))
    before = F.array(F.col("k") % 5 + 20, F.col("k") % 3 + 30, F.col("k") % 2 + 40)
    palette = R.next_palette(F.array(F.col("k") % 7, F.col("k") % 11), before, F.array(F.col("k") % 2 == 0, F.col("k") % 3 == 0, F.col("k") % 5 == 0), 4)
    samples = R.palette_samples(F.array(*(F.lit(x).cast("long") for x in (10, 20, 30))), F.array(*(x.cast("int") for x in (F.col("k") % 4, d(2) % 4, d(3) % 4))), F.array(*(100 + F.col("k") % 50 + i for i in range(3))))
    return _part(spark, sf).select("k", joined(palette).alias("palette"), joined(samples).alias("samples"))


# --- rows of samples and pictures ---


@query("""SELECT track_id, decode_index, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY decode_index ROWS UNBOUNDED PRECEDING),
    first_value(v IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY decode_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 128)::BIGINT AS value
    FROM (SELECT track_id, decode_index, CASE WHEN event_id % 5 = 0 THEN event_id % 256 END AS v FROM samples)""", views.SAMPLES)
def substituted_samples(spark, sf):
    s = views.samples(spark, sf).select("track_id", "decode_index", F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 256).alias("value"))
    return O.substituted(s, ("track_id",), "decode_index").select("track_id", "decode_index", F.col("value").cast("long").alias("value"))


@query("SELECT frame_id, i::INTEGER AS i, sum(v - 128) OVER (PARTITION BY frame_id, i // 8 ORDER BY i)::BIGINT AS across, sum(v - 128) OVER (PARTITION BY frame_id, i % 8 ORDER BY i)::BIGINT AS down FROM cells", views.IMAGES, _CELLS)
def accumulated_residuals(spark, sf):
    c = _cells(spark, sf).select("frame_id", "i", div(F.col("i"), F.lit(8)).alias("y"), (F.col("i") % 8).alias("x"), (F.col("v") - 128).cast("long").alias("value"))
    c = O.accumulated(c, ("frame_id",), "x", "y").withColumnRenamed("total", "across")
    return O.accumulated(c, ("frame_id",), "y", "x").select("frame_id", "i", "across", F.col("total").alias("down"))


@query("""SELECT track_id, decode_index, sum(event_id % 50) OVER w::BIGINT AS total, sum(event_id % 50) OVER w > 500 AS over_ FROM samples WINDOW w AS (PARTITION BY track_id ORDER BY decode_index)""", views.SAMPLES)
def decode_budget(spark, sf):
    s = views.samples(spark, sf).withColumn("blocks", F.col("event_id") % 50)
    return O.block_budget(s, ("track_id",), 500, "decode_index").select("track_id", "decode_index", "total", F.col("over").alias("over_"))


_HELD = """held AS (SELECT track_id, n AS poc, CASE WHEN event_id % 3 = 0 THEN 'long' ELSE 'short' END AS mark FROM pictures),
wanted AS (SELECT track_id, n, n - n % 4 - (n % 3) AS poc, n % 5 = 0 AS long_term, CASE WHEN n % 10 = 0 THEN 8 END AS max_lsb FROM pictures)"""


@query("""SELECT w.track_id, w.n AS ref_no, min(h.poc) AS found FROM wanted w LEFT JOIN held h ON w.track_id = h.track_id AND CASE WHEN max_lsb IS NULL THEN w.poc = h.poc AND (long_term OR mark = 'short')
    ELSE (w.poc % 8 + 8) % 8 = h.poc % 8 END GROUP BY ALL""", views.PICTURES, _HELD)
def buffer_references(spark, sf):
    n = F.col("n")
    p = views.pictures(spark, sf)
    held = p.select("track_id", n.alias("poc"), F.when(F.col("event_id") % 3 == 0, "long").otherwise("short").alias("mark"), F.lit(0).alias("layer"))
    wanted = p.select("track_id", n.alias("ref_no"), (n - n % 4 - n % 3).alias("poc"), (n % 5 == 0).alias("long_term"), F.when(n % 10 == 0, 8).cast("long").alias("max_lsb"), F.lit(0).alias("layer"))
    return O.found_references(wanted, held, ("track_id",)).select("track_id", "ref_no", "found")


_USES = """c AS (SELECT track_id, n, event_id, sum(CASE WHEN resets AND n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY n) AS cvs FROM pictures),
a AS (SELECT *, row_number() OVER (PARTITION BY track_id, cvs ORDER BY n) AS pos FROM c),
uses AS (SELECT track_id, cvs, n AS r_n, pos AS r_at, n - d AS poc FROM a, range(1, 4) t(d) WHERE (event_id + d) % 4 > 0)"""


@query("""SELECT a.track_id, a.n, coalesce(max(u.r_n) FILTER (u.r_at - a.pos = u.k), a.n) AS "last" FROM a LEFT JOIN (
    SELECT p.track_id, p.n, u.r_n, u.r_at, row_number() OVER (PARTITION BY p.track_id, p.n ORDER BY u.r_at) AS k FROM a p JOIN uses u ON u.track_id = p.track_id AND u.cvs = p.cvs AND u.poc = p.n AND u.r_at > p.pos) u
    ON u.track_id = a.track_id AND u.n = a.n GROUP BY a.track_id, a.n""", views.PICTURES, _USES)
def buffer_lifetimes(spark, sf):
    p = pictures.coded_sequences(views.pictures(spark, sf)).withColumn("poc", F.col("n"))
    kept = p.select("track_id", "n", "event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("d")).where((F.col("event_id") + F.col("d")) % 4 > 0)
    return O.kept_until(p.select("track_id", "n", "cvs", "poc"), kept.select("track_id", "n", (F.col("n") - F.col("d")).alias("poc")), ("track_id",)).select("track_id", "n", "last")


@query()
def reorder_buffer(spark, sf):
    """When pictures leave a buffer of two; held against a plain buffer in a test."""
    p = pictures.picture_order(pictures.coded_sequences(views.pictures(spark, sf)))
    return O.reordered(p.select("track_id", "n", "cvs", "poc"), 2)


@query("""SELECT p_partkey, slot::INTEGER AS slot, (p_partkey * (slot + 3)) % 16 AS order_hint FROM part, range(0, 8) t(slot) WHERE (p_partkey * (slot + 3)) % 16 = (p_partkey * 3) % 16 AND slot % 3 < 2""")
def slots_left(spark, sf):
    s = views.table(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot"))
    held = s.withColumn("order_hint", F.col("p_partkey") * (F.col("slot") + 3) % 16)
    return O.valid_slots(held, s.where(F.col("slot") % 3 < 2).withColumn("order_hint", F.col("p_partkey") * 3 % 16), ("p_partkey",))


@query(f"""WITH {_K} SELECT k, CASE WHEN k % 5 = 0 AND (k % 3 = 1 OR k % 2 = 1) THEN 'MalformedMedia' WHEN k % 7 = 0 AND (k % 3 = 0 OR k % 2 = 0) THEN 'Unsupported' END AS error FROM k""")
def reference_slots(spark, sf):
    slot = lambda w: F.struct(w.alias("width"), F.lit(16).cast("long").alias("height"))
    slots = F.array(slot(F.when(F.col("k") % 7 == 0, 8).otherwise(16).cast("long")), F.when(F.col("k") % 5 > 0, slot(F.lit(16).cast("long"))), slot(F.lit(16).cast("long")))
    indexes = F.array((F.col("k") % 3).cast("int"), (F.col("k") % 2).cast("int"))
    return O.referred_slots(_part(spark, sf), slots, indexes, F.lit(16), F.lit(16)).select("k", "error")


# --- residuals and prediction ---

_MATRIX = ", ".join(f"({k}, {n}, {v})" for k, row in enumerate(RS.transform_matrix(8).tolist()) for n, v in enumerate(row))
_RESIDUAL = f"""t(k, n, m) AS (VALUES {_MATRIX}),
c AS (SELECT frame_id, i // 8 AS y, i % 8 AS x, greatest(-32768, least(32767, floor(((v - 128) * 16 * [40, 45, 51, 57, 64, 72][(frame_id % 52 % 6 + 1)::INTEGER] * (1 << (frame_id % 52 // 6)::INTEGER) + 32) / 64.0)))::BIGINT AS v FROM cells),
h AS (SELECT frame_id, n AS y, x, greatest(-32768, least(32767, floor((sum(m * v) + 64) / 128.0)))::BIGINT AS v FROM c JOIN t ON t.k = c.y GROUP BY frame_id, n, x)"""


@query("""SELECT frame_id, (y * 8 + n)::INTEGER AS i, floor((sum(m * v) + 2048) / 4096.0)::BIGINT AS v FROM h JOIN t ON t.k = h.x GROUP BY frame_id, y, n""", views.IMAGES, _CELLS, _RESIDUAL)
def residuals_8x8(spark, sf):
    """Images as levels, scaled at a quantiser of their own and transformed back."""
    b = views.images(spark, sf).select("frame_id", F.transform("gray", lambda v: v - 128).alias("levels"), (F.col("frame_id") % 52).alias("qp"))
    return RS.residual_blocks(b, 8).select("frame_id", F.posexplode("residual").alias("i", "v"))


@query("""SELECT frame_id, i::INTEGER AS i, ((7 - i % 8) * l[i // 8 + 1] + (i % 8 + 1) * t[9] + (7 - i // 8) * t[i % 8 + 1] + (i // 8 + 1) * l[9] + 8) // 16 AS planar
    FROM (SELECT frame_id, gray[1:16] AS t, gray[17:32] AS l, unnest(range(0, 64)) AS i FROM images)""", views.IMAGES)
def planar_prediction(spark, sf):
    b = views.images(spark, sf).select("frame_id", F.lit(0).alias("mode"), F.slice("gray", 1, 16).alias("top"), F.slice("gray", 17, 16).alias("left"), F.get("gray", F.lit(40)).alias("corner"))
    return RS.predicted_blocks(b).select("frame_id", F.posexplode("block").alias("i", "planar"))


@query()
def directional_prediction(spark, sf):
    """A directional mode of each image; held against a plain walk in a test."""
    b = views.images(spark, sf).select("frame_id", (F.col("frame_id") % 34 + 1).cast("int").alias("mode"), F.slice("gray", 1, 16).alias("top"), F.slice("gray", 17, 16).alias("left"), F.get("gray", F.lit(40)).alias("corner"))
    return RS.predicted_blocks(b).select("frame_id", "mode", joined(F.col("block")).alias("samples"))


@query()
def quantiser_chains(spark, sf):
    """Quantisers of units of 8 samples in rows of a picture of 128; held against a plain walk in a test."""
    p = _part(spark, sf).select("k", div(F.col("k"), F.lit(256).cast("long")).alias("slice_id"), (F.col("k") % 256).alias("n"))
    u = p.withColumn("x", F.col("n") % 16 * 8).withColumn("y", div(F.col("n"), F.lit(16).cast("long")) * 8).withColumn("size", F.lit(8).cast("long")).withColumn("delta", F.col("k") % 11 - 5).withColumn("start_qp", F.lit(30).cast("long"))
    return RS.quantiser_chain(u).select("k", "qp")


@query(f"""WITH {_K} SELECT k, CASE WHEN k % 3 = 0 AND k % 5 > 0 AND k % 2 = 1 AND k % 7 > 0 AND k % 11 > 0 AND k % 13 > 0 THEN NULL ELSE 'Unsupported' END AS inter,
    CASE WHEN k % 3 = 0 AND k % 5 > 0 AND k % 2 = 0 AND k % 13 > 0 THEN NULL ELSE 'Unsupported' END AS still FROM k""")
def av1_sequences(spark, sf):
    no = F.lit(False)
    k = F.col("k")
    values = {"profile": k % 3, "bit_depth": F.when(k % 5 > 0, 8).otherwise(10), "monochrome": F.lit(True), "reduced": k % 2 == 0, "order_hints": k % 7 > 0, "warped_motion": k % 11 == 0, "cdef": k % 13 == 0}
    others = ("frame_ids", "decoder_model", "ref_frame_mvs", "interintra", "masked_compound", "dual_filter", "jnt_comp", "superres", "restoration", "film_grain")
    s = F.struct(*(v.alias(n) for n, v in values.items()), *(no.alias(n) for n in others))
    return _part(spark, sf).select("k", RS.av1_support(s, inter=True).alias("inter"), RS.av1_support(s, inter=False).alias("still"))


@query("""SELECT event_id, event_id % 9 AS short, event_id AS long_, event_id % 300 AS level, CASE WHEN event_id % 9 < 8 THEN event_id % 9 + 1 ELSE 8 END
    + 2 * floor(log2(event_id / 4.0 + 1) + 0.0000001)::BIGINT + 3 AS bits FROM events""")
def binarisations(spark, sf):
    """Truncated unary, Exp-Golomb of order 2 and Rice codes of order 1, read back; and the bits of the first two."""
    from framelake.catalogue_bytes import _map
    from framelake.functions.bits import Bits, BitWriter

    def row(i):
        first = BitWriter().unary(i % 9, 8).egk(i, 2)
        n = first.n
        b = Bits(first.rice(i % 300, 1).trailing().bytes())
        return [(i, b.unary(8), b.egk(2), b.rice(1), n)]

    return _map(views.table(spark, sf, "events").select("event_id"), "event_id long, short long, long_ long, level long, bits long", row)


@query(f"""WITH {_K}, c AS (SELECT k, CASE WHEN k % 3 > 0 THEN k % 5 END AS a, CASE WHEN k % 4 > 0 THEN k % 7 END AS b, CASE WHEN k % 2 > 0 THEN k % 11 END AS t FROM k),
s AS (SELECT k, t, CASE WHEN a IS NULL AND b IS NULL THEN [] WHEN a IS NULL THEN [b] WHEN b IS NULL OR a = b THEN [a] ELSE [a, b] END AS s FROM c)
SELECT k, array_to_string((s || CASE WHEN len(s) < 2 AND t IS NOT NULL THEN [t] ELSE [] END || [0, 0])[1:2], ',') AS predictors FROM s""")
def motion_predictors(spark, sf):
    k = F.col("k")
    found = R.predictor_candidates(F.when(k % 3 > 0, k % 5), F.when(k % 4 > 0, k % 7), F.when(k % 2 > 0, k % 11), F.lit(0).cast("long"))
    return _part(spark, sf).select("k", joined(found).alias("predictors"))
