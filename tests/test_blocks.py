"""Reconstruction arithmetic and block relations against plain Python."""

import numpy as np

import __spark_entry__ as entry
from framelake import views
from framelake.functions import rebuild
from framelake.operators import residuals

SF = "/root/testdata/sf0.001"


def clip(x, low, high):
    return max(low, min(high, x))


def plain_edge(rows, beta, tc):
    """The luma filter over four rows, line by line."""
    bend = lambda r, a, b, c: abs(r[a] - 2 * r[b] + r[c])
    dp = [bend(r, 1, 2, 3) for r in rows]
    dq = [bend(r, 6, 5, 4) for r in rows]
    if dp[0] + dq[0] + dp[3] + dq[3] >= beta:
        return rows
    strong = all(2 * (dp[i] + dq[i]) < beta >> 2 and abs(rows[i][0] - rows[i][3]) + abs(rows[i][4] - rows[i][7]) < beta >> 3 and abs(rows[i][3] - rows[i][4]) < (5 * tc + 1) >> 1 for i in (0, 3))
    out = []
    for p3, p2, p1, p0, q0, q1, q2, q3 in rows:
        if strong:
            a = clip((p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3, p0 - 2 * tc, p0 + 2 * tc)
            b = clip((p2 + p1 + p0 + q0 + 2) >> 2, p1 - 2 * tc, p1 + 2 * tc)
            c = clip((2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3, p2 - 2 * tc, p2 + 2 * tc)
            d = clip((p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) >> 3, q0 - 2 * tc, q0 + 2 * tc)
            e = clip((p0 + q0 + q1 + q2 + 2) >> 2, q1 - 2 * tc, q1 + 2 * tc)
            f = clip((p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4) >> 3, q2 - 2 * tc, q2 + 2 * tc)
            out.append([p3, c, b, a, d, e, f, q3])
            continue
        delta = (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4
        if abs(delta) >= 10 * tc:
            out.append([p3, p2, p1, p0, q0, q1, q2, q3])
            continue
        delta = clip(delta, -tc, tc)
        side = (beta + (beta >> 1)) >> 3
        np1, nq1 = p1, q1
        if dp[0] + dp[3] < side:
            np1 = clip(p1 + clip((((p2 + p0 + 1) >> 1) - p1 + delta) >> 1, -(tc >> 1), tc >> 1), 0, 255)
        if dq[0] + dq[3] < side:
            nq1 = clip(q1 + clip((((q2 + q0 + 1) >> 1) - q1 - delta) >> 1, -(tc >> 1), tc >> 1), 0, 255)
        out.append([p3, p2, np1, clip(p0 + delta, 0, 255), clip(q0 - delta, 0, 255), nq1, q2, q3])
    return out


def test_luma_edges(spark):
    beta = lambda q: 0 if q < 16 else q - 10 if q < 29 else 2 * q - 38
    images = {r["frame_id"]: r["gray"] for r in views.images(spark, SF).collect()}
    got = {r["frame_id"]: [int(x) for x in r["samples"].split(",")] for r in entry.queries()["luma_edges"](spark, SF).collect()}
    assert got
    for i, g in images.items():
        want = plain_edge([g[8 * r : 8 * r + 8] for r in range(4)], beta(i % 52), rebuild.LIMITS[i % 52])
        assert got[i] == [x for r in want for x in r]
    smooth = [[100 + c // 4 * 6 for c in range(8)] for _ in range(4)], [[100, 101, 103, 104, 107, 108, 108, 109]] * 4, [[100] * 4 + [140] * 4] * 4
    from pyspark.sql import functions as F

    for rows in smooth:
        for q in (30, 40, 51):
            out = spark.range(1).select(rebuild.luma_edge(F.lit([list(r) for r in rows]), F.lit(beta(q)), F.lit(rebuild.LIMITS[q])).alias("o")).first()["o"]
            assert [list(r) for r in out] == plain_edge([list(r) for r in rows], beta(q), rebuild.LIMITS[q])


def test_merged_offsets(spark):
    got = {r["k"]: (r["from_x"], r["from_y"]) for r in entry.queries()["merged_offsets"](spark, SF).collect()}
    parts = {r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert set(got) == parts
    found = {}
    for k in sorted(parts):
        at = lambda j: (j // 64, j % 64 // 27) if j in parts else None
        x, y = k % 8, k % 64 // 8
        if k % 3 == 0 and x and at(k - 1) == at(k):
            found[k] = found[k - 1]
        elif k % 2 == 0 and y and at(k - 8) == at(k):
            found[k] = found[k - 8]
        else:
            found[k] = (x, y)
    assert got == found


def test_reorder_buffer(spark):
    from framelake.operators import pictures

    rows = pictures.picture_order(pictures.coded_sequences(views.pictures(spark, SF))).select("track_id", "n", "cvs", "poc").collect()
    got = {(r["track_id"], r["n"]): (r["left_at"], r["turn"]) for r in entry.queries()["reorder_buffer"](spark, SF).collect()}
    for track in {r["track_id"] for r in rows}:
        held, turn = [], 0
        own = sorted((r["n"], r["cvs"], r["poc"]) for r in rows if r["track_id"] == track)
        for n, cvs, poc in [*own, (None, None, None)]:
            if n is not None:
                held.append((cvs, poc, n))
            while held and (n is None or len(held) > 2):
                least = min(held)
                held.remove(least)
                assert got[track, least[2]] == (n, turn)
                turn += 1
        assert turn == len(own)


def test_taps_sum_to_one():
    assert all(sum(rebuild.taps("luma", p)) == 64 for p in range(4)) and all(sum(rebuild.taps("chroma", p)) == 64 for p in range(8))
    assert rebuild.taps("luma", 3) == rebuild.taps("luma", 1)[::-1] and len(rebuild.LIMITS) == 54


def plain_direction(mode, top, left, corner):
    """A directional block sample by sample, from the position on the projected line."""
    n = len(top) // 2
    angle = residuals.ANGLES[mode - 2]
    main, side = (top, left) if mode >= 18 else (left, top)

    def line(i):
        if i == 0:
            return corner
        return main[i - 1] if i > 0 else side[((-i * round(8192 / -angle) + 128) >> 8) - 1]

    out = [[0] * n for _ in range(n)]
    for j in range(n):
        for i in range(n):
            at = (i + 1) * 32 + (j + 1) * angle
            whole, part = at >> 5, at & 31
            v = ((32 - part) * line(whole) + (part * line(whole + 1) if part else 0) + 16) >> 5
            if angle == 0 and i == 0:
                v = clip(main[0] + ((side[j] - corner) >> 1), 0, 255)
            if mode >= 18:
                out[j][i] = v
            else:
                out[i][j] = v
    return [x for r in out for x in r]


def test_directional_prediction(spark):
    images = {r["frame_id"]: r["gray"] for r in views.images(spark, SF).collect()}
    rows = entry.queries()["directional_prediction"](spark, SF).collect()
    assert len({r["mode"] for r in rows}) > 20
    for r in rows:
        g, got = images[r["frame_id"]], [int(x) for x in r["samples"].split(",")]
        top, left, corner = g[:16], g[16:32], g[40]
        if r["mode"] > 1:
            assert got == plain_direction(r["mode"], top, left, corner), r["mode"]
        else:
            mean = (sum(top[:8]) + sum(left[:8]) + 8) >> 4
            assert got[9] == mean and got[1] == (top[1] + 3 * mean + 2) >> 2 and got[0] == (left[0] + 2 * mean + top[0] + 2) >> 2


def test_quantiser_chains(spark):
    got = {r["k"]: r["qp"] for r in entry.queries()["quantiser_chains"](spark, SF).collect()}
    before, at = {}, {}
    for k in sorted(got):
        s, n = k // 256, k % 256
        x, y = n % 16, n // 16
        last = before.get(s, 30)
        left = at.get((s, x - 1, y), last) if x % 8 else last
        above = at.get((s, x, y - 1), last) if y % 8 else last
        qp = ((left + above + 1 >> 1) + k % 11 - 5) % 52
        before[s] = at[s, x, y] = qp
        assert got[k] == qp


def test_transforms():
    for n in (4, 8, 16, 32):
        m = residuals.transform_matrix(n)
        assert (abs(m @ m.T - np.eye(n) * 64 * 64 * n) < 0.012 * 64 * 64 * n).all() and (m[0] == 64).all()
    assert residuals.transform_matrix(4).tolist() == [[64, 64, 64, 64], [83, 36, -36, -83], [64, -64, -64, 64], [36, -83, 83, -36]]
    sine = residuals.transform_matrix(4, sine=True)
    assert (abs(sine @ sine.T - np.eye(4) * 16384) < 200).all()
    flat = np.zeros((1, 8, 8), dtype=int)
    flat[0, 0, 0] = 512
    assert (residuals.inverse_transform(flat) == (((512 * 64 + 64) >> 7) * 64 + 2048) >> 12).all()
    assert (residuals.skipped_transform(flat)[0, 0, :2] == [(512 * 128 + 2048) >> 12, 0]).all()
