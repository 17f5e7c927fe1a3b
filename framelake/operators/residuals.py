"""Dequantised residuals, inverse transforms and intra prediction of blocks, as batches of arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first column of the 32-point transform from its second row on, the 4-point sine transform, the
#: steps of the quantiser, and the angles of the directional modes from straight down-left to straight up-right.
COSINES = [90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4]
SINES = [[29, 55, 74, 84], [74, 74, 0, -74], [84, -29, -74, 55], [55, -84, 74, -29]]
STEPS = [40, 45, 51, 57, 64, 72]
ANGLES = [32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32]


@lru_cache(maxsize=8)
def transform_matrix(size: int, sine: bool = False) -> np.ndarray:
    """Basis functions in rows: of 4, 8, 16 or 32 points, every other one of twice as many, by the symmetry of the cosine."""
    if sine:
        return np.array(SINES, dtype=np.int64)
    wave = [64, *COSINES, 0]
    at = lambda m: wave[m] if m <= 32 else -wave[64 - m] if m <= 64 else at(128 - m)
    step = 32 // size
    return np.array([[64 if not k else at((2 * n + 1) * k * step % 128) for n in range(size)] for k in range(size)], dtype=np.int64)


def scaled(levels: np.ndarray, factors: np.ndarray | int, qp: np.ndarray, depth: int = 8) -> np.ndarray:
    """Coefficients of levels (blocks, side, side) at quantisers, one for each block."""
    side = levels.shape[-1]
    shift = depth + side.bit_length() - 1 - 5
    step = np.array(STEPS, dtype=np.int64)[qp % 6][:, None, None] << (qp // 6)[:, None, None]
    return np.clip((levels.astype(np.int64) * factors * step + (1 << (shift - 1))) >> shift, -32768, 32767)


def inverse_transform(coefficients: np.ndarray, depth: int = 8, sine: bool = False) -> np.ndarray:
    """Residuals of blocks (blocks, side, side): columns, then rows, each stage rounded, the first kept to 16 bits."""
    m = transform_matrix(coefficients.shape[-1], sine)
    half = np.clip((np.einsum("ky,bkx->byx", m, coefficients.astype(np.int64)) + 64) >> 7, -32768, 32767)
    last = 20 - depth
    return (np.einsum("kx,byk->byx", m, half) + (1 << (last - 1))) >> last


def skipped_transform(coefficients: np.ndarray, depth: int = 8) -> np.ndarray:
    """Residuals where the transform is passed over: the coefficients at its scale."""
    last = 20 - depth
    return ((coefficients.astype(np.int64) << 7) + (1 << (last - 1))) >> last


def predicted_block(mode: int, top: np.ndarray, left: np.ndarray, corner: int, *, luma: bool = True) -> np.ndarray:
    """A square block from its neighbours (twice its side above and beside it): 0 planar, 1 mean, 2 to 34 directional.

    Mean, straight down and straight across smooth the border of small luma blocks.
    """
    n = len(top) // 2
    x, y = np.arange(n), np.arange(n)[:, None]
    top, left = top.astype(np.int64), left.astype(np.int64)
    if mode == 0:
        shift = n.bit_length()
        return ((n - 1 - x) * left[:n, None] + (x + 1) * top[n] + (n - 1 - y) * top[None, :n] + (y + 1) * left[n] + n) >> shift
    smooth = luma and n < 32
    if mode == 1:
        mean = (top[:n].sum() + left[:n].sum() + n) >> n.bit_length()
        out = np.full((n, n), mean)
        if smooth:
            out[0], out[:, 0] = (top[:n] + 3 * mean + 2) >> 2, (left[:n] + 3 * mean + 2) >> 2
            out[0, 0] = (left[0] + 2 * mean + top[0] + 2) >> 2
        return out
    angle, upright = ANGLES[mode - 2], mode >= 18
    main, side = (top, left) if upright else (left, top)
    # The main side goes on below 0 with the other side, projected along the angle.
    ref = {0: corner, **{i + 1: int(v) for i, v in enumerate(main)}}
    if angle < 0 and n * angle >> 5 < -1:
        inverse = round(8192 / -angle)
        for i in range(n * angle >> 5, 0):
            ref[i] = int(side[((-i * inverse + 128) >> 8) - 1])
    out = np.empty((n, n), dtype=np.int64)
    for j in range(n):
        whole, part = (j + 1) * angle >> 5, (j + 1) * angle & 31
        for i in range(n):
            a = ref[i + whole + 1]
            out[j, i] = ((32 - part) * a + part * ref[i + whole + 2] + 16) >> 5 if part else a
    if angle == 0 and smooth:
        out[:, 0] = np.clip(main[0] + ((side[:n] - corner) >> 1), 0, 255)
    return out if upright else out.T


def _batches(df: DataFrame, out: str, one: Callable[[pd.DataFrame], list]) -> DataFrame:
    """``df`` with a column more, of what ``one`` gives for a batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{out.split()[0]: pd.Series(one(p), index=p.index, dtype=object)})

    return df.mapInPandas(run, ", ".join([*(f"{n} {t}" for n, t in df.dtypes), out]))


def residual_blocks(blocks: DataFrame, side: int, *, levels: str = "levels", qp: str = "qp", factor: int = 16, sine: bool = False) -> DataFrame:
    """Adds ``residual``: of arrays of side x side levels and a quantiser, scaled and transformed back."""

    def one(p: pd.DataFrame) -> list:
        x = np.array(p[levels].tolist(), dtype=np.int64).reshape(-1, side, side)
        return [r.ravel().tolist() for r in inverse_transform(scaled(x, factor, p[qp].to_numpy(np.int64)), sine=sine)]

    return _batches(blocks, "residual array<bigint>", one)


def predicted_blocks(blocks: DataFrame, *, luma: bool = True) -> DataFrame:
    """Adds ``block``: predicted from (mode, top, left, corner), row by row."""

    def one(p: pd.DataFrame) -> list:
        return [predicted_block(int(m), np.array(t), np.array(l), int(c), luma=luma).ravel().tolist() for m, t, l, c in zip(p["mode"], p["top"], p["left"], p["corner"], strict=True)]

    return _batches(blocks, "block array<bigint>", one)


def quantiser_chain(units: DataFrame, offset: int = 0) -> DataFrame:
    """Adds ``qp`` to the coding units of slices (slice_id, n, x, y, size, delta, start_qp), in a grid of quantisation groups.

    A group's prediction is the rounded mean of the group to its left and above in the same tree block of 64, where one that
    is not there counts as the unit before it in coding order. A fold over numbers in order, slices in parallel.
    """

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("n")
        at: dict[tuple, int] = {}
        before, out = int(own["start_qp"].iloc[0]) if len(own) else 0, []
        for x, y, size, delta in own[["x", "y", "size", "delta"]].itertuples(index=False, name=None):
            left = at.get((x - 1, y)) if x % 64 else None
            above = at.get((x, y - 1)) if y % 64 else None
            predicted = (before if left is None else left) + (before if above is None else above) + 1 >> 1
            before = (predicted + delta + 52 + 2 * offset) % (52 + offset) - offset
            out.append(before)
            # What later units look at: the last column and row of this one.
            for i in range(size):
                at[x + size - 1, y + i] = at[x + i, y + size - 1] = before
        return own.assign(qp=out)

    return units.groupBy("slice_id").applyInPandas(run, ", ".join([*(f"{n} {t}" for n, t in units.dtypes), "qp long"]))


def av1_support(sequence: Column, *, inter: bool) -> Column:
    """``Unsupported`` for a sequence header (a struct) that the lossless decoders can't take, else null; inter or still pictures."""
    s = lambda name: F.coalesce(sequence[name], F.lit(False))
    plain = (sequence["profile"] == 0) & (sequence["bit_depth"] == 8) & s("monochrome")
    kind = ~s("reduced") & s("order_hints") if inter else s("reduced")
    tools = ("frame_ids", "decoder_model", "warped_motion", "ref_frame_mvs", "interintra", "masked_compound", "dual_filter", "jnt_comp") if inter else ()
    none = F.lit(True)
    for name in (*tools, "superres", "cdef", "restoration", "film_grain"):
        none = none & ~s(name)
    return F.when(~F.coalesce(plain & kind & none, F.lit(False)), "Unsupported")

