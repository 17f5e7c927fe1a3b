"""Frames: layouts, validation, digests, PSNR, and transfer plans and execution."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.errors import first_error
from framelake.limits import DEFAULT, Limits

#: Tags of the pixel formats in a digest, and bytes of a packed pixel.
FORMATS = {"Rgba8": 0, "Bgra8": 1, "Rgb8": 2, "Gray8": 3, "Yuv420p8": 4}
PACKED = {"Rgba8": 4, "Bgra8": 4, "Rgb8": 3, "Gray8": 1}
RANGES = {"Full": 0, "Limited": 1}


def plane_layouts(width: Column, height: Column, pixel_format: Column) -> Column:
    """Array of struct(row_bytes, rows), one per plane; null for an unknown format."""
    one = lambda w, h: F.struct(w.cast("long").alias("row_bytes"), h.cast("long").alias("rows"))
    half = lambda x: F.call_function("div", x + 1, F.lit(2))
    out = F.when(pixel_format == "Yuv420p8", F.array(one(width, height), one(half(width), half(height)), one(half(width), half(height))))
    for name, n in PACKED.items():
        out = out.when(pixel_format == name, F.array(one(width * n, height)))
    return out


def frame_error(limits: Limits = DEFAULT) -> Column:
    """The first fault of a frame row (width, height, pixel_format, planes), as struct(kind, message), or null."""
    w, h = F.col("width"), F.col("height")
    layouts = plane_layouts(w, h, F.col("pixel_format"))
    pairs = F.zip_with("planes", layouts, lambda p, x: F.struct(p.alias("p"), x.alias("x")))
    total = F.aggregate("planes", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["data"]))
    return first_error(
        ((w <= 0) | (h <= 0), "InvalidInput", "width or height of zero"),
        ((w > limits.max_width) | (h > limits.max_height), "ResourceLimit", "width or height above the limit"),
        (layouts.isNull(), "InvalidInput", "unknown pixel format"),
        (F.size("planes") != F.size(layouts), "InvalidInput", "the pixel format has another number of planes"),
        (F.exists(pairs, lambda z: z["p"]["stride"] < z["x"]["row_bytes"]), "InvalidInput", "stride less than a row's bytes"),
        (F.exists(pairs, lambda z: F.octet_length(z["p"]["data"]) < z["p"]["stride"] * z["x"]["rows"]), "InvalidInput", "plane ends before its last row"),
        (total > limits.max_allocation, "ResourceLimit", "frame larger than the allocation limit"),
    )


def active_bytes() -> Column:
    """The rows of all planes without the padding behind them."""
    layouts = plane_layouts(F.col("width"), F.col("height"), F.col("pixel_format"))

    def rows(p: Column, x: Column) -> Column:
        at = F.sequence(F.lit(0).cast("long"), x["rows"] - 1)
        return F.array_join(F.transform(at, lambda r: F.hex(p["data"].substr((r * p["stride"] + 1).cast("int"), x["row_bytes"].cast("int")))), "")

    return F.unhex(F.array_join(F.zip_with("planes", layouts, rows), ""))


def _big_endian(x: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(x), 2 * n, "0"))


def _tag(table: dict[str, int], name: str) -> Column:
    out = F.lit(None).cast("int")
    for k, v in table.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out


def frame_digest() -> Column:
    """SHA-256 over the dimensions, the tags, the number of planes and the active rows, as hex."""
    head = [_big_endian(F.col("width"), 4), _big_endian(F.col("height"), 4), _big_endian(_tag(FORMATS, "pixel_format"), 1), _big_endian(_tag(RANGES, "color_range"), 1), _big_endian(F.size("planes"), 1)]
    return F.sha2(F.concat(*head, active_bytes()), 256)


def psnr(left: Column, right: Column) -> Column:
    """PSNR of two equally long arrays of 8-bit samples; infinite where they are equal, null where lengths differ."""
    error = F.aggregate(F.zip_with(left, right, lambda a, b: ((a - b) * (a - b)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    value = F.when(error == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(255.0 * 255.0) * F.size(left) / error))
    return F.when(F.size(left) == F.size(right), value)


def transfer_plan(source: str = "source", target: str = "target") -> Column:
    """Names of the stages between two frame descriptions (width, height, pixel_format, color_range, orientation, stride), in fixed order."""
    a, b = F.col(source), F.col(target)
    stages = [
        F.when(a["stride"] != b["stride"], "RepackStride"),
        F.when((a["width"] != b["width"]) | (a["height"] != b["height"]), "Scale"),
        F.when(a["orientation"] != b["orientation"], "FlipVertical"),
        F.when(a["pixel_format"] != b["pixel_format"], "ConvertPixelFormat"),
        F.when(a["color_range"] != b["color_range"], "ConvertColor"),
    ]
    return F.filter(F.array(*stages), lambda s: s.isNotNull())


def transfer_capability(mode: Column, required: Column, stages: Column) -> Column:
    """struct(mode, stages, reason) of a planned transfer: a strict policy must equal the mode, and sharing admits no stage."""
    reason = (
        F.when(mode == "Unsupported", "no way to transfer between these frames")
        .when(required.isNotNull() & ((required == "Unsupported") | (required != mode)), F.concat(F.lit("policy admits only "), required, F.lit(", but the backend reports "), mode))
        .when((mode == "Shared") & (F.size(stages) > 0), "sharing was planned although frames have to be converted")
    )
    return F.struct(F.when(reason.isNull(), mode).otherwise("Unsupported").alias("mode"), F.when(reason.isNull(), stages).otherwise(F.array().cast("array<string>")).alias("stages"), reason.alias("reason"))


def _channels(pixel_format: str) -> list[int]:
    """Places of red, green, blue and alpha in a packed pixel."""
    return {"Rgba8": [0, 1, 2, 3], "Bgra8": [2, 1, 0, 3], "Rgb8": [0, 1, 2], "Gray8": [0]}[pixel_format]


def convert_pixels(image: np.ndarray, source: str, target: str) -> np.ndarray:
    """Between packed formats, the bytes of a pixel last. Gray spreads over the colours; alpha is opaque where there is none."""
    if source == "Gray8":
        rgb = np.repeat(image[..., :1], 3, axis=-1)
        alpha = np.full(image.shape[:-1], 255, dtype=np.uint8)
    else:
        place = _channels(source)
        rgb = image[..., place[:3]]
        alpha = image[..., place[3]] if len(place) == 4 else np.full(image.shape[:-1], 255, dtype=np.uint8)
    if target == "Gray8":
        c = rgb.astype(np.int32)
        return ((77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2] + 128) >> 8).astype(np.uint8)[..., None]
    out = np.empty((*image.shape[:-1], PACKED[target]), dtype=np.uint8)
    place = _channels(target)
    out[..., place[:3]] = rgb
    if len(place) == 4:
        out[..., place[3]] = alpha
    return out


def convert_range(image: np.ndarray, pixel_format: str, source: str, target: str) -> np.ndarray:
    """Colours between full and limited range; alpha stays."""
    if source == target:
        return image
    v = image.astype(np.int32)
    new = 16 + (v * 219 + 127) // 255 if source == "Full" else np.minimum(255, (np.maximum(v - 16, 0) * 255 + 109) // 219)
    new = new.astype(np.uint8)
    if len(_channels(pixel_format)) == 4:
        new[..., 3] = image[..., 3]
    return new


def transfer_alike(data: list[bytes], a: dict, b: dict, smooth: bool = False) -> list[bytes]:
    """Copy packed frames of one description into another, together: rows, nearest scaling, orientation, format, range, stride."""
    if a["pixel_format"] not in PACKED or b["pixel_format"] not in PACKED:
        raise ValueError("only packed pixel formats can be transferred")
    if smooth and (a["width"], a["height"]) != (b["width"], b["height"]):
        raise ValueError("linear scaling is not supported")
    n, size = PACKED[a["pixel_format"]], a["stride"] * a["height"]
    raw = np.frombuffer(b"".join(d[:size] for d in data), dtype=np.uint8).reshape(len(data), a["height"], a["stride"])
    images = raw[:, :, : a["width"] * n].reshape(len(data), a["height"], a["width"], n)
    rows = np.arange(b["height"]) * a["height"] // b["height"]
    columns = np.arange(b["width"]) * a["width"] // b["width"]
    if a["orientation"] == "BottomLeft":
        rows = a["height"] - 1 - rows
    images = images[:, rows][:, :, columns]
    images = convert_range(convert_pixels(images, a["pixel_format"], b["pixel_format"]), b["pixel_format"], a["color_range"], b["color_range"])
    if b["orientation"] == "BottomLeft":
        images = images[:, ::-1]
    out = np.zeros((len(data), b["height"], b["stride"]), dtype=np.uint8)
    out[:, :, : b["width"] * PACKED[b["pixel_format"]]] = images.reshape(len(data), b["height"], -1)
    return [x.tobytes() for x in out]


def transfer(data: bytes, a: dict, b: dict, smooth: bool = False) -> bytes:
    """One frame."""
    return transfer_alike([data], a, b, smooth)[0]


def execute_transfers(frames: DataFrame) -> DataFrame:
    """Adds ``result`` (bytes) to rows with ``data``, ``source`` and ``target``; frames of one geometry go together."""
    side = "struct<width:int,height:int,pixel_format:string,color_range:string,orientation:string,stride:int>"
    kept = frames.withColumn("source", F.col("source").cast(side)).withColumn("target", F.col("target").cast(side))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            kinds: dict[tuple, list[int]] = defaultdict(list)
            for i, (a, b) in enumerate(zip(p["source"], p["target"], strict=True)):
                kinds[tuple(a.items()), tuple(b.items())].append(i)
            data, out = p["data"].to_list(), [b""] * len(p)
            for (a, b), rows in kinds.items():
                for i, x in zip(rows, transfer_alike([bytes(data[i]) for i in rows], dict(a), dict(b)), strict=True):
                    out[i] = x
            yield p.assign(result=pd.Series(out, index=p.index, dtype=object))

    return kept.mapInPandas(run, T.StructType([*kept.schema.fields, T.StructField("result", T.BinaryType())]))
