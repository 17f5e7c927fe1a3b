"""AV1 byte streams: open bitstream units, sequence headers, configuration records, tile groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from framelake.errors import MediaError, limit, malformed
from framelake.functions.bits import Bits, leb128, put_leb128
from framelake.limits import DEFAULT, Limits

#: Unit types.
TYPES = {1: "SequenceHeader", 2: "TemporalDelimiter", 3: "FrameHeader", 4: "TileGroup", 5: "Metadata", 6: "Frame", 7: "RedundantFrameHeader", 8: "TileList", 15: "Padding"}


def units(data: bytes, limits: Limits = DEFAULT) -> Iterator[dict]:
    """The units of a low-overhead stream: every one carries its size."""
    at = n = 0
    while at < len(data):
        n += 1
        if n > limits.max_obus:
            raise limit("too many units")
        head = data[at]
        if head & 0x80:
            raise malformed("a unit has its forbidden bit set")
        if head & 1:
            raise malformed("a unit has its reserved bit set")
        extended, sized = head >> 2 & 1, head >> 1 & 1
        if not sized:
            raise malformed("a unit lacks its size")
        width, temporal, spatial = 1, 0, 0
        if extended:
            if at + 1 >= len(data):
                raise malformed("a unit header ends early")
            if data[at + 1] & 7:
                raise malformed("a unit has its reserved bits set")
            width, temporal, spatial = 2, data[at + 1] >> 5, data[at + 1] >> 3 & 3
        size, used = leb128(data, at + width)
        start = at + width + used
        if start + size > len(data):
            raise malformed("a unit ends early")
        kind = TYPES.get(head >> 3 & 15, "Reserved")
        if kind == "TemporalDelimiter" and size:
            raise malformed("a temporal delimiter must be empty")
        yield {"obu_type": kind, "temporal_id": temporal, "spatial_id": spatial, "header_len": width, "size_field_len": used, "payload": data[start : start + size]}
        at = start + size


def unit(kind: int, payload: bytes) -> bytes:
    """A unit with its size."""
    return bytes([kind << 3 | 2]) + put_leb128(len(payload)) + payload


def temporal_units(data: bytes) -> list[bytes]:
    """A stream cut before each temporal delimiter."""
    out: list[bytearray] = []
    at = 0
    for u in units(data):
        n = u["header_len"] + u["size_field_len"] + len(u["payload"])
        if u["obu_type"] == "TemporalDelimiter" or not out:
            out.append(bytearray())
        out[-1] += data[at : at + n]
        at += n
    return [bytes(x) for x in out]


def color_config(b: Bits, profile: int) -> dict:
    high = b.u(1)
    depth = (12 if b.u(1) else 10) if profile == 2 and high else 10 if high else 8
    mono = b.u(1) if profile != 1 else 0
    primaries, transfer, matrix = (b.u(8), b.u(8), b.u(8)) if b.u(1) else (2, 2, 2)
    out = {"bit_depth": depth, "monochrome": bool(mono), "subsampling_x": 1, "subsampling_y": 1, "chroma_sample_position": 0, "separate_uv_delta_q": False}
    if mono:
        out["full_range"] = b.flag()
        return out
    if (primaries, transfer, matrix) == (1, 13, 0):
        return out | {"full_range": True, "subsampling_x": 0, "subsampling_y": 0, "separate_uv_delta_q": b.flag()}
    out["full_range"] = b.flag()
    if profile == 1:
        x = y = 0
    elif profile == 0:
        x = y = 1
    elif depth == 12:
        x = b.u(1)
        y = b.u(1) if x else 0
    else:
        x, y = 1, 0
    position = b.u(2) if x and y else 0
    return out | {"subsampling_x": x, "subsampling_y": y, "chroma_sample_position": position, "separate_uv_delta_q": b.flag()}


def sequence_header(payload: bytes, limits: Limits = DEFAULT) -> dict:
    """The fields of a sequence header that decoding and inspection need."""
    b = Bits(payload)
    profile = b.u(3)
    if profile > 2:
        raise malformed("the sequence profile is reserved")
    still, reduced = b.flag(), b.flag()
    if reduced and not still:
        raise malformed("a reduced header needs a still picture")
    out: dict = {"profile": profile, "still_picture": still, "reduced": reduced, "operating_points": []}
    if reduced:
        out["operating_points"].append({"idc": 0, "level": b.u(5), "tier": 0})
    else:
        timing, decoder, delay_bits = b.flag(), False, 0
        if timing:
            b.u(32)
            b.u(32)
            if b.flag():
                b.uvlc()
            decoder = b.flag()
            if decoder:
                delay_bits = b.u(5) + 1
                b.u(32)
                b.u(10)
        delayed = b.flag()
        count = b.u(5) + 1
        if count > limits.max_operating_points:
            raise limit("too many operating points")
        for _ in range(count):
            point = {"idc": b.u(12), "level": b.u(5), "tier": 0}
            point["tier"] = b.u(1) if point["level"] > 7 else 0
            if decoder and b.flag():
                b.u(delay_bits)
                b.u(delay_bits)
                b.u(1)
            if delayed and b.flag():
                b.u(4)
            out["operating_points"].append(point)
    wide, high = b.u(4) + 1, b.u(4) + 1
    out["max_width"], out["max_height"] = b.u(wide) + 1, b.u(high) + 1
    if out["max_width"] > limits.max_width or out["max_height"] > limits.max_height:
        raise limit("width or height above the limit")
    out["frame_ids"] = False if reduced else b.flag()
    if out["frame_ids"]:
        out["delta_frame_id_bits"] = b.u(4) + 2
        out["frame_id_bits"] = b.u(3) + out["delta_frame_id_bits"] + 1
    out["superblock_128"], out["filter_intra"], out["intra_edge_filter"] = b.flag(), b.flag(), b.flag()
    out["order_hint_bits"] = 0
    names = ("interintra", "masked_compound", "warped_motion", "dual_filter")
    out |= dict.fromkeys(names, False)
    out |= {"jnt_comp": False, "ref_frame_mvs": False, "screen_content_tools": 2, "integer_mv": 2}
    if not reduced:
        out |= {n: b.flag() for n in names}
        hints = b.flag()
        if hints:
            out["jnt_comp"], out["ref_frame_mvs"] = b.flag(), b.flag()
        out["screen_content_tools"] = 2 if b.flag() else b.u(1)
        if out["screen_content_tools"]:
            out["integer_mv"] = 2 if b.flag() else b.u(1)
        if hints:
            out["order_hint_bits"] = b.u(3) + 1
    out["superres"], out["cdef"], out["restoration"] = b.flag(), b.flag(), b.flag()
    out["color"] = color_config(b, profile)
    out["film_grain"] = b.flag()
    return out


def parse_av1c(data: bytes, limits: Limits = DEFAULT) -> dict:
    """A configuration record with its box header; its sequence header, if any, must agree with it."""
    if len(data) < 12:
        raise malformed("configuration box shorter than its header")
    head = 16 if data[:4] == b"\0\0\0\1" else 8
    size = int.from_bytes(data[8:16] if head == 16 else data[:4], "big")
    if size != len(data) or data[4:8] != b"av1C":
        raise malformed("not a configuration box of this size and type")
    p = data[head:]
    if len(p) < 4:
        raise malformed("configuration record shorter than its fixed part")
    if p[0] != 0x81:
        raise malformed("configuration record of an unknown version")
    if p[2] & 3 or p[3] & 0xE0:
        raise malformed("reserved bits set in a configuration record")
    if p[1] >> 5 > 2:
        raise malformed("reserved profile in a configuration record")
    out = {
        "profile": p[1] >> 5, "level": p[1] & 31, "tier": p[2] >> 7, "high_bitdepth": p[2] >> 6 & 1, "twelve_bit": p[2] >> 5 & 1, "monochrome": p[2] >> 4 & 1,
        "subsampling_x": p[2] >> 3 & 1, "subsampling_y": p[2] >> 2 & 1, "chroma_sample_position": p[2] & 3, "presentation_delay": (p[3] & 15) + 1 if p[3] & 16 else None,
    }
    first = None
    for u in units(p[4:], limits):
        if u["obu_type"] not in ("SequenceHeader", "Metadata"):
            raise malformed("a configuration record may hold a sequence header only")
        if u["obu_type"] == "SequenceHeader" and first is None:
            first = sequence_header(u["payload"], limits)
    if first is not None:
        c = first["color"]
        told = (first["profile"], c["bit_depth"] > 8, c["bit_depth"] == 12, c["monochrome"], c["subsampling_x"], c["subsampling_y"], c["chroma_sample_position"])
        if told != tuple(out[k] for k in ("profile", "high_bitdepth", "twelve_bit", "monochrome", "subsampling_x", "subsampling_y", "chroma_sample_position")):
            raise malformed("configuration record and sequence header differ")
    return out


def tile_group(payload: bytes, columns_log2: int, rows_log2: int, size_bytes: int, limits: Limits = DEFAULT) -> list[tuple[int, bytes]]:
    """(tile, data) of a tile group; the last tile takes what remains."""
    bits = columns_log2 + rows_log2
    count = 1 << bits
    if count > limits.max_tiles:
        raise limit("too many tiles")
    b = Bits(payload)
    first, last = 0, count - 1
    if count > 1 and b.flag():
        first, last = b.u(bits), b.u(bits)
        if last < first:
            raise malformed("a tile group ends before it starts")
    b.align()
    at, out = b.at // 8, []
    for tile in range(first, last + 1):
        if tile == last:
            n = len(payload) - at
        else:
            if not 1 <= size_bytes <= 4 or at + size_bytes > len(payload):
                raise malformed("a tile size ends early")
            n = int.from_bytes(payload[at : at + size_bytes], "little") + 1
            at += size_bytes
        if n <= 0 or at + n > len(payload):
            raise malformed("a tile ends early")
        out.append((tile, payload[at : at + n]))
        at += n
    return out


OBUS = "unit_no long, obu_type string, temporal_id int, spatial_id int, header_len int, size_field_len int, payload binary, kind string, message string"


def unit_rows(streams: DataFrame, key: str = "stream_id", data: str = "data") -> DataFrame:
    """Rows of units of byte streams; what goes wrong ends a stream with a row that has the error's kind and message."""
    names = [key, *(c.split()[0] for c in OBUS.split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows: list[tuple] = []
            for k, d in zip(p[key], p[data], strict=True):
                i = 0
                try:
                    for i, u in enumerate(units(bytes(d))):
                        rows.append((k, i, *u.values(), None, None))
                except MediaError as e:
                    rows.append((k, None, None, None, None, None, None, None, e.kind, e.message))
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    return streams.select(key, data).mapInPandas(run, f"{key} {dict(streams.dtypes)[key]}, {OBUS}")
