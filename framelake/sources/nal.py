"""HEVC byte streams: NAL units, decoder configuration, supplemental messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framelake.errors import MediaError, malformed
from framelake.functions.bits import strip_emulation

#: NAL unit types kept from a configuration's arrays: parameter sets and supplemental messages.
CONFIG_TYPES = {32, 33, 34, 39, 40}
#: Supplemental messages by type, in the prefix and the suffix unit.
PREFIX_SEI = {4: "user_data_registered", 5: "user_data_unregistered", 6: "recovery_point", 129: "active_parameter_sets", 137: "mastering_display", 144: "content_light_level", 147: "alternative_transfer"}
SUFFIX_SEI = {4: "user_data_registered", 5: "user_data_unregistered", 132: "decoded_picture_hash"}


def unit(coded: bytes) -> tuple[int, int, int, bytes]:
    """(type, layer, temporal id, payload) of a coded NAL unit."""
    if len(coded) < 2:
        raise malformed("a NAL unit is shorter than its header")
    if coded[0] & 0x80:
        raise malformed("a NAL unit has its forbidden bit set")
    if not coded[1] & 7:
        raise malformed("a NAL unit has no temporal id")
    return coded[0] >> 1 & 63, (coded[0] & 1) << 5 | coded[1] >> 3, (coded[1] & 7) - 1, strip_emulation(coded[2:])


def split_prefixed(data: bytes, width: int) -> list[bytes]:
    """Coded units behind lengths of 1, 2 or 4 bytes."""
    if width not in (1, 2, 4):
        raise malformed("a length prefix has 1, 2 or 4 bytes")
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + width], "big")
        if at + width > len(data) or at + width + n > len(data):
            raise malformed("a sample ends inside a unit")
        out.append(data[at + width : at + width + n])
        at += width + n
    return out


def split_annexb(data: bytes) -> list[bytes]:
    """Coded units between start codes; zeros before a code are padding, bytes before the first are skipped."""
    starts, at = [], data.find(b"\0\0\1")
    while at >= 0:
        starts.append(at)
        at = data.find(b"\0\0\1", at + 3)
    if not starts:
        raise malformed("there is no start code")
    out = []
    for i, s in enumerate(starts):
        body = data[s + 3 : starts[i + 1] if i + 1 < len(starts) else len(data)].rstrip(b"\0")
        if body:
            out.append(body)
    return out


def join_annexb(units: list[bytes]) -> bytes:
    return b"".join(b"\0\0\0\1" + u for u in units)


def join_prefixed(units: list[bytes], width: int = 4) -> bytes:
    return b"".join(len(u).to_bytes(width, "big") + u for u in units)


def parse_hvcc(data: bytes) -> dict:
    """The fields of a decoder configuration (without its box header), and its kept units."""
    if len(data) < 23:
        raise malformed("decoder configuration shorter than its fixed part")
    if data[0] != 1:
        raise malformed("decoder configuration of an unknown version")
    if data[21] & 3 == 2:
        raise malformed("a length prefix has 1, 2 or 4 bytes")
    units, at = [], 23
    for _ in range(data[22]):
        if at + 3 > len(data):
            raise malformed("decoder configuration ends inside a unit")
        kind, n = data[at] & 63, int.from_bytes(data[at + 1 : at + 3], "big")
        at += 3
        for _ in range(n):
            size = int.from_bytes(data[at : at + 2], "big")
            if at + 2 > len(data) or at + 2 + size > len(data):
                raise malformed("decoder configuration ends inside a unit")
            if kind in CONFIG_TYPES:
                units.append(data[at + 2 : at + 2 + size])
            at += 2 + size
    return {
        "profile_space": data[1] >> 6, "tier": data[1] >> 5 & 1, "profile": data[1] & 31, "compatibility": int.from_bytes(data[2:6], "big"), "constraints": list(data[6:12]), "level": data[12],
        "chroma_format": data[16] & 3, "bit_depth_luma": (data[17] & 7) + 8, "bit_depth_chroma": (data[18] & 7) + 8, "temporal_layers": data[21] >> 3 & 7, "length_size": (data[21] & 3) + 1, "units": units,
    }


def parse_sei(rbsp: bytes, suffix: bool = False) -> list[tuple[int, int, str, bytes]]:
    """(type, size, name, payload) of the messages of a unit; unknown types are ``reserved``."""
    end = len(rbsp.rstrip(b"\0"))
    if not end:
        raise malformed("a message unit is empty")
    end -= rbsp[end - 1] == 0x80
    out, at = [], 0
    while at < end:
        values = []
        for _ in range(2):
            value = 0
            while at < end and rbsp[at] == 255:
                value, at = value + 255, at + 1
            if at >= end:
                raise malformed("a message ends early")
            values.append(value + rbsp[at])
            at += 1
        kind, size = values
        if at + size > end:
            raise malformed("a message ends early")
        out.append((kind, size, (SUFFIX_SEI if suffix else PREFIX_SEI).get(kind, "reserved"), rbsp[at : at + size]))
        at += size
    return out


#: The methods of a picture hash by their number, and the bytes of each.
HASHES = {0: ("md5", 16), 1: ("crc", 2), 2: ("checksum", 4)}


def picture_hashes(payload: bytes, planes: int) -> tuple[str, list[bytes]]:
    """Method and values, one for each plane, of a picture hash message."""
    method, size = HASHES.get(payload[0] if payload else 255, (None, 0))
    if method is None or len(payload) < 1 + planes * size:
        raise malformed("a picture hash of an unknown method, or without all planes")
    return method, [payload[1 + size * k : 1 + size * (k + 1)] for k in range(planes)]


def plane_hashes(method: str, planes: list[tuple[bytes, int, int]]) -> list[bytes]:
    """The values that a message should hold, of planes of 8-bit samples (bytes, width, height)."""
    import binascii
    import hashlib

    def checksum(data: bytes, width: int, height: int) -> bytes:
        x, y = np.arange(width, dtype=np.uint32), np.arange(height, dtype=np.uint32)[:, None]
        mask = (x & 255) ^ (y & 255) ^ (x >> 8) ^ (y >> 8)
        total = (np.frombuffer(data, dtype=np.uint8).reshape(height, width) ^ mask).sum(dtype=np.uint64)
        return (int(total) & 0xFFFFFFFF).to_bytes(4, "big")

    def crc(data: bytes) -> bytes:
        # A register of ones that is pushed out by two zero bytes is the same as one that starts at 0x1D0F.
        return binascii.crc_hqx(data, 0x1D0F).to_bytes(2, "big")

    ways = {"md5": lambda d, w, h: hashlib.md5(d).digest(), "crc": lambda d, w, h: crc(d), "checksum": checksum}
    return [ways[method](*p) for p in planes]


def split_substreams(data: bytes, escaped: bytes, entry_points: list[int]) -> list[bytes]:
    """Substreams of slice data; entry points count the bytes before emulation prevention goes."""
    skipped, zeros, where = 0, 0, []
    for i, b in enumerate(escaped):
        if zeros >= 2 and b == 3:
            where.append(i)
            zeros = 0
            continue
        zeros = zeros + 1 if b == 0 else 0
    out, start, total = [], 0, 0
    for n in entry_points:
        total += n
        skipped = sum(w < total for w in where)
        end = total - skipped
        if end > len(data) or end < start:
            raise malformed("an entry point lies beyond its slice")
        out.append(data[start:end])
        start = end
    return [*out, data[start:]]


UNITS = "unit_no long, nal_type int, layer_id int, temporal_id int, rbsp binary, kind string, message string"


def unit_rows(streams: DataFrame, split: Callable[[bytes], list[bytes]] = split_annexb, key: str = "stream_id", data: str = "data") -> DataFrame:
    """Rows of units of byte streams (key, data): a stream that can't be split gives one row with an error's kind and message."""
    names = [key, *(c.split()[0] for c in UNITS.split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, d in zip(p[key], p[data], strict=True):
                try:
                    rows += [(k, i, *unit(u), None, None) for i, u in enumerate(split(bytes(d)))]
                except MediaError as e:
                    rows.append((k, None, None, None, None, None, e.kind, e.message))
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    return streams.select(key, data).mapInPandas(run, f"{key} {dict(streams.dtypes)[key]}, {UNITS}")
