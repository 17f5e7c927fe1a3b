"""HEVC parameter sets and slice headers, each described once and both read and written from that.

A description walks a ``Fields``: in a reader every call takes a value from the bits and keeps it under its name, in a
writer it takes the value of that name (0 if absent) and puts it into bits. What is derived from the values is in functions
of its own. Sets of extensions that are not described end in an opaque ``tail``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.errors import MediaError, limit, malformed
from framelake.functions.bits import Bits, BitWriter
from framelake.functions.blocks import scan_order

#: Unit types of sets, and of slices (up to 9 and from 16 to 21).
VPS, SPS, PPS = 32, 33, 34
IDR, RANDOM_ACCESS = (19, 20), range(16, 24)


class Fields:
    """Named values of a syntax structure, on bits that are read or written."""

    def __init__(self, bits: Bits | BitWriter, values: dict | None = None):
        self.bits, self.writes, self.values = bits, isinstance(bits, BitWriter), {} if values is None else values

    def _field(self, name: str, read: Callable[[], int], write: Callable[[int], object]) -> int:
        if self.writes:
            write(int(self.values.get(name, 0)))
        else:
            self.values[name] = read()
        return int(self.values.get(name, 0))

    def u(self, name: str, n: int) -> int:
        return self._field(name, lambda: self.bits.u(n), lambda v: self.bits.u(v, n))

    def flag(self, name: str) -> bool:
        return bool(self.u(name, 1))

    def ue(self, name: str, most: int = (1 << 32) - 2) -> int:
        value = self._field(name, lambda: self.bits.ue(), lambda v: self.bits.ue(v))
        if value > most:
            raise malformed(f"{name} is {value}, above {most}")
        return value

    def se(self, name: str) -> int:
        return self._field(name, lambda: self.bits.se(), lambda v: self.bits.se(v))

    def zeros(self, n: int) -> None:
        """Bits without a meaning."""
        for at in range(0, n, 32):
            self.u("_", min(32, n - at))
        self.values.pop("_", None)

    def part(self, name: str) -> Fields:
        """A structure inside this one."""
        return Fields(self.bits, self.values.setdefault(name, {}))

    def parts(self, name: str, n: int) -> list[Fields]:
        held = self.values.setdefault(name, [])
        held += [{} for _ in range(n - len(held))]
        return [Fields(self.bits, held[i]) for i in range(n)]

    def each(self, name: str, n: int, one: Callable[[Fields, str], int]) -> list[int]:
        """A list of ``n`` values under one name."""
        held = self.values.setdefault(name, [])
        for i in range(n):
            item = Fields(self.bits, {"v": held[i]} if i < len(held) else {})
            value = one(item, "v")
            if i < len(held):
                held[i] = value
            else:
                held.append(value)
        return held[:n]

    def tail(self) -> None:
        """What is left, up to the stop bit, as it is."""
        if self.writes:
            for b in self.values.get("tail", ""):
                self.bits.u(int(b), 1)
        else:
            data = self.bits.data.rstrip(b"\0")
            end = 8 * len(data) - ((data[-1] & -data[-1]).bit_length() if data else 0)
            self.values["tail"] = "".join(str(self.bits.u(1)) for _ in range(max(0, end - self.bits.at)))


# --- video sets ---


def profile_level(f: Fields, sub_layers: int, profile: bool = True) -> None:
    def one(g: Fields) -> None:
        g.u("space", 2), g.flag("tier"), g.u("profile", 5), g.u("compatibility", 32)
        for name in ("progressive", "interlaced", "non_packed", "frame_only"):
            g.flag(name)
        g.u("constraints", 43), g.flag("inbld")

    if profile:
        one(f)
    f.u("level", 8)
    subs = f.parts("sub_layers", sub_layers)
    for g in subs:
        g.flag("profile_present"), g.flag("level_present")
    if sub_layers:
        f.zeros(2 * (8 - sub_layers))
    for g in subs:
        if g.values.get("profile_present"):
            one(g)
        if g.values.get("level_present"):
            g.u("level", 8)


def sub_layer_ordering(f: Fields, sub_layers: int) -> None:
    every = f.flag("ordering_for_each")
    for g in f.parts("ordering", sub_layers + 1 if every else 1):
        g.ue("buffering"), g.ue("reorder"), g.ue("latency")


def buffer_timing(f: Fields, common: bool, sub_layers: int) -> None:
    """Parameters of the hypothetical decoder."""
    kinds = []
    if common:
        kinds = [k for k in ("nal", "vcl") if f.flag(k)]
        if kinds:
            fine = f.flag("sub_picture")
            if fine:
                f.u("tick_divisor", 8), f.u("removal_length", 5), f.flag("in_sei"), f.u("output_length", 5)
            f.u("rate_scale", 4), f.u("size_scale", 4)
            if fine:
                f.u("fine_size_scale", 4)
            f.u("initial_length", 5), f.u("removal_delay", 5), f.u("output_delay", 5)
    for g in f.parts("layers", sub_layers + 1):
        fixed = g.flag("fixed_general") or g.flag("fixed")
        low = False
        if fixed:
            g.ue("duration")
        else:
            low = g.flag("low_delay")
        count = 1 if low else g.ue("count", 31) + 1
        for k in kinds:
            for h in g.parts(k, count):
                h.ue("rate"), h.ue("size")
                if f.values.get("sub_picture"):
                    h.ue("fine_size"), h.ue("fine_rate")
                h.flag("constant")


def video_set(f: Fields) -> None:
    f.u("id", 4), f.flag("base_internal"), f.flag("base_available"), f.u("layers", 6)
    sub = f.u("sub_layers", 3)
    f.flag("nesting"), f.u("reserved", 16)
    profile_level(f.part("profile"), sub)
    sub_layer_ordering(f, sub)
    most = f.u("layer_id_most", 6)
    for g in f.parts("layer_sets", f.ue("more_layer_sets", 1023)):
        g.each("included", most + 1, lambda h, n: h.u(n, 1))
    if f.flag("timing"):
        f.u("tick", 32), f.u("time_scale", 32)
        if f.flag("proportional"):
            f.ue("ticks_per_picture")
        for i, g in enumerate(f.parts("buffers", f.ue("buffer_count", 1024))):
            g.ue("layer_set")
            buffer_timing(g, g.flag("common") if i else True, sub)
    f.flag("extension")
    f.tail()


# --- scaling lists ---

#: The default 8 x 8 factors by their place in the diagonal scan, intra and inter.
DEFAULT_INTRA = [16] * 10 + [17, 16, 17, 16, 17, 18, 17, 18, 18, 17, 18, 21, 19, 20, 21, 20, 19, 21, 24, 22, 22, 24, 24, 22, 22, 24, 25, 25, 27, 30, 27, 25, 25, 29, 31, 35, 35, 31, 29, 36, 41, 44, 41, 36, 47, 54, 54, 47, 65, 70, 65, 88, 88, 115]
DEFAULT_INTER = [16] * 10 + [17] * 5 + [18] * 6 + [20] * 7 + [24] * 8 + [25] * 7 + [28] * 6 + [33] * 5 + [41] * 4 + [54] * 3 + [71] * 2 + [91]


def scaling_lists(f: Fields) -> None:
    for size in range(4):
        for g in f.parts(f"size{size}", 6 if size < 3 else 2):
            if not g.flag("given"):
                g.ue("back", 5)
            else:
                if size > 1:
                    g.se("dc")
                g.each("deltas", min(64, 1 << (4 + 2 * size)), lambda h, n: h.se(n))


def scaling_factors(lists: dict | None, size: int, matrix: int) -> list[int]:
    """Factors of a transform of 4, 8, 16 or 32 (size 0 to 3), row by row; without lists all are 16.

    A list is given by differences, or it is that of an earlier matrix, or the default; 16 and 32 repeat an 8 x 8 list.
    """
    side = 4 << size
    if lists is None:
        return [16] * (side * side)
    known: list[tuple[list[int], int]] = []
    for i, g in enumerate(lists[f"size{size}"][: matrix + 1]):
        if not g["given"]:
            if g["back"] > i:
                raise malformed("a scaling list refers to one before the first")
            default = [16] * 16 if not size else (DEFAULT_INTRA if i < (3 if size < 3 else 1) else DEFAULT_INTER)
            known.append(known[i - g["back"]] if g["back"] else (default, 16))
        else:
            last = g.get("dc", 0) + 8 if size > 1 else 8
            first, values = last, []
            for d in g["deltas"]:
                last = (last + d + 256) % 256
                values.append(last)
            known.append((values, first))
    values, dc = known[matrix]
    coded = min(side, 8)
    grid = dict(zip(scan_order(coded, "diagonal"), values, strict=True))
    out = [grid[x * coded // side, y * coded // side] for y in range(side) for x in range(side)]
    if size > 1:
        out[0] = dc
    return out


# --- reference picture sets ---


def reference_set(f: Fields, index: int, sets: list[dict], in_slice: bool = False) -> None:
    """A short-term set, by its own pictures or by changes to an earlier one; keeps ``pictures``: (difference, used)."""
    if index and f.flag("predicted"):
        back = f.ue("back", index - 1) + 1 if in_slice else 1
        base = sets[index - back]["pictures"]
        negative, size = f.flag("negative"), f.ue("size", 32767) + 1
        shift = -size if negative else size
        used, kept = [], []
        marks = f.parts("marks", len(base) + 1)
        for g in marks:
            used.append(g.flag("used"))
            kept.append(used[-1] or g.flag("kept"))
        # The shift stands for the picture of the earlier set itself.
        moved = [(d + shift, u) for (d, _), u, k in zip([*base, (0, 0)], used, kept, strict=True) if k and d + shift]
        before, after = sorted((m for m in moved if m[0] < 0), reverse=True), sorted(m for m in moved if m[0] > 0)
        f.values["pictures"] = [(d, int(u)) for d, u in [*before, *after]]
    else:
        n, p = f.ue("before", 16), f.ue("after", 16)
        pictures: list[tuple[int, int]] = []
        for name, count, sign in (("earlier", n, -1), ("later", p, 1)):
            at = 0
            for g in f.parts(name, count):
                at += sign * (g.ue("step", 32767) + 1)
                pictures.append((at, int(g.flag("used"))))
        f.values["pictures"] = pictures
    if len(f.values["pictures"]) > 16:
        raise malformed("a reference set has more than 16 pictures")


# --- sequence sets ---


def usability(f: Fields, sub: int) -> None:
    """What a display should know."""
    if f.flag("aspect") and f.u("aspect_kind", 8) == 255:
        f.u("aspect_width", 16), f.u("aspect_height", 16)
    if f.flag("overscan"):
        f.flag("overscan_fits")
    if f.flag("signal"):
        f.u("video_format", 3), f.flag("full_range")
        if f.flag("colours"):
            f.u("primaries", 8), f.u("transfer", 8), f.u("matrix", 8)
    if f.flag("chroma_place"):
        f.ue("chroma_top", 5), f.ue("chroma_bottom", 5)
    f.flag("neutral_chroma"), f.flag("fields"), f.flag("field_info")
    if f.flag("window"):
        for side in ("left", "right", "top", "bottom"):
            f.ue(f"window_{side}")
    if f.flag("timing"):
        f.u("tick", 32), f.u("time_scale", 32)
        if f.flag("proportional"):
            f.ue("ticks_per_picture")
        if f.flag("buffer"):
            buffer_timing(f.part("timing_buffer"), True, sub)
    if f.flag("restrictions"):
        f.flag("fixed_tiles"), f.flag("motion_over_edges"), f.flag("restricted_lists")
        f.ue("segment_size"), f.ue("most_bytes"), f.ue("most_bits"), f.ue("motion_x"), f.ue("motion_y")


RANGE_FLAGS = ("rotation", "context", "implicit_rdpcm", "explicit_rdpcm", "extended_precision", "intra_smoothing_off", "high_precision_offsets", "persistent_rice", "bypass_alignment")


def sequence_set(f: Fields) -> None:
    f.u("video_set", 4)
    sub = f.u("sub_layers", 3)
    f.flag("nesting")
    profile_level(f.part("profile"), sub)
    f.ue("id", 15)
    chroma = f.ue("chroma", 3)
    if chroma == 3:
        f.flag("separate_planes")
    f.ue("width"), f.ue("height")
    if f.flag("cropped"):
        for side in ("left", "right", "top", "bottom"):
            f.ue(f"crop_{side}")
    f.ue("luma_depth", 8), f.ue("chroma_depth", 8)
    lsb = f.ue("poc_bits", 12) + 4
    sub_layer_ordering(f, sub)
    for name in ("least_block", "block_steps", "least_transform", "transform_steps", "inter_depth", "intra_depth"):
        f.ue(name, 32)
    if f.flag("scaling") and f.flag("scaling_given"):
        scaling_lists(f.part("lists"))
    f.flag("asymmetric"), f.flag("offsets")
    if f.flag("pcm"):
        f.u("pcm_luma", 4), f.u("pcm_chroma", 4), f.ue("pcm_least"), f.ue("pcm_steps"), f.flag("pcm_unfiltered")
    sets: list[dict] = f.values.setdefault("sets", [])
    for i, g in enumerate(f.parts("sets", f.ue("set_count", 64))):
        reference_set(g, i, sets)
    if f.flag("long_term"):
        f.each("long_lsb", n := f.ue("long_count", 32), lambda h, name: h.u(name, lsb))
        f.each("long_used", n, lambda h, name: h.u(name, 1))
    f.flag("temporal_motion"), f.flag("strong_smoothing")
    if f.flag("usable"):
        usability(f.part("usability"), sub)
    if f.flag("extension"):
        ranged, multilayer, three_d, screen = (f.flag(n) for n in ("range", "multilayer", "three_d", "screen"))
        f.u("extension_rest", 4)
        if ranged:
            for name in RANGE_FLAGS:
                f.flag(name)
        if multilayer:
            f.flag("view_motion_bound")
        if screen and not three_d:
            f.flag("current_picture")
            if f.flag("palette"):
                f.ue("palette_most"), f.ue("palette_predictor")
                if f.flag("palette_given"):
                    n = f.ue("palette_entries") + 1
                    for c in range(1 if chroma == 0 else 3):
                        f.each(f"palette{c}", n, lambda h, name, c=c: h.u(name, 8 + int(f.values["chroma_depth" if c else "luma_depth"])))
            f.u("motion_resolution", 2), f.flag("boundary_filter_off")
    f.tail()


def picture_set(f: Fields) -> None:
    f.ue("id", 63), f.ue("sequence_set", 15)
    f.flag("dependent"), f.flag("output_flag"), f.u("extra_bits", 3), f.flag("sign_hiding"), f.flag("cabac_init")
    f.ue("refs0", 14), f.ue("refs1", 14)
    f.se("qp"), f.flag("constrained_intra"), f.flag("transform_skip")
    if f.flag("qp_change"):
        f.ue("qp_depth")
    f.se("cb"), f.se("cr")
    for name in ("slice_chroma", "weighted", "weighted_bi", "bypass", "tiles", "wavefront"):
        f.flag(name)
    if f.values.get("tiles"):
        columns, rows = f.ue("columns", 19), f.ue("rows", 21)
        if not f.flag("uniform"):
            f.each("widths", columns, lambda h, n: h.ue(n)), f.each("heights", rows, lambda h, n: h.ue(n))
        f.flag("filter_tiles")
    f.flag("filter_slices")
    if f.flag("deblocking"):
        f.flag("deblocking_override")
        if not f.flag("deblocking_off"):
            f.se("beta"), f.se("tc")
    if f.flag("scaling"):
        scaling_lists(f.part("lists"))
    f.flag("lists_change"), f.ue("merge_level"), f.flag("header_extension")
    if f.flag("extension"):
        ranged = f.flag("range")
        f.u("extension_rest", 7)
        if ranged:
            if f.values.get("transform_skip"):
                f.ue("skip_size")
            f.flag("cross_component")
            if f.flag("chroma_offsets"):
                f.ue("offset_depth"), f.each("cb_list", n := f.ue("offset_count", 5) + 1, lambda h, name: h.se(name)), f.each("cr_list", n, lambda h, name: h.se(name))
            f.ue("offset_luma"), f.ue("offset_chroma")
    f.tail()


# --- slices ---


def tree_blocks(sps: dict) -> tuple[int, int]:
    """Columns and rows of tree blocks."""
    log2 = sps["least_block"] + 3 + sps["block_steps"]
    return (sps["width"] + (1 << log2) - 1) >> log2, (sps["height"] + (1 << log2) - 1) >> log2


def prediction_weights(f: Fields, chroma: bool, lists: list[int]) -> None:
    f.ue("luma_log2", 7)
    if chroma:
        f.se("chroma_log2")
    for k, n in enumerate(lists):
        entries = f.parts(f"list{k}", n)
        for g in entries:
            g.flag("luma")
        for g in entries if chroma else ():
            g.flag("chroma")
        for g in entries:
            if g.values.get("luma"):
                g.se("weight"), g.se("offset")
            if chroma and g.values.get("chroma"):
                for c in ("cb", "cr"):
                    g.se(f"{c}_weight"), g.se(f"{c}_offset")


def slice_header(f: Fields, kind: int, pictures: dict[int, dict], sequences: dict[int, dict]) -> None:
    """The header of a slice segment of a unit type, in the sets that it names by their ids."""
    first = f.flag("first")
    if kind in RANDOM_ACCESS:
        f.flag("drop_earlier")
    pps = pictures.get(f.ue("picture_set", 63))
    sps = sequences.get(pps["sequence_set"]) if pps else None
    if sps is None:
        raise malformed("a slice names a parameter set that is not there")
    columns, rows = tree_blocks(sps)
    dependent = False
    if not first:
        dependent = bool(pps["dependent"]) and f.flag("dependent")
        f.u("address", (columns * rows - 1).bit_length())
        if f.values["address"] >= columns * rows:
            raise malformed("a slice starts outside its picture")
    if not dependent:
        _independent(f, kind, pps, sps)
    if pps.get("tiles") or pps.get("wavefront"):
        if n := f.ue("entry_count", columns * rows):
            f.each("entries", n, lambda h, name, bits=f.ue("entry_bits", 31) + 1: h.u(name, bits))
    if pps.get("header_extension"):
        f.each("extension", f.ue("extension_length", 256), lambda h, n: h.u(n, 8))
    if f.writes:
        f.bits.trailing()
    else:
        if not f.bits.u(1):
            raise malformed("a slice header lacks its stop bit")
        f.bits.align()


def _independent(f: Fields, kind: int, pps: dict, sps: dict) -> None:
    f.zeros(pps["extra_bits"])
    kind_of = f.ue("type", 2)  # 0: B, 1: P, 2: I
    if pps["output_flag"]:
        f.flag("output")
    if sps.get("separate_planes"):
        f.u("plane", 2)
    total = 0
    if kind not in IDR:
        bits = sps["poc_bits"] + 4
        f.u("poc_lsb", bits)
        sets = sps.get("sets", [])
        if not f.flag("from_sequence"):
            own = f.part("own_set")
            reference_set(own, len(sets), sets, in_slice=True)
            chosen = own.values["pictures"]
        else:
            index = f.u("set_index", (len(sets) - 1).bit_length()) if len(sets) > 1 else 0
            if index >= len(sets):
                raise malformed("a slice names a reference set that is not there")
            chosen = sets[index]["pictures"]
        total = sum(used for _, used in chosen)
        if sps.get("long_term"):
            given = len(sps.get("long_lsb", []))
            known = f.ue("known_long", given) if given else 0
            for i, g in enumerate(f.parts("long", known + f.ue("more_long", 32))):
                if i < known:
                    at = g.u("at", (given - 1).bit_length()) if given > 1 else 0
                    total += sps["long_used"][at]
                else:
                    g.u("lsb", bits)
                    total += g.flag("used")
                if g.flag("msb_present"):
                    g.ue("msb")
        if sps.get("temporal_motion"):
            f.flag("temporal_motion")
    chroma = sps["chroma"] != 0 and not sps.get("separate_planes")
    if sps.get("offsets"):
        f.flag("offset_luma")
        if chroma:
            f.flag("offset_chroma")
    if kind_of < 2:
        _inter(f, kind_of == 0, pps, total, chroma)
    f.se("qp")
    if pps["slice_chroma"]:
        f.se("cb"), f.se("cr")
    if pps.get("chroma_offsets"):
        f.flag("chroma_change")
    off = bool(pps.get("deblocking_off"))
    if pps.get("deblocking_override") and f.flag("own_deblocking"):
        off = f.flag("deblocking_off")
        if not off:
            f.se("beta"), f.se("tc")
    if pps["filter_slices"] and (f.values.get("offset_luma") or f.values.get("offset_chroma") or not off):
        f.flag("filter_edges")


def _inter(f: Fields, both: bool, pps: dict, total: int, chroma: bool) -> None:
    counts = [pps["refs0"] + 1, pps["refs1"] + 1]
    if f.flag("own_counts"):
        counts = [f.ue("refs0", 14) + 1, f.ue("refs1", 14) + 1 if both else counts[1]]
    lists = counts[: 1 + both]
    if pps["lists_change"] and total > 1:
        for k, n in enumerate(lists):
            if f.flag(f"changed{k}"):
                f.each(f"entry{k}", n, lambda h, name: h.u(name, (total - 1).bit_length()))
    if both:
        f.flag("no_second_change")
    if pps["cabac_init"]:
        f.flag("cabac_init")
    if f.values.get("temporal_motion"):
        side = 0 if not both or f.flag("collocated_first") else 1
        if lists[side] > 1:
            f.ue("collocated", lists[side] - 1)
    if pps["weighted_bi" if both else "weighted"]:
        prediction_weights(f.part("weights"), chroma, lists)
    f.ue("merge_less", 4)


# --- reading, writing, checking ---

DESCRIPTIONS = {VPS: video_set, SPS: sequence_set, PPS: picture_set}


def read(describe: Callable, rbsp: bytes, *more) -> dict:
    """The values of a payload without its unit header."""
    f = Fields(Bits(rbsp))
    describe(f, *more)
    return f.values


def write(describe: Callable, values: dict, *more) -> bytes:
    """The payload of values, which are copied: what they lack counts as 0."""
    f = Fields(BitWriter(), json.loads(json.dumps(values)))
    describe(f, *more)
    return f.bits.bytes() if describe is slice_header else f.bits.trailing().bytes()


def sequence_facts(sps: dict) -> dict:
    """Cropped size, depths and buffer of a sequence set."""
    across, down = (1 if sps["chroma"] in (0, 3) else 2), (2 if sps["chroma"] == 1 else 1)
    crop = [sps.get(f"crop_{side}", 0) for side in ("left", "right", "top", "bottom")]
    last = sps["ordering"][-1]
    width, height = sps["width"] - across * (crop[0] + crop[1]), sps["height"] - down * (crop[2] + crop[3])
    if width <= 0 or height <= 0:
        raise malformed("the crop leaves nothing of the picture")
    return {"width": width, "height": height, "chroma": sps["chroma"], "luma_bits": sps["luma_depth"] + 8, "chroma_bits": sps["chroma_depth"] + 8, "buffering": last["buffering"], "reorder": last["reorder"], "poc_lsb": 16 << sps["poc_bits"]}


def check_sequence(sps: dict, width: int, height: int, most_bytes: int) -> None:
    """Raise unless a sequence set is 8-bit 4:2:0 of the track's size, and its buffer fits."""
    facts = sequence_facts(sps)
    if sps["profile"].get("profile") not in (1, 3) or (facts["chroma"], facts["luma_bits"], facts["chroma_bits"]) != (1, 8, 8):
        raise MediaError("Unsupported", "only 8-bit 4:2:0 pictures can be decoded")
    if (facts["width"], facts["height"]) != (width, height):
        raise malformed("the sequence set and the track differ in size")
    if 6 * sps["width"] * sps["height"] * (facts["buffering"] + 2) + 4 * width * height > most_bytes:
        raise limit("the pictures of the buffer exceed the allocation limit")


SETS = "set_kind string, id int, width int, height int, reorder int, fields string, error_kind string, error_message string"


def set_rows(units: DataFrame, key: str = "stream_id") -> DataFrame:
    """Parameter sets among units (key, unit_no, nal_type, rbsp): their ids, sizes and all fields as JSON, or an error."""
    names = [key, "unit_no", *(c.split()[0] for c in SETS.split(", "))]
    kinds = {VPS: "video", SPS: "sequence", PPS: "picture"}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, n, kind, data in zip(p[key], p["unit_no"], p["nal_type"], p["rbsp"], strict=True):
                try:
                    values = read(DESCRIPTIONS[int(kind)], bytes(data))
                    facts = sequence_facts(values) if kind == SPS else {}
                    rows.append((k, n, kinds[int(kind)], values["id"], facts.get("width"), facts.get("height"), facts.get("reorder"), json.dumps(values), None, None))
                except MediaError as e:
                    rows.append((k, n, kinds[int(kind)], *[None] * 5, e.kind, e.message))
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    chosen = units.where(F.col("nal_type").isin(*kinds))
    return chosen.select(key, "unit_no", "nal_type", "rbsp").mapInPandas(run, f"{key} {dict(units.dtypes)[key]}, unit_no long, {SETS}")


SLICES = "nal_type int, first boolean, address int, type string, poc_lsb long, qp int, max_poc_lsb long, reorder int, fields string, error_kind string, error_message string"


def slice_rows(units: DataFrame, key: str = "stream_id") -> DataFrame:
    """Slice headers among units (key, unit_no, nal_type, rbsp), each in the sets that stand before it in its stream.

    A stream is sorted in its partition and walked once; a set holds until one of its id follows.
    """
    names = [key, "unit_no", *(c.split()[0] for c in SLICES.split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, sets = None, {SPS: {}, PPS: {}}
        for p in parts:
            rows = []
            for k, n, kind, data in zip(p[key], p["unit_no"], p["nal_type"], p["rbsp"], strict=True):
                if k != stream:
                    stream, sets = k, {SPS: {}, PPS: {}}
                kind = int(kind)
                try:
                    if kind in sets:
                        values = read(DESCRIPTIONS[kind], bytes(data))
                        sets[kind][values["id"]] = values
                        continue
                    h = read(slice_header, bytes(data), kind, sets[PPS], sets[SPS])
                    facts = sequence_facts(sets[SPS][sets[PPS][h["picture_set"]]["sequence_set"]])
                    rows.append((k, n, kind, bool(h["first"]), h.get("address", 0), "BPI"[h["type"]] if "type" in h else None, h.get("poc_lsb"), h.get("qp"), facts["poc_lsb"], facts["reorder"], json.dumps(h), None, None))
                except MediaError as e:
                    if kind not in sets:
                        rows.append((k, n, kind, *[None] * 8, e.kind, e.message))
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    chosen = units.where(F.col("nal_type").isin(SPS, PPS) | F.col("nal_type").between(0, 9) | F.col("nal_type").between(16, 21))
    dealt = chosen.select(key, "unit_no", "nal_type", "rbsp").repartition(key).sortWithinPartitions(key, "unit_no")
    return dealt.mapInPandas(run, f"{key} {dict(units.dtypes)[key]}, unit_no long, {SLICES}")
