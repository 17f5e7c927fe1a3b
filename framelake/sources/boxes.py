"""ISO base media boxes: walking, parsing the tables of a movie, and building them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from framelake.errors import MediaError, limit, malformed
from framelake.limits import DEFAULT, Limits

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"dinf"}
#: Sample entries, their codec, kind and configuration box.
ENTRIES = {b"hvc1": ("Hevc", "Video", b"hvcC"), b"hev1": ("Hevc", "Video", b"hvcC"), b"av01": ("Av1", "Video", b"av1C"), b"mp4a": ("Aac", "Audio", b"esds")}
#: Bytes of a visual and of an audio sample entry before its boxes.
ENTRY_HEAD = {"Video": 78, "Audio": 28}


@dataclass
class Box:
    kind: bytes
    start: int
    payload: int
    end: int
    depth: int
    path: str


class Walker:
    """Counts boxes against a budget while it reads headers."""

    def __init__(self, limits: Limits = DEFAULT):
        self.limits, self.seen = limits, 0

    def header(self, data: bytes, at: int, end: int, depth: int, path: str) -> Box:
        self.seen += 1
        if self.seen > self.limits.max_boxes:
            raise limit("too many boxes")
        if depth > self.limits.max_depth:
            raise limit("boxes are nested too deep")
        if end - at < 8:
            raise malformed("a box header ends early")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise malformed("a box header ends early")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or size > end - at:
            raise malformed("a box size is out of bounds")
        name = kind.decode("latin-1")
        return Box(kind, at, at + head, at + size, depth, f"{path}/{name}" if path else name)

    def children(self, data: bytes, start: int, end: int, depth: int = 0, path: str = "") -> Iterator[Box]:
        at = start
        while at < end:
            box = self.header(data, at, end, depth, path)
            yield box
            at = box.end

    def walk(self, data: bytes, start: int = 0, end: int | None = None, depth: int = 0, path: str = "") -> Iterator[Box]:
        """All boxes, each before those inside it."""
        for box in self.children(data, start, len(data) if end is None else end, depth, path):
            yield box
            if box.kind in CONTAINERS:
                yield from self.walk(data, box.payload, box.end, depth + 1, box.path)


def probe(head: bytes) -> bool:
    """Whether bytes may start an MP4 file."""
    if len(head) < 8:
        return False
    size, kind = struct.unpack_from(">I4s", head)
    return (size in (0, 1) or size >= 8) and kind in (b"ftyp", b"moov")


class Cursor:
    """Bounded reads inside one box."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def take(self, form: str) -> tuple:
        n = struct.calcsize(form)
        if n > self.end - self.at:
            raise malformed("a box payload ends early")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += n
        return out

    def one(self, form: str) -> int:
        return self.take(">" + form)[0]

    def skip(self, n: int) -> None:
        if n > self.end - self.at:
            raise malformed("a box payload ends early")
        self.at += n

    def full(self) -> tuple[int, int]:
        """(version, flags) of a full box."""
        word = self.one("I")
        return word >> 24, word & 0xFFFFFF

    def left(self) -> int:
        return self.end - self.at


@dataclass
class Track:
    track_id: int = 0
    kind: str | None = None
    codec: str | None = None
    timescale: int = 0
    duration: int = 0
    width: int | None = None
    height: int | None = None
    channels: int | None = None
    decoder_config: bytes = b""
    ignored: bool = False
    edits: list[tuple] = field(default_factory=list)
    stts: list[tuple] = field(default_factory=list)
    ctts: list[tuple] = field(default_factory=list)
    stsc: list[tuple] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)
    sync: list[int] | None = None
    dependencies: list[int] = field(default_factory=list)


@dataclass
class Movie:
    timescale: int = 0
    tracks: list[Track] = field(default_factory=list)
    trex: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    fragments: list[dict] = field(default_factory=list)
    media: list[tuple[int, int]] = field(default_factory=list)


class Parser(Walker):
    """The tables of a file: what belongs to the index, never the media bytes."""

    def count(self, c: Cursor, width: int) -> int:
        n = c.one("I")
        if n > self.limits.max_samples_per_track:
            raise limit("a sample table is too long")
        if n * width > c.left():
            raise malformed("a sample table ends early")
        return n

    def movie(self, data: bytes) -> Movie:
        out, seen = Movie(), 0
        for box in self.children(data, 0, len(data)):
            if box.end - box.payload > self.limits.max_box_bytes and box.kind in (b"moov", b"moof"):
                raise limit("a metadata box is too large")
            if box.kind == b"moov":
                seen += 1
                self.moov(data, box, out)
            elif box.kind == b"moof":
                out.fragments.append(self.moof(data, box, len(out.fragments)))
            elif box.kind == b"mdat":
                out.media.append((box.payload, box.end))
        if seen != 1:
            raise malformed("a file needs exactly one moov box")
        ids = [t.track_id for t in out.tracks]
        if 0 in ids or len(set(ids)) != len(ids):
            raise malformed("track ids must be unique and nonzero")
        out.tracks = [t for t in out.tracks if not t.ignored]
        return out

    def moov(self, data: bytes, moov: Box, out: Movie) -> None:
        for box in self.children(data, moov.payload, moov.end, 1, "moov"):
            c = Cursor(data, box.payload, box.end)
            if box.kind == b"mvhd":
                version, _ = c.full()
                c.skip(16 if version == 1 else 8)
                out.timescale = c.one("I")
                if not out.timescale:
                    raise malformed("a time scale is zero")
            elif box.kind == b"trak":
                if len(out.tracks) >= self.limits.max_tracks:
                    raise limit("too many tracks")
                out.tracks.append(self.trak(data, box))
            elif box.kind == b"mvex":
                for inner in self.children(data, box.payload, box.end, 2, box.path):
                    if inner.kind == b"trex":
                        c = Cursor(data, inner.payload, inner.end)
                        c.full()
                        track, _, duration, size, flags = c.take(">5I")
                        out.trex[track] = (duration, size, flags)

    def trak(self, data: bytes, trak: Box) -> Track:
        t = Track()
        for box in self.walk(data, trak.payload, trak.end, trak.depth + 1, trak.path):
            c = Cursor(data, box.payload, box.end)
            handler = getattr(self, "on_" + box.kind.decode("latin-1").strip(), None)
            if handler and box.kind not in CONTAINERS:
                handler(c, t)
        if not t.ignored:
            if t.kind is None or t.codec is None:
                raise malformed("a track lacks its handler or sample description")
            if not t.timescale:
                raise malformed("a time scale is zero")
        return t

    def on_tkhd(self, c: Cursor, t: Track) -> None:
        version, _ = c.full()
        c.skip(16 if version == 1 else 8)
        t.track_id = c.one("I")
        c.skip(4 + (8 if version == 1 else 4) + 8 + 8 + 36)
        t.width, t.height = (x >> 16 for x in c.take(">2I"))

    def on_mdhd(self, c: Cursor, t: Track) -> None:
        version, _ = c.full()
        c.skip(16 if version == 1 else 8)
        t.timescale = c.one("I")
        t.duration = c.one("Q" if version == 1 else "I")
        if not t.timescale:
            raise malformed("a time scale is zero")

    def on_hdlr(self, c: Cursor, t: Track) -> None:
        c.full()
        c.skip(4)
        name = c.take("4s")[0]
        t.kind = {b"vide": "Video", b"soun": "Audio"}.get(name)
        t.ignored = t.kind is None

    def on_elst(self, c: Cursor, t: Track) -> None:
        version, _ = c.full()
        n = self.count(c, 20 if version == 1 else 12)
        for _ in range(n):
            duration, media = c.take(">Qq" if version == 1 else ">Ii")
            rate, fraction = c.take(">hh")
            t.edits.append((duration, media, rate, fraction))

    def on_stsd(self, c: Cursor, t: Track) -> None:
        if t.ignored:
            return
        c.full()
        if c.one("I") != 1:
            raise malformed("a track needs exactly one sample description")
        entry = self.header(c.data, c.at, c.end, 6, "stsd")
        if entry.kind not in ENTRIES:
            raise MediaError("Unsupported", "the sample entry is not supported")
        t.codec, kind, wanted = ENTRIES[entry.kind]
        if t.kind is not None and t.kind != kind:
            raise malformed("the sample entry does not match the handler")
        head = Cursor(c.data, entry.payload, entry.end)
        if kind == "Audio":
            head.skip(16)
            t.channels = head.one("H")
            head.skip(10)
        else:
            head.skip(ENTRY_HEAD[kind])
        for box in self.children(c.data, head.at, head.end, 7, entry.path):
            if box.kind == wanted:
                t.decoder_config = bytes(c.data[box.start : box.end])
        if not t.decoder_config:
            raise malformed("the decoder configuration is missing")

    def on_stts(self, c: Cursor, t: Track) -> None:
        c.full()
        t.stts = [c.take(">II") for _ in range(self.count(c, 8))]

    def on_ctts(self, c: Cursor, t: Track) -> None:
        version, _ = c.full()
        t.ctts = [c.take(">Ii" if version == 1 else ">II") for _ in range(self.count(c, 8))]

    def on_stsc(self, c: Cursor, t: Track) -> None:
        c.full()
        t.stsc = [c.take(">III") for _ in range(self.count(c, 12))]

    def on_stsz(self, c: Cursor, t: Track) -> None:
        c.full()
        size = c.one("I")
        n = self.count(c, 0 if size else 4)
        t.sizes = [size] * n if size else [c.one("I") for _ in range(n)]

    def on_stz2(self, c: Cursor, t: Track) -> None:
        c.full()
        width = c.one("I") & 0xFF
        if width not in (4, 8, 16):
            raise malformed("a compact sample size has 4, 8 or 16 bits")
        n = self.count(c, 0)
        if (n * width + 7) // 8 > c.left():
            raise malformed("a sample table ends early")
        t.sizes = compact_sizes(bytes(c.data[c.at : c.end]), width, n)

    def on_stco(self, c: Cursor, t: Track) -> None:
        c.full()
        t.chunks = [c.one("I") for _ in range(self.count(c, 4))]

    def on_co64(self, c: Cursor, t: Track) -> None:
        c.full()
        t.chunks = [c.one("Q") for _ in range(self.count(c, 8))]

    def on_stss(self, c: Cursor, t: Track) -> None:
        c.full()
        t.sync = [c.one("I") for _ in range(self.count(c, 4))]

    def on_sdtp(self, c: Cursor, t: Track) -> None:
        c.full()
        t.dependencies = list(c.data[c.at : c.end])

    def moof(self, data: bytes, moof: Box, number: int) -> dict:
        trafs = []
        for box in self.children(data, moof.payload, moof.end, 1, "moof"):
            if box.kind == b"traf":
                trafs.append(self.traf(data, box, moof.start))
        return {"fragment_no": number, "moof_start": moof.start, "trafs": trafs}

    def traf(self, data: bytes, traf: Box, start: int) -> dict:
        out = {"track_id": None, "base": start, "decode_time": 0, "default_duration": 0, "default_size": 0, "default_flags": 0, "runs": []}
        for box in self.children(data, traf.payload, traf.end, 2, traf.path):
            c = Cursor(data, box.payload, box.end)
            if box.kind == b"tfhd":
                _, flags = c.full()
                out["track_id"] = c.one("I")
                if flags & 0x1:
                    out["base"] = c.one("Q")
                if flags & 0x2:
                    c.skip(4)
                for bit, name in ((0x8, "default_duration"), (0x10, "default_size"), (0x20, "default_flags")):
                    if flags & bit:
                        out[name] = c.one("I")
            elif box.kind == b"tfdt":
                version, _ = c.full()
                out["decode_time"] = c.one("Q" if version == 1 else "I")
            elif box.kind == b"trun":
                out["runs"].append(self.trun(c))
        if out["track_id"] is None:
            raise malformed("a track fragment lacks its header")
        return out

    def trun(self, c: Cursor) -> dict:
        version, flags = c.full()
        width = 4 * sum(bool(flags & b) for b in (0x100, 0x200, 0x400, 0x800))
        n = c.one("I")
        if n > self.limits.max_samples_per_track:
            raise limit("a fragment run is too long")
        offset = c.one("i") if flags & 0x1 else None
        first = c.one("I") if flags & 0x4 else None
        if n * width > c.left():
            raise malformed("a fragment run ends early")
        samples = []
        for _ in range(n):
            duration = c.one("I") if flags & 0x100 else None
            size = c.one("I") if flags & 0x200 else None
            own = c.one("I") if flags & 0x400 else None
            shift = c.one("i" if version == 1 else "I") if flags & 0x800 else 0
            samples.append((duration, size, own, shift))
        return {"data_offset": offset, "first_flags": first, "samples": samples}


def compact_sizes(data: bytes, width: int, n: int) -> list[int]:
    """Sizes of 4, 8 or 16 bits; of two in a byte the high one is first."""
    if width == 16:
        return list(struct.unpack_from(f">{n}H", data))
    if width == 8:
        return list(data[:n])
    return [data[i // 2] >> (0 if i % 2 else 4) & 15 for i in range(n)]


# --- building ---------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def runs(values: list[int]) -> list[tuple[int, int]]:
    """(count, value) of maximal runs."""
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [(n, v) for n, v in out]
