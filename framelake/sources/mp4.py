"""MP4 files as tables: a Python data source for the index, and the assembly of files.

``spark.read.format("mp4_index").option("table", ...).load(path)`` gives one of the tables
``tracks``, ``stts``, ``ctts``, ``stsc``, ``sizes``, ``chunks``, ``sync``, ``sdtp``, ``edits``, ``trex``, ``frag_samples``, ``media`` or
``errors``, one partition for each file; ``all`` gives them together from one walk, each row with its ``table``. Files are
mapped, so media bytes are passed over unread. ``sample_index`` composes the index of samples from the tables with the DataFrame
operators. A file that is malformed gives a row in ``errors`` and none elsewhere.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from framelake.errors import MediaError
from framelake.functions.pixels import unpack_dependency
from framelake.operators import samples as S
from framelake.session import materialise
from framelake.sources.boxes import Movie, Parser, box, full_box, runs

KEYS = ("file_id", "track_id")
SCHEMAS = {
    "tracks": "file_id string, track_id long, kind string, codec string, timescale long, duration long, width int, height int, channels int, decoder_config binary",
    "stts": "file_id string, track_id long, run_no long, count long, value long",
    "ctts": "file_id string, track_id long, run_no long, count long, value long",
    "stsc": "file_id string, track_id long, first_chunk long, samples_per_chunk long, description_index long",
    "sizes": "file_id string, track_id long, decode_index long, size long",
    "chunks": "file_id string, track_id long, chunk_no long, chunk_offset long",
    "sync": "file_id string, track_id long, sample_no long",
    "sdtp": "file_id string, track_id long, decode_index long, byte int",
    "edits": "file_id string, track_id long, edit_no long, segment_duration long, media_time long, rate_int int, rate_frac int",
    "trex": "file_id string, track_id long, duration long, size long, flags long",
    "frag_samples": "file_id string, fragment_no long, traf_no long, run_no long, i long, track_id long, moof_start long, base long, decode_time long, default_duration long, default_size long, default_flags long, data_offset long, first_flags long, duration long, size long, flags long, cto long",
    "media": "file_id string, r_start long, r_end long",
    "boxes": "file_id string, path string, kind string, start long, payload_start long, end long, depth int",
    "errors": "file_id string, kind string, message string",
}
#: The tables of ``all``, and their columns side by side: a table's rows leave those of others null.
INDEX = [t for t in SCHEMAS if t not in ("boxes", "errors")]
WIDE = dict(c.split() for t in [*INDEX, "errors"] for c in SCHEMAS[t].split(", "))
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
SCHEMAS["all"] = ", ".join(["table string", *(f"{n} {kind}" for n, kind in WIDE.items())])


#: Rows that are held as Python values at one time, of each table, and bytes of written files.
AT_ONCE, FILES_BYTES = 1 << 14, 1 << 23


def names_of(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def table_rows(name: str, file: str, movie: Movie) -> Iterator[tuple]:
    """The rows of one table of a parsed movie."""
    if name == "media":
        yield from ((file, a, b) for a, b in movie.media)
    elif name == "trex":
        yield from ((file, t, *v) for t, v in movie.trex.items())
    elif name == "frag_samples":
        for f in movie.fragments:
            for traf_no, t in enumerate(f["trafs"]):
                head = (t["track_id"], f["moof_start"], t["base"], t["decode_time"], t["default_duration"], t["default_size"], t["default_flags"])
                for run_no, r in enumerate(t["runs"]):
                    for i, s in enumerate(r["samples"]):
                        yield (file, f["fragment_no"], traf_no, run_no, i, *head, r["data_offset"], r["first_flags"], *s)
    else:
        for t in movie.tracks:
            key = (file, t.track_id)
            if name == "tracks":
                yield (*key, t.kind, t.codec, t.timescale, t.duration, t.width, t.height, t.channels, t.decoder_config)
            elif name in ("stts", "ctts"):
                yield from ((*key, i, n, v) for i, (n, v) in enumerate(getattr(t, name)))
            elif name == "stsc":
                yield from ((*key, *e) for e in t.stsc)
            elif name == "sizes":
                yield from ((*key, i, n) for i, n in enumerate(t.sizes))
            elif name == "chunks":
                yield from ((*key, i + 1, n) for i, n in enumerate(t.chunks))
            elif name == "sync":
                yield from ((*key, n) for n in t.sync or ())
            elif name == "sdtp":
                yield from ((*key, i, b) for i, b in enumerate(t.dependencies))
            elif name == "edits":
                yield from ((*key, i, *e) for i, e in enumerate(t.edits))


def wide_rows(found: Iterator[tuple[str, tuple]]) -> Iterator[tuple]:
    """Rows of several tables in the columns of ``all``."""
    place = {n: i + 1 for i, n in enumerate(WIDE)}
    at = {t: [place[n] for n in names_of(t)] for t in [*INDEX, "errors"]}
    for table, r in found:
        wide = [table, *[None] * len(WIDE)]
        for i, v in zip(at[table], r, strict=True):
            wide[i] = v
        yield tuple(wide)


@dataclass
class OneFile(InputPartition):
    path: str


def _local(path: str) -> str:
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme == "file" else path


def find_files(path: str) -> list[str]:
    root = _local(path)
    if os.path.isfile(root):
        return [root]
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n[0] not in "._")


class Mp4Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options.get("table", "tracks")
        self.track: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("track_id",):
                self.track = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in find_files(self.path)] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            if not os.fstat(f.fileno()).st_size:
                yield from file_rows(self.table, os.path.basename(partition.path), b"", self.track)
                return
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                yield from file_rows(self.table, os.path.basename(partition.path), data, self.track)


def found_rows(table: str, name: str, data: bytes) -> Iterator[tuple[str, tuple]]:
    """A table's name and a row of it, for each row of one file; a malformed file has them in ``errors`` only."""
    try:
        if table == "boxes":
            rows = [(table, (name, b.path, b.kind.decode("latin-1"), b.start, b.payload, b.end, b.depth)) for b in Parser().walk(data)]
        else:
            movie = Parser().movie(data)
            rows = ((t, r) for t in (INDEX if table == "all" else [] if table == "errors" else [table]) for r in table_rows(t, name, movie))
    except MediaError as e:
        rows = [("errors", (name, e.kind, e.message))] if table in ("errors", "all") else []
    yield from rows


def file_rows(table: str, name: str, data: bytes, track: int | None = None) -> Iterator[tuple]:
    """Rows of a table of one file, of one track if asked; those of ``all`` side by side."""
    found = found_rows(table, name, data)
    rows = wide_rows(found) if table == "all" else (r for _, r in found)
    at = SCHEMAS[table].replace(" string", "").replace(" long", "").split(", ").index("track_id") if track is not None and "track_id" in SCHEMAS[table] else None
    yield from (r for r in rows if at is None or r[at] == track)


class Mp4Index(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4_index"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "tracks")]

    def reader(self, schema) -> DataSourceReader:
        return Mp4Reader(dict(self.options))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of the files below a path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mp4Index)
    return spark.read.format("mp4_index").option("table", table).load(path)


def tables_of(content: DataFrame, table: str) -> DataFrame:
    """The same tables from files as rows (path, content), as ``binaryFile`` gives them: works on any storage that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((path.as_py().rsplit("/", 1)[-1], content.as_py()) for b in batches for path, content in zip(b.column(0), b.column(1), strict=True))
        yield from table_batches(table, files)

    return content.select("path", "content").mapInArrow(run, SCHEMAS[table])


def table_batches(table: str, files: Iterable[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of files (name, content) in batches of ``AT_ONCE`` rows at most, each of one table: only its own columns are made of values."""
    schema = pa.schema([pa.field(n, ARROW[kind]) for n, kind in (c.split() for c in SCHEMAS[table].split(", "))])
    waiting: dict[str, list[tuple]] = {}

    def batch(kind: str) -> pa.RecordBatch:
        rows = waiting.pop(kind)
        own = dict(zip(names_of(kind), zip(*rows, strict=True), strict=True))
        if table == "all":
            own["table"] = [kind] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(rows), f.type) for f in schema], schema=schema)

    for name, data in files:
        for kind, row in found_rows(table, name, data):
            own = waiting.setdefault(kind, [])
            own.append(row)
            if len(own) == AT_ONCE:
                yield batch(kind)
    for kind in list(waiting):
        yield batch(kind)


def split_tables(together: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``all``, which is written once and then read by its columns."""
    written = materialise(together, "movies")
    return {t: written.where(F.col("table") == t).select(*names_of(t)) for t in [*INDEX, "errors"]}


def sample_index(tables: dict[str, DataFrame]) -> DataFrame:
    """All samples of all tracks: place, size, times, sync, dependencies and presentation index.

    Chunked samples come from the run-length tables, fragments follow them; everything here is windows and equi-joins.
    A written table's bytes say little of its rows (runs, and columns of few values), so no side of a join may be broadcast by them.
    """
    # Samples of a chunk follow each other: the n-th sample of a track lies in the chunk whose first sample is last at or before it.
    chunked = S.chunk_samples(S.chunk_map(tables["chunks"], tables["stsc"], KEYS), KEYS)
    steps = F.sequence(F.lit(0).cast("long"), F.col("samples_per_chunk") - 1)
    places = chunked.select(*KEYS, "chunk_no", "chunk_offset", "first_sample", F.explode(steps).alias("k")).withColumn("decode_index", F.col("first_sample") + F.col("k"))
    durations = S.expand_runs(tables["stts"], KEYS).select(*KEYS, F.col("i").alias("decode_index"), F.col("value").alias("duration"))
    shifts = S.expand_runs(tables["ctts"], KEYS).select(*KEYS, F.col("i").alias("decode_index"), F.col("value").alias("cto"))
    by = [*KEYS, "decode_index"]
    places = places.select(*by, "chunk_no", "chunk_offset")
    base = tables["sizes"].join(durations.hint("merge"), by).join(places.hint("merge"), by).join(shifts.hint("merge"), by, "left").join(tables["sdtp"].hint("merge"), by, "left")
    base = S.is_sync(S.sample_offsets(S.decode_times(base, KEYS), KEYS), tables["sync"].hint("merge"), KEYS)
    byte = F.coalesce("byte", F.when(F.col("is_sync"), 0x20).otherwise(0x10))
    base = base.select(*KEYS, "offset", "size", "dts", (F.col("dts") + F.coalesce("cto", F.lit(0))).alias("pts"), "duration", "is_sync", unpack_dependency(byte).alias("dependency"))
    fragments = S.fragment_samples(tables["frag_samples"], tables["trex"].hint("merge")).where("error IS NULL")
    fragments = fragments.select(*KEYS, "offset", "size", "dts", "pts", "duration", "is_sync", "dependency")
    both = base.unionByName(fragments)
    from pyspark.sql import Window

    order = Window.partitionBy(*KEYS).orderBy("dts", "offset")
    return S.presentation_order(both.withColumn("decode_index", (F.row_number().over(order) - 1).cast("long")), KEYS)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """The sample index of the files below a path."""
    return sample_index(split_tables(read_table(spark, path, "all")))


#: Samples whose bytes are cut from one copy of their file.
TOGETHER = 4096


def payloads(samples: DataFrame, content: DataFrame) -> DataFrame:
    """Adds each sample's bytes from files as rows (file_id, content); a short read has ``error`` set."""
    names = [c for c in samples.columns if c != "file_id"]
    part = F.call_function("div", F.col("decode_index"), F.lit(TOGETHER).cast("long"))
    groups = samples.groupBy("file_id", "track_id", part.alias("part")).agg(F.collect_list(F.struct(*names)).alias("own")).drop("track_id")
    joined = groups.join(content.select("file_id", "content").hint("merge"), "file_id")
    cut = lambda s: F.struct(*(s[n].alias(n) for n in names), F.col("content").substr((s["offset"] + 1).cast("int"), s["size"].cast("int")).alias("data"))
    found = joined.select("file_id", F.inline(F.transform("own", cut)))
    return found.withColumn("error", F.when(F.octet_length("data") != F.col("size"), "the file ends inside the sample"))


def read_payloads(samples: DataFrame, path: str) -> DataFrame:
    """The same from the files below a path: each task reads the ranges of its samples, in the order of the file."""
    folder = _local(path)

    def run(parts):
        import pandas as pd

        for p in parts:
            data = []
            for name, rows in p.groupby("file_id", sort=False):
                with open(folder if os.path.isfile(folder) else os.path.join(folder, name), "rb") as f:
                    for i, offset, size in zip(rows.index, rows["offset"], rows["size"], strict=True):
                        f.seek(int(offset))
                        data.append((i, f.read(int(size))))
            p = p.assign(data=pd.Series(dict(data), dtype=object))
            yield p.assign(error=[None if len(d) == n else "the file ends inside the sample" for d, n in zip(p["data"], p["size"], strict=True)])

    dealt = samples.repartition("file_id", F.call_function("div", F.col("decode_index"), F.lit(TOGETHER).cast("long"))).sortWithinPartitions("file_id", "offset")
    flat = samples.drop("dependency") if "dependency" in samples.columns else samples
    dealt = dealt.select(*flat.columns)
    schema = ", ".join(f"{n} {t}" for n, t in flat.dtypes)
    return dealt.mapInPandas(run, f"{schema}, data binary, error string")


# --- writing ----------------------------------------------------------------------------------

MOVIE_SCALE = 1000
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _table(kind: bytes, entries: list[bytes], version: int = 0) -> bytes:
    return full_box(kind, version, 0, struct.pack(">I", len(entries)), *entries)


def sample_tables(track: dict, rows: list[dict], offsets: list[int]) -> bytes:
    """stbl of a track: one sample in each chunk, 64-bit offsets."""
    video = track["kind"] == "Video"
    if video:
        head = bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HH", track["width"], track["height"]) + struct.pack(">II", 0x480000, 0x480000) + bytes(4) + struct.pack(">H", 1) + bytes(32) + struct.pack(">Hh", 24, -1)
    else:
        head = bytes(6) + struct.pack(">H", 1) + bytes(8) + struct.pack(">HH", track["channels"], 16) + bytes(4) + struct.pack(">I", track["timescale"] << 16 & 0xFFFFFFFF)
    entry = {"Hevc": b"hvc1", "Av1": b"av01", "Aac": b"mp4a"}[track["codec"]]
    shifts = [r["pts"] - r["dts"] for r in rows]
    parts = [
        full_box(b"stsd", 0, 0, struct.pack(">I", 1), box(entry, head, track["decoder_config"])),
        _table(b"stts", [struct.pack(">II", *r) for r in runs([r["duration"] for r in rows])]),
    ]
    if any(shifts):
        parts.append(_table(b"ctts", [struct.pack(">Ii", *r) for r in runs(shifts)], 1))
    parts += [
        _table(b"stsc", [struct.pack(">III", 1, 1, 1)] if rows else []),
        full_box(b"stsz", 0, 0, struct.pack(">II", 0, len(rows)), *(struct.pack(">I", len(r["data"])) for r in rows)),
        _table(b"co64", [struct.pack(">Q", o) for o in offsets]),
    ]
    if video:
        parts.append(_table(b"stss", [struct.pack(">I", i + 1) for i, r in enumerate(rows) if r["is_sync"]]))
    parts.append(full_box(b"sdtp", 0, 0, bytes(r["sdtp"] for r in rows)))
    return box(b"stbl", *parts)


def _trak(track: dict, rows: list[dict], offsets: list[int]) -> tuple[bytes, int]:
    end = rows[-1]["dts"] + rows[-1]["duration"] if rows else 0
    shown = max((r["pts"] + r["duration"] for r in rows), default=0) - track.get("priming", 0) - track.get("padding", 0)
    movie = max(0, shown) * MOVIE_SCALE // track["timescale"]
    video = track["kind"] == "Video"
    size = struct.pack(">II", track.get("width", 0) << 16, track.get("height", 0) << 16) if video else bytes(8)
    tkhd = full_box(b"tkhd", 1, 3, struct.pack(">QQIIQ", 0, 0, track["track_id"], 0, movie), bytes(8), struct.pack(">hhHH", 0, 0, 0 if video else 0x100, 0), MATRIX, size)
    edts = box(b"edts", full_box(b"elst", 1, 0, struct.pack(">IQqhh", 1, movie, track.get("priming", 0), 1, 0)))
    mdhd = full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, track["timescale"], end, 0x55C4, 0))
    hdlr = full_box(b"hdlr", 0, 0, bytes(4), b"vide" if video else b"soun", bytes(12), b"media\0")
    media_head = full_box(b"vmhd", 0, 1, bytes(8)) if video else full_box(b"smhd", 0, 0, bytes(4))
    dinf = box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1)))
    mdia = box(b"mdia", mdhd, hdlr, box(b"minf", media_head, dinf, sample_tables(track, rows, offsets)))
    return box(b"trak", tkhd, edts, mdia), movie


def build_file(tracks: list[dict], rows: list[dict]) -> bytes:
    """An MP4 file of tracks (track_id, kind, codec, timescale, width, height, channels, decoder_config, priming, padding) and
    samples in the order of writing (track_id, dts, pts, duration, is_sync, sdtp, data)."""
    for t in tracks:
        expected = 0
        for r in (r for r in rows if r["track_id"] == t["track_id"]):
            if r["duration"] <= 0 or not r["data"] or r["dts"] != expected or not -(1 << 31) <= r["pts"] - r["dts"] < 1 << 31:
                raise MediaError("InvalidInput", "a sample's times or data are invalid")
            expected += r["duration"]
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso6mp41")
    at = len(ftyp) + 16
    offsets: dict[int, list[int]] = {t["track_id"]: [] for t in tracks}
    for r in rows:
        offsets[r["track_id"]].append(at)
        at += len(r["data"])
    mdat = struct.pack(">I4sQ", 1, b"mdat", at - len(ftyp)) + b"".join(r["data"] for r in rows)
    traks, longest = [], 0
    for t in tracks:
        one, movie = _trak(t, [r for r in rows if r["track_id"] == t["track_id"]], offsets[t["track_id"]])
        traks.append(one)
        longest = max(longest, movie)
    mvhd = full_box(b"mvhd", 1, 0, struct.pack(">QQIQIH", 0, 0, MOVIE_SCALE, longest, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", max((t["track_id"] for t in tracks), default=0) + 1))
    return ftyp + mdat + box(b"moov", mvhd, *traks)


def write_files(samples: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows (file_id, content): each file assembled in one task from its samples and tracks, samples in order of ``write_no``.

    Tracks and samples come as one sorted stream, so a task holds the rows of one file and a batch.
    """
    heads = tracks.select("file_id", F.lit(0).alias("side"), F.lit(None).cast(samples.schema["write_no"].dataType).alias("write_no"), F.struct(*tracks.columns).alias("head"), F.lit(None).cast(samples.select(F.struct(*samples.columns).alias("s")).schema["s"].dataType).alias("sample"))
    own = samples.select("file_id", F.lit(1).alias("side"), "write_no", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), F.struct(*samples.columns).alias("sample"))
    dealt = heads.unionByName(own).repartition("file_id").sortWithinPartitions("file_id", "side", "write_no").select("file_id", "side", "head", "sample")

    def records(column: pa.StructArray) -> list[dict]:
        names = [f.name for f in column.type]
        return [dict(zip(names, r, strict=True)) for r in zip(*(column.field(i).to_pylist() for i in range(len(names))), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, files, size, own = [], [], 0, ([], [])
        for b in batches:
            ids, sides = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name, side, head, sample in zip(ids, sides, records(b.column(2)), records(b.column(3)), strict=True):
                if not names or names[-1] != name:
                    if names:
                        files.append(build_file(*own))
                        size += len(files[-1])
                    if size >= FILES_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.binary())], ["file_id", "content"])
                        names, files, size = [], [], 0
                    names.append(name)
                    own = ([], [])
                own[side].append(sample if side else head)
        if names:
            files.append(build_file(*own))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.binary())], ["file_id", "content"])

    return dealt.mapInArrow(run, "file_id string, content binary")
