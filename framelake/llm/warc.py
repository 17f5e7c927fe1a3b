"""WARC archives: a writer, and a Python data source that reads headers first.

Writing is a DataFrame plan up to one string per record; payloads stay where they are, as only digests meet. The data source then
writes each record as a gzip member of its own, as is customary, so that a reader can start at any record whose place it knows.
A file ends behind ``FILE_BYTES``. A task writes under a name that readers pass over; the driver gives the files of tasks
that succeeded their names, so a lost executor leaves nothing behind.

Reading plans whole files into partitions of about ``split_bytes``. Predicates on
``file``, ``warc_type``, ``record_id``, ``target_uri``, ``refers_to``, ``payload_digest``
and ``content_length`` are pushed down: a record's header is parsed first, and the body of a
record that no predicate admits is passed over undecoded, as are all bodies with
the option ``payload`` set to ``false``.

Defined results: a null payload is empty; equal payloads of at least
``MIN_REVISIT`` bytes are written once, under the smallest id, and the others
revisit it; rows that repeat the smallest id are responses too, as are rows with a
null id; line ends in a URL are percent-encoded and its other control characters dropped; a null URL has no
target header; an empty table writes an archive without records; bytes after the
last complete record raise an error.
"""

from __future__ import annotations

import gzip
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from framelake.llm.common import broadcast_if_small, text_or_empty
from framelake.session import materialise

MIN_REVISIT = 100
SALTS = 32
#: Bytes behind which a file ends.
FILE_BYTES = 1 << 30
END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "file string, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, payload_bytes long, payload string"


def record_uri(key: Column) -> Column:
    return F.concat(F.lit("<urn:framelake:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def record_key(uri: str) -> Column:
    """The id in a record's URI."""
    return F.regexp_extract(uri, r"^<urn:framelake:(-?\d+)>$", 1).try_cast("long")


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """``row``, ``payload``, ``digest`` and ``first``: the id of the record that a row revisits, or null.

    Only digests that occur twice stay on the small side. It is broadcast where it is small; else it is there once per
    salt, so one payload that fills a third of the table is dealt over many tasks.
    """
    body = text_or_empty(payload)
    rows = pages.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    long = F.octet_length(body) >= MIN_REVISIT
    firsts = (
        pages.where(long)
        .select(F.col(key).cast("long").alias("key"), F.sha2(body, 256).alias("digest"))
        .groupBy("digest")
        .agg(F.min("key").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("first_digest"), "first")
    )
    firsts = materialise(firsts, "firsts")
    small = broadcast_if_small(firsts)
    if small is not firsts:
        met = rows.join(small, F.col("digest") == F.col("first_digest"), "left")
    else:
        salted = firsts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("first_salt"))
        salt = F.pmod(F.xxhash64("key", "digest"), F.lit(SALTS)).cast("int")
        met = rows.join(salted, (F.col("digest") == F.col("first_digest")) & (salt == F.col("first_salt")), "left")
    return met.select("row", "key", "payload", "digest", F.when(F.col("first") < F.col("key"), F.col("first")).alias("first"))


def records(found: DataFrame, url: str = "url") -> DataFrame:
    """One string per record, without the two line ends that close it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(F.col("first").isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    target = F.col("row").getField(url)
    clean = F.translate(target, "".join(map(chr, [*range(32), 127])), "")
    target = F.when(target.rlike(r"[\x00-\x1f\x7f]"), F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))).otherwise(target)
    target = F.when(target.rlike(r"[\x00-\x1f\x7f]"), clean).otherwise(target)

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")

    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(F.col("first").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", record_uri(F.col("key"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(F.col("first").isNotNull(), PROFILE)),
        line("WARC-Refers-To", F.when(F.col("first").isNotNull(), record_uri(F.col("first")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return found.select(F.concat(head, block).alias("value"))


def write_archive(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write one record per row below ``path``."""
    pages.sparkSession.dataSource.register(WarcSource)
    records(revisits(pages, key, payload), url).write.format("warc").mode("append").save(path)


@dataclass
class FilePlan(InputPartition):
    files: tuple[str, ...]


def _store(uri: str):
    """(file system or None, path) of a URI; None is the local or mounted disk."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path) if parts.scheme else uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def list_files(uri: str) -> list[tuple[str, int]]:
    """Data files below a folder, with their sizes."""
    store, path = _store(uri)
    if store is None:
        if os.path.isfile(path):
            return [(path, os.path.getsize(path))]
        found = [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n[0] not in "._"]
        return sorted((p, os.path.getsize(p)) for p in found)
    from pyarrow import fs

    scheme = urlsplit(uri).scheme
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f"{scheme}://{f.path.lstrip('/')}", f.size) for f in found if f.is_file and f.base_name[0] not in "._")


def _open(uri: str) -> io.BufferedIOBase:
    store, path = _store(uri)
    raw = open(path, "rb") if store is None else store.open_input_stream(path)
    if path.endswith(".gz"):
        return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
    return io.BufferedReader(raw, 1 << 20) if store is None else raw


def admits(filters: list[Filter], values: dict) -> bool:
    """Whether a record's header fields pass every pushed predicate."""
    for f in filters:
        x = values.get(f.attribute[0])
        if isinstance(f, EqualNullSafe):
            ok = x == f.value
        elif isinstance(f, IsNotNull):
            ok = x is not None
        elif x is None:
            ok = False
        elif isinstance(f, EqualTo):
            ok = x == f.value
        elif isinstance(f, In):
            ok = x in f.value
        elif isinstance(f, StringStartsWith):
            ok = x.startswith(f.value)
        elif isinstance(f, GreaterThan):
            ok = x > f.value
        elif isinstance(f, GreaterThanOrEqual):
            ok = x >= f.value
        elif isinstance(f, LessThan):
            ok = x < f.value
        else:
            ok = x <= f.value
        if not ok:
            return False
    return True


def parse_headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The next record's header lines, or None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a header ends early")
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return fields


def pass_over(stream: io.BufferedIOBase, n: int) -> None:
    """Skip n bytes without keeping or decoding them."""
    while n:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("a record ends early")
        n -= got


def split_http(block: bytes) -> tuple[int | None, bytes]:
    """(declared length, body) of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return None, body


class WarcReader(DataSourceReader):
    PUSHED = (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
    FIELDS = {"file", "warc_type", "record_id", "target_uri", "refers_to", "payload_digest", "content_length"}

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split_bytes", 32 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, self.PUSHED) and len(f.attribute) == 1 and f.attribute[0] in self.FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        plans: list[FilePlan] = []
        group: list[str] = []
        size = 0
        for name, n in list_files(self.path):
            if group and size + n > self.split:
                plans.append(FilePlan(tuple(group)))
                group, size = [], 0
            group.append(name)
            size += n
        return plans + [FilePlan(tuple(group))] * bool(group) or [FilePlan(())]

    def read(self, partition: FilePlan) -> Iterator[tuple]:
        for name in partition.files:
            with _open(name) as stream:
                while (fields := parse_headers(stream)) is not None:
                    length = int(fields["content-length"])
                    digest = fields.get("warc-payload-digest")
                    values = {
                        "file": name,
                        "warc_type": fields.get("warc-type"),
                        "record_id": fields.get("warc-record-id"),
                        "target_uri": fields.get("warc-target-uri"),
                        "refers_to": fields.get("warc-refers-to"),
                        "payload_digest": digest.removeprefix("sha256:") if digest else None,
                        "content_length": length,
                    }
                    if not admits(self.filters, values):
                        pass_over(stream, length)
                        continue
                    body = size = None
                    if self.payload or values["warc_type"] == "revisit":
                        block = stream.read(length)
                        if len(block) < length:
                            raise ValueError("a record ends early")
                        size, body = split_http(block) if "http" in fields.get("content-type", "") else (length, block)
                        body = body.decode("utf-8", "replace") if values["warc_type"] != "revisit" and self.payload else None
                    else:
                        pass_over(stream, length)
                    yield (*values.values(), size, body)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, by the names that readers pass over."""

    files: tuple[str, ...]


class WarcWriter(DataSourceWriter):
    """Rows of one column, a record each without the line ends that close it."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = _store(self.path)
        part, files, out, size = TaskContext.get().partitionId(), [], None, 0
        for row in rows:
            if out is None or size > self.file_bytes:
                if out is not None:
                    out.close()
                files.append(f"{folder}/.part-{part:05}-{len(files):05}-{uuid.uuid4().hex}.warc.gz")
                out, size = self._create(store, folder, files[-1]), 0
            member = gzip.compress((row[0] + END).encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.write(member)
            size += len(member)
        if out is not None:
            out.close()
        return Written(tuple(files))

    @staticmethod
    def _create(store, folder: str, name: str):
        if store is None:
            os.makedirs(folder, exist_ok=True)
            return open(name, "wb")
        store.create_dir(folder, recursive=True)
        return store.open_output_stream(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _store(self.path)
        if store is None:
            os.makedirs(folder, exist_ok=True)
        else:
            store.create_dir(folder, recursive=True)
        for name in (f for m in messages if m is not None for f in m.files):
            known = f"{folder}/{name.rsplit('/', 1)[1][1:]}"
            os.rename(name, known) if store is None else store.move(name, known)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _store(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            os.remove(name) if store is None else store.delete_file(name)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload`` and ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options))


def read_archive(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The records below ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
