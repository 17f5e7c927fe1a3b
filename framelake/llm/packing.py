"""Best-fit packing of token pieces, planned over the histogram of their lengths.

Documents become pieces of at most ``size`` tokens (only longer documents are cut,
their first piece may be shorter). The plan is made from the counts of each length,
at most ``size`` rows whatever the number of documents: best fit, decreasing,
places runs of equal lengths into runs of equally filled sequences. A piece finds
its slot by its length and its rank among the pieces of that length: the slots of a length are runs of ranks, found by
bisection in a table that follows the number of lengths, not of pieces. Ranks come
from counts per (length, salt), with more salts for more pieces, so a length that most pieces share is ranked in
many tasks.

Defined results: a null or empty text is its end token alone; repeated rows are
packed each on its own; equal pieces are ranked by key, piece and checksum; an
empty table packs into nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import broadcast_if_small, text_or_empty
from framelake.session import materialise

#: Entries of the cache of words that a worker keeps; it is emptied when full.
CACHE = 300_000
#: Parts that a length is ranked in at least and at most, and the pieces for which there is one more.
SALTS, MOST_SALTS, SALT_ROWS = 64, 1 << 14, 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
#: GPT-2 style split of a byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of a byte-level BPE file, word by word with a bounded cache.

    A single space between two characters that aren't white space always starts
    a pre-token, so the words between such spaces have their own ids.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(letter[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.cache: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        ids = np.array(self.encode(word), dtype="<u4").tobytes()
        if len(word) <= 64:
            self.cache[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                get, make = self.cache.get, self._ids
                first, *rest = self.split(part)
                out.append(get(first) or make(first))
                out += [get(w) or make(w) for w in map(" ".__add__, rest)]
        return b"".join(out)


@lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def cuts(length: int, size: int) -> list[int]:
    """Lengths of the pieces of a document: whole ones, and what remains in front."""
    if length <= size:
        return [length]
    return [length % size] * bool(length % size) + [size] * (length // size)


def token_pieces(docs: DataFrame, path: str, *, size: int = 2048, end: int = 0, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of each document: place, length and CRC-32 of the ids, and the ids if wanted."""
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for b in batches:
            out: list[list] = [[] for _ in kind]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, start = bpe(t or "") + tail, 0
                for i, n in enumerate(cuts(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + n)]
                    for x, v in zip(out, (doc, i, start, n, zlib.crc32(part), np.frombuffer(part, dtype="<i4") if with_ids else None), strict=True):
                        x.append(v)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kind, strict=True)], schema=kind)

    found = docs.select(F.col(key).cast("long"), text_or_empty(text)).mapInArrow(run, PIECES)
    return found if with_ids else found.drop("ids")


def best_fit(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots for counts of lengths: rows (length, first rank, pieces, first sequence, sequences, offset).

    The pieces of a row fill its sequences in turn, one layer of ``length`` after
    another. Also gives the number of sequences. Lengths go from long to short,
    each into the sequences with the least room that suffices.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of sequences
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fitting = sorted(r for r, runs in room.items() if r >= length and runs)
        while left:
            space = fitting.pop(0) if fitting else size
            runs, keep = (room.pop(space), False) if space in room and room[space] else ([], True)
            layers = space // length
            if keep:  # nothing fits: new sequences
                runs = [(opened, -(-left // layers))]
                opened += runs[0][1]
            rest = []
            for first, n in runs:
                full = min(n, left // layers)
                if full:
                    rows.append((length, rank, full * layers, first, full, size - space))
                    room[space - layers * length].append((first, full))
                    rank, left, first, n = rank + full * layers, left - full * layers, first + full, n - full
                if n and left:  # fewer pieces than one more sequence holds
                    rows.append((length, rank, left, first, 1, size - space))
                    room[space - left * length].append((first, 1))
                    rank, left, first, n = rank + left, 0, first + 1, n - 1
                if n:
                    rest.append((first, n))
            if rest:
                room[space] += rest
        room.pop(0, None)
    return rows, opened


def pack(pieces: DataFrame, *, size: int = 2048) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset``; ``pieces`` should be a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    rows, _ = best_fit(counts, size)
    slots = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast((slots[:, 0] << 40 | slots[:, 1], slots))
    salts = min(MOST_SALTS, max(SALTS, max(counts.values(), default=0) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order))
    ranked = ranked.join(broadcast_if_small(materialise(offsets, "offsets")), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("salt", "nth", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = plan.value
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            s = table[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            layer, across = np.divmod(rank - s[:, 1], s[:, 4])
            b = b.append_column("sequence_id", pa.array(s[:, 3] + across))
            yield b.append_column("offset", pa.array(s[:, 5] + layer * length))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").drop("rank")


def pack_documents(docs: DataFrame, path: str, *, size: int = 2048, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Tokenise and pack; the pieces are written once, since counts and placement both read them."""
    pieces = token_pieces(docs, path, size=size, text=text, key=key, with_ids=with_ids)
    return pack(materialise(pieces, "pieces"), size=size)
