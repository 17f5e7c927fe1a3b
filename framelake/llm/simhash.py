"""SimHash near-duplicates through Golay-code fuzzy hashing.

The binary Golay code of length 23 is perfect: each word lies within three bits of
exactly one codeword. The codewords nearest to a word and to its 23 one-bit
neighbours are one to six in number, and two words that differ in at most two
bits always have such a codeword in common. A key joins the exact bits of one
segment of a fingerprint with a codeword index (12 bits) of another.

``fingerprint_groups`` links 64-bit fingerprints at two or fewer differing bits.
Of three segments, two errors leave one exact, and the next has two at most, so
each linked pair meets in a key: none is lost. Buckets of more than ``BUCKET``
fingerprints are not paired off: each of their fingerprints goes to the 65 words within
one bit of it, where any two that meet differ in two bits at most and all that
differ so meet; linking to the least there gives the same components from 65
rows each.

``similar_groups`` links texts whose sets of word shingles have a Jaccard similarity
of ``similarity`` or more. Texts with the same words are one class, and classes meet in keys of two kinds:
``TABLES`` tables of one exact and one Golay segment of a wide fingerprint of word pairs, which stay
close under scattered edits, and ``BANDS`` bands of ``ROWS`` minima of the shingle sets, whose
chance depends on the Jaccard similarity alone: 1 - (1 - 0.8 ** 6) ** 24, over 0.999 at 0.8.
What meets is verified on exact shingle sets, in rounds that grow with the number of keys:

1. every bucket pairs its members with one leader, drawn by a hash, so each bucket has its own;
2. buckets of more than ``PAIRED`` members do so again with other leaders, for members that are still apart;
3. members of smaller buckets that are still apart are paired, ``PAIRED`` at most for a key;
4. for the members of larger buckets an exact join takes the place of pairs: shingles are ordered from
   rare to frequent, and two similar sets share one among the first few of both. Of near copies of one text
   the shingles of their own edits come first; where texts still meet, the parities of their elements over
   ``PARITY`` hashed places differ in no more places than the sets do, so most pairs end there.

Defined results: null and empty texts have fingerprint zero and form one group;
a text with fewer words than a shingle is one shingle; repeated rows are in one
group; a null id never is a group's id unless all of its ids are null; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import broadcast_if_small, lower_ascii, text_or_empty, words_of
from framelake.llm.graph import components
from framelake.session import materialise, release

SEED = 42
BUCKET = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
#: Exact bits and Golay bits of a table of similar_groups, and the number of tables.
EXACT, FUZZY, TABLES = 20, 23, 8
#: Bands of similar_groups and the minima that have to agree in one.
BANDS, ROWS = 24, 6
WORDS64 = -(-(EXACT + FUZZY) * TABLES // 64)
#: Members of a bucket of similar_groups up to which those still apart are paired off, and rounds of leaders in larger ones.
PAIRED, LEADERS = 8, 2
#: Places of the parities of a set, in words of 64.
PARITY = 256
#: Differing bits of 64 beyond which two texts can't be similar: five deviations above the mean at similarity 0.8.
FAR_BITS = 24


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of 23-bit words by byte, as three tables of 256, and the error for each of 2048 remainders."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    single = [remainder(1 << i) for i in range(23)]
    by_byte = np.zeros((3, 256), dtype=np.uint32)
    for place in range(3):
        for value in range(256):
            for i in range(8):
                if value >> i & 1 and 8 * place + i < 23:
                    by_byte[place, value] ^= single[8 * place + i]
    errors = np.zeros(2048, dtype=np.uint32)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                pattern = 1 << i | 1 << j | 1 << k
                found = 0
                for b in {i, j, k}:
                    found ^= single[b]
                errors[found] = pattern
    return by_byte, errors


def nearest_codewords(words: np.ndarray) -> np.ndarray:
    """Codeword indices of each 23-bit word and its one-bit neighbours: (n, 24), repeats as -1, each row sorted."""
    by_byte, errors = _golay()
    flips = np.array([0, *(1 << i for i in range(23))], dtype=np.uint32)
    near = words.astype(np.uint32)[:, None] ^ flips
    rest = by_byte[0, near & 255] ^ by_byte[1, near >> 8 & 255] ^ by_byte[2, near >> 16 & 127]
    index = np.sort((near ^ errors[rest]) >> 11, axis=1).astype(np.int64)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return index


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words of the text, A-Z lower-cased, in order."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), dtype=np.uint64)


def majority_bits(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits set in over half of the hashes, as ``words`` unsigned 64-bit words.

    Words after the first come from the hashes by a mixing step (that of SplitMix64).
    """
    out = np.zeros(words, dtype=np.uint64)
    for w in range(words if len(hashes) else 0):
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 15):
            h = hashes[at : at + (1 << 15)]
            if w:
                h = h + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]
    return out


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A negative long for each band of a set of shingle hashes; table keys are not negative."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12), None] * _factors()).min(axis=0))
    raw = least.astype("<u8").tobytes()
    found = [xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) | 1 << 63 for i in range(BANDS)]
    return np.array(found, dtype="<u8").view("<i8")


def fingerprints(docs: DataFrame, size: int = 3, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and 64-bit fingerprint (as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([majority_bits(shingle_hashes(t or "", size))[0] for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long"), text_or_empty(text)).mapInArrow(run, "doc_id long, fingerprint long")


def golay_keys(distinct: DataFrame) -> DataFrame:
    """Rows (bucket, fingerprint): the keys of each distinct 64-bit fingerprint."""
    places = [(0, 21), (21, 21), (42, 22)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [(f >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in places]
            for a in range(3):
                index = nearest_codewords(parts[(a + 1) % 3])
                keys = np.where(index < 0, -1, a << 40 | parts[a][:, None] << 12 | index)
                real = keys >= 0
                yield pa.RecordBatch.from_arrays([pa.array(keys[real]), pa.array(np.repeat(f.view(np.int64), real.sum(axis=1)))], ["bucket", "fingerprint"])

    return distinct.select("fingerprint").mapInArrow(run, "bucket long, fingerprint long")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that connect all fingerprints at two or fewer differing bits."""
    keys = materialise(golay_keys(distinct), "golay")
    crowded = broadcast_if_small(materialise(keys.groupBy("bucket").count().where(F.col("count") > BUCKET).select("bucket"), "crowded"))
    few = keys.join(crowded, "bucket", "left_anti")
    a, b = few.select("bucket", F.col("fingerprint").alias("u")), few.select("bucket", F.col("fingerprint").alias("v"))
    paired = a.join(b, "bucket").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v").distinct()
    many = keys.join(crowded, "bucket", "left_semi").select("fingerprint").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = many.select("fingerprint", F.explode(flips).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("word"))
    # At most 65 distinct fingerprints are within one bit of a word.
    stars = near.groupBy("word").agg(F.min("fingerprint").alias("v"), F.collect_set("fingerprint").alias("all")).where(F.size("all") > 1)
    return paired.unionByName(stars.select(F.explode("all").alias("u"), "v").where("u <> v").distinct())


def fingerprint_groups(docs: DataFrame, *, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ``fingerprint`` (hex) and ``component_id`` (least key of its group)."""
    found = materialise(fingerprints(docs, size, text=text, key=key), "fingerprints")
    distinct = materialise(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fingerprint").alias("f"), "component_id")
    out = found.join(named, F.col("fingerprint") == F.col("f"))
    return out.select(F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# --- groups by the similarity of shingle sets -------------------------------------------------


def word_class(text: str) -> Column:
    """A long that texts share which have the same words, A-Z lower-cased, in order."""
    return F.xxhash64(words_of(lower_ascii(text_or_empty(text))))


def _sketches(classes: DataFrame, size: int) -> DataFrame:
    """Per class: number of distinct shingles, the wide fingerprint of its word pairs, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, prints, bands = [], [], []
            for t in b.column(1).to_pylist():
                hashes = np.unique(shingle_hashes(t, size))
                counts.append(len(hashes))
                bands.append(band_keys(hashes).tobytes())
                prints.append(majority_bits(np.unique(shingle_hashes(t, 2)), WORDS64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(prints, pa.binary()), pa.array(bands, pa.binary())], ["node", "n", "print", "bands"])

    return classes.mapInArrow(run, "node long, n int, print binary, bands binary")


def _table_keys(sketches: DataFrame) -> DataFrame:
    """Rows (bucket, node, n, head) of each class; ``head`` is 64 bits of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
            head = raw[:, :8].copy().view("<i8")[:, 0]
            own = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(np.repeat(x, BANDS)) for x in (nodes, n, head))], ["bucket", "node", "n", "head"])
            for t in range(TABLES):
                at = t * (EXACT + FUZZY)
                exact = bits[:, at : at + EXACT] @ (1 << np.arange(EXACT))
                index = nearest_codewords(bits[:, at + EXACT : at + EXACT + FUZZY] @ (1 << np.arange(FUZZY)))
                keys = np.where(index < 0, -1, t << (EXACT + 12) | exact[:, None] << 12 | index)
                real = keys >= 0
                times = real.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[real]), pa.array(np.repeat(nodes, times)), pa.array(np.repeat(n, times)), pa.array(np.repeat(head, times))], ["bucket", "node", "n", "head"])

    return sketches.select("node", "n", "print", "bands").mapInArrow(run, "bucket long, node long, n int, head long")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, size: int, text: str) -> DataFrame:
    """Rows (node, shingles, odd) of the classes among ``nodes``: one text of each is cut."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t, size)) for t in b.column(1).to_pylist()]
            odd = [np.packbits(np.bincount((h % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).view("<i8") for h in found]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.view(np.int64) for h in found], lists), pa.array(odd, lists)], ["node", "shingles", "odd"])

    texts = docs.select(word_class(text).alias("node"), text_or_empty(text).alias("t"))
    wanted = texts.join(broadcast_if_small(nodes), "node", "left_semi").groupBy("node").agg(F.min("t").alias("t"))
    return wanted.mapInArrow(sets, "node long, shingles array<bigint>, odd array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) of classes whose shingle sets are similar enough, written."""
    ends = materialise(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends")
    shingles = materialise(sets.join(broadcast_if_small(ends), "node", "left_semi").select("node", "shingles"), "shingles")
    left = pairs.join(shingles.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(shingles.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    found = materialise(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"), "similar")
    release(ends, shingles)
    return found


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs (u, v) of rows (node, root, shingles, odd) that can be similar enough and have different roots.

    Elements are ordered by how many sets hold them. If two sets are similar, their first common element is
    among the first ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller and the first ``n - ceil(t n) + 1`` of the
    larger, and enough elements are left behind it in both.
    """
    t = similarity

    def least(x: Column) -> Column:
        return F.ceil(x - F.lit(1e-9)).cast("int")

    sets = materialise(sets, "crowd")
    flat = materialise(sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token")), "tokens")
    often = materialise(flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    # An element of one set only meets nothing; it takes a place before all others.
    ranked = flat.join(often, "token").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"))
    ranked = ranked.select("node", "root", "n", (F.col("n") - F.size("order")).alias("alone"), "order")
    placed = ranked.withColumn("reach", F.col("n") - least(F.col("n") * t) + 1).where("alone < reach")
    first = F.slice("order", F.lit(1), F.col("reach") - F.col("alone"))
    marked = placed.select("node", "root", "n", "alone", first.alias("first")).join(sets.select(F.col("node").alias("o"), "odd"), F.col("node") == F.col("o"))
    rows = marked.select("node", "root", "n", "odd", "alone", F.posexplode(F.transform("first", lambda x: x["token"])).alias("at", "token"))
    rows = materialise(rows.select("token", "node", "root", "n", "odd", (F.col("at") + F.col("alone")).alias("at")), "prefixes")
    release(sets, flat, often)
    small = rows.where(F.col("at") <= F.col("n") - least(F.col("n") * (2 * t / (1 + t))))
    names = ("node", "root", "n", "at", "odd")
    a, b = small.select("token", *(F.col(c).alias(f"{c}1") for c in names)), rows.select("token", *(F.col(c).alias(f"{c}2") for c in names))
    smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
    left = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    fits = (F.col("n1") >= least(F.col("n2") * t)) & (left >= least((F.col("n1") + F.col("n2")) * (t / (1 + t))))
    apart = F.bit_count(F.get("odd1", F.lit(0)).bitwiseXOR(F.get("odd2", F.lit(0))))
    for i in range(1, PARITY // 64):
        apart = apart + F.bit_count(F.get("odd1", F.lit(i)).bitwiseXOR(F.get("odd2", F.lit(i))))
    both = F.col("n1") + F.col("n2")
    fits = fits & (apart <= both - 2 * least(both * (t / (1 + t))))
    met = a.join(b, "token").where(smaller & fits & (F.col("root1") != F.col("root2")))
    found = materialise(met.select(F.greatest("node1", "node2").alias("u"), F.least("node1", "node2").alias("v")).distinct(), "met")
    release(rows)
    return found


def _rooted(keys: DataFrame, links: DataFrame) -> DataFrame:
    """The keys with the root that the links give their class so far."""
    roots = components(links).select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
    return keys.join(roots, F.col("node") == F.col("r_node"), "left").select("bucket", "node", "n", "head", "c", F.coalesce("r_root", "node").alias("root"))


def similar_classes(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """Rows (node, root): for each class of texts that links to others, the least class it reaches."""
    classes = docs.select(word_class(text).alias("node"), text_or_empty(text).alias("t"))
    sketches = materialise(_sketches(classes, size).where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("print").alias("print"), F.max("bands").alias("bands")), "sketches")
    keys = materialise(_table_keys(sketches), "tables")
    release(sketches)
    near = (F.least("n", "n2") >= similarity * F.greatest("n", "n2")) & (F.bit_count(F.col("head").bitwiseXOR(F.col("head2"))) <= FAR_BITS)

    def leaders(rows: DataFrame, turn: int, *more: str) -> DataFrame:
        drawn = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("draw"), "node", "n", "head", *more)).alias("f")
        found = rows.groupBy("bucket").agg(drawn, F.count("*").alias("c")).where("c > 1")  # buckets of one need no join
        named = {"node": "v", "n": "n2", "head": "head2", "root": "root2"}
        return materialise(found.select(F.col("bucket").alias("b"), "c", *(F.col(f"f.{c}").alias(named[c]) for c in ("node", "n", "head", *more))), "leaders")

    def tried(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct(), "pairs")
        found = _verified(pairs, sets, similarity)
        release(pairs)
        return found

    first = leaders(keys, 0)
    # Only classes that meet another need their sets.
    meeting = materialise(keys.join(first.select("b"), F.col("bucket") == F.col("b"), "left_semi").select("node").distinct(), "meeting")
    sets = materialise(_shingle_sets(docs, meeting, size, text), "sets")
    links = tried(keys.join(first, F.col("bucket") == F.col("b")).where((F.col("node") != F.col("v")) & near))
    # In a bucket of two the pair with its leader is the only one.
    shared = materialise(keys.join(first.where("c > 2").select("b", "c"), F.col("bucket") == F.col("b")).drop("b"), "shared")
    release(keys, first)
    for turn in range(1, LEADERS):
        crowded = materialise(_rooted(shared.where(F.col("c") > PAIRED), links), "crowded")
        chosen = leaders(crowded, turn, "root").drop("c")
        apart = (F.col("root") != F.col("root2")) & near
        links = links.unionByName(tried(crowded.join(chosen, F.col("bucket") == F.col("b")).where(apart)))
        release(crowded)
    owned = materialise(_rooted(shared, links), "owned")
    release(shared)
    few = owned.where(F.col("c") <= PAIRED)
    other = few.select(F.col("bucket").alias("b"), F.col("node").alias("v"), F.col("n").alias("n2"), F.col("head").alias("head2"), F.col("root").alias("root2"))
    pairs = few.join(other, F.col("bucket") == F.col("b")).where((F.col("node") > F.col("v")) & (F.col("root") != F.col("root2")) & near)
    many = materialise(owned.where(F.col("c") > PAIRED).select("node", "root").distinct(), "many")
    exact = prefix_pairs(sets.join(many.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).drop("m"), similarity)
    links = links.unionByName(tried(pairs.select("node", "v").unionByName(exact.select(F.col("u").alias("node"), "v"))))
    release(sets, meeting, owned, many, exact)
    return components(links)


def similar_groups(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key and ``component_id``, the least key of its group of similar texts.

    A document is judged by its text, whatever else stands under its key.
    """
    roots = materialise(similar_classes(docs, size=size, similarity=similarity, text=text), "roots")
    named = docs.select(F.col(key).cast("long").alias("own_key"), word_class(text).alias("own"))
    rooted = materialise(named.join(broadcast_if_small(roots), F.col("own") == F.col("node"), "left").select("own_key", F.coalesce("root", "own").alias("root")), "rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("own_key").alias("component_id")).withColumnRenamed("root", "r"), "ids")
    return rooted.join(ids, F.col("root") == F.col("r")).select(F.col("own_key").alias(key), "component_id")
