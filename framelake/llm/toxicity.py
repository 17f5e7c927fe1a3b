"""Toxicity from class-conditional Kneser-Ney models of word pairs.

Two interpolated bigram models, of toxic and of ordinary training texts: a pair is discounted and backs off to its
second word, whose probability in a class follows the number of distinct words it follows there (so a copied text
counts once), is discounted and backs off to the same counts over both classes together, and those
to an even share for words never seen. Every token of a text is scored under both models with the full
backoff. As logarithms the two differ by

    log p(w | v, toxic) - log p(w | v, ordinary) = A(v) + B(w) + C(v, w),

of the backoff weights of v, of the backed-off probabilities of w, and of a pair that was seen. The end of a text is a
token as well, so each word is on both sides. So the model is one
table of keys, of words (B + A) and of pairs (C), and the difference of a text is a sum over its keys.

Plain sums drown a few telling words in the noise of many rare ones. So the sum is kept in two parts: the
expressions that training texts tell apart (smoothed counts differ by ``NATS`` or more, where both classes together
lend ``PRIOR`` occurrences in the smaller class), and all others. Both parts are divided by the
text's length; a logistic curve over them, fitted on at most ``FIT_ROWS`` labelled rows of a fold that is not counted, weighs them.

The model grows with the training texts and stays in the cluster. At most ``HOT`` frequent keys are broadcast, and a
filter of fixed size (``FILTER_BITS``; left out where it would be full) spares keys that are not in the model the join; the others
meet the model in an equi-join.

Defined results: null and empty texts score as texts without evidence; rows without
a label, or with a null one, are not learned from, nor are those whose checksum
modulo 5 is 0; a row labelled twice counts as toxic if either label says so; without
training texts of both classes every score is 0; repeated rows score alike, each
on its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import broadcast_if_small, text_or_empty
from framelake.session import materialise, materialise_parts, release

#: Letters and digits.
TOKEN = re.compile(r"[^\W_]+")
DISCOUNT = 0.75
#: Nats by which an expression must differ between the classes to be told apart, and the occurrences lent.
NATS, PRIOR = 1.0, 2.0
#: Most labelled rows that the logistic curve is fitted on, and the fold they come from.
FIT_ROWS, FIT_FOLD = 20_000, 1
FOLDS = 5
#: Most words and keys that are broadcast, and the size of the filter.
HOT_WORDS, HOT, FILTER_BITS = 1 << 16, 1 << 20, 1 << 27
#: Texts that one step of a worker holds.
PART_ROWS = 500
#: Slices in which documents meet the model, and rare pairs their words, one after the other: their keys are shuffled, which takes disk.
SLICES, PAIR_SLICES = 4, 2


def fold(key: Column) -> Column:
    """The checksum of the key as text, modulo the folds; 0 is held out, and a null key too."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS, F.lit(0))


def text_hash(text: Column) -> Column:
    """Tells apart texts that share a key."""
    return F.xxhash64(text_or_empty(text))


# --- keys ---


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of eight bytes."""
    # The five primes of XXH64.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n)
    h = (seed + p5 + np.uint64(8)) ^ turned(x * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The 64-bit key of two numbers, in order: what ``xxhash64`` of both is in SQL."""
    return _hash_long(right, _hash_long(left, np.full(len(left), 42, dtype=np.uint64)))


#: The hashes of a text's start and end; and the second number of a word's key, where pairs have a hash.
START, END, AS_WORD = 0, 1, 2


def tokenised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the tokens of all texts as places in them, the text of each, and the place before it.

    The last two hashes are those of a start and an end. A text without words has no tokens.
    """
    seen: dict[str, int] = {}
    parts = [[seen.setdefault(w, len(seen)) for w in TOKEN.findall(t.lower())] for t in texts]
    sizes = np.array([len(p) + 1 if p else 0 for p in parts], dtype=np.int64)
    tokens = np.fromiter((w for p in parts if p for w in chain(p, (-1,))), dtype=np.int64, count=int(sizes.sum()))
    tokens[tokens < 0] = len(seen) + 1
    hashes = np.empty(len(seen) + 2, dtype=np.uint64)
    hashes[:-2] = np.fromiter(map(xxhash.xxh64_intdigest, seen), dtype=np.uint64, count=len(seen))
    hashes[-2:] = START, END
    before = np.concatenate([[len(seen)], tokens[:-1]]) if len(tokens) else tokens
    before[before == len(seen) + 1] = len(seen)
    return hashes, tokens, np.repeat(np.arange(len(texts)), sizes), before


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PART_ROWS):
            yield b.slice(at, PART_ROWS)


# --- the model ---


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    return labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("known_id")).agg(F.max(F.col(label)).cast("int").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Labelled documents of the folds that are counted: ``doc_id``, ``t``, ``toxic``."""
    learn = docs.where(~fold(F.col(key)).isin(0, FIT_FOLD)).select(F.col(key).alias("doc_id"), text_or_empty("text").alias("t"))
    return learn.join(broadcast_if_small(materialise(labelled(labels, key, label), "labels")), F.col("doc_id") == F.col("known_id")).select("doc_id", "t", "toxic")


def count_pairs(rows: DataFrame) -> DataFrame:
    """Rows (v, w, toxic, plain): pairs of word hashes with their counts in toxic and in ordinary texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            hashes, words, text, before = tokenised(b.column(0).to_pylist())
            pair, at, which = np.unique(before * len(hashes) + words, return_index=True, return_inverse=True)
            toxic = b.column(1).to_numpy(zero_copy_only=False)[text]
            counts = [np.bincount(which, weights=x, minlength=len(pair)).astype(np.int64) for x in (toxic == 1, toxic != 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes[before[at]].view(np.int64), hashes[words[at]].view(np.int64), *counts)], ["v", "w", "toxic", "plain"])

    found = rows.select("t", "toxic").mapInArrow(run, "v long, w long, toxic long, plain long")
    return found.groupBy("v", "w").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _smoothed(toxic: Column, plain: Column, share: float) -> Column:
    """Log ratio of the counts by class, with what both classes together lend them."""
    lent = PRIOR / min(share, 1 - share)
    return F.log(toxic / share + lent) - F.log(plain / (1 - share) + lent)


def frequent(table: DataFrame, most: int) -> int:
    """The least ``freq`` that at most ``most`` rows reach: exact below 64, beyond on a grid of powers of two."""
    step = F.when(F.col("freq") < 64, F.col("freq")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("freq")) - 1))
    total, least = 0, 1 << 62
    for r in sorted(table.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # 64 and one for each power
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return least


def model(pairs: DataFrame) -> tuple[DataFrame, float, float] | None:
    """Rows (key, told, other, freq) of the model, the value of a word that it has not, and that of a text's start.

    None without training texts of both classes.
    """

    def of(word: str, role: str) -> Column:
        return F.struct(F.col(word).alias("word"), *((F.col(c) if role == r else F.lit(0).cast("long")).alias(f"{c}_{r}") for r in ("w", "v") for c in ("toxic", "plain")), F.lit(role == "w").alias("as_word"))

    sides = pairs.select(F.inline(F.array(of("w", "w"), of("v", "v"))))
    some = lambda c: F.count_if(F.col(c) > 0)
    sums = [F.sum(c).alias(c) for c in ("toxic_w", "plain_w", "toxic_v", "plain_v")]
    kinds = [some(c).alias(n) for c, n in (("toxic_w", "tt"), ("plain_w", "to"), ("toxic_v", "kt"), ("plain_v", "ko"))]
    words = counted = materialise(sides.groupBy("word").agg(*sums, *kinds, F.count_if("as_word").alias("ts")), "words")
    total = words.agg(*(F.sum(c).alias(c) for c in ("toxic_w", "plain_w", "tt", "to", "ts")), *(some(c).alias(f"u_{c}") for c in ("tt", "to", "ts"))).first()
    if not total["tt"] or not total["to"]:
        return None
    unseen = math.log(total["u_tt"] / total["tt"]) - math.log(total["u_to"] / total["to"])
    shared = (F.greatest(F.col("ts") - DISCOUNT, F.lit(0.0)) + DISCOUNT * total["u_ts"] / (total["u_ts"] + 1)) / total["ts"]
    for n, p in (("tt", "pt"), ("to", "po")):
        words = words.withColumn(p, (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * total[f"u_{n}"] * shared) / total[n])
    share, tokens = total["tt"] / (total["tt"] + total["to"]), total["toxic_w"] / (total["toxic_w"] + total["plain_w"])
    words = words.withColumn("freq", F.col("toxic_w") + F.col("plain_w") + F.col("toxic_v") + F.col("plain_v"))

    def entry(key: Column, told: Column | float, other: Column, freq: Column) -> list[Column]:
        told = told if isinstance(told, Column) else F.lit(told)
        return [key.alias("key"), told.cast("float").alias("told"), other.cast("float").alias("other"), freq.alias("freq")]

    # Enough distinct words before it or enough occurrences: the last word of a fixed expression has one word before it.
    ratio = F.log("pt") - F.log("po")
    tells = ((F.abs(_smoothed(F.col("tt"), F.col("to"), share)) >= NATS) | (F.abs(_smoothed(F.col("toxic_w"), F.col("plain_w"), tokens)) >= NATS)) & (F.abs(ratio) >= NATS)
    weight = lambda k, n: F.when(F.col(n) > 0, F.log(DISCOUNT * F.col(k) / F.col(n))).otherwise(0.0)
    left = weight("kt", "toxic_v") - weight("ko", "plain_v")
    start = words.where(F.col("word") == START).select(left.alias("a")).first()["a"]
    freq = F.col("toxic_w") + F.col("plain_w")
    known = words.where("ts > 0")
    alone = known.select(*entry(F.xxhash64("word", F.lit(AS_WORD).cast("long")), F.when(tells, ratio).otherwise(0.0), F.when(tells, 0.0).otherwise(ratio) - unseen + left, freq))
    lefts, rights = words.select(F.col("word").alias("v_"), "kt", "ko"), words.select(F.col("word").alias("w_"), "pt", "po")
    least = frequent(words, HOT_WORDS)
    hot_left, hot_right = (F.broadcast(x) for x in (words.where(F.col("freq") >= least).select(F.col("word").alias("v_"), "kt", "ko"), words.where(F.col("freq") >= least).select(F.col("word").alias("w_"), "pt", "po")))
    met = pairs.join(hot_left, F.col("v") == F.col("v_"), "left").join(hot_right, F.col("w") == F.col("w_"), "left")
    warm = F.col("kt").isNotNull() & F.col("pt").isNotNull()
    rare = lambda own: met.where(own & ~warm).select("v", "w", "toxic", "plain").join(lefts, F.col("v") == F.col("v_")).join(rights, F.col("w") == F.col("w_"))
    gain = lambda c, k, p: F.when(F.col(c) > 0, F.log1p((F.col(c) - DISCOUNT) / (DISCOUNT * F.col(k) * F.col(p)))).otherwise(0.0)
    value, tells = gain("toxic", "kt", "pt") - gain("plain", "ko", "po"), F.abs(_smoothed(F.col("toxic"), F.col("plain"), tokens)) >= NATS
    both = entry(F.xxhash64("v", "w"), F.when(tells, value).otherwise(0.0), F.when(tells, 0.0).otherwise(value), F.col("toxic") + F.col("plain"))
    slice_of = F.pmod(F.xxhash64("v"), F.lit(PAIR_SLICES))
    parts = [alone.unionByName(met.where(warm).select(*both)), *(rare(slice_of == i).select(*both) for i in range(PAIR_SLICES))]
    entries = materialise_parts(parts, "model")
    release(counted)
    return entries, unseen, start


def key_filter(entries: DataFrame) -> np.ndarray | None:
    """A bit for each key of the model, or None where the bits would nearly all be set.

    Tasks send the places they set as gaps, which one task joins: with at most twice the bits as keys that is bounded.
    """
    if entries.limit(2 * FILTER_BITS + 1).count() > 2 * FILTER_BITS:
        return None

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(b.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.diff(at, prepend=np.uint32(0)).tobytes(), 1)], pa.binary())], ["gaps"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for b in batches:
            for gaps in b.column(0).to_pylist():
                bits[np.cumsum(np.frombuffer(zlib.decompress(gaps), dtype="<u4"), dtype=np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["bits"])

    found = entries.select("key").mapInArrow(places, "gaps binary").repartition(1).mapInArrow(joined, "bits binary").first()
    return np.frombuffer(zlib.decompress(found["bits"]), dtype=np.uint8)


class Hot:
    """What is broadcast, in little room, as every node keeps it on its disk: gaps between sorted keys, and what compresses.

    A worker unpacks it once and drops the packed bytes; the arrays go with the broadcast, so that later steps of the worker have their room.
    """

    def __init__(self, keys: np.ndarray, told: np.ndarray, other: np.ndarray, bits: np.ndarray | None):
        gaps = np.diff(keys, prepend=keys[:1]).view(np.uint64) if len(keys) else np.empty(0, dtype=np.uint64)
        columns = [gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T, told.astype("<f4").view(np.uint8).reshape(-1, 4).T, other.astype("<f4").view(np.uint8).reshape(-1, 4).T]
        self.first = int(keys[0]) if len(keys) else 0
        self.packed = [*(zlib.compress(np.ascontiguousarray(c).tobytes(), 6) for c in columns), None if bits is None else zlib.compress(bits.tobytes(), 6)]
        self.arrays: tuple | None = None

    def unpacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Keys, both values, and the filter."""
        if self.arrays is None:
            *columns, bits = self.packed
            gaps, told, other = (np.ascontiguousarray(np.frombuffer(zlib.decompress(c), dtype=np.uint8).reshape(n, -1).T) for c, n in zip(columns, (8, 4, 4), strict=True))
            with np.errstate(over="ignore"):
                keys = (np.cumsum(gaps.view("<u8")[:, 0], dtype=np.uint64) + np.uint64(self.first & (1 << 64) - 1)).view(np.int64) if len(gaps) else np.empty(0, dtype=np.int64)
            self.arrays = keys, told.view("<f4")[:, 0], other.view("<f4")[:, 0], None if bits is None else np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
            self.packed = []
        return self.arrays


# --- scores ---


def evidence(docs: DataFrame, entries: DataFrame | None, unseen: float = 0.0, start: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``text_hash``, ``n`` words, and the log-likelihood difference in its two parts ``told`` and ``other``."""
    base = docs.select(F.col(key).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), text_or_empty(text).alias("t"))
    if entries is None:
        return base.select("doc_id", "text_hash", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("told"), F.lit(0.0).alias("other"))
    least = frequent(entries, HOT)
    hot = entries.where(F.col("freq") >= least).select("key", "told", "other").toArrow().sort_by("key")  # HOT rows of 16 bytes at most
    shared = docs.sparkSession.sparkContext.broadcast(Hot(*(hot[c].to_numpy() for c in ("key", "told", "other")), key_filter(entries)))
    names = ["row", "key", "base"]
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("told", pa.float64()), ("other", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_told, hot_other, bits = shared.value.unpacked()
        row = TaskContext.get().partitionId() << 33

        def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Both values of each key, and whether it has to meet the model."""
            own = keys.view(np.int64)
            at = np.minimum(np.searchsorted(hot_keys, own), max(len(hot_keys) - 1, 0))
            known = hot_keys[at] == own if len(hot_keys) else np.zeros(len(own), dtype=bool)
            sought = ~known
            if bits is not None:
                place = keys % np.uint64(FILTER_BITS)
                sought &= (bits[place >> np.uint64(3)] >> (np.uint64(7) - place % np.uint64(8)).astype(np.uint8) & 1).astype(bool)
            if not len(hot_keys):
                return np.zeros(len(own)), np.zeros(len(own)), sought
            return np.where(known, hot_told[at], 0.0), np.where(known, hot_other[at], 0.0), sought

        for b in _parts(batches):
            hashes, words, text, before = tokenised(b.column(2).to_pylist())
            number = lambda n: np.full(len(hashes), n, dtype=np.uint64)
            tokens = np.bincount(text, minlength=b.num_rows)
            n = np.maximum(tokens - 1, 0)
            # Keys once for a batch: its words, and its distinct pairs.
            pair, at, which = np.unique(before * len(hashes) + words, return_index=True, return_inverse=True)
            sides = ((mixed(hashes, number(AS_WORD)), words, text), (mixed(hashes[before[at]], hashes[words[at]]), which, text))
            told, other, cold_keys, cold_rows = np.zeros(b.num_rows), tokens * unseen + np.where(n > 0, start, 0.0), [], []
            for keys, at, of in sides:
                a, c, sought = look(keys)
                told += np.bincount(of, weights=a[at], minlength=b.num_rows)
                other += np.bincount(of, weights=c[at], minlength=b.num_rows)
                sought = sought[at]
                cold_keys.append(keys[at[sought]].view(np.int64))
                cold_rows.append(of[sought])
            rows = row + np.arange(b.num_rows)
            row += b.num_rows
            values = (b.column(0), b.column(1), n.astype(np.int64), told, other)
            base = pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], fields=[pa.field(*f) for f in fields])
            # A row's own line meets no entry: it has no key.
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(b.num_rows, pa.int64()), base], names)
            cold, at = np.concatenate(cold_keys), rows[np.concatenate(cold_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cold), pa.nulls(len(cold), base.type)], names)

    model_of = entries.where(F.col("freq") < least).select(F.col("key").alias("k"), F.col("told").alias("k_told"), F.col("other").alias("k_other"))
    own = F.col("base").isNotNull()
    value = lambda c: F.sum(F.when(own, F.col(f"base.{c}")).otherwise(F.coalesce(F.col(f"k_{c}").cast("double"), F.lit(0.0)))).alias(c)

    def met(part: DataFrame) -> DataFrame:
        lines = part.mapInArrow(run, "row long, key long, base struct<doc_id:long,text_hash:long,n:long,told:double,other:double>")
        # Lines without a key are dealt by their row.
        dealt = lines.withColumn("spot", F.coalesce("key", F.xxhash64("row"))).drop("key")
        found = dealt.join(model_of, F.col("spot") == F.col("k"), "left").where(own | F.col("k").isNotNull())
        found = found.groupBy("row").agg(*(F.max(f"base.{c}").alias(c) for c in ("doc_id", "text_hash", "n")), value("told"), value("other"))
        return found.select("doc_id", "text_hash", "n", "told", "other")

    slice_of = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SLICES))
    return materialise_parts((met(base.where(slice_of == i)) for i in range(SLICES)), "evidence")


def _features(told: np.ndarray, other: np.ndarray, n: np.ndarray) -> np.ndarray:
    per = 100 / np.maximum(n, 1)
    return np.stack([np.ones_like(per), np.arcsinh(per * told), np.arcsinh(per * other)], axis=1)


def fit_curve(told: np.ndarray, other: np.ndarray, n: np.ndarray, label: np.ndarray) -> list[float]:
    """Weights of a logistic curve over the two length-normalised parts, by Newton's steps with a small ridge."""
    x, w = _features(told, other, n), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - label) + 1e-2 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def score_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``held_out``, ``score``, ``predicted``, and the evidence it rests on."""
    rows = training_rows(docs.select(F.col(key), F.col(text).alias("text")), labels, key)
    pairs = materialise(count_pairs(rows), "pairs")
    found = model(pairs)
    release(pairs)
    if found is None:
        scored = evidence(docs, None, key=key, text=text).withColumn("score", F.lit(0.0))
    else:
        scored = evidence(docs, *found, key, text)
        release(found[0])
        known = labelled(labels, "doc_id" if key not in labels.columns else key, "toxic")
        fit = scored.join(known, F.col("doc_id") == F.col("known_id")).where(fold(F.col("doc_id")) != 0)
        # The fold that was not counted; where it has not both classes, all training rows.
        fit = fit.withColumn("later", (fold(F.col("doc_id")) != FIT_FOLD).cast("int"))
        fit = fit.orderBy("later", F.xxhash64("doc_id"), "n").limit(FIT_ROWS).select("later", "told", "other", "n", "toxic").toPandas()
        first = fit[fit["later"] == 0]
        fit = first if first["toxic"].nunique() == 2 else fit
        w = fit_curve(*(fit[c].to_numpy(float) for c in ("told", "other", "n", "toxic")))
        per = 100 / F.greatest(F.col("n"), F.lit(1))
        z = F.lit(w[0]) + w[1] * F.asinh(per * F.col("told")) + w[2] * F.asinh(per * F.col("other"))
        scored = scored.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(F.col("doc_id").alias(key), (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_hash", "told", "other", "n")
