"""Line dedup by content-defined chunks of lines.

A line ends at a line feed, or behind the spaces after a sentence end or after a character of a fixed class that
about a third of all words end with. So long lines and paragraphs fall into short lines whose ends depend on
their own words only, and a passage inside a sentence has lines of its own. A rolling hash over the hashes of
two neighbouring lines chooses where chunks end: where it is less than at the ``APART`` lines to both sides. So an
insertion moves no boundary far beyond its own, and a chunk has several lines: ``APART`` + 1 or more, but for the ends of a text.

Chunks meet by a 64-bit hash; their first place (least key, then position) stays.
The bytes of a repeated chunk are compared with those of its first place. At the ends of a row of such chunks so are the
lines around, up to ``GROW`` lines, as far as they agree, since chunks at the ends of a passage differ by what stands around it (but
not where a document repeats itself);
lines are removed where repeated chunks cover a run of at least ``LEAST_WORDS`` words.

Keys that a third of the rows share are aggregated and written before they are joined, so that a skewed partition can be split.

Defined results: a null text stays null and an empty one empty; a document whose
every line is repeated is left with an empty text; rows that repeat with the same key and
text are one place and keep their lines; a row with a null key is left as it is; a text without spaces and
line feeds is one line and stays;
an empty table gives no rows. Columns of the input stay inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import broadcast_if_small
from framelake.session import materialise, release

#: Lines to both sides among which the least rolling hash ends a chunk; least and most
#: lines of a chunk; and words that a removed run has at least.
APART, LEAST, MOST, LEAST_WORDS = 1, 2, 32, 25
#: Lines by which a hit may grow to either side.
GROW = 8
#: Repeated chunks up to which their list is broadcast, if it is also small in bytes; beyond, all chunks are shuffled.
REPEATED = 1 << 21
#: Characters that are held as numbers at one time, but for a longer text, and those hashed at one time, but for a longer line.
PART, SEGMENT = 1 << 18, 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def line_starts(codes: np.ndarray) -> np.ndarray:
    """Where the lines of a text start; each has what ends it.

    A line ends at a line feed, or at spaces behind a sentence end or a character, of any script, whose number leaves 1 modulo 5.
    """
    if not len(codes):
        return np.empty(0, dtype=np.int64)
    space = codes == 32
    ending = (codes % 5 == 1) & (codes > 32) | (codes == 33) | (codes == 46) | (codes == 63)
    before = np.maximum.accumulate(np.where(space, 0, np.arange(len(codes))))
    ends = codes == 10
    ends[:-1] |= space[:-1] & ~space[1:] & ending[before[:-1]]
    ends[-1] = False
    return np.concatenate([[0], np.nonzero(ends)[0] + 1])


def lines_of(text: str) -> list[str]:
    """The text cut into lines; joined they are the text."""
    starts = line_starts(_codes(text)).tolist()
    return [text[i:j] for i, j in zip(starts, [*starts[1:], len(text)])]


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, from the first up to the n-th and one more."""
    return tuple(np.cumprod(np.full(n + 1, x, dtype=np.uint64)) for x in (MULTIPLIER, INVERSE))


def line_hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits of each line's characters that are not white space: a polynomial over the line, from running sums."""
    bounds = np.append(starts, len(codes))
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SEGMENT, side="right")) - 1)
        part = codes[bounds[i] : bounds[j]]
        solid = (part > 32) | (part < 9) | (part > 13) & (part < 32)
        rank = np.concatenate([[0], np.cumsum(solid)])
        with np.errstate(over="ignore"):
            powers, back = _powers(max(SEGMENT, len(part)))
            sums = np.concatenate([[np.uint64(0)], np.cumsum((part[solid].astype(np.uint64) + np.uint64(1)) * powers[: rank[-1]])])
            at = rank[bounds[i : j + 1] - bounds[i]]
            out[i:j] = _spread((sums[at[1:]] - sums[at[:-1]]) * back[at[:-1]])
        i = j
    return out


def chunks_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line starts of each text; and text, first line, lines and hash (as a signed long) of the chunks of several lines.

    White space does not count.
    """
    # One array for all, with a line feed behind each text.
    codes = _codes("\n".join([*texts, ""]))
    behind = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    at = line_starts(codes)
    text = np.searchsorted(behind, at, side="right")
    real = at < behind[text] - 1  # not the line feed alone
    h = line_hashes(codes, at)[real]
    text = text[real]
    place = at[real] - (behind - [len(t) + 1 for t in texts])[text]
    sizes = np.bincount(text, minlength=len(texts))
    starts = np.split(place, np.cumsum(sizes)[:-1])
    total = len(h)
    if not total:
        return starts, *(np.empty(0, dtype=np.int64),) * 4
    begin = (np.cumsum(sizes) - sizes)[text]
    place = np.arange(total) - begin
    rolling = h.copy()
    rolling[1:] += np.where(place[1:] > 0, h[:-1], 0) * np.uint64(MULTIPLIER)
    end = np.ones(total, dtype=bool)
    for off in range(1, APART + 1):
        end[off:] &= (place[off:] < off) | (rolling[off:] < rolling[:-off])
        end[:-off] &= (place[off:] < off) | (rolling[:-off] < rolling[off:])
    opens = place == 0
    opens[1:] |= end[:-1]
    start = np.maximum.accumulate(np.where(opens, np.arange(total), 0))
    opens |= (np.arange(total) - start) % MOST == 0
    first = np.nonzero(opens)[0]
    n = np.diff(np.append(first, total))
    # A chunk's hash sums its lines' hashes, each mixed with its place in the chunk.
    x = _spread(h ^ (np.arange(total) - np.repeat(first, n)).astype(np.uint64) * np.uint64(MULTIPLIER))
    found = np.add.reduceat(x, first)
    real = n >= LEAST
    first = first[real]
    return starts, text[first], place[first], n[real], found[real].view(np.int64)


def parted(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of ``PART`` characters, with the number of the first: numbers take many times a text's room."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > PART:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def bare(text: str) -> str:
    """The words of a text, one space between them."""
    return " ".join(text.split())


def chunk_lines(text: str) -> list[tuple[int, int, int]]:
    """(first line, lines, hash) of the chunks of one text."""
    return [(int(a), int(n), int(h)) for a, n, h in zip(*chunks_of([text])[2:], strict=True)]


def chunk_table(texts: DataFrame) -> DataFrame:
    """Rows (hash, doc_id, first, n): where each chunk stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False)
            for at, part in parted(b.column(1).to_pylist()):
                _, text, first, n, h = chunks_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(docs[at + text]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["hash", "doc_id", "first", "n"])

    return texts.where("doc_id IS NOT NULL AND text <> ''").mapInArrow(run, "hash long, doc_id long, first int, n int")


def _first_texts(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows (hash, chunk, before, after): the text of each repeated chunk at its first place, and the lines around it."""
    wanted = firsts.groupBy("at_doc").agg(F.collect_list(F.struct("at_first", "low", "high")).alias("places"))  # a document's own chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1)
            flat, ends = own.flatten(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            at_first, low, high = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at_first", "low", "high"))
            for begin, texts in parted(b.column(0).to_pylist()):
                starts, text, first, n, h = chunks_of(texts)
                # A text's chunks are in order: the wanted places are found among them.
                where = text * (1 << 32) + first
                wanted = np.repeat(np.arange(len(texts)), np.diff(ends[begin : begin + len(texts) + 1])) * (1 << 32) + at_first[ends[begin] : ends[begin + len(texts)]]
                at = np.minimum(np.searchsorted(where, wanted), max(len(where) - 1, 0))
                rows = np.nonzero(where[at] == wanted)[0] if len(where) else np.empty(0, dtype=np.int64)
                chunks, before, after = [], [], []
                for r in rows.tolist():
                    i = at[r]
                    t, line = texts[text[i]], [*starts[text[i]][max(0, first[i] - GROW) : first[i] + n[i] + GROW + 1].tolist(), len(texts[text[i]])]
                    a = min(GROW, int(first[i]))
                    z = a + int(n[i])
                    chunks.append(bare(t[line[a] : line[z]]))
                    before.append("\n".join(bare(t[x:y]) for x, y in zip(line[:a], line[1 : a + 1], strict=True)) if low[ends[begin] + r] else "")
                    after.append("\n".join(bare(t[x:y]) for x, y in zip(line[z : z + GROW], line[z + 1 : z + GROW + 1], strict=False)) if high[ends[begin] + r] else "")
                yield pa.RecordBatch.from_arrays([pa.array(h[at[rows]]), *(pa.array(x, pa.string()) for x in (chunks, before, after))], ["hash", "chunk", "before", "after"])

    met = texts.join(broadcast_if_small(materialise(wanted, "wanted")), F.col("doc_id") == F.col("at_doc")).select("text", "places")
    found = met.mapInArrow(run, "hash long, chunk string, before string, after string")
    found = materialise(found, "found")
    if found.count() == firsts.count():
        return found
    # A document that stands there several times gives its chunks as often.
    return found.groupBy("hash").agg(F.min(F.struct("chunk", "before", "after")).alias("found")).select("hash", "found.*")


def repeated_spans(text: str, marks: list[tuple[int, int, str, str, str]]) -> tuple[int, list[dict]]:
    """Words and spans of the passages of a text that go.

    A mark is a chunk here, and the words of its first place with the lines before and after it there.
    """
    starts = line_starts(_codes(text)).tolist()
    lines = len(starts)
    starts.append(len(text))
    covered = [False] * lines
    line = lambda i: bare(text[starts[i] : starts[i + 1]])
    for low, n, chunk, before, after in marks:
        high = low + n
        if high > lines or bare(text[starts[low] : starts[high]]) != chunk:  # bytes, not hashes
            continue
        for x in reversed(before.split("\n")) if before else ():
            if not low or line(low - 1) != x:
                break
            low -= 1
        for x in after.split("\n") if after else ():
            if high == lines or line(high) != x:
                break
            high += 1
        covered[low:high] = [True] * (high - low)
    words, spans, i = 0, [], 0
    while i < lines:
        j = i
        while j < lines and covered[j]:
            j += 1
        if j > i and (n := len(text[starts[i] : starts[j]].split())) >= LEAST_WORDS:
            words += n
            spans.append({"start": starts[i], "end": starts[j]})
        i = max(j, i + 1)
    return words, spans


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the input), ``text`` without repeated passages, ``removed_words`` and ``removed`` (start and end in characters)."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chunks = materialise(chunk_table(texts), "chunks")
    # Written, so that a frequent chunk's partition of the next join can be split.
    repeated = materialise(chunks.groupBy("hash").agg(F.min("doc_id").alias("at_doc"), F.count("*").alias("times")).where("times > 1").select("hash", "at_doc"), "repeated")
    # Hits side by side cover what is between them: only at the ends of a row of hits do the lines around count,
    # and not where a document repeats itself.
    own = Window.partitionBy("doc_id").orderBy("first")
    other = F.col("doc_id") != F.col("at_doc")
    open_low = other & ~F.coalesce(F.lag(F.when(other, F.col("first") + F.col("n"))).over(own) == F.col("first"), F.lit(False))
    open_high = other & ~F.coalesce(F.lead(F.when(other, F.col("first"))).over(own) == F.col("first") + F.col("n"), F.lit(False))
    hits = materialise(chunks.join(broadcast_if_small(repeated, REPEATED), "hash").select("*", open_low.alias("low"), open_high.alias("high")), "hits")
    release(chunks, repeated)
    at_first = F.min(F.when(~other, F.col("first"))).alias("at_first")
    firsts = materialise(hits.groupBy("hash", "at_doc").agg(at_first, F.max("low").alias("low"), F.max("high").alias("high")), "firsts")
    places = firsts.select(F.col("hash").alias("h"), "at_first")
    bodies = materialise(_first_texts(texts, firsts).join(places, F.col("hash") == F.col("h")).drop("h"), "bodies")
    later = hits.join(bodies, "hash").where("doc_id <> at_doc OR first <> at_first")
    later = later.withColumn("before", F.when(F.col("low"), F.col("before")).otherwise("")).withColumn("after", F.when(F.col("high"), F.col("after")).otherwise(""))
    marks = later.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "chunk", "before", "after")).alias("marks")).withColumnRenamed("doc_id", "mark_doc")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("doc_id"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kind = "struct<words:bigint,spans:array<struct<start:int,end:int>>>"

    @F.arrow_udf(kind)
    def passages(text: pa.Array, marks: pa.Array) -> pa.Array:
        flat = marks.flatten()
        first, n = (flat.field(c).to_pylist() for c in ("first", "n"))
        bodies = [flat.field(c).to_pylist() for c in ("chunk", "before", "after")]
        words, spans, at = [], [], 0
        for t, times in zip(text.to_pylist(), marks.value_lengths().to_pylist(), strict=True):
            own = range(at, at + (times or 0))
            at = own.stop
            found = repeated_spans(t, [(first[i], n[i], *(x[i] for x in bodies)) for i in own]) if t and times else (0, [])
            words.append(found[0])
            spans.append(found[1])
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(spans, span)], ["words", "spans"])

    # Only texts with marks go to the workers, and only spans come back.
    met = rows.join(marks, F.col("doc_id") == F.col("mark_doc"), "left")
    met = met.select("row", F.col("row").getField(text).cast("string").alias("t"), "marks")
    met = met.select("row", "t", passages(F.when(F.col("marks").isNotNull(), F.col("t")), "marks").alias("gone"))
    spans = F.col("gone.spans")
    # What is between the spans: from the end of one to the start of the next.
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length("t")))
    kept = F.concat_ws("", F.zip_with(starts, ends, lambda i, j: F.substring(F.col("t"), i + 1, j - i)))
    return met.select("row", F.when(F.size(spans) > 0, kept).otherwise(F.col("t")).alias("text"), F.col("gone.words").alias("removed_words"), spans.alias("removed"))
