"""Token counts of whole texts, with every distinct pre-token counted once.

A text is cut where no vocabulary piece can span: before each run of spaces and
around each line feed, which is always one byte token. The pieces of a pre-token
are counted once for the whole corpus, in a table of distinct pre-tokens. Each document gives its
distinct pre-tokens with their frequencies, which meet the table in an equi-join and are summed. Only the most
frequent pre-tokens (at most ``HOT``, which are in most documents and would make hot keys of the join) are
broadcast and summed where the text is split. No token ids are kept.

The cuts are exact for a SentencePiece BPE model with the identity normaliser, a
dummy prefix, and no piece that has a space after another character or that
holds a line feed; ``check_model`` verifies that and raises otherwise.

Defined results: a null or empty text has 0 tokens and 0 bytes; a text without
spaces is one pre-token however long; repeated rows are counted each on its own;
special strings in a text are ordinary text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import text_or_empty
from framelake.session import materialise

SPACE = "▁"
#: Most pre-tokens that are broadcast.
HOT = 1 << 16
#: Texts whose pre-tokens are counted together before they are shuffled.
PART_ROWS = 1000
PIECES = re.compile(" *[^ ]+| +").findall


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raise if pre-tokens of this model can't be counted on their own."""
    sp = _model(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
        raise ValueError("a piece spans a pre-token boundary")
    if sp.encode("a \n b  cﬁ", out_type=str)[:3] != [SPACE + "a", SPACE, "<0x0A>"] or len(sp.encode("\n")) != 2:
        raise ValueError("the model does not keep white space as it is")


def count_pieces(path: str, pretokens: list[str]) -> list[int]:
    """Tokens of each pre-token; a line feed in front keeps the model's dummy prefix off it."""
    return [len(ids) - 2 for ids in _model(path).encode(["\n" + p for p in pretokens], num_threads=1)]


def pretokens_of(text: str) -> list[str]:
    """Pre-tokens of the lines of a text, the first with the dummy prefix; line feeds are not among them."""
    return [p for line in (" " + text.replace(SPACE, " ")).split("\n") for p in PIECES(line)] if text else []


def distinct_pretokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every distinct pre-token of the corpus with its frequency and its number of tokens."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART_ROWS):
                found: Counter[str] = Counter()
                for t in b.column(0).slice(at, PART_ROWS).to_pylist():
                    found.update(pretokens_of(t))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pretoken", "freq"])

    pieces = docs.select(text_or_empty(text).alias("t")).where("t <> ''").mapInArrow(split, "pretoken string, freq long")
    counted = pieces.groupBy("pretoken").agg(F.sum("freq").alias("freq"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_pieces(path, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["pretoken", "freq", "n"])

    return counted.mapInArrow(count, "pretoken string, freq long, n long")


def hot_threshold(table: DataFrame, most: int) -> int:
    """The least frequency that at most ``most`` pre-tokens reach, on a grid of powers of two."""
    grid = F.length(F.bin("freq"))
    rows = sorted(table.groupBy(grid.alias("bits")).count().collect(), key=lambda r: -r["bits"])
    total, least = 0, 1 << 62
    for r in rows:
        total += r["count"]
        if total > most:
            break
        least = 1 << (r["bits"] - 1)
    return least


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", limit: int = 4096) -> DataFrame:
    """One row per document: key, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    check_model(path)
    spark = docs.sparkSession
    table = materialise(distinct_pretokens(docs, path, text), "pretokens")
    least = hot_threshold(table, HOT)
    hot = spark.sparkContext.broadcast({r["pretoken"]: r["n"] for r in table.where(F.col("freq") >= least).toLocalIterator()})
    names = ["row", "key", "n_bytes", "n", "pretoken"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = hot.value.get
        row = (TaskContext.get().partitionId() << 33) - 1
        for whole in batches:
            for at in range(0, whole.num_rows, PART_ROWS):
                b = whole.slice(at, PART_ROWS)
                rows, keys, sizes, totals = [], b.column(0), [], []
                rare_rows, times, pretokens = [], [], []
                for t in b.column(1).to_pylist():
                    row += 1
                    total = t.count("\n")
                    for p, c in Counter(pretokens_of(t)).items():
                        n = get(p)
                        if n is None:
                            rare_rows.append(row)
                            times.append(c)
                            pretokens.append(p)
                        else:
                            total += n * c
                    rows.append(row)
                    sizes.append(len(t.encode()))
                    totals.append(total)
                # A row's own line: its pre-token meets none, since none holds a line feed.
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), keys, pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([f"\n{r}" for r in rows], pa.string())], names)
                nothing = pa.nulls(len(rare_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rare_rows, pa.int64()), nothing, nothing, pa.array(times, pa.int64()), pa.array(pretokens, pa.string())], names)

    parts = docs.select(F.col(key).cast("long"), text_or_empty(text)).mapInArrow(split, "row long, key long, n_bytes long, n long, pretoken string")
    rare = table.where(F.col("freq") < least).select("pretoken", F.col("n").alias("rare_n"))
    joined = parts.join(rare, "pretoken", "left").select("row", "key", "n_bytes", (F.col("n") * F.coalesce("rare_n", F.lit(1))).alias("n"))
    summed = joined.groupBy("row").agg(F.max("key").alias(key), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return summed.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
