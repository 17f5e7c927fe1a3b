"""Expressions and helpers that several corpus operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words, and a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a table counts as small enough to broadcast.
BROADCAST_ROWS = 200_000
#: Bytes up to which it does.
BROADCAST_BYTES = 64 << 20


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order, as an array."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def literal_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A small driver-side table as a literal, with no RDD behind it."""
    kind = T.ArrayType(schema)
    parsed = F.from_json(F.lit(json.dumps(rows)), kind)
    return spark.range(1, numPartitions=1).select(F.inline(parsed))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where a count shows that at most ``rows`` rows of ``most`` bytes together are there.

    ``df`` should be cheap to count: a written table or a literal. Strings and lists count by their lengths.
    """
    long = {T.StringType: F.octet_length, T.BinaryType: F.octet_length, T.ArrayType: lambda c: 16 * F.size(c)}
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if type(f.dataType) in long:
            size = size + F.coalesce(long[type(f.dataType)](F.col(f"`{f.name}`")), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= most else df


def own_columns(df: DataFrame, *names: str) -> None:
    """Fail early and clearly where a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
