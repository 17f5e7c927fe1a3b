"""Errors as data: a kind and a message, or an exception where a caller asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of error and their stable codes.
CODES = {
    "InvalidInput": "INVALID_INPUT",
    "Unsupported": "UNSUPPORTED",
    "MalformedMedia": "MALFORMED_MEDIA",
    "ResourceLimit": "RESOURCE_LIMIT",
    "Io": "IO",
    "Codec": "CODEC",
    "Graphics": "GRAPHICS",
    "Cancelled": "CANCELLED",
    "InvalidState": "INVALID_STATE",
    "Internal": "INTERNAL",
}


class MediaError(Exception):
    """An error of the Python walkers, with its kind."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message = kind, message


def malformed(message: str) -> MediaError:
    return MediaError("MalformedMedia", message)


def limit(message: str) -> MediaError:
    return MediaError("ResourceLimit", message)


def error_code(kind: Column) -> Column:
    """The stable code of a kind; null for an unknown kind."""
    out = F.lit(None).cast("string")
    for name, code in CODES.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def first_error(*checks: tuple[Column, str, str]) -> Column:
    """Of (condition that fails, kind, message) the first that holds, as struct(kind, message); null if none does."""
    kind = "struct<kind:string,message:string>"
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(m).alias("message")).cast(kind)) for bad, k, m in checks]
    return F.coalesce(*found, F.lit(None).cast(kind))


def fail_fast(df: DataFrame, error: str = "error") -> DataFrame:
    """Raise on the first row whose error column is set, and drop the column."""
    return df.where(F.col(error).isNull() | F.raise_error(F.concat_ws(": ", F.col(error)["kind"], F.col(error)["message"])).isNotNull()).drop(error)
