"""Row and table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(cols: list[str]) -> Column:
    """SHA-256 of the row; a null differs from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_number_hash(cols: list[str]) -> Column:
    """60 bits of the row hash as a number."""
    return F.conv(F.substring(row_hash(cols), 1, 15), 16, 10).cast("long")


def table_hash(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-independent content hash: rows, sum and exclusive-or of 60 bits of each row hash."""
    h = row_number_hash(cols or df.columns)
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )
