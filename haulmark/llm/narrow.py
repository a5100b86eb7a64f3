"""A filter of fixed size that thins out documents before an exact join by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the filter, of 64 bits each. The table never has more, whatever it is built from.
FILTER_ROWS = 1 << 17


def _place(*key: str) -> tuple[Column, Column]:
    h = F.xxhash64(*key, F.lit(77))
    return F.pmod(h, F.lit(FILTER_ROWS)).alias("_row"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")


def maybe_in(df: DataFrame, wanted: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may have their key in ``wanted``, and rows that surely have not.

    One bit per key, gathered by ``bit_or`` into at most ``FILTER_ROWS`` rows of 16 bytes, so the
    broadcast is bounded by 2 MB of values; as keys grow beyond its bits it lets more rows pass,
    and never stops a wanted one.
    """
    row, bit = _place(*key)
    bits = wanted.select(row, F.expr("1L").alias("_one"), bit.alias("_bit")).select("_row", F.expr("shiftleft(_one, _bit)").alias("_set"))
    bits = F.broadcast(bits.groupBy("_row").agg(F.bit_or("_set").alias("_bits")))
    marked = df.withColumns({"_row": row, "_bit": bit}).join(bits, "_row", "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(_bits, _bit) & 1L) = 1L"), F.lit(False))
    return marked.filter(hit).select(*df.columns), marked.filter(~hit).select(*df.columns)
