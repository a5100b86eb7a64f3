"""What the text operators share: stored intermediates, checked columns and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.session import work_folder

#: Bytes of text that a Python task works on at a time, apart from single longer texts.
SLICE_BYTES = 4 << 20
#: Rows per Arrow batch; texts are much wider than the rows the Spark default is meant for.
ROWS_PER_BATCH = 1000
#: A word is a run of anything but these ASCII blanks.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from files that outlive executors."""
    path = f"{work_folder(df.sparkSession)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def told_apart(df: DataFrame, *keys: str) -> DataFrame:
    """Add ``_nth``: 0 for a row whose keys no other row has, else a number of its own, so that equal rows can be spread."""
    from haulmark.llm.narrow import maybe_in

    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    again = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1"))
    near, far = maybe_in(rows, again, *keys)
    same = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys]
    repeated = again.select(*[F.col(k).alias("_k_" + k) for k in keys], F.lit(True).alias("_again"))
    near = near.join(repeated, same, "left").withColumn("_nth", F.when(F.col("_again"), F.col("_row") + 1).otherwise(F.lit(0)))
    columns = [*df.columns, "_nth"]
    return far.withColumn("_nth", F.lit(0).cast("long")).select(*columns).unionByName(near.select(*columns))


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python a thousand rows at a time, so that long ones fit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows that hold about ``SLICE_BYTES`` of text; no text is cut."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def over_text(df: DataFrame, score: Callable[[pa.Array], dict[str, pa.Array]], schema: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and what ``score`` says of each whole text; ``score`` sees a slice of texts at a time."""
    small_batches(df.sparkSession)

    def run(batches):
        for part in text_slices(batches):
            made = score(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), *made.values()], names=[*keep, *made]
            )

    chosen = df.select(*keep, "text") if "text" not in keep else df.select(*keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keep).schema.fields)
    return chosen.mapInArrow(run, f"{kept}, {schema}")


def bucket_of(key: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, max_chars: int
) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels to learn from: at most ``rows`` labels, half of each value where there are enough.

    Labels are taken in the order of a hash of their doc_id, so the sample is the same on every
    run. Labels of several rows of one document are reduced to the smallest. A text of over
    ``max_chars`` code points is left out whole, never cut, so the bound on bytes holds.
    """
    clean = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & allowed)
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [clean.filter(F.col("_label") == v).orderBy(*order).limit(rows // 2) for v in (0, 1)]
    # At most ``rows`` pairs of numbers, so sending them to every executor is bounded.
    chosen = F.broadcast(picked[0].union(picked[1]))
    found = (
        docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(chosen, "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("_label"))
        .orderBy(*order).toArrow()
    )
    return found.column("text").to_pylist(), found.column("_label").to_pylist()
