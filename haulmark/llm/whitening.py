"""Whitening of embeddings by the covariance of their distinct vectors.

Vectors are rounded to whole numbers, equal ones are grouped, and each distinct vector counts once
or as often as it occurs. Sums, covariance and whitening are computed on distinct vectors alone,
by matrix products inside tasks; only sums per dimension and one matrix come to the driver. Every
row then gets the result of its vector.

Defined cases: a vector that is null, empty, or holds a null or non-finite entry takes no part, nor
does one with an entry beyond 2**54 in size, which has no exact whole number here. If lengths
differ, the commonest length counts (ties: the longer) and others take no part. A component
without variance has null ``whitened``, and ``identity_error`` leaves it out. A null id and
repeated rows keep their rows. An empty table gives no rows. Columns other than those asked for
are not read. A ``deviation`` of over 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import small_batches, stored

#: The covariance matrix comes to the driver: at most 4096 x 4096 numbers, 134 MB.
MAX_DIMENSIONS = 4096
#: A vector that holds over a thousandth of all rows is joined by broadcast: there are under a thousand.
HOT_SHARE = 1000


def rounded(vector: str, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift))


def usable(vector: str) -> Column:
    """Not null, not empty, and all entries finite."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= float(1 << 54), F.lit(False)))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fits, F.lit(False))


def _matrix(batch: pa.RecordBatch, column: str, kind) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, -1)


def exact_sums(df: DataFrame, column: str, weight: str) -> tuple[int, list[int]]:
    """Total weight, and the weighted sum of each dimension of a column of whole numbers, as Python numbers.

    High and low halves are added apart, so no 64-bit sum overflows; one row per dimension and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, high, low = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch, column, np.int64), batch.column(weight).to_numpy()
                if high is None:
                    high, low = [0] * x.shape[1], [0] * x.shape[1]
                if w.sum() >= 1 << 30:
                    x, w = x.astype(object), w.astype(object)
                # A batch is added in 64 bits where its weights allow, batches as Python numbers.
                hi, lo = w @ (x >> 32), w @ (x & 0xFFFFFFFF)
                total += int(w.sum())
                high = [a + int(b) for a, b in zip(high, hi, strict=True)]
                low = [a + int(b) for a, b in zip(low, lo, strict=True)]
        if high is not None:
            sums = [Decimal(total), *[Decimal((a << 32) + b) for a, b in zip(high, low, strict=True)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(high)), pa.int32()), pa.array(sums, pa.decimal128(38, 0))], names=["dim", "s"]
            )

    parts = df.select(column, weight).mapInArrow(run, "dim int, s decimal(38,0)")
    found = {r["dim"]: int(r["s"]) for r in parts.groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    return found.pop(-1, 0), [found[i] for i in sorted(found)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: in 64 bits where they suffice, else in Python numbers."""
    base = [s // n for s in sums]
    if max(map(abs, base), default=0) < 1 << 62:
        near = x - np.array(base, np.int64)
        rest = np.array([s - n * b for s, b in zip(sums, base, strict=True)], object)
        most = int(np.abs(near).max(initial=0)) + 1
        if n * most < 1 << 62:
            return near * np.int64(n) - rest.astype(np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(d: np.ndarray) -> pa.Array:
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < 1 << 63:
        d = d.astype(np.int64)
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    whole = [sum(int(v) ** 2 for v in row) for row in d]
    return pa.array([Decimal(v) if v < 10**38 else None for v in whole], pa.decimal128(38, 0))


def centred_products(df: DataFrame, column: str, weight: str, centre, width: int) -> np.ndarray:
    """The weighted sum of outer products of ``centre(rows)``: one matrix product per batch, one matrix per task.

    ``centre`` takes a matrix of rows and returns them, as doubles, less their mean.
    """
    at = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                z = centre(_matrix(batch, column, None))
                out += z.T @ (z * batch.column(weight).to_numpy()[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0]), dtype=np.int32)), pa.array(out[at])], names=["cell", "v"])

    cells = df.select(column, weight).mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    cell = cells.column("cell").to_numpy()
    out[at[0][cell], at[1][cell]] = cells.column("v").to_numpy()
    return out + np.triu(out, 1).T


def whiten(
    df: DataFrame,
    keep: list[str],
    vector: str = "embedding",
    components: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
    weights: str = "one",
) -> DataFrame:
    """One row per usable row of ``df``: ``keep``, ``n``, ``deviation``, ``whitened`` and ``explained`` as arrays.

    ``weights`` is ``one`` (each distinct vector once) or ``counts`` (as often as it occurs).
    ``deviation`` is the exact sum over dimensions of ``(n * x - S) ** 2`` as a decimal.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights: one or counts")
    spark = df.sparkSession
    small_batches(spark)
    result = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + (
        ", n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    )
    good = df.filter(usable(vector))
    common = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], result)
    width = common["d"]
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors of at most {MAX_DIMENSIONS} dimensions")
    x = rounded(vector, scale, shift)
    # Two hashes with seeds of their own: 128 bits that stand for the vector in the join back.
    own = [F.xxhash64("x").alias("_a"), F.xxhash64(F.lit(11), "x").alias("_b")]
    rows = good.filter(F.size(vector) == width).select(*keep, x.alias("x"))
    distinct = rows.groupBy("x").agg(F.count("*").alias("copies"))
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    distinct = stored(distinct.select("x", "copies", weight.alias("w")))

    n, sums = exact_sums(distinct, "x", "w")
    vectors = centred_products(distinct, "x", "w", lambda x: deviations(x, n, sums).astype(np.float64) / n, width) / n
    values, axes = np.linalg.eigh(vectors)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(vectors))
    real = values > max(values[0], 0) * width * np.finfo(float).eps
    scales = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), np.nan)
    explained = [float(v) / trace for v in values] if trace > 0 else [None] * len(values)
    projection = axes * scales

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = deviations(_matrix(batch, "x", np.int64), n, sums)
            white = (exact.astype(np.float64) / n) @ projection
            flat = pa.array(white.ravel(), mask=np.isnan(white).ravel())
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_a"), batch.column("_b"), batch.column("copies"), batch.column("w"), square_sums(exact), pa.ListArray.from_arrays(starts, flat)],
                names=["_a", "_b", "copies", "w", "deviation", "whitened"],
            )

    made = stored(
        distinct.select(*own, "x", "copies", "w").mapInArrow(run, "_a long, _b long, copies long, w long, deviation decimal(38,0), whitened array<double>")
    )
    error = F.lit(_identity_error(made, n, real)).cast("double").alias("identity_error")
    shown = F.array(*[F.lit(e).cast("double") for e in explained]).alias("explained")
    keyed = rows.select(*keep, *own)
    back = ["_a", "_b"]
    found = made.select(*back, "copies", "deviation", "whitened")
    total = made.agg(F.sum("copies")).first()[0]
    is_hot = F.col("copies") * HOT_SHARE > total
    hot = F.broadcast(found.filter(is_hot).drop("copies").withColumn("_hot", F.lit(True)))
    met = keyed.join(hot, back, "left")
    cold = met.filter("_hot IS NULL").select(*keep, *back).join(found.filter(~is_hot).drop("copies"), back)
    both = met.filter("_hot").select(*keep, "deviation", "whitened").unionByName(cold.select(*keep, "deviation", "whitened"))
    return both.select(*keep, F.lit(n).cast("long").alias("n"), "deviation", "whitened", shown, error)


def _identity_error(made: DataFrame, n: int, real: np.ndarray) -> float | None:
    """Largest entry of the covariance of the whitened vectors less the identity, over components with variance."""
    width = int(real.sum())
    if not width:
        return None
    lead = made.select(F.slice("whitened", 1, width).alias("y"), "w")
    means = lead.select(F.posexplode("y"), "w").groupBy("pos").agg(F.sum(F.col("col") * F.col("w")).alias("s")).collect()
    mean = np.zeros(width)
    for r in means:
        mean[r["pos"]] = r["s"] / n
    return float(np.abs(centred_products(lead, "y", "w", lambda y: y - mean, width) / n - np.eye(width)).max())


def by_component(white: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row and component, components numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained"))
    long = white.select(*keep, "n", "deviation", "identity_error", pairs.alias("_at", "_of"))
    return long.select(
        *keep, (F.col("_at") + 1).cast("int").alias("component"), "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "_of.whitened", "_of.explained", "identity_error",
    )
