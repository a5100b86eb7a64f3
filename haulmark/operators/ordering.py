"""Order-dependent operators that never put a whole table into one task.

A global order is made by range partitions. What lies before a row is then the total of the
earlier partitions plus what precedes it inside its own, and only the totals, one row per
partition, are brought together. Quantiles need no order: values are counted in ever finer bins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.session import free, written

#: Bins per doubling of a value in the first pass, and bins per interval in later ones.
FIRST_BINS, LATER_BINS = 256, 4096
_EARLIER = (Window.unboundedPreceding, -1)


def _all_of(pairs) -> Column:
    return reduce(lambda x, y: x & y, pairs)


def prefix_sums(df: DataFrame, order: list, sums: list[str], by: list[str] = ()) -> DataFrame:
    """Add ``before_<c>``: the sum of ``c`` over the rows that precede in the order.

    The rows must be unique on ``by`` and ``order``; aggregate ties first. They are shuffled once,
    into range partitions, and summed there. Only the first group of a partition can have begun in
    an earlier one, so what is added afterwards is at most one row per partition.
    """
    by = list(by)
    marked = df.withColumn("_group", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    placed = marked.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    types = {c: marked.select(F.sum(c).alias(c)).schema[c].dataType.simpleString() for c in sums}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields)
    fields += ", _part int, " + ", ".join(f"`_in_{c}` {t}" for c, t in types.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("_group").to_numpy()
            new = np.concatenate([[last is None or group[0] != last], group[1:] != group[:-1]])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(group)), -1))
            out = []
            for c in sums:
                x = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                x = x.astype(np.float64 if x.dtype.kind == "f" else np.int64)
                total = np.concatenate([[x.dtype.type(0)], np.cumsum(x)])
                before = total[:-1] - np.where(starts >= 0, total[starts], 0) + np.where(starts < 0, carried[c], 0).astype(x.dtype)
                carried[c] = before[-1] + x[-1]
                out.append(pa.array(before))
            last = group[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(group), part, np.int32)), *out],
                names=[*batch.schema.names, "_part", *[f"_in_{c}" for c in sums]],
            )

    inside, _ = written(placed.mapInArrow(run, fields))
    totals = inside.groupBy("_part", *by).agg(*[F.sum(c).alias(c) for c in sums])
    groups = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part")
    offsets = totals.withColumns(
        {f"_off_{c}": F.sum(c).over(groups.rowsBetween(*_EARLIER)) for c in sums} | {"_nth": F.row_number().over(groups)}
    ).filter("_nth > 1")
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(b).alias("_k_" + b) for b in by], *[f"_off_{c}" for c in sums])
    same = _all_of([F.col("_part") == F.col("_p"), *[F.col(b).eqNullSafe(F.col("_k_" + b)) for b in by]])
    # At most one row per partition.
    joined = inside.join(F.broadcast(offsets), same, "left")
    out = joined.withColumns({f"before_{c}": F.col("_in_" + c) + F.coalesce("_off_" + c, F.lit(0)) for c in sums})
    return out.select(*df.columns, *[f"before_{c}" for c in sums])


def carry_forward(df: DataFrame, by: list[str], order: list[str], lasts: list[str] = (), maxima: list[str] = ()) -> DataFrame:
    """Add ``last_<c>``, the newest value of ``c`` that is not null up to each row of its group, and ``max_<c>``.

    Rows are shuffled once, into range partitions of group and order, and scanned there, so a group
    of any length spreads over tasks. What a partition hands on is the state of its last group: one row. Newest
    and largest are associative, so these rows are folded and completed into the first group of
    the next partitions.
    """
    lasts, maxima = list(lasts), list(maxima)
    marked = df.withColumn("_group", F.xxhash64(*by))
    placed = marked.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    kept = {f"_last_{c}": marked.schema[c].dataType for c in lasts} | {f"_max_{c}": T.DoubleType() for c in maxima}
    schema = T.StructType([*marked.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType()),
                           T.StructField("_first", T.BooleanType()), *[T.StructField(n, t) for n, t in kept.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, first_group = TaskContext.get().partitionId(), 0, None, None
        held: dict[str, pa.Array] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group = batch.column("_group").to_numpy()
            first_group = group[0] if first_group is None else first_group
            new = np.concatenate([[last is None or group[0] != last], group[1:] != group[:-1]])
            starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = []
            for c in lasts:
                column = batch.column(c)
                given = np.asarray(column.is_valid())
                at = np.maximum.accumulate(np.where(given, np.arange(n), -1))
                whole = pa.concat_arrays([held[c], column]) if c in held else pa.concat_arrays([pa.nulls(1, column.type), column])
                # Place 0 is what the batch before handed on; it counts for its own group alone.
                where = np.where(at >= starts, at + 1, 0)
                out.append(whole.take(pa.array(where, mask=(where == 0) & (starts >= 0))))
                held[c] = out[-1].slice(n - 1)
            for c in maxima:
                values = pd.Series(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)).groupby(np.cumsum(new)).cummax()
                values = values.groupby(np.cumsum(new)).ffill()
                if c in held and not new[0]:
                    before = held[c].to_numpy(zero_copy_only=False)[0]
                    values = values.where(starts >= 0, np.fmax(values, before))
                out.append(pa.array(values, from_pandas=True))
                held[c] = out[-1].slice(n - 1)
            last = group[-1]
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), pa.array((group == first_group) & (starts <= 0 if not seen else starts < 0))]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra, *out], names=schema.names)

    inside, _ = written(placed.mapInArrow(run, schema))
    ends = inside.groupBy("_part").agg(F.max_by(F.struct("_group", *kept), "_place").alias("e")).select("_part", "e.*")
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    folded = ends.select(
        F.col("_part").alias("_p"), F.col("_group").alias("_g"),
        *[F.last("_last_" + c, True).over(earlier).alias("_over_last_" + c) for c in lasts], *[F.max("_max_" + c).over(earlier).alias("_over_max_" + c) for c in maxima],
    )
    # The next partition that has rows takes over: at most one row per partition.
    heads = inside.filter("_place = 0").select("_part", "_group")
    before = Window.partitionBy(F.lit(0)).orderBy("_part")
    heads = heads.select("_part", "_group", F.lag("_part").over(before).alias("_p")).join(folded, ["_p"])
    heads = heads.filter("_group = _g").drop("_p", "_g", "_group").withColumnRenamed("_part", "_q").withColumn("_yes", F.lit(True))
    joined = inside.join(F.broadcast(heads), (F.col("_part") == F.col("_q")) & F.col("_first"), "left")
    return joined.select(
        *df.columns, *[F.coalesce("_last_" + c, "_over_last_" + c).alias("last_" + c) for c in lasts],
        *[F.greatest("_max_" + c, "_over_max_" + c).alias("max_" + c) for c in maxima],
    )


def row_numbers(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """Zero-based position in a total order."""
    placed, _ = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    frame = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(*_EARLIER)
    # One row per partition.
    offsets = F.broadcast(counts.select("_p", F.coalesce(F.sum("_n").over(frame), F.lit(0)).alias("_off")))
    return placed.join(offsets, part == F.col("_p")).withColumn(name, F.col("_off") + place).drop("_id", "_p", "_off")


def summarise(
    df: DataFrame,
    by: list[str],
    aggs: dict[str, Column],
    quantiles: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Group and aggregate, with exact linearly interpolated quantiles.

    The built-in percentile would keep every distinct value of a group in one task. Here the
    columns that are needed are written once, and the quantiles of all groups and columns are
    found together by counting. A group without any value keeps its row, with null quantiles.
    """
    by = list(by)
    if not quantiles:
        left = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]) if aggs else df.select(*by).distinct()
        return left.select(*by, *aggs)
    values = sorted({c for c, _ in quantiles.values()})
    spark, (base, path) = df.sparkSession, written(_needed(df, [*by, *values], aggs))
    left = base.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]) if aggs else base.select(*by).distinct()
    found, paths = _counted_quantiles(base, by, quantiles)
    if by:
        right = found.select(*[F.col(b).alias("_k_" + b) for b in by], *quantiles)
        out = left.join(right, _all_of(F.col(b).eqNullSafe(F.col("_k_" + b)) for b in by), "left")
    elif aggs:
        out = left.join(F.broadcast(found), F.lit(True), "left")  # one row each
    else:
        out = found
    result, _ = written(out.select(*by, *aggs, *quantiles))
    free(spark, [path, *paths])
    return result


def _needed(df: DataFrame, columns: list[str], aggs: dict[str, Column]) -> DataFrame:
    """The columns named here or in an aggregate; all of them if that cannot be told."""
    said = set(re.findall(r"\w+", " ".join(str(c) for c in aggs.values())))
    narrow = df.select(*[F.col(f"`{c}`") for c in df.columns if c in columns or c in said])
    try:
        if aggs:
            narrow.agg(*aggs.values())
        return narrow
    except AnalysisException:
        return df


def _first_bin(v: Column) -> Column:
    """A number that never falls as the value rises: sign and logarithm, cut at ``FIRST_BINS`` per doubling."""
    top = 1100 * FIRST_BINS
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1030.0)) * FIRST_BINS).cast("int") + top
    return F.when(F.isnan(v), 3 * top).when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _later_bin(v: Column, lo: Column, hi: Column) -> Column:
    """Both ends have bins of their own, so each pass narrows what is open."""
    part = (v * 0.5 - lo * 0.5) / F.nullif(hi * 0.5 - lo * 0.5, F.lit(0.0))
    inner = F.coalesce(F.floor(F.least(F.nanvl(part, F.lit(0.5)), F.lit(1.0)) * LATER_BINS), F.lit(0)).cast("int")
    return F.when(v == lo, -1).when(v == hi, LATER_BINS + 1).otherwise(inner)


def _counted_quantiles(base: DataFrame, by: list[str], quantiles: dict[str, tuple[str, float]]) -> tuple[DataFrame, list[str]]:
    """Quantiles of all columns and groups by counting, and the paths of the tables that were written.

    Each pass counts values by bin, with the smallest and largest of each, and keeps the bins that
    hold a wanted rank. A rank at the end of its bin, or in a bin of one value, is known; the other
    bins are split. No pass sorts or moves the values: only counts are shuffled, and open bins, at
    most two per group and quantile, are joined with the values.
    """
    columns = sorted({c for c, _ in quantiles.values()})
    wanted = F.array()
    total = F.col("_total")
    for c in columns:
        at = [(total - 1) * F.lit(float(p)) for p in sorted({p for q, p in quantiles.values() if q == c})]
        wanted = F.when(F.col("_c") == c, F.array_distinct(F.array(*[f(x) for x in at for f in (F.floor, F.ceil)]))).otherwise(wanted)
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), (F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias("_v")) for c in columns])
    long = base.select(*by, F.inline(pairs)).filter("_v IS NOT NULL").withColumn("_bin", _first_bin(F.col("_v")))
    counts = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    key = [*by, "_c"]

    hist = long.groupBy(*key, "_bin").agg(*counts)
    group = Window.partitionBy(*key)
    hist = hist.withColumns({
        "_before": F.coalesce(F.sum("_n").over(group.orderBy("_bin").rowsBetween(*_EARLIER)), F.lit(0)),
        "_total": F.sum("_n").over(group),
    }).withColumn("_ks", wanted)
    known, paths = [], []
    keep = [*key, "_bin", "_total", "_before", "_n", "_lo", "_hi"]
    inside = F.filter("_ks", lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_n")))
    while True:
        hits = hist.select(*keep, inside.alias("_ks")).filter(F.size("_ks") > 0).withColumn("_u", F.monotonically_increasing_id())
        hits, path = written(hits)
        paths.append(path)
        ended = lambda k: (F.col("_lo") == F.col("_hi")) | (k == F.col("_before")) | (k == F.col("_before") + F.col("_n") - 1)
        ks = hits.select(*key, "_total", "_before", "_n", "_lo", "_hi", F.explode("_ks").alias("_k")).filter(ended(F.col("_k")))
        value = F.when(F.col("_k") == F.col("_before"), F.col("_lo")).otherwise(F.col("_hi"))
        known.append(ks.select(*key, "_total", "_k", value.alias("_value")))
        # A range with NaN on one end cannot be split by size, nor need it be: NaN has a bin of its own.
        open_ = hits.withColumn("_ks", F.filter("_ks", lambda k: ~ended(k))).filter(F.size("_ks") > 0)
        if open_.isEmpty():
            break
        mine = open_.select(*[F.col(c).alias("_k_" + c) for c in key], F.col("_bin").alias("_b"), "_u", "_lo", "_hi")
        same = [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in key]
        within = long.join(mine, _all_of([*same, F.col("_bin") == F.col("_b"), F.col("_v").between(F.col("_lo"), F.col("_hi"))]))
        split = within.groupBy("_u", _later_bin(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_sub")).agg(*counts)
        earlier = Window.partitionBy("_u").orderBy("_sub").rowsBetween(*_EARLIER)
        split = split.withColumn("_add", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        hist = split.join(open_.select(*key, "_bin", "_total", "_before", "_ks", "_u"), "_u").withColumn("_before", F.col("_before") + F.col("_add"))
    full = reduce(DataFrame.unionByName, known)
    out = []
    for name, (c, p) in quantiles.items():
        at = F.when(F.col("_c") == c, (total - 1) * F.lit(float(p)))
        low = F.max(F.when(F.col("_k") == F.floor(at), F.col("_value")))
        high = F.max(F.when(F.col("_k") == F.ceil(at), F.col("_value")))
        out.append((low + F.max(at - F.floor(at)) * (high - low)).alias(name))
    return full.groupBy(*by).agg(*out), paths


def share_of_total(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """Each row's part of the column total; the total is a scalar subquery, not a window."""
    return df.withColumn(name, F.col(col) / df.select(F.sum(col)).scalar())


def ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Competition rank of each row under some measures: column to name of the rank; a null has rank null.

    Rows are counted per distinct value and measure, and the counts of smaller values added up.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
    counted = df.select(F.inline(pairs)).filter("_v IS NOT NULL").groupBy("_c", "_v").agg(F.count("*").alias("_n"))
    placed = prefix_sums(counted, ["_v"], ["_n"], ["_c"])
    for c, name in columns.items():
        mine = placed.filter(F.col("_c") == c).select(F.col("_v").alias("_w"), (F.col("before__n") + 1).cast("int").alias(name))
        df = df.join(mine, F.col(c).cast("double") == F.col("_w"), "left").drop("_w")
    return df


def rank_shift(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rank under two measures and the difference, for a grouped table."""
    ranked = ranks(df, {first: "rank_first", second: "rank_second"})
    return ranked.withColumn("rank_shift", F.col("rank_second") - F.col("rank_first"))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows: a bounded heap per partition, then one merge."""
    return df.orderBy(*order).limit(k)


def temporal_split(df: DataFrame, order: list[str], fractions=(0.70, 0.85), names=("train", "calib", "test")) -> DataFrame:
    """Split by position in time: ``int(n * fraction)`` rows lie before each cut.

    Only the order columns are sorted. The cut rows, one per fraction, come to the driver and
    the full rows are compared with them, so the wide table itself is not shuffled.
    """
    placed, _ = written(row_numbers(df.select(*order), order))
    total = placed.count()
    at = [int(total * f) for f in fractions]
    found = {r["row_no"]: r for r in placed.filter(F.col("row_no").isin(at)).collect()}
    me, out = F.struct(*order), F.lit(names[-1])
    for place, name in reversed(list(zip(at, names[:-1], strict=True))):
        if place in found:
            cut = F.struct(*[F.lit(found[place][c]).cast(df.schema[c].dataType).alias(c) for c in order])
            out = F.when(me < cut, name).otherwise(out)
        else:
            out = F.lit(name)
    return df.withColumn("split", out)


def date_split(df: DataFrame, ts: str, days: int = 90) -> DataFrame:
    """The last ``days`` of the table are the test side."""
    cut = df.select(F.timestamp_add("DAY", F.lit(-days), F.max(ts))).scalar()
    return df.withColumn("split", F.when(F.col(ts) <= cut, "train").otherwise("test"))


def random_split(df: DataFrame, keys: list[str], fractions=(0.70, 0.15, 0.15), seed: int = 42, names=("train", "calib", "test")) -> DataFrame:
    """Repeatable random split: the side depends on the keys and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 8)
    u = F.conv(digits, 16, 10).cast("long") / F.lit(1 << 32)
    out, edge = F.lit(names[-1]), 1.0
    for fraction, name in reversed(list(zip(fractions[:-1], names[:-1], strict=True))):
        edge = sum(fractions[: names.index(name) + 1])
        out = F.when(u < edge, name).otherwise(out)
    return df.withColumn("split", out)


def qcut(df: DataFrame, col: str, q: int, name: str) -> DataFrame:
    """Quantile bins of the column itself, one-based; equal edges are merged."""
    return cut_by_reference(df, df, col, [i / q for i in range(q + 1)], name, open_ends=False)


def cut_by_reference(df: DataFrame, reference: DataFrame, col: str, probs: list[float], name: str, open_ends: bool = True) -> DataFrame:
    """Bins whose edges are frozen on another table, e.g. the training side.

    Only the edges, one number per probability, come to the driver.
    """
    edges = summarise(reference, [], {}, {f"q{i}": (col, p) for i, p in enumerate(probs)}).first()
    edges = sorted({float(e) for e in edges if e is not None})
    x = F.col(col)
    inner = edges[1:-1]
    position = F.lit(1) + sum([(x > F.lit(e)).cast("int") for e in inner], F.lit(0))
    inside = F.lit(True) if open_ends else x.between(F.lit(edges[0]), F.lit(edges[-1]))
    return df.withColumn(name, F.when(inside & x.isNotNull(), position))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, over rows where both are present."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    ).agg(F.count("*").alias("n"))
    pairs, _ = written(pairs)
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("x", "y")])
    counted = pairs.select(F.inline(sides), "n").groupBy("side", "v").agg(F.sum("n").alias("n"))
    placed = prefix_sums(counted, ["v"], ["n"], ["side"])
    middle = F.col("before_n") + (F.col("n") + 1) / 2.0
    rank = {c: placed.filter(F.col("side") == c).select(F.col("v").alias(c), middle.alias("r" + c)) for c in ("x", "y")}
    ranked, _ = written(pairs.join(rank["x"], "x").join(rank["y"], "y").select("rx", "ry", "n"))
    return weighted_pearson(ranked, "rx", "ry", "n", "spearman")


def weighted_pearson(df: DataFrame, x: str, y: str, weight: str, name: str) -> DataFrame:
    """Pearson correlation of weighted pairs, from centred moments."""
    mean_x = df.select(F.sum(F.col(weight) * F.col(x)) / F.sum(weight)).scalar()
    mean_y = df.select(F.sum(F.col(weight) * F.col(y)) / F.sum(weight)).scalar()
    dx, dy, w = F.col(x) - mean_x, F.col(y) - mean_y, F.col(weight)
    top, bottom = F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy))
    return df.select((top / F.nullif(bottom, F.lit(0.0))).alias(name), F.sum(weight).alias("n"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.corr(x, y).alias("pearson"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))
