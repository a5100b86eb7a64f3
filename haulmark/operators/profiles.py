"""Group profiles, distributions and flag effects over the curated table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.config import NO_BRANCH
from haulmark.functions.base import count_if, flag
from haulmark.functions.times import hours_between, year_month
from haulmark.operators.ordering import share_of_total, summarise

PROBS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def stack(df: DataFrame, columns: dict[str, Column | str], keep: list[str], name: str, value: str) -> DataFrame:
    """Wide to long without a shuffle: one output row per listed column."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias(name), (F.col(c) if isinstance(c, str) else c).alias(value)) for n, c in columns.items()]
    )
    return df.select(*keep, F.inline(pairs))


def distribution(df: DataFrame, cols: list[str], probs=PROBS, digits: int = 4) -> DataFrame:
    """Count, mean, standard deviation and quantiles per column, over non-null values."""
    long = stack(df, {c: F.col(c).cast("double") for c in cols}, [], "column", "v")
    quantiles = {f"p{round(p * 100)}": ("v", p) for p in probs}
    out = summarise(long, ["column"], {"n": F.count("v"), "mean": F.avg("v"), "sd": F.stddev_samp("v")}, quantiles)
    return out.withColumns({c: F.round(c, digits) for c in ["mean", "sd", *quantiles]})


def stage_breakdown(df: DataFrame) -> DataFrame:
    """The three stages of the lead time and each one's part of the summed medians."""
    days = {
        "approval": hours_between("purchase_ts", "approved_ts") / 24,
        "dispatch": hours_between("approved_ts", "carrier_ts") / 24,
        "transport": hours_between("carrier_ts", "delivered_ts") / 24,
    }
    out = summarise(
        stack(df, days, [], "stage", "d"),
        ["stage"],
        {"n": F.count("d"), "mean": F.avg("d")},
        {"median": ("d", 0.5), "p90": ("d", 0.9), "p99": ("d", 0.99)},
    )
    return share_of_total(out, "median", "median_share").withColumns(
        {c: F.round(c, 4) for c in ("mean", "median", "p90", "p99")} | {"median_share": F.round("median_share", 4)}
    )


def profile_by(df: DataFrame, key: str | Column, name: str | None = None) -> DataFrame:
    """Volume, honest lateness, and median lead, freight, goods and ticket of each group."""
    name = name or key
    base = df.withColumn("_group", F.col(key) if isinstance(key, str) else key).filter("_group IS NOT NULL")
    out = summarise(
        base,
        ["_group"],
        {"orders": F.count("*"), "honest_late_pct": 100 * F.avg(F.col("honest_late").cast("double"))},
        {
            "median_lead": ("lead_days", 0.5),
            "median_freight": ("freight_value", 0.5),
            "median_goods": ("goods_value", 0.5),
            "median_paid": ("paid_value", 0.5),
        },
    )
    out = share_of_total(out, "orders", "share_pct").withColumn(
        "freight_over_goods", F.col("median_freight") / F.nullif("median_goods", F.lit(0.0))
    )
    return out.select(
        F.col("_group").alias(name),
        "orders",
        F.round(100 * F.col("share_pct"), 4).alias("share_pct"),
        *[F.round(c, 3).alias(c) for c in ("honest_late_pct", "median_lead", "median_freight", "median_goods", "median_paid")],
        F.round("freight_over_goods", 4).alias("freight_over_goods"),
    )


def extremes(profile: DataFrame, key: str, min_n: int = 300, exclude: str = NO_BRANCH) -> DataFrame:
    """Worst and best group among real ones of enough volume, and their ratio."""
    real = profile.filter((F.col("orders") >= min_n) & (F.col(key) != exclude))
    tie = F.struct("honest_late_pct", key)
    return real.agg(
        F.max(tie)[key].alias("worst"),
        F.max("honest_late_pct").alias("worst_pct"),
        F.min(tie)[key].alias("best"),
        F.min("honest_late_pct").alias("best_pct"),
        F.round(F.max("honest_late_pct") / F.nullif(F.min("honest_late_pct"), F.lit(0.0)), 4).alias("ratio"),
    )


def money_summary(df: DataFrame) -> DataFrame:
    """Totals and medians of goods and freight, and freight over goods in the aggregate."""
    out = summarise(
        df,
        [],
        {"goods_total": F.sum("goods_value"), "freight_total": F.sum("freight_value")},
        {"goods_median": ("goods_value", 0.5), "freight_median": ("freight_value", 0.5)},
    )
    return out.select(
        *[F.round(c, 2).alias(c) for c in ("goods_total", "freight_total", "goods_median", "freight_median")],
        F.round(100 * F.col("freight_total") / F.col("goods_total"), 4).alias("freight_share_pct"),
    )


def approval_latency_by(df: DataFrame, key: str = "payment_channel") -> DataFrame:
    """Median hours from purchase to approval per channel."""
    base = df.filter(F.col(key).isNotNull()).withColumn("_h", hours_between("purchase_ts", "approved_ts"))
    return summarise(base, [key], {"orders": F.count("*")}, {"median_hours": ("_h", 0.5)}).withColumn(
        "median_hours", F.round("median_hours", 2)
    )


def flag_effect(df: DataFrame, flags: list[str], kpi: str = "honest_late", min_n: int = 20, tautology: float = 0.95, protective: float = 0.05) -> DataFrame:
    """Rate of the measure inside and outside each flag, from one pass over the table."""
    long = stack(df, {f: flag(F.col(f)) for f in flags}, [kpi], "flag", "on")
    y = F.col(kpi).cast("double")
    out = long.groupBy("flag").agg(
        count_if(F.col("on")).alias("orders"),
        F.avg(F.when(F.col("on"), y)).alias("inside"),
        F.avg(F.when(~F.col("on"), y)).alias("outside"),
    )
    return out.filter(F.col("orders") >= min_n).select(
        "flag",
        "orders",
        F.round(100 * F.col("inside"), 4).alias("inside_pct"),
        F.round(100 * F.col("outside"), 4).alias("outside_pct"),
        F.round(100 * (F.col("inside") - F.col("outside")), 4).alias("delta_pp"),
        (F.col("inside") >= tautology).alias("tautological"),
        (F.col("inside") <= protective).alias("protective"),
    )


def centroid_report(centroids: DataFrame) -> DataFrame:
    """How far duplicates had moved the centroids."""
    out = summarise(
        centroids,
        [],
        {
            "prefixes": F.count("*"),
            "affected": count_if(F.col("duplicates_removed") > 0),
            "over_1_km": count_if(F.col("centroid_shift_m") > 1000),
            "max_m": F.max("centroid_shift_m"),
        },
        {"p50_m": ("centroid_shift_m", 0.5), "p90_m": ("centroid_shift_m", 0.9), "p99_m": ("centroid_shift_m", 0.99)},
    )
    return out.withColumns({c: F.round(c, 0) for c in ("max_m", "p50_m", "p90_m", "p99_m")})


def city_report(mapping: DataFrame) -> DataFrame:
    """Spellings and rows per kind of change and rule."""
    return mapping.groupBy("change", "rules").agg(F.count("*").alias("spellings"), F.sum("n_rows").alias("n_rows"))


def quarantine_bias(df: DataFrame) -> DataFrame:
    """Medians inside and outside the quarantine: what leaves is not like what stays."""
    out = summarise(
        df,
        ["qa_quarantine"],
        {"orders": F.count("*")},
        {"median_freight": ("freight_value", 0.5), "median_goods": ("goods_value", 0.5), "median_weight_g": ("weight_g", 0.5)},
    )
    return out.withColumns({c: F.round(c, 2) for c in ("median_freight", "median_goods", "median_weight_g")})


def flag_composition(df: DataFrame, flags: list[str]) -> DataFrame:
    """How often each flag occurs, flags that never occur left out."""
    return stack(df, {f: flag(F.col(f)) for f in flags}, [], "flag", "on").filter("on").groupBy("flag").agg(
        F.count("*").alias("orders")
    )


def drift(df: DataFrame, ts: str, medians: dict[str, str], min_n: int = 200) -> DataFrame:
    """Monthly medians of months with enough rows."""
    base = df.withColumn("month", year_month(ts))
    out = summarise(base, ["month"], {"n": F.count("*")}, {n: (c, 0.5) for n, c in medians.items()})
    return out.filter(F.col("n") >= min_n).withColumns({n: F.round(n, 3) for n in medians})


def amplitude(series: DataFrame, col: str, relative: bool = True) -> DataFrame:
    """Largest against smallest of a series: relative, or in its own points."""
    high, low = F.max(col), F.min(col)
    out = 100 * (high / low - 1) if relative else high - low
    return series.agg(low.alias("lowest"), high.alias("highest"), F.round(out, 4).alias("amplitude"))


def target_decomposition(df: DataFrame, pivot: str, min_n: int = 200) -> DataFrame:
    """The honest target per month split into late and overdue parts, before and from a month on."""
    out = df.groupBy(year_month("purchase_ts").alias("month")).agg(
        F.count("*").alias("orders"),
        F.round(100 * F.avg(flag(F.col("honest_late")).cast("double")), 4).alias("honest_pct"),
        F.round(100 * F.avg(flag(F.col("late")).cast("double")), 4).alias("late_pct"),
        F.round(100 * F.avg(F.col("overdue_no_record").cast("double")), 4).alias("overdue_pct"),
    )
    side = F.when(F.col("month") < pivot, "before").otherwise("after")
    return out.filter(F.col("orders") >= min_n).withColumn("side", side)


def crosstab_share(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Long cross table: each cell and its share of the row."""
    cells = df.groupBy(rows, cols).agg(F.count("*").alias("n"))
    totals = cells.groupBy(rows).agg(F.sum("n").alias("_t"))
    return cells.join(totals, rows).select(rows, cols, "n", F.round(100 * F.col("n") / F.col("_t"), 4).alias("row_pct"))


def top_share_by(df: DataFrame, group: str, col: str, k: int = 4) -> DataFrame:
    """Most frequent values of each group with their share among non-null values.

    The window sees one row per value, and the rank limit lets each task keep k of them.
    """
    cells = df.filter(F.col(col).isNotNull()).groupBy(group, col).agg(F.count("*").alias("n"))
    totals = cells.groupBy(group).agg(F.sum("n").alias("_t"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), col))
    top = cells.withColumn("place", place).filter(F.col("place") <= k)
    return top.join(totals, group).select(group, col, "place", "n", F.round(100 * F.col("n") / F.col("_t"), 4).alias("pct"))


def segment_profile(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Medians, means, dispersion and shares of each shipment segment."""
    medians = (
        "distance_km", "weight_total_kg", "cubic_weight_kg", "density", "declared_value", "freight_value",
        "freight_per_kg", "freight_pct_value", "lead_days",
    )
    out = summarise(
        df,
        [segment],
        {
            "shipments": F.count("*"),
            "quantity_mean": F.avg("quantity_items"),
            "freight_mean": F.avg("freight_value"),
            "freight_cv": F.stddev_samp("freight_value") / F.avg("freight_value"),
            "late_pct": 100 * F.avg(flag(F.col("delay_days") > 0).cast("double")),
            "review_mean": F.avg("review_score"),
            "same_state_pct": 100 * F.avg((F.col("same_state") == "same_state").cast("double")),
            "_freight": F.sum("freight_value"),
            "_value": F.sum("declared_value"),
        },
        {c: (c, 0.5) for c in medians},
    )
    for source, name in (("shipments", "share_pct"), ("_freight", "freight_share_pct"), ("_value", "value_share_pct")):
        out = share_of_total(out, source, name).withColumn(name, 100 * F.col(name))
    rounded = [c for c in out.columns if c not in (segment, "shipments", "_freight", "_value")]
    return out.select(segment, "shipments", *[F.round(c, 3).alias(c) for c in rounded])


def artifact_test(df: DataFrame, segment: str, flags: list[str], ratio: float = 2.0, min_rate: float = 0.02, fail_at: float = 3.0) -> DataFrame:
    """Flags over-represented in a segment: the group may be drawn by a record defect."""
    rates = stack(df, {f: flag(F.col(f)) for f in flags}, [segment], "flag", "on").groupBy(segment, "flag").agg(
        F.count("*").alias("n"), count_if(F.col("on")).alias("hits")
    )
    overall = rates.groupBy("flag").agg((F.sum("hits") / F.sum("n")).alias("overall"))
    out = rates.join(overall, "flag").withColumn("rate", F.col("hits") / F.col("n"))
    out = out.filter((F.col("overall") > 0) & (F.col("rate") > 0)).withColumn("enrichment", F.col("rate") / F.col("overall"))
    return out.filter((F.col("enrichment") >= ratio) & (F.col("rate") >= min_rate)).select(
        segment,
        "flag",
        F.round(100 * F.col("rate"), 4).alias("segment_pct"),
        F.round(100 * F.col("overall"), 4).alias("overall_pct"),
        F.round("enrichment", 4).alias("enrichment"),
        F.col("hits").alias("orders"),
        (F.col("enrichment") >= fail_at).alias("fails"),
    )
