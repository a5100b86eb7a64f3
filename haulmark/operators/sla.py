"""Service-level reports with the reported and the honest denominator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions.base import count_if, flag
from haulmark.functions.times import year_month
from haulmark.operators.ordering import ranks, summarise


def sla_by(df: DataFrame, key: str, min_n: int = 200) -> DataFrame:
    """Lateness per group under both denominators, the jump, and the ranks among large groups.

    Reported divides by orders with a delivery date; honest divides by all active orders and
    counts an overdue order without a record as late.
    """
    base = df.filter("active")
    out = summarise(
        base,
        [key],
        {
            "orders": F.count("*"),
            "measurable": count_if(F.col("measurable")),
            "late_orders": count_if(flag(F.col("delivered_ts") > F.col("promised_ts"))),
            "overdue": count_if(F.col("overdue_no_record")),
        },
        {"median_lead": ("lead_days", 0.5)},
    )
    out = out.select(
        key,
        "orders",
        "measurable",
        (F.col("orders") - F.col("measurable")).alias("no_record"),
        F.round(100 * (F.col("orders") - F.col("measurable")) / F.col("orders"), 2).alias("no_record_pct"),
        F.round(100 * F.col("late_orders") / F.nullif("measurable", F.lit(0)), 2).alias("reported_pct"),
        F.round(100 * (F.col("late_orders") + F.col("overdue")) / F.col("orders"), 2).alias("honest_pct"),
        F.round("median_lead", 1).alias("median_lead"),
    ).withColumn("jump_pp", F.round(F.col("honest_pct") - F.col("reported_pct"), 2))
    large = ranks(out.filter(F.col("orders") >= min_n), {"reported_pct": "rank_reported", "honest_pct": "rank_honest"})
    large = large.select(F.col(key).alias("_key"), "rank_reported", "rank_honest")
    return out.join(large, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def population_cuts(df: DataFrame) -> DataFrame:
    """Size of each analysis population and its share of all orders."""
    analytic = F.col("active") & ~F.col("qa_quarantine") & ~F.col("qa_incomplete_tail")
    cuts = {
        "todos": F.lit(True),
        "ativos": F.col("active"),
        "analitico": analytic,
        "mensuravel": F.col("active") & F.col("measurable"),
        "limpos": F.col("qa_flags_total") == 0,
    }
    one = df.agg(*[count_if(c).alias(n) for n, c in cuts.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("population"), F.col(n).alias("orders")) for n in cuts])
    return one.select(F.col("todos").alias("_all"), F.inline(pairs)).select(
        "population", "orders", F.round(100 * F.col("orders") / F.col("_all"), 4).alias("pct")
    )


def analytic_cut(df: DataFrame) -> DataFrame:
    return df.filter("active AND NOT qa_quarantine AND NOT qa_incomplete_tail")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per non-null value with their share."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    total = df.select(F.count(col)).scalar()
    return counted.withColumn("pct", F.round(100 * F.col("n") / total, 4))


def sla_headline(df: DataFrame) -> DataFrame:
    """Reported and honest lateness over active orders and what separates them."""
    late, honest = F.col("late").cast("double"), F.col("honest_late").cast("double")
    return df.filter("active").agg(
        F.round(100 * F.avg(late), 4).alias("reported_pct"),
        F.count("late").alias("reported_n"),
        F.round(100 * F.avg(honest), 4).alias("honest_pct"),
        F.count("honest_late").alias("honest_n"),
        F.round(100 * (F.avg(honest) - F.avg(late)), 4).alias("delta_pp"),
        count_if(F.col("overdue_no_record")).alias("overdue_no_record"),
        count_if(~F.col("measurable")).alias("without_delivery"),
    )


def overdue_by(df: DataFrame, key: str = "branch", k: int = 10) -> DataFrame:
    """Groups with most overdue orders without a record, and their rate among active orders."""
    out = df.filter("active").groupBy(key).agg(
        count_if(F.col("overdue_no_record")).alias("overdue"), F.count("*").alias("active_orders")
    )
    out = out.filter("overdue > 0").withColumn("rate_pct", F.round(100 * F.col("overdue") / F.col("active_orders"), 4))
    return out.orderBy(F.desc("overdue"), key).limit(k)


def sla_by_month(df: DataFrame, min_n: int = 50) -> DataFrame:
    """Monthly series; a month mostly inside the incomplete tail is marked."""
    out = df.filter("active").groupBy(year_month("purchase_ts").alias("month")).agg(
        F.count("*").alias("orders"),
        F.round(100 * F.avg(F.col("late").cast("double")), 4).alias("reported_pct"),
        F.round(100 * F.avg(F.col("honest_late").cast("double")), 4).alias("honest_pct"),
        (F.avg(F.col("qa_incomplete_tail").cast("double")) > 0.5).alias("in_tail"),
    )
    return out.filter(F.col("orders") >= min_n)
