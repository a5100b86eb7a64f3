"""The seven-dimension data-quality scorecard; every report is rows, one metric each or one group each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.config import CostConfig
from haulmark.functions.base import count_if, flag
from haulmark.functions.text import SAO_PAULO_SUFFIXES, SAO_PAULO_VARIANTS, matches_entity, norm_text
from haulmark.functions.times import hours_between
from haulmark.operators.deliveries import NEAR_DUPLICATE_KEYS
from haulmark.operators.ordering import summarise
from haulmark.sources.star import Star


def long_metrics(one_row: DataFrame, names: list[str], section: str) -> DataFrame:
    """One row of named numbers as rows of (section, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return one_row.select(F.lit(section).alias("section"), F.inline(pairs))


def counters(df: DataFrame, conditions: dict[str, Column], section: str) -> DataFrame:
    """Many conditional counts in one pass over the table."""
    return long_metrics(df.agg(*[count_if(c).alias(n) for n, c in conditions.items()]), list(conditions), section)


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls and their share per column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])
    return one.select("_n", F.inline(pairs)).select(
        "column", "nulls", F.round(100 * F.col("nulls") / F.col("_n"), 2).alias("pct")
    )


def null_by_group(df: DataFrame, key: str, cols: list[str], rate_of: str, min_n: int = 100) -> DataFrame:
    """Nulls per group; groups of enough volume above the overall rate are marked."""
    out = df.groupBy(key).agg(
        F.count("*").alias("orders"), *[count_if(F.col(c).isNull()).alias("no_" + c) for c in cols]
    )
    overall = df.select(F.avg(F.col(rate_of).isNull().cast("double"))).scalar()
    rate = F.col("no_" + rate_of) / F.col("orders")
    return out.withColumn("rate_pct", F.round(100 * rate, 2)).withColumn(
        "above_average", (F.col("orders") >= min_n) & (rate > overall)
    )


def uniqueness_report(star: Star) -> DataFrame:
    """Exact duplicates, repeated keys and near-duplicates of every table.

    Each figure comes from a count per key: surplus rows are ``n - 1`` over the keys.
    """

    def keyed(df: DataFrame, keys: list[str], section: str, wanted: dict[str, Column]) -> DataFrame:
        counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
        return long_metrics(counted.agg(*[c.alias(n) for n, c in wanted.items()]), list(wanted), section)

    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    repeated_rows = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    repeated_keys = count_if(F.col("n") > 1)
    orders, items = star.orders.drop("priority"), star.items
    # Both counts of the lines come from one shuffle, by two keys that are in either.
    counted = items.repartition("order_id", "product_id").groupBy(*items.columns).agg(F.count("*").alias("n"))
    near = counted.groupBy(*NEAR_DUPLICATE_KEYS).agg(F.sum("n").alias("n")).filter("n > 1")
    near_orders = near.groupBy("order_id").agg(F.sum("n").alias("n"))
    parts = [
        keyed(orders, orders.columns, "orders", {"exact_duplicates": surplus}),
        keyed(orders, ["order_id"], "orders_id", {"repeated_ids": surplus}),
        long_metrics(counted.agg(surplus.alias("exact_duplicates")), ["exact_duplicates"], "items"),
        long_metrics(
            near_orders.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("orders")),
            ["rows", "orders"],
            "near_duplicates",
        ),
        keyed(star.reviews, ["review_id"], "reviews_id", {"repeated_ids": surplus}),
        keyed(star.reviews, ["order_id"], "reviews_order", {"rows": repeated_rows, "orders": repeated_keys}),
        keyed(star.payments, ["order_id"], "payments_order", {"rows": repeated_rows}),
        keyed(star.geo, star.geo.columns, "geo", {"exact_duplicates": surplus, "rows": F.sum("n")}),
    ]
    if "customer_unique_id" in star.customers.columns:
        parts.append(keyed(star.customers, ["customer_unique_id"], "customers", {"repeated_ids": surplus}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spelling_variants(pairs: DataFrame, k: int = 8) -> DataFrame:
    """Normalised cities with most spellings."""
    spelt = pairs.select(norm_text("city").alias("name"), "city").distinct()
    return (
        spelt.groupBy("name")
        .agg(F.count("*").alias("spellings"), F.array_join(F.array_sort(F.collect_set("city")), " | ").alias("examples"))
        .orderBy(F.desc("spellings"), "name")
        .limit(k)
    )


def consistency_report(pairs: DataFrame, variants=SAO_PAULO_VARIANTS, suffixes=SAO_PAULO_SUFFIXES, many: int = 3) -> DataFrame:
    """Per field: spellings before and after normalising, groups of many, states inside the text."""
    counted = pairs.groupBy("field", "city").agg(F.count("*").alias("rows"))
    named = counted.withColumns({"name": norm_text("city"), "entity": matches_entity("city", variants, suffixes)})
    per_name = named.groupBy("field", "name").agg(
        F.count("*").alias("spellings"),
        F.sum("rows").alias("rows"),
        count_if(F.col("city").contains("/") | F.col("city").contains("-") | (F.col("city") != F.trim("city"))).alias("embedded"),
        count_if(F.col("entity")).alias("entity_spellings"),
    )
    return per_name.groupBy("field").agg(
        F.sum("spellings").alias("spellings"),
        F.count("*").alias("names"),
        count_if(F.col("spellings") >= many).alias("names_with_many"),
        F.sum("embedded").alias("embedded_state"),
        F.sum("entity_spellings").alias("entity_spellings"),
        F.sum("rows").alias("rows"),
    )


def validity_report(star: Star, deliveries: DataFrame) -> DataFrame:
    """Values outside their possible domain, one pass per table."""
    delivered = F.col("order_status") == "delivered"
    c = F.col
    orders = {
        "delivered_before_purchase": delivered & (c("delivered_ts") < c("purchase_ts")),
        "delivered_before_carrier": delivered & (c("delivered_ts") < c("carrier_ts")),
        "approved_before_purchase": c("approved_ts") < c("purchase_ts"),
        "limit_before_purchase": delivered & (c("shipping_limit_ts") < c("purchase_ts")),
        "zero_freight_delivered": delivered & (c("freight_value") == 0),
    }
    products = {
        "weight_not_positive": c("weight_g") <= 0,
        "weight_missing": c("weight_g").isNull(),
        "dimension_not_positive": flag(c("length_cm") <= 0) | flag(c("height_cm") <= 0) | flag(c("width_cm") <= 0),
    }
    items = {"price_not_positive": c("price") <= 0, "freight_negative": c("freight_value") < 0}
    payments = {
        "payment_not_positive": c("payment_value") <= 0,
        "card_without_installments": (c("installments") == 0) & (c("payment_type") == "credit_card"),
        "channel_not_defined": c("payment_type") == "not_defined",
    }
    reviews = {"score_out_of_range": ~flag(c("review_score").between(1, 5))}
    without = star.customers.join(star.geo.select("zip_prefix").distinct(), "zip_prefix", "left_anti")
    return (
        counters(deliveries, orders, "orders")
        .unionByName(counters(star.products, products, "products"))
        .unionByName(counters(star.items, items, "items"))
        .unionByName(counters(star.payments, payments, "payments"))
        .unionByName(counters(star.reviews, reviews, "reviews"))
        .unionByName(counters(without, {"zip_without_geo": F.lit(True)}, "customers"))
    )


def accuracy_report(star: Star, deliveries: DataFrame) -> DataFrame:
    """Possible but implausible values, and the lead-time distribution."""
    done = deliveries.filter("order_status = 'delivered'").withColumns(
        {
            "lead": hours_between("purchase_ts", "delivered_ts") / 24,
            "gap": F.abs(F.col("paid_value") - (F.col("goods_value") + F.col("freight_value"))),
        }
    )
    c = F.col
    aggs = {
        "lead_n": F.count("lead"),
        "lead_mean": F.avg("lead"),
        "lead_sd": F.stddev_samp("lead"),
        "lead_min": F.min("lead"),
        "lead_max": F.max("lead"),
        "lead_over_100_days": count_if(c("lead") > 100),
        "lead_under_12_hours": count_if(c("lead") < 0.5),
        "freight_over_3x_goods": count_if((c("freight_value") > 3 * c("goods_value")) & (c("goods_value") > 0)),
        "payment_differs": count_if(c("gap") > 1),
    }
    quantiles = {"lead_p50": ("lead", 0.5), "lead_p90": ("lead", 0.9), "lead_p99": ("lead", 0.99), "gap_p50": ("gap", 0.5)}
    orders = summarise(done, [], aggs, quantiles)
    sides = F.coalesce(c("length_cm"), F.lit(0)) + F.coalesce(c("height_cm"), F.lit(0)) + F.coalesce(c("width_cm"), F.lit(0))
    products = {
        "weight_over_30kg": count_if(c("weight_g") > 30000),
        "weight_max_g": F.max("weight_g"),
        "sides_over_250_cm": count_if(sides > 250),
    }
    return long_metrics(orders, [*aggs, *quantiles], "orders").unionByName(
        long_metrics(star.products.agg(*[x.alias(n) for n, x in products.items()]), list(products), "products")
    )


def lag_summary(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Hours between two timestamps per named pair: median, p90, maximum, negatives, missing."""
    lags = F.array(*[F.struct(F.lit(n).alias("stage"), hours_between(a, b).alias("h")) for n, (a, b) in pairs.items()])
    out = summarise(
        df.select(F.inline(lags)),
        ["stage"],
        {"max_h": F.max("h"), "negative": count_if(F.col("h") < 0), "missing": count_if(F.col("h").isNull())},
        {"p50_h": ("h", 0.5), "p90_h": ("h", 0.9)},
    )
    return out.withColumns({c: F.round(c, 1) for c in ("max_h", "p50_h", "p90_h")})


def timeliness_report(star: Star, as_of: str, tail_days: int = 60) -> DataFrame:
    """Record lags, the incomplete tail and the age of the extract on a given day."""
    orders, delivered = star.orders, star.orders.filter("order_status = 'delivered'")
    parts = [
        lag_summary(orders, {"purchase_to_approval": ("purchase_ts", "approved_ts")}),
        lag_summary(delivered, {"approval_to_dispatch": ("approved_ts", "carrier_ts")}),
        lag_summary(star.reviews, {"review_to_answer": ("created_ts", "answered_ts")}),
    ]
    names = ["p50_h", "p90_h", "max_h", "negative"]
    out = None
    for p in parts:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        rows = p.select(F.col("stage").alias("section"), F.inline(pairs))
        out = rows if out is None else out.unionByName(rows)
    last = orders.select(F.max("purchase_ts")).scalar()
    tail = orders.filter(F.col("purchase_ts") >= F.timestamp_add("DAY", F.lit(-tail_days), last)).agg(
        F.count("*").alias("orders"),
        count_if(F.col("delivered_ts").isNull()).alias("without_delivery"),
        F.round(100 * F.avg(F.col("delivered_ts").isNull().cast("double")), 4).alias("without_delivery_pct"),
    )
    age = orders.agg(
        F.floor(hours_between(F.max("purchase_ts"), F.to_timestamp(F.lit(as_of))) / 24).alias("age_days")
    )
    return out.unionByName(
        long_metrics(tail, ["orders", "without_delivery", "without_delivery_pct"], "tail")
    ).unionByName(long_metrics(age, ["age_days"], "extract"))


def provenance_by(df: DataFrame, key: str) -> DataFrame:
    """Recording quality per origin over active orders; the group without origin stays."""
    out = summarise(
        df.filter("active"),
        [key],
        {
            "orders": F.count("*"),
            "no_carrier_pct": F.avg(F.col("carrier_ts").isNull().cast("double")),
            "no_delivery_pct": F.avg(F.col("delivered_ts").isNull().cast("double")),
            "no_weight_pct": F.avg(F.col("weight_g_original").isNull().cast("double")),
            "late_pct": F.avg(flag(F.col("delivered_ts") > F.col("promised_ts")).cast("double")),
        },
        {"median_lead": ("lead_days", 0.5)},
    )
    shares = {c: F.round(100 * F.col(c), 2) for c in out.columns if c.endswith("_pct")}
    return out.withColumns({**shares, "median_lead": F.round("median_lead", 1)})


def defect_cost(star: Star, core: DataFrame, pairs: DataFrame, cfg: CostConfig = CostConfig()) -> DataFrame:
    """Yearly cost of the three gravest defects: lost delivery records, duplicates, city spellings."""
    median_freight = summarise(
        core.filter("order_status = 'delivered'"), [], {}, {"m": ("freight_value", 0.5)}
    ).select("m").scalar()
    first, last = F.min("purchase_ts"), F.max("purchase_ts")
    yearly = star.orders.select(365 / F.floor(hours_between(first, last) / 24)).scalar()
    overdue = core.agg(count_if(F.col("overdue_no_record")).alias("affected"))
    near = star.items.groupBy(*NEAR_DUPLICATE_KEYS).agg(F.count("*").alias("n")).filter("n > 1")
    duplicated = near.agg(F.count_distinct("order_id").alias("affected"))
    spelt = pairs.filter("field = 'geolocation_city' OR field = 'customer_city'").select(norm_text("city").alias("name"), "city").distinct()
    cities = spelt.groupBy("name").agg(F.count("*").alias("n")).agg(count_if(F.col("n") >= 3).alias("affected"))
    fine = cfg.penalty * median_freight

    def cost(df, defect, unit):
        return df.select(F.lit(defect).alias("defect"), "affected", F.round(F.col("affected") * unit * yearly, 2).alias("yearly_cost"))

    return (
        cost(overdue, "overdue_without_record", fine + cfg.redelivery)
        .unionByName(cost(duplicated, "near_duplicate_orders", fine))
        .unionByName(cost(cities, "cities_with_many_spellings", cfg.misrouted_per_city * (fine + cfg.redelivery)))
    )


def scorecard(evidence: DataFrame, grades: dict[str, float]) -> DataFrame:
    """Grades given by people next to the counted evidence, with the mean grade.

    ``evidence`` has (section, metric, value); ``grades`` maps a section to its grade. Evidence
    of a section without a grade stays, with a null grade.
    """
    spark = evidence.sparkSession
    given = spark.createDataFrame(list(grades.items()), "section string, grade double")
    mean = sum(grades.values()) / len(grades)
    return evidence.join(given, "section", "left").withColumn("mean_grade", F.round(F.lit(mean), 1))
