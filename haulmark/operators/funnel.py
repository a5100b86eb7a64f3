"""Exclusion funnels and what the exclusions do to the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions.base import count_if
from haulmark.functions.numbers import PRICE_CATEGORICAL, PRICE_NUMERIC, WEIGHT_BANDS_KG, cut, require
from haulmark.operators.centroids import zip_centroids
from haulmark.operators.deliveries import (
    attach_ends,
    attach_geo,
    shipment_features,
    shipment_items,
    shipment_rollup,
)
from haulmark.operators.ordering import summarise, top_k
from haulmark.operators.quality import lag_summary, long_metrics
from haulmark.session import written
from haulmark.sources.star import Star

_REQUIRED = [*PRICE_NUMERIC, "freight_value"]


def excluded(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first table whose key is not in the second."""
    return before.join(after.select(*keys).distinct(), keys, "left_anti")


def flag_member(df: DataFrame, reference: DataFrame, key: str, name: str) -> DataFrame:
    """Membership as a flag; a missing key is not a member."""
    marked = reference.select(key).distinct().withColumn("_in", F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def _placed(rolled: DataFrame, star: Star) -> DataFrame:
    ends = attach_ends(rolled, star)
    return shipment_features(attach_geo(ends, written(zip_centroids(star.geo, "median"))[0]))


def exclusion_funnel(star: Star) -> DataFrame:
    """Rows, share of the raw rows and freight that remain after each step.

    Items are read once: they are rolled up to shipments with a mark for delivered ones, and each
    later step is counted on that table.
    """
    tagged, _ = written(shipment_rollup(shipment_items(star, every=True), ("is_delivered",)))
    lines, freight, kept = F.col("quantity_items"), F.col("freight_value"), F.coalesce("is_delivered", F.lit(False))
    first = {
        "raw_items": (F.sum(lines), F.sum(freight)),
        "delivered_items": (F.sum(F.when(kept, lines)), F.sum(F.when(kept, freight))),
        "shipments": (count_if(kept), F.sum(F.when(kept, freight))),
    }
    # A condition that meets a missing value is not met: the row leaves.
    complete = F.col("distance_km").isNotNull() & freight.isNotNull()
    valid = complete & (freight >= 0) & (F.col("weight_total_kg") > 0) & (lines > 0)
    last = {
        label: (count_if(c), F.sum(F.when(c, freight)))
        for label, c in {"with_both_ends": F.lit(True), "complete": complete, "in_domain": valid}.items()
    }

    def steps(df, measures, start):
        one = df.agg(*[F.struct(F.coalesce(n, F.lit(0)).alias("n"), f.alias("f")).alias(label) for label, (n, f) in measures.items()])
        rows = [F.struct(F.lit(start + i).alias("step"), F.lit(m).alias("label"), F.col(f"{m}.n").alias("n"), F.col(f"{m}.f").alias("f")) for i, m in enumerate(measures)]
        return one.select(F.inline(F.array(*rows)))

    out = steps(tagged, first, 0).unionByName(steps(_placed(tagged.filter("is_delivered").drop("is_delivered"), star), last, 3))
    raw = tagged.select(F.sum(lines)).scalar()
    return out.select(
        "step", "label", F.col("n").alias("rows"), F.round(100 * F.col("n") / raw, 2).alias("pct_of_raw"), F.round("f", 2).alias("freight")
    )


def segment_funnel(core: DataFrame) -> DataFrame:
    """Orders left after each requirement of the segmentation, counted in one pass."""
    c = F.col
    conditions = [
        ("curated", F.lit(True)),
        ("active", c("active")),
        ("with_distance", c("dist_km").isNotNull()),
        ("with_weight", c("weight_g").isNotNull()),
        ("with_goods", c("goods_value").isNotNull()),
        ("with_lead", c("lead_days").isNotNull()),
        ("positive", (c("weight_g") > 0) & (c("goods_value") > 0) & (c("lead_days") > 0)),
    ]
    seen, columns = F.lit(True), {}
    for name, test in conditions:
        seen = seen & test
        columns[name] = count_if(seen)
    one = core.agg(*[x.alias(n) for n, x in columns.items()])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), F.col(n).alias("rows")) for i, n in enumerate(columns)])
    return one.select(F.inline(rows))


def exclusion_bias(star: Star) -> DataFrame:
    """Typical values of what left the table, by cause, next to what stayed."""
    status = star.orders.select("order_id", F.when(F.col("order_status") == "delivered", "kept_delivered").otherwise("left_by_status").alias("cause"))
    lines = star.items.join(status, "order_id")
    items = summarise(
        lines, ["cause"], {"rows": F.count("*"), "mean_freight": F.avg("freight_value")},
        {"median_freight": ("freight_value", 0.5), "median_price": ("price", 0.5)},
    )
    full, _ = written(_placed(shipment_rollup(shipment_items(star)), star))
    kept = require(full, _REQUIRED, [*PRICE_CATEGORICAL, "purchase_ts"])
    no_geo = full.filter("distance_km IS NULL").withColumn("cause", F.lit("left_incomplete"))
    domain = kept.filter("NOT (freight_value >= 0 AND weight_total_kg > 0 AND quantity_items > 0)").withColumn(
        "cause", F.lit("left_domain")
    )
    shipments = summarise(
        no_geo.select("cause", "freight_value", "declared_value").unionByName(domain.select("cause", "freight_value", "declared_value")),
        ["cause"], {"rows": F.count("*"), "mean_freight": F.avg("freight_value")},
        {"median_freight": ("freight_value", 0.5), "median_price": ("declared_value", 0.5)},
    )
    money = ("mean_freight", "median_freight", "median_price")
    return items.unionByName(shipments).withColumns({c: F.round(c, 2) for c in money})


def grain_stats(star: Star, shipments: DataFrame) -> DataFrame:
    """Items, orders, shipments, orders with several sellers, items per order, distinct routes.

    Item rows meet on (order, seller) first, so the order level only sees that many rows.
    """
    pairs = star.items.groupBy("order_id", "seller_id").agg(F.count("*").alias("n"))
    per_order = pairs.groupBy("order_id").agg(F.sum("n").alias("items"), F.count("seller_id").alias("sellers"))
    names = {
        "items": F.sum("items"),
        "orders": F.count("*"),
        "shipments": F.sum("sellers"),
        "multi_seller_orders": count_if(F.col("sellers") > 1),
        "multi_seller_pct": F.round(100 * F.avg((F.col("sellers") > 1).cast("double")), 4),
        "items_per_order_max": F.max("items"),
    }
    one = summarise(per_order, [], names, {"items_per_order_p50": ("items", 0.5)})
    routes = shipments.agg(F.count_distinct("route").alias("routes"), F.count("*").alias("final_shipments"))
    return long_metrics(one, [*names, "items_per_order_p50"], "grain").unionByName(
        long_metrics(routes, ["routes", "final_shipments"], "grain")
    )


LATENCY_PAIRS = {
    "purchase_to_approval": ("purchase_ts", "approved_ts"),
    "approval_to_carrier": ("approved_ts", "carrier_ts"),
    "carrier_to_delivery": ("carrier_ts", "delivered_ts"),
    "purchase_to_delivery": ("purchase_ts", "delivered_ts"),
}


def latency_table(orders: DataFrame, pairs: dict[str, tuple[str, str]] = LATENCY_PAIRS) -> DataFrame:
    return lag_summary(orders, pairs)


def geo_coverage(star: Star, centroids: DataFrame) -> DataFrame:
    """Customers per state and sellers per state whose ZIP has no centroid."""

    def side(df, key, state, name):
        return flag_member(df, centroids, "zip_prefix", "ok").groupBy(F.col(state).alias("state")).agg(
            F.count("*").alias("total"), count_if(~F.col("ok")).alias("without_geo")
        ).withColumn("side", F.lit(name))

    out = side(star.customers, "customer_id", "customer_state", "customers").unionByName(
        side(star.sellers, "seller_id", "seller_state", "sellers")
    )
    return out.withColumn("without_pct", F.round(100 * F.col("without_geo") / F.col("total"), 4))


def value_concentration(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Distinct values, weight of the most common ones, share of zeros."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    top = top_k(counted, [F.desc("n"), F.col(col)], k).select(F.sum("n")).scalar()
    zero = F.coalesce(F.sum(F.when(F.col(col) == 0, F.col("n"))), F.lit(0))
    return counted.agg(
        F.count("*").alias("distinct_values"),
        F.sum("n").alias("rows"),
        F.round(100 * top / F.sum("n"), 4).alias("top_pct"),
        zero.alias("zeros"),
        F.round(100 * zero / F.sum("n"), 4).alias("zero_pct"),
    )


def cell_dispersion(shipments: DataFrame, min_n: int = 30, bands=WEIGHT_BANDS_KG) -> DataFrame:
    """Freight dispersion inside each route and weight band with enough shipments."""
    base = shipments.withColumn("band", cut("weight_total_kg", *bands)).filter("route IS NOT NULL AND band IS NOT NULL")
    cells = summarise(
        base,
        ["route", "band"],
        {"n": F.count("*"), "sd": F.stddev_samp("freight_value"), "lowest": F.min("freight_value"), "highest": F.max("freight_value")},
        {"median": ("freight_value", 0.5)},
    )
    return cells.filter(F.col("n") >= min_n).withColumn("cv", F.col("sd") / F.nullif("median", F.lit(0.0)))


def dispersion_summary(cells: DataFrame) -> DataFrame:
    out = summarise(cells, [], {"cells": F.count("*")}, {"cv_p50": ("cv", 0.5), "cv_p90": ("cv", 0.9)})
    return out.withColumns({c: F.round(c, 4) for c in ("cv_p50", "cv_p90")})
