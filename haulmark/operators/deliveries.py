"""Order-grain and shipment-grain tables built from the star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.geo import city_kind, geo_profile, haversine_km, route_key, same_state
from haulmark.functions.numbers import PRICE_NUMERIC, cubage, require, valid_shipments
from haulmark.functions.times import days_between
from haulmark.operators.centroids import zip_centroids
from haulmark.session import written
from haulmark.sources.star import Star

NEAR_DUPLICATE_KEYS = ["order_id", "product_id", "seller_id", "price", "freight_value"]
ITEM_ORDER = ["order_item_id", "product_id", "seller_id", "price", "freight_value"]
_FIRST = ["product_id", "seller_id", "shipping_limit_ts"]
#: Orders are looked at in so many shares by hash; a share is crowded over so many lines and four times the mean.
ORDER_SHARES, CROWDED_LINES = 65536, 100_000


def item_rollup(items: DataFrame) -> DataFrame:
    """Per order: first item, totals, count, and whether it holds near-duplicate lines.

    "First" is the first non-null value of each column in line order. Lines are shuffled once, as
    they are, to the task of their order. Only orders in a crowded share of all orders are counted
    per near-duplicate key before they meet, so one huge order is reduced by many tasks.
    """
    share = F.pmod(F.xxhash64("order_id"), F.lit(ORDER_SHARES))
    counted = items.groupBy(share.alias("_share")).agg(F.count("*").alias("_n"))
    mean = F.avg("_n").over(Window.partitionBy(F.lit(0)))
    # At most one row per share; fewer than a quarter of them hold four times the mean.
    crowded = counted.withColumn("_mean", mean).filter(F.col("_n") > F.greatest(F.lit(CROWDED_LINES), 4 * F.col("_mean")))
    marked = items.withColumn("_share", share).join(F.broadcast(crowded.select("_share", F.lit(True).alias("_crowded"))), "_share", "left")
    spread, whole = marked.filter("_crowded"), marked.filter("_crowded IS NULL").drop("_crowded", "_share").repartition("order_id")
    return _rolled(whole).unionByName(_rolled(spread))


def _rolled(items: DataFrame) -> DataFrame:
    # Within a near-duplicate key only the line's number and limit tell lines apart.
    here = F.struct("order_item_id", "shipping_limit_ts")
    lines = items.groupBy(*NEAR_DUPLICATE_KEYS).agg(
        F.count("order_item_id").alias("n"),
        F.count("*").alias("lines"),
        F.sum("price").alias("goods"),
        F.sum("freight_value").alias("freight"),
        F.min(here).alias("here"),
        F.min(F.when(F.col("shipping_limit_ts").isNotNull(), here)).alias("limited"),
    )

    def first(c):
        at = "limited" if c == "shipping_limit_ts" else "here"
        place = F.struct(f"{at}.order_item_id", *ITEM_ORDER[1:], f"{at}.shipping_limit_ts")
        return F.min(F.when(F.col(at if at == "limited" else c).isNotNull(), place))[c].alias(c)

    return lines.groupBy("order_id").agg(
        *[first(c) for c in _FIRST],
        F.sum("n").alias("n_items"),
        F.sum("goods").alias("goods_value"),
        F.sum("freight").alias("freight_value"),
        F.max(F.col("lines") > 1).alias("near_duplicate"),
    )


def payment_rollup(payments: DataFrame) -> DataFrame:
    """Per order: amount paid and the first channel by payment sequence."""
    order = F.struct("payment_sequential", "payment_type")
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("paid_value"),
        F.min(F.when(F.col("payment_type").isNotNull(), order))["payment_type"].alias("payment_channel"),
    )


def order_rollup(star: Star) -> DataFrame:
    """Item and payment rollups of the orders that have any."""
    return item_rollup(star.items).join(payment_rollup(star.payments), "order_id", "full_outer")


def near_duplicates(items: DataFrame, keys: list[str] = NEAR_DUPLICATE_KEYS) -> DataFrame:
    """Item groups that occur more than once; nothing is removed."""
    return items.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def build_deliveries(star: Star) -> DataFrame:
    """One row per order, none lost: left joins of rollups and dimensions.

    No broadcast hint is given: dimensions are written, so the optimiser picks a broadcast from the
    size of their files. What must be shuffled for a dimension is one side, orders or rollups, before both
    meet on their order.
    """
    sellers, _ = written(star.sellers.select("seller_id", F.col("zip_prefix").alias("seller_zip"), "seller_state", "seller_city"))
    customers, _ = written(
        star.customers.select("customer_id", F.col("zip_prefix").alias("customer_zip"), "customer_state", "customer_city")
    )
    weights, _ = written(star.products.select("product_id", "weight_g"))
    orders = star.orders.drop("priority")
    lines = item_rollup(star.items).join(weights, "product_id", "left").join(sellers, "seller_id", "left")
    out = (
        orders.join(customers, "customer_id", "left")
        .join(lines, "order_id", "left")
        .join(payment_rollup(star.payments), "order_id", "left")
    )
    keys = ["product_id", "customer_id", "seller_id", "order_id"]
    ends = [c for c in (*sellers.columns, *customers.columns, *weights.columns) if c not in keys]
    return out.select(*keys, *[c for c in out.columns if c not in (*keys, *ends)], *ends)


def shipment_items(star: Star, every: bool = False) -> DataFrame:
    """Items of delivered orders with their product; or ``every`` item, with a mark for those."""
    columns = ["order_id", "customer_id", "purchase_ts", "delivered_ts", "promised_ts"]
    delivered = F.col("order_status") == "delivered"
    orders = star.orders.select(*columns, delivered.alias("is_delivered")) if every else star.orders.filter(delivered).select(*columns)
    products = star.products.select(
        "product_id", "category", "weight_g", (F.col("length_cm") * F.col("height_cm") * F.col("width_cm")).alias("volume_cm3")
    )
    # Orders come last: their join leaves the lines dealt by order, as the rollup behind wants them.
    lines = star.items.join(products, "product_id", "left").join(orders, "order_id", "left" if every else "inner")
    return lines.select("product_id", "order_id", *[c for c in lines.columns if c not in ("product_id", "order_id")])


def shipment_rollup(lines: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    """One row per order and seller (and ``marks``). A sum without values is zero."""

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0.0))

    place = F.struct("order_item_id", "product_id", "category")
    return lines.groupBy("order_id", "seller_id", "customer_id", "purchase_ts", "delivered_ts", "promised_ts", *marks).agg(
        F.count("order_item_id").alias("quantity_items"),
        total("price").alias("declared_value"),
        total("freight_value").alias("freight_value"),
        total("weight_g").alias("weight_total_g"),
        total("volume_cm3").alias("volume_cm3"),
        F.min(F.when(F.col("category").isNotNull(), place))["category"].alias("category"),
    )


def attach_ends(shipments: DataFrame, star: Star, how: str = "inner") -> DataFrame:
    """ZIP prefix of both ends.

    The two columns of each end are written first: the size of the files tells whether the wide
    shipments must be shuffled for them.
    """
    customers, _ = written(star.customers.select("customer_id", F.col("zip_prefix").alias("customer_zip")))
    sellers, _ = written(star.sellers.select("seller_id", F.col("zip_prefix").alias("seller_zip")))
    return shipments.join(customers, "customer_id", how).join(sellers, "seller_id", how)


def attach_geo(df: DataFrame, centroids: DataFrame, origin: str = "seller_zip", dest: str = "customer_zip", columns=("lat", "lng", "city", "state")) -> DataFrame:
    """Centroid, city and state of both ends; a missing centroid leaves nulls."""

    def end(key, prefix):
        return centroids.select(F.col("zip_prefix").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    return df.join(end(origin, "origin"), origin, "left").join(end(dest, "dest"), dest, "left")


def attach_reviews(df: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mean review of the order."""
    return df.join(reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score")), "order_id", "left")


def shipment_features(df: DataFrame) -> DataFrame:
    """Distance, weights, calendar and route columns of shipments with both ends attached.

    Ends that carry their ``kind`` need no look at the city of each row.
    """
    if "origin_kind" in df.columns:
        kinds = [F.coalesce(f"{end}_kind", city_kind(F.lit(None).cast("string"))) for end in ("origin", "dest")]
        profile = F.concat_ws("_", *kinds)
    else:
        profile = geo_profile("origin_city", "dest_city")
    return cubage(df).withColumns(
        {
            "distance_km": haversine_km("origin_lat", "origin_lng", "dest_lat", "dest_lng"),
            "month": F.month("purchase_ts"),
            "origin_state": F.upper("origin_state"),
            "dest_state": F.upper("dest_state"),
            "geo_profile": profile,
            "lead_days": days_between("purchase_ts", "delivered_ts"),
            "delay_days": days_between("promised_ts", "delivered_ts"),
        }
    ).withColumns(
        {
            "route": route_key("origin_state", "dest_state"),
            "same_state": same_state("origin_state", "dest_state"),
        }
    ).drop("origin_kind", "dest_kind")


def shipments_before_filters(star: Star) -> DataFrame:
    # Joined at both ends; written, since a checkpoint has no size and would have the wide table shuffled by few prefixes.
    geo, _ = written(zip_centroids(star.geo, stat="median").withColumn("kind", city_kind("city")))
    ends = attach_ends(shipment_rollup(shipment_items(star)), star)
    return shipment_features(attach_geo(ends, geo, columns=("lat", "lng", "city", "state", "kind")))


def _located(df: DataFrame) -> DataFrame:
    """Rows that have a distance: it is a finite number exactly when no coordinate is missing.

    Asked of the coordinates, since a filter on the distance itself has it computed several times for each row.
    """
    return df.filter("origin_lat IS NOT NULL AND origin_lng IS NOT NULL AND dest_lat IS NOT NULL AND dest_lng IS NOT NULL")


def build_shipments(star: Star) -> DataFrame:
    """Shipments for pricing: complete features, freight not negative, weight positive."""
    numeric = [c for c in [*PRICE_NUMERIC, "freight_value"] if c != "distance_km"]
    # Route, same state and profile are given where both states are.
    states = ["origin_state", "dest_state"]
    return valid_shipments(require(_located(shipments_before_filters(star)), numeric, [*states, "purchase_ts"]))


def build_segment_shipments(star: Star) -> DataFrame:
    """Shipments for segmentation: also cubage and lead time, and the mean review."""
    numeric = ["weight_total_kg", "cubic_weight_kg", "declared_value", "freight_value", "lead_days"]
    full = require(_located(shipments_before_filters(star)), numeric, ["quantity_items"])
    return attach_reviews(valid_shipments(full, strict=True), star.reviews)
