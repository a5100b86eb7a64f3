"""Queries over the star, the joins and the curation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.functions import geo, numbers, times
from haulmark.operators import centroids, cities, curation, deliveries
from haulmark.operators import sla as sla_ops
from haulmark.plans.ctes import haversine_sql
from haulmark.plans.registry import query
from haulmark.session import work_folder
from haulmark.sources.star import read_star, write_star


def _text(*names):
    """Timestamps as text, so that both engines hand over the same value."""
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def _sql_text(*names):
    return ", ".join(f"strftime({n},'%Y-%m-%d %H:%M:%S') {n}" for n in names)


_ORDER_TS = ("purchase_ts", "approved_ts", "carrier_ts", "delivered_ts", "promised_ts")


@query("star_orders", f"SELECT order_id, customer_id, order_status, {_sql_text(*_ORDER_TS)} FROM fx_orders")
def _(t):
    return t.star.orders.select("order_id", "customer_id", "order_status", *_text(*_ORDER_TS))


@query("star_orders_from_csv", f"SELECT CAST(order_id AS VARCHAR) order_id, order_status, {_sql_text(*_ORDER_TS)} FROM fx_orders")
def _(t):
    """The star written as CSV and read back as text."""
    folder = work_folder(t.spark)
    write_star(t.star, folder, "csv")
    return read_star(t.spark, folder).orders.select("order_id", "order_status", *_text(*_ORDER_TS))


@query(
    "star_items",
    "SELECT order_id, CAST(order_item_id AS INT) order_item_id, product_id, seller_id, price, freight_value FROM fx_items",
)
def _(t):
    return t.star.items.drop("shipping_limit_ts")


@query(
    "star_payments",
    "SELECT order_id, payment_sequential, payment_type, round(payment_value,3) payment_value FROM fx_payments",
)
def _(t):
    return t.star.payments.select(
        "order_id", "payment_sequential", "payment_type", F.round("payment_value", 3).alias("payment_value")
    )


@query(
    "coerced_timestamps",
    """SELECT event_id, strftime(try_cast(CASE WHEN event_id%7=0 THEN 'n/a' WHEN event_id%7=1 THEN '2024-13-45'
    ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS TIMESTAMP),'%Y-%m-%d %H:%M:%S') seen_at FROM events""",
)
def _(t):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 7 == 1, "2024-13-45").otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    df = t.table("events").select("event_id", raw.alias("seen_at"))
    return times.coerce_timestamps(df, ["seen_at"]).select("event_id", *_text("seen_at"))


@query(
    "first_item_and_totals",
    """SELECT order_id, f.product_id, f.seller_id, n_items, round(goods_value,2) goods_value,
    round(freight_value,2) freight_value, order_id IN (SELECT order_id FROM cu_near) near_duplicate,
    round(paid_value,2) paid_value, payment_channel
    FROM cu_first f JOIN cu_totals USING(order_id) LEFT JOIN cu_paid USING(order_id)""",
)
def _(t):
    money = {c: F.round(c, 2) for c in ("goods_value", "freight_value", "paid_value")}
    return deliveries.order_rollup(t.star).withColumns(money).drop("shipping_limit_ts")


@query(
    "delivery_table",
    """SELECT order_id, seller_id, product_id, customer_id, seller_state, customer_state, seller_zip, customer_zip,
    weight_g, n_items, round(goods_value,2) goods_value, payment_channel FROM cu_joined""",
)
def _(t):
    return deliveries.build_deliveries(t.star).select(
        "order_id", "seller_id", "product_id", "customer_id", "seller_state", "customer_state", "seller_zip",
        "customer_zip", "weight_g", "n_items", F.round("goods_value", 2).alias("goods_value"), "payment_channel",
    )


@query(
    "shipment_lines",
    """SELECT order_id, order_item_id, seller_id, product_id, customer_id, category, weight_g, volume_cm3, price
    FROM sh_items""",
)
def _(t):
    return deliveries.shipment_items(t.star).select(
        "order_id", "order_item_id", "seller_id", "product_id", "customer_id", "category", "weight_g", "volume_cm3", "price"
    )


@query(
    "shipments_rolled_up",
    """SELECT order_id, seller_id, customer_id, quantity_items, round(declared_value,2) declared_value,
    round(freight_value,2) freight_value, weight_total_g, volume_cm3, category FROM sh_rollup""",
)
def _(t):
    return deliveries.shipment_rollup(deliveries.shipment_items(t.star)).select(
        "order_id", "seller_id", "customer_id", "quantity_items", F.round("declared_value", 2).alias("declared_value"),
        F.round("freight_value", 2).alias("freight_value"), "weight_total_g", "volume_cm3", "category",
    )


@query(
    "shipments_with_both_ends",
    """SELECT order_id, seller_id, origin_state, origin_city, dest_state, dest_city, round(origin_lat,4) origin_lat,
    round(dest_lng,4) dest_lng, round(distance_km,3) distance_km, route, same_state, geo_profile FROM sh_all""",
)
def _(t):
    return deliveries.shipments_before_filters(t.star).select(
        "order_id", "seller_id", "origin_state", "origin_city", "dest_state", "dest_city",
        F.round("origin_lat", 4).alias("origin_lat"), F.round("dest_lng", 4).alias("dest_lng"),
        F.round("distance_km", 3).alias("distance_km"), "route", "same_state", "geo_profile",
    )


@query(
    "priceable_shipments",
    """SELECT order_id, seller_id, quantity_items, round(declared_value,2) declared_value,
    round(freight_value,2) freight_value, weight_total_kg, round(distance_km,3) distance_km, CAST("month" AS INT) "month"
    FROM sh_price""",
)
def _(t):
    return deliveries.build_shipments(t.star).select(
        "order_id", "seller_id", "quantity_items", F.round("declared_value", 2).alias("declared_value"),
        F.round("freight_value", 2).alias("freight_value"), "weight_total_kg",
        F.round("distance_km", 3).alias("distance_km"), F.col("month").cast("int").alias("month"),
    )


@query(
    "segment_shipments",
    """SELECT order_id, seller_id, round(cubic_weight_kg,4) cubic_weight_kg, round(density,4) density,
    round(freight_per_kg,4) freight_per_kg, round(freight_pct_value,4) freight_pct_value, round(lead_days,4) lead_days,
    round(delay_days,4) delay_days, review_score FROM sh_segment""",
)
def _(t):
    rounded = ("cubic_weight_kg", "density", "freight_per_kg", "freight_pct_value", "lead_days", "delay_days")
    return deliveries.build_segment_shipments(t.star).select(
        "order_id", "seller_id", *[F.round(c, 4).alias(c) for c in rounded], "review_score"
    )


@query(
    "shipment_price_features",
    """SELECT order_id, seller_id, round(ln(1+distance_km),4) x_distance_km, round(ln(1+weight_total_kg),4) x_weight_total_kg,
    round(ln(1+quantity_items),4) x_quantity_items, round(ln(1+declared_value),4) x_declared_value,
    CAST("month" AS DOUBLE) x_month, route x_route FROM sh_price""",
)
def _(t):
    rounded = ("x_distance_km", "x_weight_total_kg", "x_quantity_items", "x_declared_value")
    return numbers.prepare_features(deliveries.build_shipments(t.star)).select(
        "order_id", "seller_id", *[F.round(c, 4).alias(c) for c in rounded], "x_month", "x_route"
    )


@query(
    "shipment_segment_features",
    """SELECT order_id, seller_id, round(ln(1+cubic_weight_kg),4) x_cubic_weight_kg,
    round(ln(greatest(density,0.001)),4) x_log_density, round(ln(1+declared_value),4) x_declared_value FROM sh_segment""",
)
def _(t):
    rounded = ("x_cubic_weight_kg", "x_log_density", "x_declared_value")
    return numbers.prepare_segment_features(deliveries.build_segment_shipments(t.star)).select(
        "order_id", "seller_id", *[F.round(c, 4).alias(c) for c in rounded]
    )


@query(
    "haversine_two_radii",
    f"""WITH p AS (SELECT g.zip_prefix, o.lat a, o.lng b, g.lat c, g.lng d FROM ge_median g
    JOIN ge_median o ON o.zip_prefix='00000')
    SELECT zip_prefix, round({haversine_sql('a','b','c','d')},4) km, round({haversine_sql('a','b','c','d',6371.0)},4) km_short
    FROM p""",
)
def _(t):
    m = centroids.zip_centroids(t.star.geo, "median")
    origin = m.filter("zip_prefix = '00000'")
    a, b = origin.select("lat").scalar(), origin.select("lng").scalar()
    return m.select(
        "zip_prefix",
        F.round(geo.haversine_km(a, b, "lat", "lng"), 4).alias("km"),
        F.round(geo.haversine_km(a, b, "lat", "lng", geo.EARTH_RADIUS_SHORT_KM), 4).alias("km_short"),
    )


@query(
    "durations_of_orders",
    """SELECT order_id, round(epoch(delivered_ts-purchase_ts)/86400,4) lead_days,
    round(epoch(delivered_ts-promised_ts)/86400,4) days_vs_promise, round(epoch(promised_ts-purchase_ts)/86400,4) promised_days,
    round(epoch(shipping_limit_ts-purchase_ts)/86400,4) dispatch_slack_days,
    round(epoch(approved_ts-purchase_ts)/86400,4) approval_days, round(epoch(carrier_ts-approved_ts)/86400,4) dispatch_days,
    round(epoch(delivered_ts-carrier_ts)/86400,4) transport_days FROM cu_joined""",
)
def _(t):
    names = ("lead_days", "days_vs_promise", "promised_days", "dispatch_slack_days", "approval_days", "dispatch_days", "transport_days")
    return times.durations(deliveries.build_deliveries(t.star)).select("order_id", *[F.round(c, 4).alias(c) for c in names])


@query(
    "calendar_of_orders",
    """SELECT order_id, CAST(month(purchase_ts) AS INT) "month", CAST(isodow(purchase_ts)-1 AS INT) weekday,
    CAST(hour(purchase_ts) AS INT) "hour", strftime(purchase_ts,'%Y-%m') year_month FROM fx_orders""",
)
def _(t):
    return times.calendar_parts(t.star.orders).select("order_id", "month", "weekday", "hour", "year_month")


@query(
    "weight_bands",
    """SELECT product_id, CASE WHEN weight_g>0 AND weight_g<=300 THEN '<=300g' WHEN weight_g>300 AND weight_g<=750 THEN '301-750g'
    WHEN weight_g>750 AND weight_g<=2000 THEN '751g-2kg' WHEN weight_g>2000 AND weight_g<=5000 THEN '2-5kg'
    WHEN weight_g>5000 AND weight_g<=15000 THEN '5-15kg' WHEN weight_g>15000 THEN '>15kg' END band,
    CASE WHEN weight_g>0 AND weight_g<=300 THEN 1 WHEN weight_g>300 AND weight_g<=750 THEN 2
    WHEN weight_g>750 AND weight_g<=2000 THEN 3 WHEN weight_g>2000 AND weight_g<=5000 THEN 4
    WHEN weight_g>5000 AND weight_g<=15000 THEN 5 WHEN weight_g>15000 THEN 6 END band_no FROM fx_products""",
)
def _(t):
    edges, labels = numbers.WEIGHT_BANDS_G
    return t.star.products.select(
        "product_id",
        numbers.cut("weight_g", edges, labels).alias("band"),
        numbers.cut_ordinal("weight_g", edges).alias("band_no"),
    )


@query(
    "textual_booleans",
    """SELECT event_id, lower(CASE event_id%6 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'Sim' WHEN 2 THEN '1' WHEN 3 THEN 'no'
    WHEN 4 THEN NULL ELSE event_type END) IN ('true','1','sim') IS TRUE parsed FROM events""",
)
def _(t):
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, "TRUE").when(k == 1, "Sim").when(k == 2, "1").when(k == 3, "no")
        .when(k == 4, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    )
    return t.table("events").select("event_id", numbers.parse_bool(raw).alias("parsed"))


@query(
    "required_and_finite",
    """SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id%5=0 THEN NULL WHEN event_id%11=0 THEN NULL ELSE value END v,
    CASE WHEN event_id%17<>0 THEN event_type END e FROM events) WHERE v IS NOT NULL AND e IS NOT NULL""",
)
def _(t):
    k = F.col("event_id")
    v = F.when(k % 5 == 0, F.lit(float("inf"))).when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    df = t.table("events").select("event_id", v.alias("v"), F.when(k % 17 != 0, F.col("event_type")).alias("e"))
    return numbers.require(df, ["v"], ["e"]).drop("e")


@query(
    "domain_filters",
    """SELECT CAST(count(*) FILTER (freight_value>=0 AND weight_total_kg>0 AND quantity_items>0) AS BIGINT) loose,
    CAST(count(*) FILTER (freight_value>0 AND weight_total_kg>0 AND cubic_weight_kg>0 AND declared_value>0
      AND quantity_items>0 AND lead_days>0) AS BIGINT) strict FROM sh_all""",
)
def _(t):
    df = deliveries.shipments_before_filters(t.star)
    mark = lambda d, name: d.agg(F.count("*").alias(name))
    strict = mark(numbers.valid_shipments(df, strict=True), "strict")
    return mark(numbers.valid_shipments(df), "loose").select("loose", strict.select("strict").scalar().alias("strict"))


_FLAG_SETS = {
    "completeness_flags": ["qa_no_item", "qa_no_delivery_ts", "qa_no_carrier_ts", "qa_no_approval_ts", "qa_no_weight"],
    "validity_flags": [
        "qa_delivered_before_carrier", "qa_negative_dispatch_lag", "qa_invalid_weight", "qa_zero_freight",
        "qa_invalid_payment", "qa_undefined_channel", "weight_g", "weight_g_original",
    ],
    "accuracy_flags": [
        "qa_implausible_lead", "qa_implausible_weight", "qa_disproportionate_freight", "qa_payment_mismatch",
    ],
    "near_duplicate_flag": ["qa_near_duplicate"],
    "tail_flag": ["qa_incomplete_tail"],
    "branch_default": ["branch"],
    "seller_tiers": ["seller_tier"],
    "delivery_kpis": ["active", "measurable", "days_vs_promise", "late", "overdue_no_record", "honest_late"],
    "quarantine_marks": ["qa_quarantine", "quarantine_reason"],
}


def _flag_query(name, columns):
    @query(name, f"SELECT order_id, {', '.join(columns)} FROM cu_core")
    def _(t):
        return t.core.select("order_id", *columns)


for _name, _columns in _FLAG_SETS.items():
    _flag_query(_name, _columns)

_CURATED = [*curation.FLAGS, "qa_flags_total", "qa_quarantine", "branch", "seller_tier", "honest_late"]


@query("curated_deliveries", f"SELECT order_id, {', '.join(_CURATED)} FROM cu_full")
def _(t):
    return t.curated.select("order_id", *_CURATED)


@query(
    "city_rewritten_flag", "SELECT order_id, branch_city, customer_city_canonical, qa_city_rewritten FROM cu_full"
)
def _(t):
    star = t.star
    lookup = cities.canonical_lookup(cities.city_map(cities.city_pairs(star)))
    return curation.flag_city_rewritten(deliveries.build_deliveries(star), lookup).select(
        "order_id", "branch_city", "customer_city_canonical", "qa_city_rewritten"
    )


@query(
    "state_against_zip",
    """SELECT order_id, branch_zip_state, customer_zip_state, qa_branch_state_mismatch, qa_customer_state_mismatch,
    qa_zip_no_geo FROM cu_full""",
)
def _(t):
    star = t.star
    return curation.state_vs_zip(deliveries.build_deliveries(star), centroids.zip_centroids(star.geo)).select(
        "order_id", "branch_zip_state", "customer_zip_state", "qa_branch_state_mismatch", "qa_customer_state_mismatch",
        "qa_zip_no_geo",
    )


@query(
    "near_duplicate_items",
    "SELECT order_id, product_id, seller_id, price, freight_value, copies FROM cu_near",
)
def _(t):
    return deliveries.near_duplicates(t.star.items)


@query("geo_exact_duplicates", "SELECT zip_prefix, round(lat,4) lat, round(lng,4) lng, city, state, copies FROM ge_points")
def _(t):
    return centroids.exact_dedup(t.star.geo).withColumns({"lat": F.round("lat", 4), "lng": F.round("lng", 4)})


@query(
    "geo_rejects",
    """SELECT zip_prefix, city, state, round(lat,4) lat, round(lng,4) lng FROM fx_geo
    WHERE NOT (lat BETWEEN -34.0 AND 5.3 AND lng BETWEEN -74.0 AND -34.8)""",
)
def _(t):
    _, rejects = centroids.box_filter(t.star.geo)
    return rejects.withColumns({"lat": F.round("lat", 4), "lng": F.round("lng", 4)})


@query(
    "zip_centroids",
    """SELECT zip_prefix, round(lat,4) lat, round(lng,4) lng, n_points, n_points_raw, points_out_of_bounds, city, state,
    duplicates_removed, round(centroid_shift_m,0) centroid_shift_m FROM ge_mean""",
)
def _(t):
    return centroids.zip_centroids(t.star.geo).select(
        "zip_prefix", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "n_points", "n_points_raw",
        "points_out_of_bounds", "city", "state", "duplicates_removed",
        F.round("centroid_shift_m", 0).alias("centroid_shift_m"),
    )


@query("zip_medians", "SELECT zip_prefix, round(lat,4) lat, round(lng,4) lng, city, state FROM ge_median")
def _(t):
    return centroids.zip_centroids(t.star.geo, "median").select(
        "zip_prefix", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "city", "state"
    )


@query("sla_by_branch", """
WITH g AS (SELECT branch, count(*) orders, count(*) FILTER (measurable) measurable,
  count(*) FILTER (delivered_ts>promised_ts) late_orders, count(*) FILTER (overdue_no_record) overdue,
  round(median(lead_days),1) median_lead FROM cu_core WHERE active GROUP BY 1),
p AS (SELECT branch, orders, measurable, orders-measurable no_record, round(100*(orders-measurable)/orders,2) no_record_pct,
  round(100*late_orders/nullif(measurable,0),2) reported_pct, round(100*(late_orders+overdue)/orders,2) honest_pct,
  median_lead FROM g),
r AS (SELECT branch, rank() OVER (ORDER BY reported_pct NULLS FIRST) rank_reported,
  rank() OVER (ORDER BY honest_pct NULLS FIRST) rank_honest FROM p WHERE orders>=20)
SELECT p.*, round(honest_pct-reported_pct,2) jump_pp, CAST(rank_reported AS INT) rank_reported,
  CAST(rank_honest AS INT) rank_honest FROM p LEFT JOIN r USING(branch)""")
def _(t):
    return sla_ops.sla_by(t.core, "branch", min_n=20)
