"""Queries over quality reports, group profiles and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.operators import centroids, cities, curation, deliveries, funnel, ordering, profiles, quality
from haulmark.operators import sla as sla_ops
from haulmark.plans.registry import ON_INPUTS, TWINS, query
from haulmark.session import work_folder
from haulmark.sources import versions

_NULLABLE = ["seller_id", "product_id", "approved_ts", "carrier_ts", "delivered_ts", "weight_g", "paid_value", "n_items"]


def _long(section, pairs, source):
    """SQL for rows of (section, metric, value) from one scan."""
    inner = ", ".join(f"CAST({sql} AS DOUBLE) m{i}" for i, (_, sql) in enumerate(pairs))
    rows = " UNION ALL ".join(
        f"SELECT '{section}' section, '{name}' metric, m{i} AS value FROM s_{section}" for i, (name, _) in enumerate(pairs)
    )
    return f"s_{section} AS (SELECT {inner} FROM {source})", rows


def _long_query(parts):
    """Join several scans into one SQL text."""
    made = [_long(*p) for p in parts]
    return "WITH " + ",\n".join(m[0] for m in made) + "\n" + "\nUNION ALL ".join(m[1] for m in made)


def _filter(**conditions):
    return [(k, f"count(*) FILTER ({v})") for k, v in conditions.items()]


def _rounded(df, digits=3):
    return df.withColumn("value", F.round("value", digits))


@query(
    "null_profile",
    " UNION ALL ".join(
        f'SELECT \'{c}\' "column", count(*) FILTER ({c} IS NULL) nulls, round(100*count(*) FILTER ({c} IS NULL)/count(*),2) pct FROM cu_joined'
        for c in _NULLABLE
    ),
)
def _(t):
    return quality.null_profile(t.deliveries, _NULLABLE)


@query("nulls_by_branch", """
SELECT branch, orders, no_carrier_ts, no_delivered_ts, no_approved_ts, round(100*no_delivered_ts/orders,2) rate_pct,
  orders>=20 AND no_delivered_ts/orders>(SELECT avg((delivered_ts IS NULL)::INT) FROM cu_core WHERE active) above_average
FROM (SELECT branch, count(*) orders, count(*) FILTER (carrier_ts IS NULL) no_carrier_ts,
  count(*) FILTER (delivered_ts IS NULL) no_delivered_ts, count(*) FILTER (approved_ts IS NULL) no_approved_ts
  FROM cu_core WHERE active GROUP BY 1)""")
def _(t):
    return quality.null_by_group(
        t.core.filter("active"), "branch", ["carrier_ts", "delivered_ts", "approved_ts"], "delivered_ts", min_n=20
    )


@query("uniqueness_report", _long_query([
    ("orders", [("exact_duplicates", "(SELECT count(*) FROM fx_orders)-(SELECT count(*) FROM (SELECT DISTINCT * FROM fx_orders))")], "(SELECT 1)"),
    ("orders_id", [("repeated_ids", "count(*)-count(DISTINCT order_id)")], "fx_orders"),
    ("items", [("exact_duplicates", "(SELECT count(*) FROM fx_items)-(SELECT count(*) FROM (SELECT DISTINCT * FROM fx_items))")], "(SELECT 1)"),
    ("near_duplicates", [("rows", "coalesce(sum(copies),0)"), ("orders", "count(DISTINCT order_id)")], "cu_near"),
    ("reviews_id", [("repeated_ids", "count(*)-count(DISTINCT review_id)")], "fx_reviews"),
    ("reviews_order", [("rows", "coalesce(sum(n) FILTER (n>1),0)"), ("orders", "count(*) FILTER (n>1)")],
     "(SELECT order_id, count(*) n FROM fx_reviews GROUP BY 1)"),
    ("payments_order", [("rows", "coalesce(sum(n) FILTER (n>1),0)")], "(SELECT order_id, count(*) n FROM fx_payments GROUP BY 1)"),
    ("geo", [("exact_duplicates", "sum(copies-1)"), ("rows", "sum(copies)")], "ge_points"),
]))
def _(t):
    return quality.uniqueness_report(t.star)


@query("spelling_variants", """
SELECT name, count(*) spellings, string_agg(city, ' | ' ORDER BY city) examples
FROM (SELECT DISTINCT regexp_replace(lower(strip_accents(trim(city))),'\\s+',' ','g') name, city FROM ci_pairs)
GROUP BY 1 ORDER BY spellings DESC, name LIMIT 8""")
def _(t):
    return quality.spelling_variants(cities.city_pairs(t.star))


@query("consistency_report", """
WITH n AS (SELECT field, city, count(*) c, regexp_replace(lower(strip_accents(trim(city))),'\\s+',' ','g') name
  FROM ci_pairs GROUP BY 1,2),
g AS (SELECT field, name, count(*) s, sum(c) r, count(*) FILTER (city LIKE '%/%' OR city LIKE '%-%' OR city<>trim(city)) e,
  count(*) FILTER (regexp_replace(name,'[^0-9]','','g')='1') v FROM n GROUP BY 1,2)
SELECT field, CAST(sum(s) AS BIGINT) spellings, count(*) names, count(*) FILTER (s>=2) names_with_many,
  CAST(sum(e) AS BIGINT) embedded_state, CAST(sum(CASE WHEN name IN ('nation_1','nation_1 - n1') THEN s ELSE 0 END) AS BIGINT) entity_spellings,
  CAST(sum(r) AS BIGINT) AS rows FROM g GROUP BY 1""")
def _(t):
    return quality.consistency_report(cities.city_pairs(t.star), ["nation_1"], [" - n1", " n1"], many=2)


@query("validity_report", _long_query([
    ("orders", _filter(
        delivered_before_purchase="order_status='delivered' AND delivered_ts<purchase_ts",
        delivered_before_carrier="order_status='delivered' AND delivered_ts<carrier_ts",
        approved_before_purchase="approved_ts<purchase_ts",
        limit_before_purchase="order_status='delivered' AND shipping_limit_ts<purchase_ts",
        zero_freight_delivered="order_status='delivered' AND freight_value=0"), "cu_joined"),
    ("products", _filter(weight_not_positive="weight_g<=0", weight_missing="weight_g IS NULL",
        dimension_not_positive="length_cm<=0 OR height_cm<=0 OR width_cm<=0"), "fx_products"),
    ("items", _filter(price_not_positive="price<=0", freight_negative="freight_value<0"), "fx_items"),
    ("payments", _filter(payment_not_positive="payment_value<=0",
        card_without_installments="installments=0 AND payment_type='credit_card'",
        channel_not_defined="payment_type='not_defined'"), "fx_payments"),
    ("reviews", _filter(score_out_of_range="review_score NOT BETWEEN 1 AND 5"), "fx_reviews"),
    ("customers", _filter(zip_without_geo="zip_prefix NOT IN (SELECT zip_prefix FROM fx_geo)"), "fx_customers"),
]))
def _(t):
    star = t.star
    return quality.validity_report(star, t.deliveries)


_DONE = """(SELECT *, epoch(delivered_ts-purchase_ts)/86400 lead, abs(paid_value-(goods_value+freight_value)) gap
  FROM cu_joined WHERE order_status='delivered')"""


@query("accuracy_report", f"""SELECT section, metric, round(value,2) AS value FROM ({_long_query([
    ("orders", [("lead_n", "count(lead)"), ("lead_mean", "avg(lead)"), ("lead_sd", "stddev_samp(lead)"), ("lead_min", "min(lead)"),
        ("lead_max", "max(lead)"), ("lead_over_100_days", "count(*) FILTER (lead>100)"),
        ("lead_under_12_hours", "count(*) FILTER (lead<0.5)"),
        ("freight_over_3x_goods", "count(*) FILTER (freight_value>3*goods_value AND goods_value>0)"),
        ("payment_differs", "count(*) FILTER (gap>1)"), ("lead_p50", "quantile_cont(lead,0.5)"),
        ("lead_p90", "quantile_cont(lead,0.9)"), ("lead_p99", "quantile_cont(lead,0.99)"), ("gap_p50", "quantile_cont(gap,0.5)")], _DONE),
    ("products", [("weight_over_30kg", "count(*) FILTER (weight_g>30000)"), ("weight_max_g", "max(weight_g)"),
        ("sides_over_250_cm", "count(*) FILTER (length_cm+height_cm+width_cm>250)")], "fx_products")])})""")
def _(t):
    star = t.star
    return _rounded(quality.accuracy_report(star, t.deliveries), 2)


def _lags(stage, a, b, where="true", source="fx_orders"):
    return (stage, [("p50_h", "round(quantile_cont(h,0.5),1)"), ("p90_h", "round(quantile_cont(h,0.9),1)"),
        ("max_h", "round(max(h),1)"), ("negative", "count(*) FILTER (h<0)")],
        f"(SELECT epoch({b}-{a})/3600 h FROM {source} WHERE {where})")


@query("timeliness_report", _long_query([
    _lags("purchase_to_approval", "purchase_ts", "approved_ts"),
    _lags("approval_to_dispatch", "approved_ts", "carrier_ts", "order_status='delivered'"),
    _lags("review_to_answer", "created_ts", "answered_ts", source="fx_reviews"),
    ("tail", [("orders", "count(*)"), ("without_delivery", "count(*) FILTER (delivered_ts IS NULL)"),
        ("without_delivery_pct", "round(100*avg((delivered_ts IS NULL)::INT),4)")],
     "(SELECT * FROM fx_orders WHERE purchase_ts>=(SELECT max(purchase_ts) FROM fx_orders)-INTERVAL 60 DAY)"),
    ("extract", [("age_days", "floor(epoch(TIMESTAMP '2026-09-02'-max(purchase_ts))/86400)")], "fx_orders"),
]))
def _(t):
    return quality.timeliness_report(t.star, as_of="2026-09-02")


def _provenance_sql(key):
    return f"""SELECT {key}, count(*) orders, round(100*avg((carrier_ts IS NULL)::INT),2) no_carrier_pct,
    round(100*avg((delivered_ts IS NULL)::INT),2) no_delivery_pct, round(100*avg((weight_g_original IS NULL)::INT),2) no_weight_pct,
    round(100*avg(coalesce(delivered_ts>promised_ts,false)::INT),2) late_pct, round(median(lead_days),1) median_lead
    FROM cu_core WHERE active GROUP BY 1"""


@query("provenance_by_seller_tier", _provenance_sql("seller_tier"))
def _(t):
    return quality.provenance_by(t.core, "seller_tier")


@query("provenance_by_channel", _provenance_sql("payment_channel"))
def _(t):
    return quality.provenance_by(t.core, "payment_channel")


@query("defect_cost", """
WITH f AS (SELECT 0.035::DOUBLE*median(freight_value) fine FROM cu_core WHERE order_status='delivered'),
y AS (SELECT 365/floor(epoch(max(purchase_ts)-min(purchase_ts))/86400) yearly FROM fx_orders),
d AS (SELECT 'overdue_without_record' defect, count(*) FILTER (overdue_no_record) affected, 1 a, 180.0::DOUBLE b FROM cu_core
 UNION ALL SELECT 'near_duplicate_orders', count(DISTINCT order_id), 1, 0 FROM cu_near
 UNION ALL SELECT 'cities_with_many_spellings', count(*) FILTER (n>=3), 4, 180.0 FROM (SELECT name, count(*) n
   FROM (SELECT DISTINCT lower(trim(city)) name, city FROM ci_pairs WHERE field<>'seller_city') GROUP BY 1))
SELECT defect, affected, round(affected*a*(fine+b)*yearly,2) yearly_cost FROM d, f, y""")
def _(t):
    star = t.star
    return quality.defect_cost(star, t.core, cities.city_pairs(star))


#: The seven dimensions: the report each is read from, its keys and its numbers, and the grade people gave.
_DIMENSIONS = {
    "completeness": ("null_profile", ["column"], ["nulls", "pct"], 3.0),
    "uniqueness": ("uniqueness_report", ["section", "metric"], ["value"], 2.0),
    "consistency": (
        "consistency_report", ["field"], ["spellings", "names", "names_with_many", "embedded_state", "entity_spellings", "rows"], 2.0,
    ),
    "validity": ("validity_report", ["section", "metric"], ["value"], 4.0),
    "accuracy": ("accuracy_report", ["section", "metric"], ["value"], 3.0),
    "timeliness": ("timeliness_report", ["section", "metric"], ["value"], 3.0),
    "provenance": (
        "provenance_by_seller_tier", ["seller_tier"],
        ["orders", "no_carrier_pct", "no_delivery_pct", "no_weight_pct", "late_pct", "median_lead"], 2.0,
    ),
}
_GRADES = {d: grade for d, (*_, grade) in _DIMENSIONS.items()}


def _dimension_sql(section, name, keys, values, grade):
    key = "||'|'||".join(f"coalesce(CAST(\"{k}\" AS VARCHAR),'')" for k in keys)
    rows = ", ".join(f"{{'metric': '{v}', 'value': CAST(\"{v}\" AS DOUBLE)}}" for v in values)
    return f"""SELECT '{section}' section, k "key", m.metric metric, round(m.value,3) AS "value", {grade}::DOUBLE grade FROM (
      SELECT {key} k, unnest([{rows}]) m FROM ({TWINS[name]}) r)"""


@query(
    "quality_scorecard",
    f"""SELECT *, {round(sum(_GRADES.values()) / len(_GRADES), 1)}::DOUBLE mean_grade FROM ({" UNION ALL ".join(
        _dimension_sql(d, *told) for d, told in _DIMENSIONS.items())})""",
)
def _(t):
    store = versions.MetricStore(t.spark, work_folder(t.spark))
    for section, (name, keys, _, _) in _DIMENSIONS.items():
        store.record("now", section, ON_INPUTS[name](t), keys)
    return _rounded(quality.scorecard(store.read("now"), _GRADES))


@query("population_cuts", """
WITH c AS (SELECT count(*) a, count(*) FILTER (active) b, (SELECT count(*) FROM an_core) c,
  count(*) FILTER (active AND measurable) d, count(*) FILTER (qa_flags_total=0) e FROM cu_full)
SELECT p population, n orders, round(100*n/a,4) pct FROM (SELECT a, unnest(['todos','ativos','analitico','mensuravel','limpos']) p,
  unnest([a,b,c,d,e]) n FROM c)""")
def _(t):
    return sla_ops.population_cuts(t.curated)


@query("status_counts", """SELECT order_status, count(*) n, round(100*count(*)/(SELECT count(*) FROM fx_orders),4) pct
FROM fx_orders GROUP BY 1""")
def _(t):
    return sla_ops.value_counts(t.star.orders, "order_status")


@query("quarantine_reasons", """SELECT quarantine_reason, count(*) n,
round(100*count(*)/(SELECT count(*) FROM cu_core WHERE qa_quarantine),4) pct FROM cu_core WHERE qa_quarantine GROUP BY 1""")
def _(t):
    return sla_ops.value_counts(curation.quarantine_extract(t.core), "quarantine_reason")


@query("sla_headline", """SELECT round(100*avg(late::INT),4) reported_pct, count(late) reported_n,
round(100*avg(honest_late::INT),4) honest_pct, count(honest_late) honest_n,
round(100*(avg(honest_late::INT)-avg(late::INT)),4) delta_pp, count(*) FILTER (overdue_no_record) overdue_no_record,
count(*) FILTER (NOT measurable) without_delivery FROM cu_core WHERE active""")
def _(t):
    return sla_ops.sla_headline(t.core)


@query("overdue_by_branch", """SELECT branch, overdue, active_orders, round(100*overdue/active_orders,4) rate_pct FROM
(SELECT branch, count(*) FILTER (overdue_no_record) overdue, count(*) active_orders FROM cu_core WHERE active GROUP BY 1)
WHERE overdue>0 ORDER BY overdue DESC, branch LIMIT 10""")
def _(t):
    return sla_ops.overdue_by(t.core)


@query("sla_by_month", """SELECT strftime(purchase_ts,'%Y-%m') "month", count(*) orders, round(100*avg(late::INT),4) reported_pct,
round(100*avg(honest_late::INT),4) honest_pct, avg(qa_incomplete_tail::INT)>0.5 in_tail
FROM cu_core WHERE active GROUP BY 1 HAVING count(*)>=10""")
def _(t):
    return sla_ops.sla_by_month(t.core, min_n=10)


def _dist_sql(col):
    q = ", ".join(f"round(quantile_cont({col},{p}),4) p{round(p * 100)}" for p in profiles.PROBS)
    return f'SELECT \'{col}\' "column", count({col}) n, round(avg({col}),4) mean, round(stddev_samp({col}),4) sd, {q} FROM an_core'


@query("lead_and_slack_distribution", f"{_dist_sql('lead_days')} UNION ALL {_dist_sql('days_vs_promise')}")
def _(t):
    return profiles.distribution(t.analytic, ["lead_days", "days_vs_promise"])


@query("stage_breakdown", """
WITH d AS (SELECT 'approval' stage, epoch(approved_ts-purchase_ts)/86400 d FROM an_core UNION ALL
 SELECT 'dispatch', epoch(carrier_ts-approved_ts)/86400 FROM an_core UNION ALL
 SELECT 'transport', epoch(delivered_ts-carrier_ts)/86400 FROM an_core),
g AS (SELECT stage, count(d) n, avg(d) mean, median(d) m, quantile_cont(d,0.9) p90, quantile_cont(d,0.99) p99 FROM d GROUP BY 1)
SELECT stage, n, round(mean,4) mean, round(m,4) median, round(p90,4) p90, round(p99,4) p99,
 round(m/sum(m) OVER (),4) median_share FROM g""")
def _(t):
    return profiles.stage_breakdown(t.analytic)


_BAND = """CASE WHEN weight_g>0 AND weight_g<=300 THEN '<=300g' WHEN weight_g>300 AND weight_g<=750 THEN '301-750g'
WHEN weight_g>750 AND weight_g<=2000 THEN '751g-2kg' WHEN weight_g>2000 AND weight_g<=5000 THEN '2-5kg'
WHEN weight_g>5000 AND weight_g<=15000 THEN '5-15kg' WHEN weight_g>15000 THEN '>15kg' END"""


def _profile_sql(expr, name):
    return f"""WITH g AS (SELECT {expr} k, count(*) orders, 100*avg(honest_late::INT) h, median(lead_days) l, median(freight_value) f,
    median(goods_value) g, median(paid_value) p FROM an_core WHERE {expr} IS NOT NULL GROUP BY 1)
    SELECT k AS {name}, orders, round(100*orders/sum(orders) OVER (),4) share_pct, round(h,3) honest_late_pct,
    round(l,3) median_lead, round(f,3) median_freight, round(g,3) median_goods, round(p,3) median_paid,
    round(f/nullif(g,0),4) freight_over_goods FROM g"""


def _profile(name, key, sql, column):
    @query(name, _profile_sql(sql, column))
    def _(t):
        return profiles.profile_by(t.analytic, F.expr(key), column)


_profile("profile_by_branch", "branch", "branch", "branch")
_profile("profile_by_seller_tier", "seller_tier", "seller_tier", "seller_tier")
_profile("profile_by_destination", "customer_state", "customer_state", "customer_state")
_profile("profile_by_same_state", "branch = customer_state", "(branch=customer_state)", "same_state")
_profile("profile_by_weight_band", _BAND, _BAND, "band")
_profile("profile_by_channel", "payment_channel", "payment_channel", "payment_channel")


@query("extreme_branches", """
WITH p AS (SELECT branch, count(*) n, round(100*avg(honest_late::INT),3) h FROM an_core GROUP BY 1
 HAVING count(*)>=20 AND branch<>'SEM_FILIAL')
SELECT (SELECT branch FROM p ORDER BY h DESC, branch DESC LIMIT 1) worst, max(h) worst_pct,
 (SELECT branch FROM p ORDER BY h, branch LIMIT 1) best, min(h) best_pct, round(max(h)/nullif(min(h),0),4) ratio FROM p""")
def _(t):
    return profiles.extremes(profiles.profile_by(t.analytic, "branch"), "branch", min_n=20)


@query("money_summary", """SELECT round(sum(goods_value),2) goods_total, round(sum(freight_value),2) freight_total,
round(median(goods_value),2) goods_median, round(median(freight_value),2) freight_median,
round(100*sum(freight_value)/sum(goods_value),4) freight_share_pct FROM an_core""")
def _(t):
    return profiles.money_summary(t.analytic)


@query("approval_latency_by_channel", """SELECT payment_channel, count(*) orders,
round(median(epoch(approved_ts-purchase_ts)/3600),2) median_hours FROM an_core WHERE payment_channel IS NOT NULL GROUP BY 1""")
def _(t):
    return profiles.approval_latency_by(t.analytic)


def _flag_rows(source, keep):
    return " UNION ALL ".join(f"SELECT '{f}' flag, {f} v, {keep} FROM {source}" for f in curation.FLAGS)


@query("flag_effect", f"""
WITH s AS ({_flag_rows('cu_full WHERE active', 'honest_late')}),
g AS (SELECT flag, count(*) FILTER (v) orders, avg(honest_late::INT) FILTER (v) i, avg(honest_late::INT) FILTER (NOT v) o
 FROM s GROUP BY 1 HAVING count(*) FILTER (v)>=20)
SELECT flag, orders, round(100*i,4) inside_pct, round(100*o,4) outside_pct, round(100*(i-o),4) delta_pp, i>=0.95 tautological,
 i<=0.05 protective FROM g""")
def _(t):
    return profiles.flag_effect(t.curated.filter("active"), curation.FLAGS)


@query("centroid_report", """SELECT count(*) prefixes, count(*) FILTER (duplicates_removed>0) affected,
count(*) FILTER (centroid_shift_m>1000) over_1_km, round(max(centroid_shift_m),0) max_m,
round(quantile_cont(centroid_shift_m,0.5),0) p50_m, round(quantile_cont(centroid_shift_m,0.9),0) p90_m,
round(quantile_cont(centroid_shift_m,0.99),0) p99_m FROM ge_mean""")
def _(t):
    return profiles.centroid_report(centroids.zip_centroids(t.star.geo))


@query("worst_centroids", """SELECT zip_prefix, city, state, n_points, duplicates_removed, round(centroid_shift_m,0) centroid_shift_m
FROM (SELECT * FROM ge_mean ORDER BY round(centroid_shift_m,0) DESC, zip_prefix LIMIT 8)""")
def _(t):
    worst = centroids.zip_centroids(t.star.geo).withColumn("centroid_shift_m", F.round("centroid_shift_m", 0))
    return ordering.top_k(worst, [F.desc("centroid_shift_m"), "zip_prefix"], 8).select(
        "zip_prefix", "city", "state", "n_points", "duplicates_removed", "centroid_shift_m"
    )


@query("city_map", "SELECT state, spelling, city_key, canonical, n_rows, rules, change FROM ci_map")
def _(t):
    return cities.city_map(cities.city_pairs(t.star))


@query("canonical_cities", """SELECT state, city_key, any_value(canonical) canonical, CAST(sum(n_rows) AS BIGINT) key_rows
FROM ci_map GROUP BY 1,2""")
def _(t):
    return cities.canonical_city(cities.spelling_counts(cities.city_pairs(t.star)))


@query("city_report", """SELECT change, rules, count(*) spellings, CAST(sum(n_rows) AS BIGINT) n_rows FROM ci_map GROUP BY 1,2""")
def _(t):
    return profiles.city_report(cities.city_map(cities.city_pairs(t.star)))


@query("city_fields", "SELECT field, state, city, count(*) n FROM ci_pairs GROUP BY 1,2,3")
def _(t):
    return cities.city_pairs(t.star).groupBy("field", "state", "city").agg(F.count("*").alias("n"))


@query("untranslated_categories", "SELECT DISTINCT category FROM fx_products WHERE category NOT IN (SELECT category FROM fx_translation)")
def _(t):
    star = t.star
    return cities.missing_in_domain(star.products, star.translation, "category")


@query("quarantine_bias", """SELECT qa_quarantine, count(*) orders, round(median(freight_value),2) median_freight,
round(median(goods_value),2) median_goods, round(median(weight_g),2) median_weight_g FROM cu_core GROUP BY 1""")
def _(t):
    return profiles.quarantine_bias(t.core)


@query("quarantine_composition", f"""SELECT flag, count(*) orders FROM ({_flag_rows('cu_full WHERE qa_quarantine', '1 one')})
WHERE v GROUP BY 1""")
def _(t):
    return profiles.flag_composition(curation.quarantine_extract(t.curated), curation.FLAGS)


@query("exclusion_funnel", """
WITH s AS (SELECT 0 step, 'raw_items' label, count(*) n, sum(freight_value) f FROM fx_items
 UNION ALL SELECT 1, 'delivered_items', count(*), sum(freight_value) FROM sh_items
 UNION ALL SELECT 2, 'shipments', count(*), sum(freight_value) FROM sh_rollup
 UNION ALL SELECT 3, 'with_both_ends', count(*), sum(freight_value) FROM sh_all
 UNION ALL SELECT 4, 'complete', count(*), sum(freight_value) FROM sh_all WHERE distance_km IS NOT NULL
 UNION ALL SELECT 5, 'in_domain', count(*), sum(freight_value) FROM sh_price)
SELECT step, label, n AS rows, round(100*n/(SELECT count(*) FROM fx_items),2) pct_of_raw, round(f,2) freight FROM s""")
def _(t):
    return funnel.exclusion_funnel(t.star)


@query("exclusion_bias", """
WITH i AS (SELECT CASE WHEN order_status='delivered' THEN 'kept_delivered' ELSE 'left_by_status' END cause, i.freight_value f, price p
 FROM fx_items i JOIN fx_orders USING(order_id)
 UNION ALL SELECT 'left_incomplete', freight_value, declared_value FROM sh_all WHERE distance_km IS NULL
 UNION ALL SELECT 'left_domain', freight_value, declared_value FROM sh_all WHERE distance_km IS NOT NULL
   AND NOT (freight_value>=0 AND weight_total_kg>0 AND quantity_items>0))
SELECT cause, count(*) AS rows, round(avg(f),2) mean_freight, round(median(f),2) median_freight, round(median(p),2) median_price
FROM i GROUP BY 1""")
def _(t):
    return funnel.exclusion_bias(t.star)


@query("excluded_shipments", """SELECT order_id, seller_id FROM sh_all
EXCEPT SELECT order_id, seller_id FROM sh_price""")
def _(t):
    star = t.star
    before = deliveries.shipments_before_filters(star).select("order_id", "seller_id")
    return funnel.excluded(before, deliveries.build_shipments(star), ["order_id", "seller_id"])


@query("membership_flags", """SELECT o.order_id, o.order_id IN (SELECT order_id FROM cu_near) near_duplicate FROM fx_orders o""")
def _(t):
    star = t.star
    near = deliveries.near_duplicates(star.items)
    return funnel.flag_member(star.orders.select("order_id"), near, "order_id", "near_duplicate")


@query("grain_stats", f"""
WITH per AS (SELECT order_id, count(*) items, count(DISTINCT seller_id) sellers FROM fx_items GROUP BY 1),
u AS (SELECT count(*) c FROM per),
q AS ({" UNION ALL ".join(f"SELECT '{m}' metric, CAST({e} AS DOUBLE) v FROM per" for m, e in [
    ("items", "sum(items)"), ("orders", "count(*)"), ("shipments", "sum(sellers)"),
    ("multi_seller_orders", "count(*) FILTER (sellers>1)"), ("multi_seller_pct", "round(100*avg((sellers>1)::INT),4)"),
    ("items_per_order_max", "max(items)"), ("items_per_order_p50", "median(items)")])}
 UNION ALL SELECT 'routes', CAST(count(DISTINCT route) AS DOUBLE) FROM sh_price
 UNION ALL SELECT 'final_shipments', CAST(count(*) AS DOUBLE) FROM sh_price)
SELECT 'grain' section, metric, v AS value FROM q""")
def _(t):
    star = t.star
    return funnel.grain_stats(star, deliveries.build_shipments(star))


@query("latency_table", " UNION ALL ".join(
    f"""SELECT '{n}' stage, round(quantile_cont(epoch({b}-{a})/3600,0.5),1) p50_h, round(quantile_cont(epoch({b}-{a})/3600,0.9),1) p90_h,
    round(max(epoch({b}-{a})/3600),1) max_h, count(*) FILTER ({b}<{a}) negative, count(*) FILTER ({b}-{a} IS NULL) missing FROM fx_orders"""
    for n, (a, b) in funnel.LATENCY_PAIRS.items()))
def _(t):
    return funnel.latency_table(t.star.orders)


@query("geo_coverage", " UNION ALL ".join(f"""SELECT {s}_state state, '{s}s' side, count(*) total,
 count(*) FILTER (zip_prefix NOT IN (SELECT zip_prefix FROM ge_median)) without_geo,
 round(100*count(*) FILTER (zip_prefix NOT IN (SELECT zip_prefix FROM ge_median))/count(*),4) without_pct FROM fx_{s}s GROUP BY 1"""
    for s in ("customer", "seller")))
def _(t):
    star = t.star
    return funnel.geo_coverage(star, star.geo)


@query("freight_concentration", """
WITH c AS (SELECT freight_value v, count(*) n FROM fx_items GROUP BY 1)
SELECT count(*) distinct_values, CAST(sum(n) AS BIGINT) AS rows,
 round(100*(SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, v LIMIT 10))/sum(n),4) top_pct,
 CAST(coalesce(sum(n) FILTER (v=0),0) AS BIGINT) zeros, round(100*coalesce(sum(n) FILTER (v=0),0)/sum(n),4) zero_pct FROM c""")
def _(t):
    return funnel.value_concentration(t.star.items, "freight_value")


_CELLS = """(SELECT route, band, count(*) n, stddev_samp(freight_value)/nullif(median(freight_value),0) cv, median(freight_value) m FROM
(SELECT *, CASE WHEN weight_total_kg>0 AND weight_total_kg<=.5 THEN '<0.5' WHEN weight_total_kg<=1 THEN '0.5-1'
WHEN weight_total_kg<=2 THEN '1-2' WHEN weight_total_kg<=5 THEN '2-5' WHEN weight_total_kg<=10 THEN '5-10'
WHEN weight_total_kg<=30 THEN '10-30' ELSE '>30' END band FROM sh_price) GROUP BY 1,2 HAVING count(*)>=3)"""


@query("freight_dispersion_cells", f"SELECT route, band, n, round(cv,4) cv, round(m,3) AS median FROM {_CELLS}")
def _(t):
    return funnel.cell_dispersion(deliveries.build_shipments(t.star), min_n=3).select(
        "route", "band", "n", F.round("cv", 4).alias("cv"), F.round("median", 3).alias("median")
    )


@query("freight_dispersion", f"""SELECT count(*) cells, round(quantile_cont(cv,0.5),4) cv_p50, round(quantile_cont(cv,0.9),4) cv_p90
FROM {_CELLS}""")
def _(t):
    return funnel.dispersion_summary(funnel.cell_dispersion(deliveries.build_shipments(t.star), min_n=3))


_DRIFT = """SELECT strftime(purchase_ts,'%Y-%m') "month", count(*) n, round(median(freight_value),3) freight_p50,
round(median(weight_total_kg),3) kg_p50, round(median(distance_km),3) km_p50 FROM sh_price GROUP BY 1 HAVING count(*)>=40"""


def _drift(t):
    medians = {"freight_p50": "freight_value", "kg_p50": "weight_total_kg", "km_p50": "distance_km"}
    return profiles.drift(deliveries.build_shipments(t.star), "purchase_ts", medians, min_n=40)


@query("monthly_drift", _DRIFT)
def _(t):
    return _drift(t)


@query("drift_amplitude", f"""SELECT min(freight_p50) lowest, max(freight_p50) highest,
round(100*(max(freight_p50)/min(freight_p50)-1),4) amplitude FROM ({_DRIFT})""")
def _(t):
    return profiles.amplitude(_drift(t), "freight_p50")


@query("target_decomposition", """SELECT strftime(purchase_ts,'%Y-%m') "month", count(*) orders,
round(100*avg(coalesce(honest_late,false)::INT),4) honest_pct, round(100*avg(coalesce(late,false)::INT),4) late_pct,
round(100*avg(overdue_no_record::INT),4) overdue_pct,
CASE WHEN strftime(purchase_ts,'%Y-%m')<'1997-05' THEN 'before' ELSE 'after' END side
FROM cu_core WHERE active AND NOT qa_incomplete_tail GROUP BY ALL HAVING count(*)>=10""")
def _(t):
    return profiles.target_decomposition(t.core.filter("active AND NOT qa_incomplete_tail"), "1997-05", min_n=10)


@query("origin_by_branch_crosstab", """SELECT branch, seller_tier, count(*) n,
round(100*count(*)/sum(count(*)) OVER (PARTITION BY branch),4) row_pct FROM cu_core GROUP BY 1,2""")
def _(t):
    return profiles.crosstab_share(t.core, "branch", "seller_tier")


@query("top_categories_by_state", """SELECT dest_state, category, place, n, pct FROM (SELECT dest_state, category, count(*) n,
CAST(row_number() OVER (PARTITION BY dest_state ORDER BY count(*) DESC, category) AS INT) place,
round(100*count(*)/sum(count(*)) OVER (PARTITION BY dest_state),4) pct FROM sh_segment GROUP BY 1,2) WHERE place<=4""")
def _(t):
    return profiles.top_share_by(deliveries.build_segment_shipments(t.star), "dest_state", "category")


@query("branch_share_and_rank_shift", """
WITH g AS (SELECT branch, count(*) orders, round(100*avg(late::INT),3) reported, round(100*avg(honest_late::INT),3) honest
 FROM cu_core WHERE active GROUP BY 1)
SELECT branch, orders, round(orders/sum(orders) OVER (),6) share, CAST(rank() OVER (ORDER BY reported NULLS FIRST) AS INT) rank_first,
 CAST(rank() OVER (ORDER BY honest NULLS FIRST) AS INT) rank_second,
 CAST(rank() OVER (ORDER BY honest NULLS FIRST)-rank() OVER (ORDER BY reported NULLS FIRST) AS INT) rank_shift FROM g""")
def _(t):
    g = t.core.filter("active").groupBy("branch").agg(
        F.count("*").alias("orders"),
        F.round(100 * F.avg(F.col("late").cast("double")), 3).alias("reported"),
        F.round(100 * F.avg(F.col("honest_late").cast("double")), 3).alias("honest"),
    )
    out = ordering.rank_shift(ordering.share_of_total(g, "orders"), "reported", "honest")
    return out.withColumn("share", F.round("share", 6)).drop("reported", "honest")


@query("temporal_split", """
WITH r AS (SELECT order_id, seller_id, row_number() OVER (ORDER BY purchase_ts, order_id, seller_id)-1 rn, count(*) OVER () n FROM sh_price)
SELECT order_id, seller_id, CASE WHEN rn<floor(n*0.7) THEN 'train' WHEN rn<floor(n*0.85) THEN 'calib' ELSE 'test' END split FROM r""")
def _(t):
    df = deliveries.build_shipments(t.star)
    return ordering.temporal_split(df, ["purchase_ts", "order_id", "seller_id"]).select("order_id", "seller_id", "split")


@query("date_split", """SELECT order_id, CASE WHEN purchase_ts<=(SELECT max(purchase_ts)-INTERVAL 90 DAY FROM fx_orders)
THEN 'train' ELSE 'test' END split FROM fx_orders""")
def _(t):
    return ordering.date_split(t.star.orders, "purchase_ts").select("order_id", "split")


@query("random_split", """SELECT order_id, CASE WHEN u<0.70 THEN 'train' WHEN u<0.85 THEN 'calib' ELSE 'test' END split
FROM (SELECT order_id, CAST('0x'||substr(md5(order_id||'|42'),1,8) AS BIGINT)/4294967296 u FROM fx_orders)""")
def _(t):
    return ordering.random_split(t.star.orders, ["order_id"]).select("order_id", "split")


_EDGES = "(SELECT " + ", ".join(f"quantile_cont(distance_km,{i / 10}) e{i}" for i in range(11)) + " FROM sh_price)"


@query("distance_deciles", f"""SELECT order_id, seller_id, CASE WHEN distance_km BETWEEN e0 AND e10 THEN
1+{"+".join(f"(distance_km>e{i} AND e{i}>e{i - 1})::INT" for i in range(1, 10))} END decile FROM sh_price, {_EDGES}""")
def _(t):
    df = deliveries.build_shipments(t.star)
    return ordering.qcut(df, "distance_km", 10, "decile").select("order_id", "seller_id", "decile")


@query("promise_quintiles_frozen", """
WITH o AS (SELECT order_id, purchase_ts, epoch(promised_ts-purchase_ts)/86400 d FROM fx_orders),
t AS (SELECT * FROM o WHERE purchase_ts<=(SELECT max(purchase_ts)-INTERVAL 90 DAY FROM fx_orders)),
e AS (SELECT quantile_cont(d,0.2) a, quantile_cont(d,0.4) b, quantile_cont(d,0.6) c, quantile_cont(d,0.8) f FROM t)
SELECT order_id, 1+(d>a)::INT+(d>b)::INT+(d>c)::INT+(d>f)::INT quintile FROM o, e""")
def _(t):
    from haulmark.functions.times import days_between

    df = ordering.date_split(t.star.orders, "purchase_ts").withColumn("d", days_between("purchase_ts", "promised_ts"))
    out = ordering.cut_by_reference(df, df.filter("split = 'train'"), "d", [0, 0.2, 0.4, 0.6, 0.8, 1], "quintile")
    return out.select("order_id", "quintile")


@query("promise_lateness_spearman", """
WITH p AS (SELECT epoch(promised_ts-purchase_ts)/86400 x, honest_late::INT y FROM cu_core WHERE active),
r AS (SELECT rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2.0 rx,
 rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0 ry FROM p)
SELECT round(corr(rx,ry),4) spearman, count(*) n FROM r""")
def _(t):
    from haulmark.functions.times import days_between

    df = t.core.filter("active").select(
        days_between("purchase_ts", "promised_ts").alias("x"), F.col("honest_late").cast("int").alias("y")
    )
    return ordering.spearman(df, "x", "y").withColumn("spearman", F.round("spearman", 4))


@query("branch_pearson", """
WITH g AS (SELECT branch, count(*) n, 100*avg(late::INT) r, 100*avg((NOT measurable)::INT) m FROM cu_core WHERE active GROUP BY 1 HAVING count(*)>=10)
SELECT round(corr(r,m),4) pearson, count(*) FILTER (r IS NOT NULL AND m IS NOT NULL) n FROM g""")
def _(t):
    g = t.core.filter("active").groupBy("branch").agg(
        F.count("*").alias("orders"),
        (100 * F.avg(F.col("late").cast("double"))).alias("r"),
        (100 * F.avg((~F.col("measurable")).cast("double"))).alias("m"),
    )
    return ordering.pearson(g.filter("orders >= 10"), "r", "m").withColumn("pearson", F.round("pearson", 4))
