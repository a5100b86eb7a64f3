"""Queries over price, delay and segment measures, on deterministic pseudo-predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.functions.times import year_month
from haulmark.operators import centroids, deliveries, ordering, profiles
from haulmark.operators import delay as delay_ops
from haulmark.operators import evaluation as ev
from haulmark.plans.ctes import define, haversine_sql
from haulmark.plans.registry import query

define("pr_rows", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY purchase_ts, order_id, seller_id)-1 rn, count(*) OVER () n,
 freight_value*(0.803::DOUBLE+(order_id%40)/100.0::DOUBLE) p50 FROM sh_price)
SELECT *, 0.85::DOUBLE*p50 p25, (1.02::DOUBLE+(order_id%11)/10.0::DOUBLE)*p50 p75, order_id%97=0 structural_outlier,
 CASE WHEN weight_total_kg<=0.3 THEN '<0.3' WHEN weight_total_kg<=0.5 THEN '0.3-0.5' WHEN weight_total_kg<=1 THEN '0.5-1'
 WHEN weight_total_kg<=2 THEN '1-2' WHEN weight_total_kg<=5 THEN '2-5' WHEN weight_total_kg<=10 THEN '5-10'
 WHEN weight_total_kg<=30 THEN '10-30' ELSE '>30' END band,
 CASE WHEN rn<floor(n*0.7) THEN 'train' WHEN rn<floor(n*0.85) THEN 'calib' ELSE 'test' END split FROM r""")
define("pr_train", "SELECT * FROM pr_rows WHERE split='train'")
define("pr_test", "SELECT * FROM pr_rows WHERE split='test'")


def _priced(t):
    k, y = F.col("order_id"), F.col("freight_value")
    p50 = y * (0.803 + (k % 40) / 100.0)
    return deliveries.build_shipments(t.star).withColumn("p50", p50).withColumns(
        {"p25": 0.85 * F.col("p50"), "p75": (1.02 + (k % 11) / 10.0) * F.col("p50"), "structural_outlier": k % 97 == 0}
    )


def _price_split(t):
    df = ordering.temporal_split(_priced(t), ["purchase_ts", "order_id", "seller_id"])
    return df.filter("split = 'train'"), df.filter("split = 'test'")


def _metrics_sql(pred="p50", band=True):
    cover = """, round(100*avg((freight_value BETWEEN p25 AND p75)::INT),3) coverage_pct, round(100*avg((freight_value<p25)::INT),3) below_pct,
    round(100*avg((freight_value>p75)::INT),3) above_pct""" if band else ""
    return f"""count(*) n, round(avg(abs({pred}-freight_value)),3) mae, round(avg({pred}-freight_value),3) bias,
    round(median(abs({pred}-freight_value)),3) medae,
    round(median(abs(({pred}-freight_value)/freight_value)*100) FILTER (freight_value>0),3) medape{cover}"""


@query("price_metrics", f"SELECT {_metrics_sql()} FROM pr_test")
def _(t):
    return ev.price_metrics(_price_split(t)[1])


_B = """b_route AS (SELECT route, median(freight_value) m FROM pr_train GROUP BY 1), b_band AS (SELECT band, median(freight_value) m FROM pr_train GROUP BY 1),
b_cell AS (SELECT route, band, median(freight_value) m FROM pr_train GROUP BY 1,2), b_all AS (SELECT median(freight_value) m FROM pr_train),
b_pred AS (SELECT t.*, a.m b_global, coalesce(r.m,a.m) b_route, coalesce(b.m,a.m) b_band, coalesce(c.m,r.m,a.m) b_cell, c.m IS NOT NULL hit
 FROM pr_test t CROSS JOIN b_all a LEFT JOIN b_route r ON r.route=t.route LEFT JOIN b_band b ON b.band=t.band
 LEFT JOIN b_cell c ON c.route=t.route AND c.band=t.band)"""


@query("price_baselines", f"""WITH {_B} SELECT order_id, seller_id, round(b_global,3) b_global, round(b_route,3) b_route, round(b_band,3) b_band,
round(b_cell,3) b_cell, hit cell_hit FROM b_pred""")
def _(t):
    out = ev.price_baselines(*_price_split(t))
    return out.select(
        "order_id", "seller_id", *[F.round(c, 3).alias(c) for c in ("b_global", "b_route", "b_band", "b_cell")],
        (F.col("b_cell_level") == 0).alias("cell_hit"),
    )


_MODELS = {"global": "b_global", "route": "b_route", "band": "b_band", "cell": "b_cell", "model": "p50"}


@query("price_model_comparison", f"""WITH {_B}, m AS ({" UNION ALL ".join(f"SELECT '{n}' model, {_metrics_sql(c, False)} FROM b_pred" for n, c in _MODELS.items())})
SELECT *, round(100*((SELECT mae FROM m WHERE model='cell')-mae)/(SELECT mae FROM m WHERE model='cell'),1) gain_pct FROM m""")
def _(t):
    return ev.compare_price(ev.price_baselines(*_price_split(t)), _MODELS, "cell")


@query("linear_price_rule", """
WITH s AS (SELECT avg(weight_total_kg) mx, avg(distance_km) mz, avg(freight_value) my, var_pop(weight_total_kg) xx, var_pop(distance_km) zz,
 covar_pop(weight_total_kg, distance_km) xz, covar_pop(weight_total_kg, freight_value) xy, covar_pop(distance_km, freight_value) zy FROM pr_train),
c AS (SELECT *, (xy*zz-zy*xz)/(xx*zz-xz*xz) b, (zy*xx-xy*xz)/(xx*zz-xz*xz) c FROM s)
SELECT round(my-b*mx-c*mz,2) intercept, round(b,2) per_kg, round(c,4) per_km FROM c""")
def _(t):
    coef = ev.fit_linear_rule(_price_split(t)[0])
    return t.spark.createDataFrame([tuple(coef)], "a double, b double, c double").select(
        F.round("a", 2).alias("intercept"), F.round("b", 2).alias("per_kg"), F.round("c", 4).alias("per_km")
    )


@query("price_error_cost", """
WITH e AS (SELECT *, p50-freight_value err, CASE WHEN freight_value>0 THEN 100*(p50-freight_value)/freight_value END rel FROM pr_test),
a AS (SELECT count(*) n, CAST(greatest(floor(epoch(max(purchase_ts)-min(purchase_ts))/86400),1) AS BIGINT) AS days, count(*) FILTER (err<0) n_under,
 coalesce(sum(-err) FILTER (err<0),0) lost_margin, count(*) FILTER (err>0) n_over, coalesce(sum(err) FILTER (err>0),0) excess,
 count(*) FILTER (rel>10) n_over_10pct, coalesce(sum(freight_value) FILTER (rel>10),0) at_risk_10pct FROM e)
SELECT n, a.days AS days, n_under, n_over, n_over_10pct, round(lost_margin,1) lost_margin, round(excess,1) excess, round(at_risk_10pct,1) at_risk_10pct,
 round(lost_margin*365/a.days,0) lost_margin_year FROM a""")
def _(t):
    out = ev.error_cost(_price_split(t)[1])
    return out.select(
        "n", "days", "n_under", "n_over", "n_over_10pct", F.round("lost_margin", 1).alias("lost_margin"),
        F.round("excess", 1).alias("excess"), F.round("at_risk_10pct", 1).alias("at_risk_10pct"),
        F.round("lost_margin_year", 0).alias("lost_margin_year"),
    )


@query("price_outliers", """SELECT order_id, seller_id, round(z,4) price_z, abs(z)>0.7 price_outlier, structural_outlier AND abs(z)>0.7 both_outliers
FROM (SELECT *, (ln(1+freight_value)-ln(1+p50))/greatest((ln(1+p75)-ln(1+p25))/1.349::DOUBLE,0.05::DOUBLE) z FROM pr_rows)""")
def _(t):
    return ev.price_outliers(_priced(t), limit=0.7).select(
        "order_id", "seller_id", F.round("price_z", 4).alias("price_z"), "price_outlier", "both_outliers"
    )


@query("human_gate_sweep", """
WITH g AS (SELECT *, unnest([0.55,0.85,1.05]) cut, CASE WHEN p50>0 THEN (p75-p25)/p50 END w FROM pr_test),
h AS (SELECT *, structural_outlier OR coalesce(w>cut,false) human FROM g)
SELECT CAST(cut AS DOUBLE) cut, count(*) FILTER (NOT human) n_auto, count(*) FILTER (human) n_human,
 round(avg(abs(p50-freight_value)) FILTER (NOT human),3) mae_auto, round(avg(abs(p50-freight_value)) FILTER (human),3) mae_human,
 round(100*count(*) FILTER (human)/count(*),1) human_pct FROM h GROUP BY 1""")
def _(t):
    out = ev.gate_sweep(_price_split(t)[1], cuts=(0.55, 0.85, 1.05), min_auto=1, min_human=1)
    return out.drop("medape_auto", "medape_human")


@query("price_fairness_by_destination", """
SELECT dest_state, count(*) n, round(100*avg((p50>freight_value)::INT),3) over_pct, round(median(freight_value),3) freight_p50,
 round(median(100*(p50-freight_value)/freight_value) FILTER (freight_value>0),3) error_pct_p50,
 round(median(abs(100*(p50-freight_value)/freight_value)) FILTER (freight_value>0),3) medape FROM pr_rows GROUP BY 1 HAVING count(*)>=20""")
def _(t):
    return ev.fairness_by(_priced(t), "dest_state", min_n=20)


def _fairness_sql(key, source="pr_rows"):
    return f"""SELECT {key}, count(*) n, round(100*avg((p50>freight_value)::INT),3) over_pct, round(median(freight_value),3) freight_p50,
 round(median(100*(p50-freight_value)/freight_value) FILTER (freight_value>0),3) error_pct_p50,
 round(median(abs(100*(p50-freight_value)/freight_value)) FILTER (freight_value>0),3) medape FROM {source} GROUP BY 1 HAVING count(*)>=20"""


@query("price_fairness_by_profile", _fairness_sql("geo_profile"))
def _(t):
    return ev.fairness_by(_priced(t), "geo_profile", min_n=20)


@query("price_fairness_by_route", _fairness_sql("route"))
def _(t):
    return ev.fairness_by(_priced(t), "route", min_n=20)


_SIZED = """(SELECT p.*, CASE WHEN o<=50 THEN 'small' WHEN o<=100 THEN 'medium' ELSE 'large' END seller_size FROM pr_rows p
JOIN (SELECT seller_id, count(*) o FROM pr_rows GROUP BY 1) USING (seller_id))"""


@query("price_fairness_by_seller_size", _fairness_sql("seller_size", _SIZED))
def _(t):
    priced = _priced(t)
    orders = priced.groupBy("seller_id").agg(F.count("*").alias("_o"))
    size = F.when(F.col("_o") <= 50, "small").when(F.col("_o") <= 100, "medium").otherwise("large")
    return ev.fairness_by(priced.join(orders, "seller_id").withColumn("seller_size", size), "seller_size", min_n=20)


_DECILED = "(SELECT *, " + "1+" + "+".join(
    f"(distance_km>(SELECT quantile_cont(distance_km,{i / 10}) FROM pr_rows))::INT" for i in range(1, 10)
) + " distance_decile FROM pr_rows)"


@query("price_fairness_by_distance", _fairness_sql("distance_decile", _DECILED))
def _(t):
    return ev.fairness_by(ordering.qcut(_priced(t), "distance_km", 10, "distance_decile"), "distance_decile", min_n=20)


@query("price_error_by_month", """SELECT strftime(purchase_ts,'%Y-%m') "month", count(*) n, round(avg(abs(p50-freight_value)),3) mae FROM pr_test
GROUP BY 1 HAVING count(*)>=5""")
def _(t):
    out = ev.price_metrics(_price_split(t)[1].withColumn("month", year_month("purchase_ts")), ["month"])
    return out.filter("n >= 5").select("month", "n", "mae")


define("ge_city", "SELECT city, state, median(lat) lat, median(lng) lng FROM ge_mean GROUP BY 1,2")
define("dl_rows", f"""
WITH b AS (SELECT c.*, CAST(coalesce(honest_late,false) AS INT) y, epoch(promised_ts-purchase_ts)/86400 promised_days,
 epoch(shipping_limit_ts-purchase_ts)/86400 dispatch_slack_days, f.canonical bc FROM cu_core c
 LEFT JOIN ci_map f ON f.state=seller_state AND f.spelling=seller_city WHERE active AND NOT qa_incomplete_tail)
SELECT b.*, {haversine_sql('o.lat', 'o.lng', 'd.lat', 'd.lng', 6371.0)} distance_km, CAST(branch=customer_state AS INT) same_state_flag,
 branch||'>'||customer_state route, CASE WHEN purchase_ts<=(SELECT max(purchase_ts)-INTERVAL 90 DAY FROM b) THEN 'train' ELSE 'test' END split,
 ((order_id*2654435761)%1000)/1000.0::DOUBLE p, ((order_id*40503)%500)/500.0::DOUBLE q
FROM b LEFT JOIN ge_mean d ON d.zip_prefix=customer_zip LEFT JOIN ge_city o ON upper(o.city)=upper(bc) AND o.state=branch""")
define("dl_test", "SELECT * FROM dl_rows WHERE split='test'")


def _delay(t):
    """Delay table with pseudo-scores ``p`` and ``q``."""
    star = t.star
    table = delay_ops.delay_table(star)
    k = F.col("order_id")
    return ordering.date_split(table, "purchase_ts").withColumns(
        {"p": ((k * 2654435761) % 1000) / 1000.0, "q": ((k * 40503) % 500) / 500.0}
    )


@query("delay_features", """SELECT order_id, y, round(promised_days,4) promised_days, round(dispatch_slack_days,4) dispatch_slack_days,
round(distance_km,3) distance_km, same_state_flag, route FROM dl_rows""")
def _(t):
    return delay_ops.delay_table(t.star).select(
        "order_id", "y", *[F.round(c, 4).alias(c) for c in ("promised_days", "dispatch_slack_days")],
        F.round("distance_km", 3).alias("distance_km"), "same_state_flag", "route",
    )


@query("branch_city_distances", "SELECT order_id, round(distance_km,3) distance_km FROM dl_rows")
def _(t):
    return delay_ops.delay_table(t.star).select("order_id", F.round("distance_km", 3).alias("distance_km"))


@query("delay_baselines", """
WITH a AS (SELECT avg(y) prev, quantile_cont(promised_days,0.25) q25 FROM dl_rows WHERE split='train'),
r AS (SELECT route, avg(y) rate FROM dl_rows WHERE split='train' GROUP BY 1 HAVING count(*)>=5)
SELECT order_id, round(prev,4) b_prevalence, 0.5::DOUBLE*(promised_days<q25)::INT+0.5::DOUBLE*(1-same_state_flag) b_rule,
 round(coalesce(rate,prev),4) b_route FROM dl_test LEFT JOIN r USING(route) CROSS JOIN a""")
def _(t):
    df = _delay(t)
    out = ev.delay_baselines(df.filter("split = 'train'"), df.filter("split = 'test'"), min_route=5)
    return out.select("order_id", F.round("b_prevalence", 4).alias("b_prevalence"), "b_rule", F.round("b_route", 4).alias("b_route"))


@query("delay_auc", """
WITH s AS (SELECT p, count(*) FILTER (y=1) pos, count(*) FILTER (y=0) neg FROM dl_rows GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) b FROM s)
SELECT CAST(sum(pos) AS BIGINT) positives, CAST(sum(neg) AS BIGINT) negatives, round(sum(pos*(b+neg/2.0::DOUBLE))/(sum(pos)*sum(neg)),4) auc FROM c""")
def _(t):
    return ev.roc_auc(_delay(t), "p", "y").withColumn("auc", F.round("auc", 4))


@query("delay_auc_by_month", """
WITH s AS (SELECT strftime(purchase_ts,'%Y-%m') m, p, count(*) FILTER (y=1) pos, count(*) FILTER (y=0) neg FROM dl_rows GROUP BY 1,2),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY m ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) b FROM s)
SELECT m "month", CAST(sum(pos) AS BIGINT) positives, CAST(sum(neg) AS BIGINT) negatives, round(sum(pos*(b+neg/2.0::DOUBLE))/(sum(pos)*sum(neg)),4) auc
FROM c GROUP BY 1 HAVING sum(pos)>0 AND sum(neg)>0""")
def _(t):
    df = _delay(t).withColumn("month", year_month("purchase_ts"))
    return ev.roc_auc(df, "p", "y", ["month"]).withColumn("auc", F.round("auc", 4))


@query("delay_average_precision", """
WITH s AS (SELECT p, count(*) FILTER (y=1) pos, count(*) n FROM dl_rows GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w hits, sum(n) OVER w alls FROM s WINDOW w AS (ORDER BY p DESC))
SELECT CAST(sum(pos) AS BIGINT) positives, round(sum(pos*hits/alls)/sum(pos),4) average_precision FROM c""")
def _(t):
    return ev.avg_precision(_delay(t), "p", "y").withColumn("average_precision", F.round("average_precision", 4))


@query("delay_cost_curve", """
WITH t AS (SELECT unnest([0.05,0.08,0.10,0.12,0.15,0.20,0.25,0.30,0.40,0.50])::DOUBLE cut),
c AS (SELECT cut, count(*) FILTER (p>=cut AND y=1) tp, count(*) FILTER (p>=cut AND y=0) fp, count(*) FILTER (p<cut AND y=1) fn, sum(y) late FROM dl_test, t GROUP BY 1),
k AS (SELECT *, fn*45.0::DOUBLE+fp*8.0::DOUBLE cost FROM c)
SELECT cut, tp, fp, fn, round(tp/greatest(late,1),4) recall, round(tp/greatest(tp+fp,1),4) "precision", cost, late*45.0::DOUBLE-cost saving,
 round((late*45.0::DOUBLE-cost)*365/90,2) saving_year, cut=(SELECT cut FROM k ORDER BY cost, cut LIMIT 1) best FROM k""")
def _(t):
    return ev.cost_curve(_delay(t).filter("split = 'test'"), "p", "y")


@query("delay_signal_shift", """
WITH e AS (SELECT quantile_cont(promised_days,0.2) a, quantile_cont(promised_days,0.4) b, quantile_cont(promised_days,0.6) c, quantile_cont(promised_days,0.8) d
 FROM dl_rows WHERE split='train'),
x AS (SELECT dl_rows.*, CAST(1+(promised_days>a)::INT+(promised_days>b)::INT+(promised_days>c)::INT+(promised_days>d)::INT AS INT) quintile FROM dl_rows, e),
n AS (SELECT count(*) FILTER (split='train') tr, count(*) FILTER (split='test') te FROM dl_rows)
SELECT quintile, count(*) FILTER (split='train') n_train, count(*) FILTER (split='test') n_test, round(median(promised_days),1) "median",
 round(100*avg(y) FILTER (split='train'),3) train_pct, round(100*avg(y) FILTER (split='test'),3) test_pct,
 round(100*avg(y) FILTER (split='test')-100*avg(y) FILTER (split='train'),3) delta_pp,
 round(100*count(*) FILTER (split='train')/any_value(tr),2) mix_train_pct, round(100*count(*) FILTER (split='test')/any_value(te),2) mix_test_pct
FROM x, n GROUP BY 1""")
def _(t):
    return ev.signal_shift(_delay(t), "promised_days", "y")


@query("delay_signal_correlation", """
WITH r AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY promised_days)+(count(*) OVER (PARTITION BY split, promised_days)-1)/2.0 rx,
 rank() OVER (PARTITION BY split ORDER BY y)+(count(*) OVER (PARTITION BY split, y)-1)/2.0 ry FROM dl_rows)
SELECT split side, round(corr(rx,ry),4) spearman, count(*) n FROM r GROUP BY 1""")
def _(t):
    return ev.signal_correlation(_delay(t), "promised_days", "y")


@query("delay_recall_by_region", """
SELECT customer_state, count(*) orders, round(100*avg(y),3) late_pct, count(*) FILTER (p>=0.3) alerts,
 round(count(*) FILTER (p>=0.3 AND y=1)/greatest(sum(y),1),4) recall,
 round(count(*) FILTER (p>=0.3 AND y=1)/greatest(count(*) FILTER (p>=0.3),1),4) "precision" FROM dl_rows GROUP BY 1 HAVING count(*)>=10""")
def _(t):
    return ev.recall_by(_delay(t), "customer_state", "p", "y", 0.3, min_n=10)


@query("delay_recall_by_distance", """
WITH e AS (SELECT """ + ", ".join(f"quantile_cont(distance_km,{i / 10}) e{i}" for i in range(11)) + """ FROM dl_rows),
x AS (SELECT *, CASE WHEN distance_km IS NOT NULL THEN """ + "+".join(
    ["1"] + [f"(distance_km>e{i} AND e{i}>e{i - 1})::INT" for i in range(1, 10)]) + """ END decile FROM dl_rows, e)
SELECT CAST(decile AS INT) decile, count(*) orders, round(100*avg(y),3) late_pct, count(*) FILTER (p>=0.3) alerts,
 round(count(*) FILTER (p>=0.3 AND y=1)/greatest(sum(y),1),4) recall,
 round(count(*) FILTER (p>=0.3 AND y=1)/greatest(count(*) FILTER (p>=0.3),1),4) "precision" FROM x GROUP BY 1""")
def _(t):
    return ev.recall_by_decile(_delay(t), "distance_km", "p", "y", 0.3)


@query("delay_regression_loss", """SELECT count(*) orders, count(days_vs_promise) with_days, count(*)-count(days_vs_promise) without_days,
count(*) FILTER (days_vs_promise IS NULL AND y=1) late_lost,
round(100*count(*) FILTER (days_vs_promise IS NULL AND y=1)/greatest(sum(y),1),2) late_lost_pct FROM dl_rows""")
def _(t):
    return ev.regression_loss(_delay(t))


@query("delay_bootstrap")
def _(t):
    out = ev.bootstrap_auc_delta(_delay(t), "p", "q", "y")
    return out.select("replicates", *[F.round(c, 3).alias(c) for c in ("delta_pp", "low_pp", "high_pp")], "includes_zero")


_SEG = "CAST(quantity_items+CASE WHEN distance_km>2000 THEN 10 ELSE 0 END AS INT)"
define("sg_rows", f"SELECT *, {_SEG} segment FROM sh_segment")


def _segmented(t):
    far = F.when(F.col("distance_km") > 2000, 10).otherwise(0)
    return deliveries.build_segment_shipments(t.star).withColumn(
        "segment", (F.col("quantity_items") + far).cast("int")
    )


@query("segment_profile", """
SELECT segment, count(*) shipments, round(avg(quantity_items),3) quantity_mean, round(median(distance_km),3) distance_km,
 round(stddev_samp(freight_value)/avg(freight_value),3) freight_cv, round(100*avg(coalesce(delay_days>0,false)::INT),3) late_pct,
 round(avg(review_score),3) review_mean, round(100*count(*)/(SELECT count(*) FROM sg_rows),3) share_pct,
 round(100*sum(freight_value)/(SELECT sum(freight_value) FROM sg_rows),3) freight_share_pct FROM sg_rows GROUP BY 1""")
def _(t):
    return profiles.segment_profile(_segmented(t)).select(
        "segment", "shipments", "quantity_mean", "distance_km", "freight_cv", "late_pct", "review_mean", "share_pct", "freight_share_pct"
    )


@query("segment_quality", """
WITH c AS (SELECT segment, count(*) n, avg(lead_days) a, avg(weight_total_kg) b FROM sg_rows GROUP BY 1),
d AS (SELECT r.segment, pow(lead_days-a,2)+pow(weight_total_kg-b,2) d2 FROM sg_rows r JOIN c USING(segment)),
s AS (SELECT c.*, avg(sqrt(d2)) s, sum(d2) w FROM c JOIN d USING(segment) GROUP BY ALL),
m AS (SELECT avg(lead_days) ma, avg(weight_total_kg) mb, count(*) total FROM sg_rows),
r AS (SELECT x.segment, max((x.s+y.s)/sqrt(pow(x.a-y.a,2)+pow(x.b-y.b,2))) r FROM s x JOIN s y ON x.segment<>y.segment GROUP BY 1)
SELECT CAST(count(*) AS INT) k, round((SELECT avg(r) FROM r),4) davies_bouldin,
 round((sum(n*(pow(a-ma,2)+pow(b-mb,2)))/(count(*)-1))/(sum(w)/(any_value(total)-count(*))),4) calinski_harabasz,
 round(100*min(n)/any_value(total),4) smallest_pct FROM s, m""")
def _(t):
    out = ev.cluster_quality(_segmented(t), ["lead_days", "weight_total_kg"])
    return out.select("k", *[F.round(c, 4).alias(c) for c in ("davies_bouldin", "calinski_harabasz", "smallest_pct")])


@query("segment_agreement", """
WITH l AS (SELECT segment a, CAST(floor(lead_days/10) AS INT) b FROM sg_rows), c AS (SELECT a, b, count(*) n FROM l GROUP BY 1,2),
x AS (SELECT sum(n*(n-1)/2) i FROM c), r AS (SELECT sum(n*(n-1)/2) i FROM (SELECT sum(n) n FROM c GROUP BY a)),
k AS (SELECT sum(n*(n-1)/2) i FROM (SELECT sum(n) n FROM c GROUP BY b)), z AS (SELECT count(*) n, count(*)*(count(*)-1)/2 i FROM l)
SELECT z.n AS rows, round((x.i-r.i*k.i/z.i)/((r.i+k.i)/2-r.i*k.i/z.i),4) ari FROM x, r, k, z""")
def _(t):
    df = _segmented(t).withColumn("other", F.floor(F.col("lead_days") / 10).cast("int"))
    return ev.adjusted_rand(df, "segment", "other").withColumn("ari", F.round("ari", 4))


@query("segment_names")
def _(t):
    return ev.name_segments(profiles.segment_profile(_segmented(t)))


_ART = ["qa_near_duplicate", "qa_no_approval_ts", "qa_negative_dispatch_lag", "qa_payment_mismatch", "qa_zero_freight"]


@query("segment_artifacts", f"""
WITH s AS ({" UNION ALL ".join(f"SELECT seller_tier, '{f}' flag, {f} v FROM cu_core" for f in _ART)}),
o AS (SELECT flag, avg(v::INT) o FROM s GROUP BY 1), g AS (SELECT seller_tier, flag, avg(v::INT) r, count(*) FILTER (v) h FROM s GROUP BY 1,2)
SELECT seller_tier, flag, round(100*r,4) segment_pct, round(100*o,4) overall_pct, round(r/o,4) enrichment, h orders, r/o>=3 fails
FROM g JOIN o USING(flag) WHERE o>0 AND r>0 AND r/o>=1.05 AND r>=0.001""")
def _(t):
    return profiles.artifact_test(t.core, "seller_tier", _ART, ratio=1.05, min_rate=0.001)


@query("segment_population_funnel", f"""
WITH d AS (SELECT c.*, {haversine_sql('o.lat', 'o.lng', 'd.lat', 'd.lng')} dist_km FROM cu_core c
 LEFT JOIN ge_mean o ON o.zip_prefix=seller_zip LEFT JOIN ge_mean d ON d.zip_prefix=customer_zip)
SELECT unnest(range(7))::INT step, unnest(['curated','active','with_distance','with_weight','with_goods','with_lead','positive']) label,
 unnest([count(*), count(*) FILTER (active), count(*) FILTER (active AND dist_km IS NOT NULL), count(*) FILTER (active AND dist_km IS NOT NULL AND weight_g IS NOT NULL),
 count(*) FILTER (active AND dist_km IS NOT NULL AND weight_g IS NOT NULL AND goods_value IS NOT NULL),
 count(*) FILTER (active AND dist_km IS NOT NULL AND weight_g IS NOT NULL AND goods_value IS NOT NULL AND lead_days IS NOT NULL),
 count(*) FILTER (active AND dist_km IS NOT NULL AND weight_g>0 AND goods_value>0 AND lead_days>0)]) AS rows FROM d""")
def _(t):
    from haulmark.functions.geo import haversine_km
    from haulmark.operators.curation import star_core
    from haulmark.operators.funnel import segment_funnel

    star = t.star
    df = deliveries.attach_geo(star_core(star), centroids.zip_centroids(star.geo))
    return segment_funnel(df.withColumn("dist_km", haversine_km("origin_lat", "origin_lng", "dest_lat", "dest_lng")))
