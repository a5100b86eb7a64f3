"""SQL definitions shared by the twins: the star adapter and the curated tables.

Written independently of the operators, so a twin checks the operator and not itself.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(sql: str) -> str:
    """Put the definitions a query mentions in front of it, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit_one(name)

    def visit_one(name: str) -> None:
        if name in ordered:
            return
        for other in CTES:
            if other != name and re.search(rf"\b{other}\b", CTES[name]):
                visit_one(other)
        ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    shared = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    own = sql.strip()
    if own[:5].upper() == "WITH ":
        return f"WITH {shared},\n{own[5:]}"
    return f"WITH {shared}\n{own}"


define("fx_orders", """
WITH b AS (SELECT o_orderkey k, o_custkey c, o_orderpriority pr,
  CASE WHEN o_orderkey%160=0 THEN 'canceled' WHEN o_orderkey%40=7 THEN 'shipped' ELSE 'delivered' END st,
  o_orderdate + to_hours(CAST(o_orderkey%24 AS INT)) buy FROM orders),
d AS (SELECT *, buy + to_hours(CAST(c%36 AS INT)) app,
  buy + to_hours(CAST(c%36 + ((k*7)%61-1)*3 AS INT)) car FROM b)
SELECT k order_id, c customer_id, st order_status, buy purchase_ts,
  CASE WHEN k%97=0 THEN NULL ELSE app END approved_ts,
  CASE WHEN st<>'delivered' AND k%2=1 THEN NULL ELSE car END carrier_ts,
  CASE WHEN st<>'delivered' OR k%200=3 THEN NULL
       WHEN k%500=11 THEN car - to_hours(24)
       WHEN k%900=13 THEN car + to_hours(24*120)
       ELSE car + to_hours(CAST(24*((k*13)%29)+k%10 AS INT)) END delivered_ts,
  date_trunc('day',buy) + to_hours(CAST(24*(20+c%10) AS INT)) promised_ts, pr priority
FROM d""")
define("fx_items", """
WITH i AS (SELECT l_orderkey order_id, l_linenumber order_item_id, l_partkey product_id, l_suppkey seller_id,
  l_shipdate shipping_limit_ts, l_extendedprice price,
  round(l_extendedprice*l_tax*CASE WHEN l_orderkey%701=0 THEN 90 ELSE 1 END+0.00003,2) freight_value FROM lineitem)
SELECT * FROM i UNION ALL SELECT order_id, order_item_id+100, product_id, seller_id, shipping_limit_ts, price,
  freight_value FROM i WHERE order_id%220=0""")
define("fx_sellers", """
SELECT s_suppkey seller_id, lpad(CAST(s_suppkey%50 AS VARCHAR),5,'0') zip_prefix, 'N'||s_nationkey seller_state,
  n_name seller_city FROM supplier JOIN nation ON s_nationkey=n_nationkey""")
define("fx_customers", """
SELECT c_custkey customer_id, lpad(CAST(10000+c_custkey%300 AS VARCHAR),5,'0') zip_prefix,
  'N'||c_nationkey customer_state,
  CASE WHEN c_custkey%40=3 THEN lower(n_name)||' - n'||c_nationkey WHEN c_custkey%40=9 THEN lower(n_name)
       ELSE n_name END customer_city
FROM customer JOIN nation ON c_nationkey=n_nationkey""")
define("fx_products", """
SELECT p_partkey product_id, p_type category,
  CASE WHEN p_partkey%211=0 THEN NULL WHEN p_partkey%307=0 THEN 0.0::DOUBLE WHEN p_partkey%401=0 THEN 35000.0::DOUBLE
       ELSE p_size*150.0::DOUBLE END weight_g,
  p_size+10.0::DOUBLE length_cm, p_size+5.0::DOUBLE height_cm, p_size+8.0::DOUBLE width_cm FROM part""")
define("fx_payments", """
WITH t AS (SELECT order_id, sum(price+freight_value) v FROM fx_items GROUP BY 1)
SELECT order_id, 1 payment_sequential,
  CASE WHEN order_id%1500=0 THEN 'not_defined' WHEN priority LIKE '1%' THEN 'boleto' WHEN priority LIKE '2%' THEN 'voucher'
       WHEN priority LIKE '3%' THEN 'debit_card' ELSE 'credit_card' END payment_type,
  CASE WHEN order_id%1500=0 THEN 0.0 WHEN order_id%300=7 THEN v+5.0 WHEN order_id%5=0 THEN v/2 ELSE v END payment_value,
  order_id%4 installments
FROM fx_orders JOIN t USING(order_id)
UNION ALL SELECT order_id, 2, 'voucher', v-v/2, order_id%4 FROM t
WHERE order_id%5=0 AND order_id%1500<>0 AND order_id%300<>7""")
define("fx_geo", """
WITH z AS (SELECT DISTINCT zip_prefix, seller_state st, seller_city city FROM fx_sellers
  UNION SELECT DISTINCT lpad(CAST(10000+c_custkey%300 AS VARCHAR),5,'0'), 'N'||c_nationkey, n_name
  FROM customer JOIN nation ON c_nationkey=n_nationkey),
y AS (SELECT *, CAST(zip_prefix AS INT) z FROM z WHERE CAST(zip_prefix AS INT)%60<>5),
p AS (SELECT y.*, j FROM y, (VALUES (0),(1),(2)) t(j))
SELECT zip_prefix, -33.0::DOUBLE+((z*37)%380)/10.0::DOUBLE+j*0.01::DOUBLE lat,
  -73.0::DOUBLE+((z*53)%380)/10.0::DOUBLE+j*0.02::DOUBLE lng, city, st state FROM p
UNION ALL SELECT zip_prefix, -33.0::DOUBLE+((z*37)%380)/10.0::DOUBLE, -73.0::DOUBLE+((z*53)%380)/10.0::DOUBLE, city, st
  FROM y WHERE z%4=0
UNION ALL SELECT zip_prefix, 41.0::DOUBLE, -8.0::DOUBLE, city, st FROM y WHERE z%90=0""")
define("fx_reviews", """
WITH o AS (SELECT order_id, promised_ts + to_hours(CAST((order_id%7)*24 AS INT)) created_ts FROM fx_orders
  WHERE order_id%50<>1)
SELECT order_id review_id, order_id, 1+order_id%5 review_score, created_ts,
  created_ts + to_hours(CAST((order_id*11)%90 AS INT)) answered_ts FROM o
UNION ALL SELECT order_id+1, order_id, 1+order_id%5, created_ts,
  created_ts + to_hours(CAST((order_id*11)%90 AS INT)) FROM o WHERE order_id%60=2""")
define("fx_translation", "SELECT DISTINCT p_type category, lower(p_type) category_english FROM part WHERE p_type NOT LIKE 'S%'")

define("cu_first", """
SELECT order_id, product_id, seller_id, shipping_limit_ts FROM (SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY order_item_id, product_id, seller_id, price, freight_value, shipping_limit_ts) rn FROM fx_items) WHERE rn=1""")
define("cu_totals", """
SELECT order_id, count(order_item_id) n_items, sum(price) goods_value, sum(freight_value) freight_value
FROM fx_items GROUP BY 1""")
define("cu_paid", """
SELECT order_id, sum(payment_value) paid_value, arg_min(payment_type, payment_sequential) payment_channel
FROM fx_payments GROUP BY 1""")
define("cu_near", """
SELECT order_id, product_id, seller_id, price, freight_value, count(*) copies FROM fx_items
GROUP BY 1,2,3,4,5 HAVING count(*)>1""")
define("cu_joined", """
SELECT o.order_id, o.customer_id, order_status, purchase_ts, approved_ts, carrier_ts, delivered_ts, promised_ts,
  f.product_id, f.seller_id, shipping_limit_ts, n_items, goods_value, freight_value, paid_value, payment_channel,
  s.zip_prefix seller_zip, seller_state, seller_city, c.zip_prefix customer_zip, customer_state, customer_city, weight_g,
  o.order_id IN (SELECT order_id FROM cu_near) near_duplicate
FROM fx_orders o LEFT JOIN cu_first f USING(order_id) LEFT JOIN cu_totals t USING(order_id)
LEFT JOIN cu_paid p USING(order_id) LEFT JOIN fx_sellers s ON s.seller_id=f.seller_id
LEFT JOIN fx_customers c ON c.customer_id=o.customer_id LEFT JOIN fx_products pr ON pr.product_id=f.product_id""")
define("cu_core", """
WITH e AS (SELECT max(purchase_ts) fim FROM fx_orders),
v AS (SELECT seller_id, count(*) n FROM cu_joined WHERE seller_id IS NOT NULL GROUP BY 1),
a AS (SELECT j.* EXCLUDE (weight_g), weight_g weight_g_original, CASE WHEN weight_g<=0 THEN NULL ELSE weight_g END weight_g,
  coalesce(seller_state,'SEM_FILIAL') branch,
  seller_id IS NULL qa_no_item, delivered_ts IS NULL qa_no_delivery_ts, carrier_ts IS NULL qa_no_carrier_ts,
  approved_ts IS NULL qa_no_approval_ts, weight_g IS NULL qa_no_weight,
  coalesce(delivered_ts<carrier_ts,false) qa_delivered_before_carrier,
  coalesce(carrier_ts<approved_ts,false) qa_negative_dispatch_lag,
  coalesce(weight_g<=0,false) qa_invalid_weight, coalesce(freight_value=0,false) qa_zero_freight,
  coalesce(paid_value<=0,false) qa_invalid_payment, coalesce(payment_channel='not_defined',false) qa_undefined_channel,
  round(epoch(delivered_ts-purchase_ts)/86400,3) lead_days,
  round(epoch(delivered_ts-promised_ts)/86400,3) days_vs_promise,
  coalesce(goods_value>0 AND freight_value>3*goods_value,false) qa_disproportionate_freight,
  coalesce(abs(paid_value-(goods_value+freight_value))>1.0,false) qa_payment_mismatch,
  near_duplicate qa_near_duplicate, purchase_ts>=fim-INTERVAL 60 DAY qa_incomplete_tail,
  CASE WHEN v.n IS NULL THEN 'SEM_VENDEDOR' WHEN v.n<=10 THEN '1-10 pedidos' WHEN v.n<=100 THEN '11-100'
       WHEN v.n<=1000 THEN '101-1000' ELSE '>1000' END seller_tier,
  order_status<>'canceled' active, delivered_ts IS NOT NULL measurable,
  order_status<>'canceled' AND delivered_ts IS NULL AND coalesce(promised_ts<fim,false) overdue_no_record
  FROM cu_joined j LEFT JOIN v USING(seller_id) CROSS JOIN e)
SELECT *, coalesce(lead_days>100,false) qa_implausible_lead, coalesce(weight_g>30000,false) qa_implausible_weight,
  CASE WHEN measurable THEN days_vs_promise>0 END late,
  CASE WHEN NOT active THEN NULL WHEN measurable THEN days_vs_promise>0 ELSE overdue_no_record END honest_late,
  (qa_delivered_before_carrier OR qa_negative_dispatch_lag OR qa_invalid_weight OR qa_invalid_payment
   OR qa_undefined_channel) qa_quarantine,
  concat_ws('|', CASE WHEN qa_delivered_before_carrier THEN 'entrega_antes_coleta' END,
    CASE WHEN qa_negative_dispatch_lag THEN 'lag_despacho_negativo' END,
    CASE WHEN qa_invalid_weight THEN 'peso_invalido' END, CASE WHEN qa_invalid_payment THEN 'pagamento_invalido' END,
    CASE WHEN qa_undefined_channel THEN 'canal_indefinido' END) quarantine_reason
FROM a""")
define("an_core", "SELECT * FROM cu_core WHERE active AND NOT qa_quarantine AND NOT qa_incomplete_tail")

define("ge_points", "SELECT zip_prefix, lat, lng, city, state, count(*) copies FROM fx_geo GROUP BY 1,2,3,4,5")
define("ge_in", "SELECT * FROM ge_points WHERE lat BETWEEN -34.0 AND 5.3 AND lng BETWEEN -74.0 AND -34.8")
define("ge_modes", """
SELECT zip_prefix,
  (SELECT city FROM ge_in i WHERE i.zip_prefix=g.zip_prefix GROUP BY city ORDER BY count(*) DESC, city LIMIT 1) city,
  (SELECT state FROM ge_in i WHERE i.zip_prefix=g.zip_prefix GROUP BY state ORDER BY count(*) DESC, state LIMIT 1) state
FROM (SELECT DISTINCT zip_prefix FROM ge_in) g""")
define("ge_mean", """
WITH a AS (SELECT zip_prefix, avg(lat) lat, avg(lng) lng, count(*) n_points FROM ge_in GROUP BY 1),
r AS (SELECT zip_prefix, count(*) n_points_raw, avg(lat) lat_raw, avg(lng) lng_raw,
  count(*) FILTER (NOT (lat BETWEEN -34.0 AND 5.3 AND lng BETWEEN -74.0 AND -34.8)) points_out_of_bounds
  FROM fx_geo GROUP BY 1)
SELECT a.*, n_points_raw, lat_raw, lng_raw, points_out_of_bounds, city, state,
  n_points_raw-n_points duplicates_removed,
  round(sqrt((lat-lat_raw)*(lat-lat_raw)+((lng-lng_raw)*cos(radians(lat)))*((lng-lng_raw)*cos(radians(lat))))*111320,1)
    centroid_shift_m
FROM a JOIN r USING(zip_prefix) JOIN ge_modes USING(zip_prefix)""")
define("ge_median", """
WITH m AS (SELECT zip_prefix, median(lat) lat, median(lng) lng FROM fx_geo GROUP BY 1),
c AS (SELECT zip_prefix, city, row_number() OVER (PARTITION BY zip_prefix ORDER BY count(*) DESC, city) rn
  FROM fx_geo GROUP BY 1,2),
s AS (SELECT zip_prefix, state, row_number() OVER (PARTITION BY zip_prefix ORDER BY count(*) DESC, state) rn
  FROM fx_geo GROUP BY 1,2)
SELECT m.*, c.city, s.state FROM m JOIN c ON c.zip_prefix=m.zip_prefix AND c.rn=1
JOIN s ON s.zip_prefix=m.zip_prefix AND s.rn=1""")

define("ci_pairs", """
SELECT city, upper(state) state, 'geolocation_city' field FROM fx_geo
UNION ALL SELECT customer_city, upper(customer_state), 'customer_city' FROM fx_customers
UNION ALL SELECT seller_city, upper(seller_state), 'seller_city' FROM fx_sellers""")
# Nation names carry no accent; a suffix of the own state is the only structural change.
define("ci_keys", r"""
SELECT state, city spelling, count(*) n_rows,
  trim(regexp_replace(regexp_replace(replace(lower(strip_accents(city)),'-',' '),'\s+',' ','g'), ' '||lower(state)||'$','')) city_key
FROM ci_pairs GROUP BY 1,2""")
define("ci_map", r"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY state, city_key ORDER BY n_rows DESC, spelling DESC) rn FROM ci_keys),
c AS (SELECT state, city_key, upper(spelling[1])||lower(spelling[2:]) canonical FROM b WHERE rn=1)
SELECT k.state, spelling, city_key, canonical, n_rows,
  CASE WHEN spelling LIKE '%-%' THEN 'sufixo-uf' ELSE 'nenhuma' END rules,
  CASE WHEN regexp_replace(replace(lower(spelling),'-',' '),'\s+',' ','g')<>lower(canonical) THEN 'estrutural'
       WHEN spelling<>canonical THEN 'formatacao' ELSE 'nenhuma' END change
FROM ci_keys k JOIN c USING(state, city_key)""")
define("cu_full", """
WITH g AS (SELECT c.*, b.canonical branch_city, x.canonical customer_city_canonical, b.change='estrutural' bs,
  x.change='estrutural' xs, z.state branch_zip_state, y.state customer_zip_state, y.zip_prefix yz
  FROM cu_core c LEFT JOIN ci_map b ON b.state=seller_state AND b.spelling=seller_city
  LEFT JOIN ci_map x ON x.state=customer_state AND x.spelling=customer_city
  LEFT JOIN ge_mean z ON z.zip_prefix=seller_zip LEFT JOIN ge_mean y ON y.zip_prefix=customer_zip),
f AS (SELECT * EXCLUDE (bs, xs, yz), coalesce(bs,false) OR coalesce(xs,false) qa_city_rewritten,
  coalesce(seller_state<>branch_zip_state,false) qa_branch_state_mismatch,
  coalesce(customer_state<>customer_zip_state,false) qa_customer_state_mismatch, yz IS NULL qa_zip_no_geo FROM g)
SELECT *, qa_no_item::INT+qa_city_rewritten::INT+qa_branch_state_mismatch::INT+qa_customer_state_mismatch::INT
  +qa_no_delivery_ts::INT+qa_no_carrier_ts::INT+qa_no_approval_ts::INT+qa_no_weight::INT
  +qa_delivered_before_carrier::INT+qa_negative_dispatch_lag::INT+qa_invalid_weight::INT+qa_zero_freight::INT
  +qa_invalid_payment::INT+qa_undefined_channel::INT+qa_zip_no_geo::INT+qa_implausible_lead::INT
  +qa_implausible_weight::INT+qa_disproportionate_freight::INT+qa_payment_mismatch::INT+qa_near_duplicate::INT
  +qa_incomplete_tail::INT qa_flags_total FROM f""")

HAV = ("CASE WHEN {a}+{b}+{c}+{d} IS NOT NULL THEN 2*{r}*asin(sqrt(least(greatest(pow(sin(radians({b}-{a})/2),2)"
       "+cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-{c})/2),2),0.0),1.0))) END")


def haversine_sql(lat1, lng1, lat2, lng2, radius=6371.0088) -> str:
    return HAV.format(a=lat1, b=lat2, c=lng1, d=lng2, r=radius)


define("sh_items", """
SELECT i.*, o.customer_id, purchase_ts, delivered_ts, promised_ts, category, weight_g,
  length_cm*height_cm*width_cm volume_cm3
FROM fx_items i JOIN fx_orders o ON o.order_id=i.order_id AND order_status='delivered'
LEFT JOIN fx_products p ON p.product_id=i.product_id""")
define("sh_rollup", """
SELECT order_id, seller_id, customer_id, purchase_ts, delivered_ts, promised_ts, count(order_item_id) quantity_items,
  coalesce(sum(price),0) declared_value, coalesce(sum(freight_value),0) freight_value,
  coalesce(sum(weight_g),0) weight_total_g, coalesce(sum(volume_cm3),0) volume_cm3,
  arg_min(category, (order_item_id, product_id, category)) category
FROM sh_items GROUP BY 1,2,3,4,5,6""")
define("sh_all", f"""
WITH j AS (SELECT r.*, c.zip_prefix customer_zip, s.zip_prefix seller_zip, o.lat origin_lat, o.lng origin_lng,
  o.city origin_city, upper(o.state) origin_state, d.lat dest_lat, d.lng dest_lng, d.city dest_city, upper(d.state) dest_state
  FROM sh_rollup r JOIN fx_customers c USING(customer_id) JOIN fx_sellers s ON s.seller_id=r.seller_id
  LEFT JOIN ge_median o ON o.zip_prefix=s.zip_prefix LEFT JOIN ge_median d ON d.zip_prefix=c.zip_prefix)
SELECT *, weight_total_g/1000.0::DOUBLE weight_total_kg, volume_cm3/6000.0::DOUBLE cubic_weight_kg,
  (weight_total_g/1000.0::DOUBLE)/nullif(volume_cm3/6000.0::DOUBLE,0) density,
  freight_value/nullif(weight_total_g/1000.0::DOUBLE,0) freight_per_kg, 100*freight_value/nullif(declared_value,0) freight_pct_value,
  {haversine_sql('origin_lat','origin_lng','dest_lat','dest_lng')} distance_km, month(purchase_ts) "month",
  epoch(delivered_ts-purchase_ts)/86400 lead_days, epoch(delivered_ts-promised_ts)/86400 delay_days,
  origin_state||'>'||dest_state route, CASE WHEN origin_state=dest_state THEN 'same_state' ELSE 'interstate' END same_state,
  'interior_interior' geo_profile
FROM j""")
define("sh_price", """
SELECT * FROM sh_all WHERE distance_km IS NOT NULL AND freight_value>=0 AND weight_total_kg>0 AND quantity_items>0""")
define("sh_segment", """
SELECT s.*, r.review_score FROM sh_all s
LEFT JOIN (SELECT order_id, avg(review_score) review_score FROM fx_reviews GROUP BY 1) r ON r.order_id=s.order_id
WHERE distance_km IS NOT NULL AND lead_days>0 AND freight_value>0 AND weight_total_kg>0 AND cubic_weight_kg>0
AND declared_value>0 AND quantity_items>0""")
