"""Streams run to their end over the event table, manifests, and what they leave behind."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from haulmark.config import CurationConfig
from haulmark.operators import centroids, cities, curation
from haulmark.plans.ctes import define
from haulmark.plans.quoting_queries import CHANGES_SQL, DAY, next_version
from haulmark.plans.registry import query
from haulmark.session import use_utc, work_folder, written
from haulmark.sources import quoting_inputs as inputs
from haulmark.sources import versions
from haulmark.streaming import quotes

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _feed(t):
    use_utc(t.spark)
    events = t.spark.readStream.schema(EVENTS).parquet(f"{t.folder}/events*.parquet")
    return inputs.derive_requests(events)


def _finish(started):
    started.awaitTermination()


@query("streamed_decisions", """SELECT outcome, count(*) n, round(coalesce(sum(CASE WHEN outcome='cotado' THEN total1 END),0),2) total
FROM rq_decided GROUP BY 1""")
def _(t):
    out = work_folder(t.spark)
    loader = lambda: inputs.derive_tariffs(t.spark, t.folder)
    _finish(quotes.start_quote_stream(quotes.dedupe_stream(_feed(t)), loader, out, f"{out}/checkpoint", DAY))
    decisions = t.spark.read.parquet(f"{out}/decisions")
    return decisions.groupBy("outcome").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum("quoted_total"), F.lit(0.0)), 2).alias("total")
    )


@query("streamed_daily_outcomes", """SELECT strftime(ts,'%Y-%m-%d') "day", event_type outcome, count(*) n FROM events GROUP BY 1,2""")
def _(t):
    out = work_folder(t.spark)
    use_utc(t.spark)
    events = t.spark.readStream.schema(EVENTS).parquet(f"{t.folder}/events*.parquet")
    counts = quotes.outcome_counts_stream(events.select("ts", F.col("event_type").alias("outcome")))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint")
    _finish(writer.trigger(availableNow=True).start())
    rows = t.spark.read.parquet(f"{out}/counts")
    return rows.groupBy("day", "outcome").agg(F.max_by("n", "batch").alias("n"))


@query("streamed_threads", """
SELECT id_email, CASE WHEN e_cotacao AND heard THEN coalesce(last_value(CASE WHEN heard AND qtd_volumes<>0 THEN qtd_volumes END IGNORE NULLS) OVER w, qtd_volumes) ELSE qtd_volumes END qtd_volumes,
 CASE WHEN e_cotacao AND heard THEN coalesce(last_value(CASE WHEN heard THEN destino END IGNORE NULLS) OVER w, destino) ELSE destino END destino,
 CASE WHEN e_cotacao AND heard THEN max(CASE WHEN heard THEN coalesce(confianca,0) END) OVER w ELSE confianca END confianca
FROM (SELECT *, NOT (coalesce(remetente,'')='' OR remetente LIKE '%noreply%') heard FROM rq_raw) WINDOW w AS (PARTITION BY thread_id ORDER BY ts, id_email ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(t):
    out = work_folder(t.spark)
    merged = quotes.thread_state(_feed(t))
    writer = merged.writeStream.outputMode("append").format("parquet").option("path", f"{out}/threads")
    _finish(writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    return t.spark.read.parquet(f"{out}/threads").select("id_email", "qtd_volumes", "destino", "confianca")


#: The feed comes in four batches by time; some requests of the first come with the last, some lack a time, an id or a thread.
_BATCH = """CASE WHEN event_id%97=3 THEN 3 ELSE least(3, CAST(floor(4*(epoch_us(ts)-lo)/(hi-lo+1)) AS INT)) END"""
define("st_feed", f"""SELECT event_id, user_id, ts, {_BATCH} batch, event_id%89=5 no_time, event_id%83=7 no_id, event_id%79=9 no_thread
FROM events, (SELECT epoch_us(min(ts)) lo, epoch_us(max(ts)) hi FROM events)""")


def _batched_requests(t):
    """Requests with their batch, faults included."""
    use_utc(t.spark)
    events = t.table("events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.select(F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    quarter = F.least(F.lit(3), F.floor(4 * (micros - lo) / (hi - lo + 1)).cast("int"))
    batch = events.select(F.col("event_id").alias("_e"), F.when(F.col("event_id") % 97 == 3, 3).otherwise(quarter).alias("batch"))
    rows = inputs.derive_requests(events).join(batch, F.col("id_email") == F.col("_e"))
    e = F.col("_e")
    return rows.withColumns(
        {
            "ts": F.when(e % 89 != 5, F.col("ts")), "id_email": F.when(e % 83 != 7, F.col("id_email")),
            "thread_id": F.when(e % 79 != 9, F.col("thread_id")),
        }
    ).drop("_e")


def _run_batches(t, loaders, state):
    """Write the feed batch by batch and run the stream to its end after each; where decisions and rejects lie."""
    out, requests = work_folder(t.spark), _batched_requests(t)
    for i, loader in enumerate(loaders):
        requests.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(f"{out}/feed")
        feed = state(quotes.read_requests(t.spark, f"{out}/feed"))
        _finish(quotes.start_quote_stream(feed, loader, out, f"{out}/checkpoint", DAY))
    return out


@query("streamed_thread_decisions", """
WITH mark AS (SELECT max(ts)-INTERVAL 7 DAY edge FROM st_feed WHERE batch<3 AND NOT (no_time OR no_id OR no_thread))
SELECT CASE WHEN no_id THEN NULL ELSE event_id END id_email, CASE WHEN no_id THEN 'no id' WHEN no_thread THEN 'no thread' WHEN no_time THEN 'no time'
 WHEN batch=3 AND date_trunc('millisecond',ts)<date_trunc('millisecond',edge) THEN 'late' END reject_reason FROM st_feed, mark""")
def _(t):
    """The whole request path over four batches: thread state, decisions, rejects; every id once."""
    loader = lambda: inputs.derive_tariffs(t.spark, t.folder)
    out = _run_batches(t, [loader] * 4, quotes.thread_state)
    decided = t.spark.read.parquet(f"{out}/decisions").select("id_email", F.lit(None).cast("string").alias("reject_reason"))
    return decided.unionByName(t.spark.read.parquet(f"{out}/rejects").select("id_email", "reject_reason"))


@query("streamed_tariff_changes", CHANGES_SQL)
def _(t):
    """What the second of two batches found changed in the tariffs."""
    first = lambda: inputs.derive_tariffs(t.spark, t.folder)
    out = _run_batches(t, [first, lambda: next_version(first())], quotes.dedupe_stream)
    return t.spark.read.parquet(f"{out}/tariffs/changes").drop("batch")


_SOURCES = ["orders", "items", "payments", "reviews", "customers", "sellers", "products", "geo", "translation"]
_OUTPUTS = {"deliveries": "cu_core", "city_map": "ci_map", "zip_centroids": "ge_mean"}


def _text(value):
    return "'" + value.replace("'", "''") + "'"


_FIXED = [("version", "version", "v1"), *[("param", k, json.dumps(v, ensure_ascii=False)) for k, v in vars(CurationConfig()).items()]]
_FIXED += [("rule", str(i + 1), r) for i, r in enumerate(versions.RULES)]
_MANIFEST = [
    f"SELECT '{kind}' kind, '{name}' name, count(*) \"rows\", true hashed, NULL AS \"value\" FROM {table}"
    for kind, tables in (("source", {s: f"fx_{s}" for s in _SOURCES}), ("output", _OUTPUTS)) for name, table in tables.items()
]
_MANIFEST += [f"SELECT {_text(k)}, {_text(n)}, NULL, false, {_text(v)}" for k, n, v in _FIXED]
_MANIFEST += ["SELECT 'window', 'purchase', NULL, false, CAST(CAST(max(purchase_ts) AS DATE) AS VARCHAR) FROM fx_orders"]


@query("manifest", " UNION ALL ".join(_MANIFEST))
def _(t):
    star, geo = t.star, centroids.zip_centroids(t.star.geo)
    outputs = {"deliveries": curation.star_core(star), "city_map": cities.city_map(cities.city_pairs(star)), "zip_centroids": geo}
    made = versions.build_manifest("v1", {s: getattr(star, s) for s in _SOURCES}, outputs, dict(vars(CurationConfig())), star.orders)
    report = versions.provenance_report(made)
    return report.select("kind", "name", "rows", (F.length("hash") == 12).alias("hashed"), "value").fillna({"hashed": False})


@query("incremental_hash", """SELECT count(*) "rows", CAST(sum(h) AS VARCHAR) hash_sum, bit_xor(h) hash_xor, 1 changed_files FROM (
SELECT CAST('0x'||substr(sha256('='||o_orderkey||'|='||o_custkey),1,15) AS BIGINT) h FROM orders)""")
def _(t):
    """Orders in eight files; one is written again, and only that one is read again."""
    out = f"{work_folder(t.spark)}/orders"
    orders = t.table("orders").select("o_orderkey", "o_custkey")
    for k in range(8):
        orders.filter(F.pmod("o_orderkey", F.lit(8)) == k).coalesce(1).write.parquet(f"{out}/part={k}")
    first, _ = written(versions.file_hashes(t.spark, f"{out}/part=*"))
    orders.filter(F.pmod("o_orderkey", F.lit(8)) == 3).coalesce(1).write.mode("overwrite").parquet(f"{out}/part=3")
    again, _ = written(versions.file_hashes(t.spark, f"{out}/part=*", first))
    new = again.join(first, ["file_path", "file_size", "file_modification_time"], "left_anti").select(F.count("*")).scalar()
    return versions.hash_of_files(again).withColumn("changed_files", new.cast("int"))


_NAMES = {**curation.CONTRACT, **curation.FLAG_CONTRACT, "qa_flags_total": "qa_flags_total", "qa_quarantine": "qa_quarentena"}
_TIMES = [c for c in _NAMES.values() if c.startswith("dt_")]
_NUMBERS = [_NAMES[c] for c in ("weight_g", "weight_g_original", "goods_value", "freight_value", "paid_value", "lead_days", "days_vs_promise")]


def _shown(name, theirs):
    if theirs in _TIMES:
        return f"strftime({name},'%Y-%m-%d %H:%M:%S') {theirs}"
    return f"round(CAST({name} AS DOUBLE),2) {theirs}" if theirs in _NUMBERS else f"{name} {theirs}"


_CONTRACT_SQL = f"SELECT {', '.join(_shown(ours, theirs) for ours, theirs in _NAMES.items())} FROM cu_full"


def _comparable(df):
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in _TIMES}
    return df.withColumns(times | {c: F.round(F.col(c).cast("double"), 2) for c in _NUMBERS})


@query("curated_contract", _CONTRACT_SQL)
def _(t):
    """All published columns of a version, written and read back."""
    out = work_folder(t.spark)
    use_utc(t.spark)
    versions.write_version({"entregas_curado": curation.select_contract(t.curated)}, out, "v1")
    return _comparable(versions.read_curated(t.spark, out, "v1"))


@query("curated_from_text", _CONTRACT_SQL)
def _(t):
    """The same by way of the semicolon-separated form."""
    out = work_folder(t.spark)
    use_utc(t.spark)
    published = curation.select_contract(t.curated).write.option("header", True).option("sep", ";")
    published.csv(f"{out}/v1/entregas_curado.csv")
    # Text has no types for keys; here they are numbers.
    keys = {c: F.col(c).cast("long") for c in ("order_id", "customer_id", "product_id", "seller_id")}
    return _comparable(versions.read_curated(t.spark, out, "v1", fmt="csv")).withColumns(keys)


@query("shipments_written", 'SELECT strftime(purchase_ts,\'%Y-%m\') year_month, count(*) n FROM sh_price GROUP BY 1')
def _(t):
    from haulmark.operators.deliveries import build_shipments

    out = work_folder(t.spark)
    versions.write_shipments(build_shipments(t.star), out)
    return t.spark.read.parquet(out).groupBy(F.col("year_month").cast("string").alias("year_month")).agg(F.count("*").alias("n"))
