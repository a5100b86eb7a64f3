"""The request stream: late, repeated and bad records, replays, tariff versions and freed files."""

import datetime as dt
import os

from pyspark.sql import functions as F

from haulmark.session import work_folder
from haulmark.sources import quoting_inputs
from haulmark.streaming import quotes

T0 = dt.datetime(2024, 3, 1)


def request(i, thread, days, **more):
    row = dict.fromkeys(["destino", "qtd_volumes", "valor_nf", "peso_kg", "volumes", "m3_informado", "modal"])
    row |= {"id_email": i, "thread_id": thread, "ts": None if days is None else T0 + dt.timedelta(days=days), "remetente": "a@b.com"}
    row |= {"e_cotacao": True, "confianca": 0.9, "origem": "Hub 1"} | more
    return row


def add_batch(spark, src, rows):
    spark.createDataFrame(rows, quotes.REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(src)


def run(spark, src, out, loader, state):
    feed = state(quotes.read_requests(spark, src, files_per_batch=1))
    quotes.start_quote_stream(feed, loader, out, f"{out}/checkpoint", "2024-07-01").awaitTermination()


def test_every_id_ends_once_in_decisions_or_rejects(spark, folder):
    src, out = work_folder(spark), work_folder(spark)
    tariffs = quoting_inputs.derive_tariffs(spark, folder).filter("line_no < 60")
    batches = [
        [request(1, 1, 0, qtd_volumes=4), request(2, 1, 1, peso_kg=10.0), request(3, 2, 0)],
        [request(4, 2, 60), request(5, None, 60), request(6, 3, None)],
        [request(7, 1, 62), request(None, 1, 62)],
        # Behind the watermark: a new id, and one that was decided long ago; and a repeat that is not late.
        [request(8, 9, 2), request(1, 1, 0), request(7, 1, 62), request(9, 2, 63)],
    ]
    for rows in batches:
        add_batch(spark, src, rows)
        run(spark, src, out, lambda: tariffs, quotes.thread_state)
    decided = {r.id_email for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert spark.read.parquet(f"{out}/decisions").count() == len(decided)
    rejects = [(r.id_email, r.reject_reason) for r in spark.read.parquet(f"{out}/rejects").collect()]
    assert decided == {1, 2, 3, 4, 7, 9}
    assert sorted(rejects, key=str) == sorted([(5, "no thread"), (6, "no time"), (8, "late"), (None, "no id")], key=str)
    plan = quotes.DecisionLog(spark, out).before(spark.createDataFrame([(9,)], "id_email long"), 99)._jdf.queryExecution().executedPlan().toString()
    assert "2024-05-03" in plan and "2024-03-01" not in plan


def test_threads_remember_and_forget(spark):
    src, out = work_folder(spark), work_folder(spark)

    def step(rows):
        add_batch(spark, src, rows)
        merged = quotes.thread_state(quotes.read_requests(spark, src, files_per_batch=1))
        writer = merged.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows")
        writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    step([request(1, 1, 0, qtd_volumes=4, destino="A"), request(2, 2, 0, qtd_volumes=9)])
    step([request(3, 1, 3, destino="B")])
    step([request(4, 1, 5), request(5, 3, 100)])
    step([request(6, 2, 101), request(7, 1, 101)])
    got = {r.id_email: (r.qtd_volumes, r.destino) for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got[3] == (4, "B") and got[4] == (4, "B")
    # Silent for more than thirty days of event time.
    assert got[6] == (None, None) and got[7] == (None, None)


def test_dedupe_keeps_late_records(spark):
    src, out = work_folder(spark), work_folder(spark)
    for rows in ([request(1, 1, 0)], [request(2, 1, 60)], [request(3, 1, 61)], [request(4, 1, 1), request(3, 1, 61), request(5, 1, None)]):
        add_batch(spark, src, rows)
        made = quotes.dedupe_stream(quotes.read_requests(spark, src, files_per_batch=1))
        writer = made.select("id_email", "reject_reason").writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows")
        writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.id_email, r.reject_reason or "") for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [(1, ""), (2, ""), (3, ""), (4, "late"), (5, "no time")]


def test_tariff_versions_are_stored_once_diffed_and_freed(spark, folder):
    src, out = work_folder(spark), work_folder(spark)
    base = quoting_inputs.derive_tariffs(spark, folder).filter("line_no < 60")
    dearer = base.withColumn("frete_minimo", F.col("frete_minimo") + 1)
    dearest = base.withColumn("frete_minimo", F.col("frete_minimo") + 2)
    for i, table in enumerate([base, base, dearer, dearest]):
        add_batch(spark, src, [request(10 + i, i, i)])
        run(spark, src, out, lambda table=table: table, quotes.dedupe_stream)
    store = quotes.TariffStore(spark, f"{out}/tariffs")
    history = [r.content for r in store.history().orderBy("batch").collect()]
    assert len(history) == 4 and history[0] == history[1] and len(set(history)) == 3
    changes = spark.read.parquet(f"{out}/tariffs/changes")
    assert {r.batch for r in changes.select("batch").distinct().collect()} == {2, 3}
    assert {(r.kind, r.field) for r in changes.collect()} == {("alterada", "frete_minimo")}
    kept = os.listdir(f"{out}/tariffs/snapshots".replace("file:", ""))
    assert sorted(kept) == sorted(f"content={c}" for c in set(history[2:]))
