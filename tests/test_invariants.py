"""What must hold whatever the data."""

import pytest
from pyspark.sql import functions as F

from haulmark.operators import curation, deliveries
from haulmark.operators.audit_log import outcome_counts
from haulmark.session import work_folder
from haulmark.sources import audit_store, quoting_inputs, versions
from haulmark.sources.star import AdaptedStar, check_sources, read_star, write_star
from haulmark.streaming import quotes


@pytest.fixture(scope="module")
def star(spark, folder):
    return AdaptedStar(spark, folder)


@pytest.fixture(scope="module")
def curated(star):
    return curation.curate_star(star).cache()


def test_no_row_is_lost(star, curated):
    assert curated.count() == star.orders.count() == curated.select("order_id").distinct().count()


def test_flags_add_up(curated):
    row = curated.agg(
        F.sum("qa_flags_total").alias("total"), sum(F.sum(F.col(f).cast("int")) for f in curation.FLAGS).alias("each")
    ).first()
    assert row.total == row.each and len(curation.FLAGS) == 21


def test_quarantine_is_an_extract(curated):
    extract = curation.quarantine_extract(curated)
    assert 0 < extract.count() < curated.count()
    assert extract.filter("quarantine_reason = ''").count() == 0


def test_contract_has_its_columns(curated):
    assert len(curation.select_contract(curated).columns) == 56


def test_star_round_trip(spark, star):
    out = work_folder(spark)
    write_star(star, out)
    back = read_star(spark, out, "parquet")
    # The file form keys are text; the rows and the money stay.
    assert back.items.count() == star.items.count()
    a, b = (t.agg(F.round(F.sum("freight_value"), 2)).first()[0] for t in (back.items, star.items))
    assert a == b
    deliveries.build_deliveries(back).limit(1).collect()


def test_missing_file_fails_first(spark):
    with pytest.raises(FileNotFoundError, match="olist_orders_dataset"):
        check_sources(spark, "/tmp", ["olist_orders_dataset"])


def test_versions_are_not_overwritten(spark, curated):
    out = work_folder(spark)
    table = {"entregas": curated.select("order_id", "active")}
    versions.write_version(table, out, "v1")
    with pytest.raises(Exception, match="exist"):
        versions.write_version(table, out, "v1")


def test_log_reads_files_of_before_a_column(spark):
    out = work_folder(spark)
    spark.createDataFrame([("a", "erro")], "id_email string, desfecho string").write.parquet(f"{out}/processados")
    audit_store.append(spark.createDataFrame([("b", "x")], "id_email string, label string"), out, "processados")
    rows = {r.id_email: r for r in audit_store.read(spark, out, "processados").collect()}
    assert rows["a"].label is None and rows["b"].label == "x"


def test_outcomes_are_zero_filled(spark, folder):
    log = quoting_inputs.derive_log(spark.read.parquet(f"{folder}/events.parquet"))
    assert {r.n for r in outcome_counts(log, "1999-01-01").collect()} == {0}


def test_rejects_keep_their_reason(spark):
    df = spark.createDataFrame([(1, 1, None), (None, 1, None)], "id_email long, thread_id long, ts timestamp")
    good, bad = quotes.split_rejects(df)
    assert good.count() == 0 and {r.reject_reason for r in bad.collect()} == {"no id", "no time"}


def test_replayed_feed_changes_nothing(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").filter("event_id < 60")
    src, out = work_folder(spark), work_folder(spark)
    requests = quoting_inputs.derive_requests(events)
    requests.coalesce(1).write.parquet(src)
    loader = lambda: quoting_inputs.derive_tariffs(spark, folder)

    def run(checkpoint):
        feed = quotes.dedupe_stream(quotes.read_requests(spark, src))
        quotes.start_quote_stream(feed, loader, out, checkpoint, "2024-07-01").awaitTermination()
        return spark.read.parquet(f"{out}/decisions").count()

    first = run(f"{out}/c1")
    requests.coalesce(1).write.mode("append").parquet(src)
    assert first == 60 and run(f"{out}/c1") == 60
