"""How often wide rows are moved, and that crowded orders come out as the others do."""

import re

import pytest
from pyspark.sql import functions as F

from haulmark.operators import curation, deliveries, quality
from haulmark.plans import load_all
from haulmark.plans.registry import ON_INPUTS, Inputs
from haulmark.sources.star import AdaptedStar


@pytest.fixture(scope="module")
def star(spark, folder):
    return AdaptedStar(spark, folder)


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_curated_rows_are_not_shuffled_for_small_tables(star):
    assert exchanges(curation.curate_star(star)) == 0


def test_lines_are_shuffled_once(star):
    whole = star.items.repartition("order_id")
    assert exchanges(deliveries._rolled(whole)) == 1
    # Beside the count per share: once for the whole orders, twice for crowded ones.
    assert exchanges(deliveries.item_rollup(star.items)) <= 5


def test_crowded_orders_roll_up_alike(star, spark, monkeypatch):
    made = [(1, i % 7, i % 3, i % 2 or None, None if i % 5 == 0 else f"2024-01-{1 + i % 28:02d}", float(i % 4), 1.5) for i in range(60)]
    made += [(k, None, None, k % 9, None, 2.0, None) for k in range(2, 30)]
    odd = spark.createDataFrame(made, "order_id long, order_item_id int, product_id long, seller_id long, t string, price double, freight_value double")
    odd = odd.withColumn("shipping_limit_ts", F.to_timestamp("t")).drop("t")
    for items in (star.items, odd):
        plain = sorted(map(str, deliveries.item_rollup(items).collect()))
        monkeypatch.setattr(deliveries, "CROWDED_LINES", 4)
        split = sorted(map(str, deliveries.item_rollup(items).select(F.expr("*")).collect()))
        monkeypatch.undo()
        assert plain == split and len(plain) == items.select("order_id").distinct().count()
    first = {r.order_id: r for r in deliveries.item_rollup(odd).collect()}[1]
    assert first.near_duplicate and first.n_items == 60 and first.goods_value == sum(float(i % 4) for i in range(60))


def test_scorecard_builds_its_deliveries_once(spark, folder, monkeypatch):
    load_all()
    from haulmark.plans import registry

    built = []
    monkeypatch.setattr(registry, "build_deliveries", lambda star: built.append(1) or deliveries.build_deliveries(star))
    ON_INPUTS["quality_scorecard"](Inputs(spark, folder))
    assert len(built) == 1


def test_line_counts_share_a_shuffle(star):
    report = quality.uniqueness_report(star)
    got = {(r.section, r.metric): r.value for r in report.collect()}
    near = deliveries.near_duplicates(star.items)
    assert got["near_duplicates", "rows"] == (near.agg(F.sum("copies")).first()[0] or 0)
    assert got["items", "exact_duplicates"] == star.items.count() - star.items.distinct().count()
