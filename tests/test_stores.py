"""Hashes by file, the metric store, and rules of a tree."""

from pyspark.sql import functions as F

from haulmark.functions.hashing import table_hash
from haulmark.operators import delay
from haulmark.session import work_folder, written
from haulmark.sources import versions


def test_hashes_of_files_add_up_and_only_changed_files_are_read(spark):
    out = work_folder(spark)
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 7 != 0, F.concat(F.lit("x"), "id")))
    df.repartition(5).write.parquet(out)
    first, _ = written(versions.file_hashes(spark, out))
    assert first.count() == 5
    assert versions.hash_of_files(first).first() == table_hash(df).first()
    assert versions.file_hashes(spark, out, first).count() == 5
    df.limit(10).coalesce(1).write.mode("append").parquet(out)
    later, _ = written(versions.file_hashes(spark, out, first))
    assert later.count() == 6
    assert versions.hash_of_files(later).first() == table_hash(spark.read.parquet(out)).first()


def test_metric_store_replaces_a_section(spark):
    store = versions.MetricStore(spark, work_folder(spark))
    report = spark.createDataFrame([("a", 1, 2.0), (None, 3, None)], "k string, n int, x double")
    store.record("r1", "one", report, ["k"])
    store.record("r1", "one", report, ["k"])
    store.record("r2", "one", report, ["k"])
    rows = sorted((r.section, r.key, r.metric, r.value) for r in store.read("r1").fillna(-1.0).collect())
    assert rows == [("one", "", "n", 3.0), ("one", "", "x", -1.0), ("one", "a", "n", 1.0), ("one", "a", "x", 2.0)]


def test_rules_of_a_tree_count_what_its_leaves_hold(spark):
    k = F.col("id")
    df = spark.range(3000).select(
        k.alias("order_id"), *[(F.when(k % (11 + i) != 0, (k * (37 + i)) % 101).cast("double")).alias(c) for i, c in enumerate(delay.NUMERIC)],
        (((k * 37) % 101 > 60) | (k % 13 == 0)).cast("int").alias("y"),
    )
    model = delay.small_tree(df)
    rules = delay.tree_rules(model, df).collect()
    assert sum(r.n for r in rules) == 3000 and all(r.conditions for r in rules)
    scored = delay.score(model, df, "p", delay.NUMERIC, [])
    leaves = sorted((r.n, r.late, r.p) for r in scored.groupBy(F.round("p", 9).alias("p")).agg(F.count("*").alias("n"), F.sum("y").alias("late")).collect())
    by_rate: dict = {}
    for r in rules:
        key = round(r.late / r.n, 9)
        n, late = by_rate.get(key, (0, 0))
        by_rate[key] = (n + r.n, late + r.late)
    assert sorted((n, late, rate) for rate, (n, late) in by_rate.items()) == leaves
