"""Routes of requests: places are compared per way of writing them, and requests only look them up."""

import re

from pyspark.sql import functions as F

from haulmark.operators import routing, tariffs
from haulmark.plans.quoting_queries import DAY
from haulmark.session import free, written
from haulmark.sources import quoting_inputs as inputs


def asked_and_audited(spark, folder):
    table = written(inputs.derive_tariffs(spark, folder))[0]
    asked = inputs.derive_requests(spark.read.parquet(f"{folder}/events.parquet"))
    # Places that are null, empty, blank, padded or accented are asked for too.
    odd = {"origem": ("", "  ", " húb  3 ", None), "modal": (" aereo ", "", None, "RODOVIARIO")}
    for c, values in odd.items():
        for i, v in enumerate(values):
            asked = asked.withColumn(c, F.when(F.col("id_email") % 50 == i + 1, F.lit(v)).otherwise(F.col(c)))
    return asked, written(tariffs.apply_quarantine(table, tariffs.audit_tariffs(table)))[0]


def test_requests_are_neither_shuffled_nor_normalised_again(spark, folder):
    asked, audited = asked_and_audited(spark, folder)
    plan = routing.route_requests(asked, audited, DAY)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning", plan)
    assert "translate(" not in plan and "regexp_replace(" not in plan


def test_status_is_that_of_the_normalised_route(spark, folder):
    asked, audited = asked_and_audited(spark, folder)
    paths = []
    got = routing.with_route_status(asked, audited, DAY, paths)
    keys = ["origin_norm", "dest_norm", "mode_norm"]
    assert got.columns == [*keys, *asked.columns, "tariff", "quarantine_reason", "registered"]
    keyed = routing.with_request_route(asked)
    assert got.select("id_email", *keys).exceptAll(keyed.select("id_email", *keys)).count() == 0
    known = routing.route_registered(keyed, audited).select("id_email")
    assert sorted(got.filter("registered").select("id_email").collect()) == sorted(known.collect())
    best = routing.pick_tariff(keyed, audited.withColumn("block_reason", F.lit(None)), DAY)
    want = keyed.join(best, keys).select("id_email", "tariff.line_no").collect()
    assert sorted(got.filter("tariff IS NOT NULL").select("id_email", "tariff.line_no").collect()) == sorted(want)
    assert got.count() == asked.count() and want and len(paths) == 2
    free(spark, paths)
