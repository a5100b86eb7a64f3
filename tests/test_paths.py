"""Request paths that SQL twins do not reach."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from haulmark.functions import geo, numbers, text
from haulmark.operators import deliveries, evaluation, quality, routing, tariffs
from haulmark.plans.quoting_queries import DAY
from haulmark.sources import quoting_inputs as inputs
from haulmark.sources.star import adapt_star
from haulmark.sources.tariffs import load_tariffs


@pytest.fixture(scope="module")
def quoting(spark, folder):
    requests = inputs.derive_requests(spark.read.parquet(f"{folder}/events.parquet"))
    table = inputs.derive_tariffs(spark, folder)
    return requests, tariffs.apply_quarantine(table, tariffs.audit_tariffs(table)).cache()


@pytest.mark.parametrize("absent", [None, float("nan")])
def test_requests_without_confidence_are_never_quoted(quoting, absent):
    requests, audited = quoting
    unsure = requests.withColumn("confianca", F.lit(absent).cast("double"))
    out = routing.route_requests(unsure, audited, DAY).groupBy("outcome").count().collect()
    assert {r.outcome for r in out} == {"erro", "ignorado"}


def test_stream_decides_like_the_batch(spark, folder, quoting):
    requests, audited = quoting
    whole = requests.withColumn("ts", F.when(F.col("id_email") != 5, F.col("ts"))).filter("ts IS NOT NULL AND thread_id IS NOT NULL")
    batch = routing.route_requests(routing.merge_thread(whole), audited, DAY).select("id_email", "outcome", "quoted_total")
    stream = entry.queries()["streamed_thread_decisions"](spark, folder)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_quarantine_reasons_stay_whole(quoting):
    requests, audited = quoting
    each = {s for r in audited.filter("quarantined").collect() for s in r.block_reasons}
    assert any("; " in s for s in each)
    got = routing.with_route_status(requests, audited, DAY).filter("quarantine_reason IS NOT NULL").select("quarantine_reason").distinct().collect()
    assert got
    for r in got:
        left = r.quarantine_reason
        for s in sorted(each, key=len, reverse=True):
            left = left.replace(s, "")
        assert set(left) <= {";", " "}


def test_html_text(spark):
    html = "<p>&nbsp;Ol&#225; &#x1F600; &amp; &#bad;</p><!-- x --><script>a</script>two<br/>three&#160;"
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(text.html_to_text("h")).collect()] == ["Olá 😀 & &#bad;\n two\nthree", None, ""]


def test_references_cut_off_stay_where_only_finished_ones_count(spark):
    html = "<h1>a&amp</h1>b&amp;c &#225; &#225 &notit; &lt"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(text.html_to_text("h", finished_only=True)).first()[0] == "a&amp\nb&c á &#225 &notit; &lt"
    assert df.select(text.html_to_text("h")).first()[0] == "a&\nb&c á á ¬it; <"


def test_rounding_of_doubles_just_below_a_tie(spark):
    values = [1.255, 1.265, -1.255, 2.5, 0.125, None]  # 1.265 too lies below its tie
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(numbers.round_scaled("v")).collect()]
    assert got == [1.25, 1.26, -1.25, 2.5, 0.13, None]


def test_segment_names_take_turns(spark):
    columns = ["segment", "distance_km", "weight_total_kg", "quantity_mean"]
    rules = [("near", "distance_km", "min"), ("heavy", "weight_total_kg", "max"), ("many", "quantity_mean", "max")]
    rows = [(0, 10.0, 99.0, 1.0), (1, 10.0, 50.0, 2.0), (2, 30.0, 50.0, 9.0), (3, 40.0, 1.0, 1.0)]
    got = {r.segment: r.name for r in evaluation.name_segments(spark.createDataFrame(rows, columns), rules=rules).collect()}
    assert got == {0: "near", 1: "heavy", 2: "many", 3: "grupo_3"}
    few = evaluation.name_segments(spark.createDataFrame(rows[:1], columns), rules=rules).collect()
    assert [tuple(r) for r in few] == [(0, "near")]


def test_odd_terms_are_discarded(spark, folder):
    fields = ["id_rota", "cidade_origem", "uf_origem", "cidade_destino", "uf_destino", "valor_por_volume", "frete_minimo", "pedagio_por_volume",
              "gris_percentual", "advalorem_percentual", "taxa_entrega_dificil", "peso_maximo_volume_kg", "prazo_dias", "modal", "distancia_km",
              "vigencia_inicio", "vigencia_fim", "status", "revisado_por", "revisado_em", "regiao_origem", "regiao_destino", "tipo_localidade_destino"]
    base = {f: None for f in fields} | {"cidade_origem": "a", "cidade_destino": "b", "valor_por_volume": "10"}
    rows = [tuple({**base, "prazo_dias": p}.values()) + (i,) for i, p in (("1", "3"), ("2", "99999999999"), ("x", "3"))]
    kept, gone = load_tariffs(spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields) + ", line_no string"))
    assert [r.line_no for r in kept.collect()] == [1] and gone.count() == 2


def test_ungraded_evidence_stays(spark):
    evidence = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0)], "section string, metric string, value double")
    assert {r.section: r.grade for r in quality.scorecard(evidence, {"a": 7.0}).collect()} == {"a": 7.0, "b": None}


def test_distance_is_finite_exactly_when_no_coordinate_is_missing(spark):
    odd = [None, float("nan"), float("inf"), 0.0, -33.0, 90.0]
    rows = [(a, b, c, 10.0) for a in odd for b in odd for c in odd]
    df = spark.createDataFrame(rows, "origin_lat double, origin_lng double, dest_lat double, dest_lng double")
    far = df.withColumn("distance_km", geo.haversine_km("origin_lat", "origin_lng", "dest_lat", "dest_lng"))
    assert deliveries._located(far).count() == numbers.require(far, ["distance_km"]).count() == 125


def test_small_centroids_do_not_shuffle_shipments_by_prefix(spark, folder):
    plan = deliveries.shipments_before_filters(adapt_star(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seller_zip" not in plan and "hashpartitioning(customer_zip" not in plan
    assert "hashpartitioning(seller_id" not in plan


def test_filters_of_shipments_compute_no_distance(spark, folder):
    plan = deliveries.build_shipments(adapt_star(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "ASIN" in line.upper()]
