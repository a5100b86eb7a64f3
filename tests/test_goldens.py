"""Hand-worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulmark.functions import geo, numbers, requests, text
from haulmark.functions.numbers import cubage
from haulmark.operators import cities, evaluation, routing, tariffs
from haulmark.sources.tariffs import TARIFF_SCHEMA, load_tariffs, map_columns


def _tariff(line=2, **changes):
    base = dict(
        line_no=line, id_rota="R001", cidade_origem="SAO JOSE DOS CAMPOS", uf_origem="SP", cidade_destino="CAMPINAS",
        uf_destino="SP", valor_por_volume=16.65, frete_minimo=55.0, pedagio_por_volume=4.20, gris_percentual=0.30,
        advalorem_percentual=0.25, taxa_entrega_dificil=0.0, peso_maximo_volume_kg=50.0, prazo_dias=1, modal="RODOVIARIO",
        distancia_km=150.0, vigencia_inicio=dt.date(2026, 1, 1), vigencia_fim=dt.date(2026, 12, 31), status="ATIVO",
        revisado_por=None, revisado_em=None, regiao_origem=None, regiao_destino=None, tipo_localidade_destino=None,
    )
    return {**base, **changes}


def _tariffs(spark, *rows):
    names = [part.split()[0] for part in TARIFF_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TARIFF_SCHEMA)


def _found(spark, *rows):
    return {(r.line_no, r.field, r.severity) for r in tariffs.audit_tariffs(_tariffs(spark, *rows)).collect()}


def test_city_spellings_share_one_key(spark):
    spellings = [
        "sao paulo", "são paulo", "sp", "sao paulo - sp", "sao paulo / sao paulo", "são paulo", "sp / sp", "sao paulo sp",
        "sao  paulo",
    ]
    pairs = spark.createDataFrame([(s, "SP", "f") for s in spellings], "city string, state string, field string")
    rows = {r.spelling: r for r in cities.city_map(pairs).collect()}
    assert {r.city_key for r in rows.values()} == {"sao paulo"}
    assert "alias" in rows["sp"].rules and rows["sp"].change == "estrutural"
    assert rows["sao paulo"].change == "formatacao"


def test_typing_errors_are_suggested_not_merged(spark):
    rows = [("São Paulo",)] * 120 + [("Sao Paulop",), ("Sao Pauo",), ("Sãopaulo",), ("Campinas",)]
    pairs = spark.createDataFrame(rows, "city string").withColumns({"state": F.lit("SP"), "field": F.lit("f")})
    found = {r.rare_city: r.edit_distance for r in cities.typo_candidates(cities.city_map(pairs)).collect()}
    assert found == {"Sao Paulop": 1, "Sao Pauo": 1, "Sãopaulo": 1}


@pytest.mark.parametrize(
    ("typed", "place"),
    [
        ("Sao Jose dos Campos - sp", "SAO JOSE DOS CAMPOS/SP"),
        ("SÃO JOSÉ DOS CAMPOS/SP", "SAO JOSE DOS CAMPOS/SP"),
        ("são josé dos campos , SP", "SAO JOSE DOS CAMPOS/SP"),
        ("12245-000", "12245000"),
        (None, ""),
    ],
)
def test_places(spark, typed, place):
    df = spark.createDataFrame([(typed,)], "p string")
    assert df.select(text.normalize_place("p")).first()[0] == place


def test_one_degree_on_the_equator(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert km == pytest.approx(111.195, rel=1e-4)


def test_cubage(spark):
    df = spark.createDataFrame([(12000.0, 96000.0, 50.0, 100.0)], "weight_total_g double, volume_cm3 double, freight_value double, declared_value double")
    row = cubage(df).first()
    assert (row.cubic_weight_kg, row.density) == (16.0, 0.75)


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (None,)], "x double")
    got = [r[0] for r in df.select(numbers.cut("x", [0, 0.3, 1], ["a", "b"])).collect()]
    assert got == [None, "a", "b", None]


def test_clean_tariff_has_no_findings(spark):
    assert _found(spark, _tariff()) == set()


def test_overlap_blocks_both_rows_and_only_them(spark):
    assert _found(spark, _tariff(2), _tariff(3, id_rota="R002")) == {(2, "vigencia", "bloqueio"), (3, "vigencia", "bloqueio")}
    later = _tariff(3, id_rota="R002", vigencia_inicio=dt.date(2027, 1, 1), vigencia_fim=None)
    assert _found(spark, _tariff(2), later) == set()
    assert _found(spark, _tariff(2), _tariff(3, id_rota="R002", status="INATIVO")) == set()


def test_overlap_equals_all_pairs(spark):
    days = [None, dt.date(2026, 1, 1), dt.date(2026, 3, 1), dt.date(2026, 6, 1)]
    rows = [
        _tariff(i, id_rota=f"R{i}", cidade_destino=f"C{i % 3}", vigencia_inicio=days[i % 4], vigencia_fim=days[(i // 4) % 4])
        for i in range(40)
    ]

    def meets(a, b):
        if a["cidade_destino"] != b["cidade_destino"]:
            return False
        if a["vigencia_fim"] and b["vigencia_inicio"] and a["vigencia_fim"] < b["vigencia_inicio"]:
            return False
        return not (b["vigencia_fim"] and a["vigencia_inicio"] and b["vigencia_fim"] < a["vigencia_inicio"])

    want = {a["line_no"] for a in rows for b in rows if a is not b and meets(a, b)}
    assert {r.line_no for r in tariffs.overlapping_validity(_tariffs(spark, *rows)).collect()} == want


def test_sign_off_silences_alerts_only(spark):
    signed = dict(revisado_por="ana", revisado_em=dt.date(2026, 1, 2))
    assert _found(spark, _tariff(prazo_dias=60)) == {(2, "prazo_dias", "alerta")}
    assert _found(spark, _tariff(prazo_dias=60, **signed)) == set()
    assert (2, "gris_percentual", "bloqueio") in _found(spark, _tariff(gris_percentual=55.0, **signed))
    assert _found(spark, _tariff(prazo_dias=60, revisado_por="ana")) == {(2, "prazo_dias", "alerta")}


def test_message_is_written_for_people(spark):
    row = tariffs.range_findings(_tariffs(spark, _tariff(gris_percentual=30.0))).first()
    assert row.message.startswith("30,00% fora da faixa 0,00% a 2,00% - ")


def test_price_change_is_one_row(spark):
    a, b = (tariffs.fingerprint(_tariffs(spark, _tariff(valor_por_volume=v))) for v in (16.65, 18.65))
    rows = tariffs.diff_snapshots(a, b).collect()
    assert [(r.kind, r.field, r.old, r.new) for r in rows] == [("alterada", "valor_por_volume", "16.65", "18.65")]


_REQUEST = (
    "id_email long, thread_id long, ts timestamp, remetente string, e_cotacao boolean, confianca double, origem string, "
    f"destino string, qtd_volumes int, valor_nf double, peso_kg double, volumes array<{requests.VOLUME}>, m3_informado double, modal string"
)


def _request(i=1, **changes):
    base = dict(
        id_email=i, thread_id=1, ts=dt.datetime(2026, 5, 1, 10, i), remetente="a@b.com", e_cotacao=True, confianca=0.9,
        origem="São José dos Campos - SP", destino="Campinas", qtd_volumes=10, valor_nf=8000.0, peso_kg=100.0, volumes=[],
        m3_informado=None, modal=None,
    )
    return tuple({**base, **changes}.values())


def _route(spark, tariff_rows, *request_rows):
    table = _tariffs(spark, *tariff_rows)
    audited = tariffs.apply_quarantine(table, tariffs.audit_tariffs(table))
    return routing.route_requests(spark.createDataFrame(list(request_rows), _REQUEST), audited, "2026-05-01")


def test_worked_price(spark):
    row = _route(spark, [_tariff()], _request()).first()
    assert (row.freight_applied, row.gris_advalorem, row.total, row.lead_days) == (208.5, 44.0, 252.5, 1)
    assert (row.outcome, row.quoted_total) == ("cotado", 252.5)


def test_waterfall_order(spark):
    asked = [
        _request(1, remetente="noreply@x.com"),
        _request(2, e_cotacao=False),
        _request(3, confianca=0.2),
        _request(4, destino="Manaus"),
        _request(5, peso_kg=None),
        _request(6, confianca=0.5),
        _request(7, peso_kg=900.0),
    ]
    rows = {r.id_email: (r.outcome, r.reason or "") for r in _route(spark, [_tariff()], *asked).collect()}
    assert [rows[i][0] for i in range(1, 8)] == ["ignorado", "ignorado", "erro", "sem_rota", "incompleto", "erro", "erro"]
    assert "para emitir preco" in rows[6][1] and rows[7][1].startswith("peso medio de 90.0 kg")
    blocked = _route(spark, [_tariff(gris_percentual=55.0)], _request()).first()
    assert blocked.outcome == "erro" and "quarentena pela curadoria" in blocked.reason
    expired = _route(spark, [_tariff(vigencia_fim=dt.date(2026, 2, 1))], _request()).first()
    assert expired.outcome == "erro" and "sem tarifa vigente" in expired.reason


def test_thread_merge(spark):
    first = _request(1, qtd_volumes=None, valor_nf=None)
    reply = _request(2, origem=None, destino="", qtd_volumes=4, valor_nf=200.0, peso_kg=0.0, confianca=0.4)
    merged = {r.id_email: r for r in routing.merge_thread(spark.createDataFrame([first, reply], _REQUEST)).collect()}
    row = merged[2]
    assert (row.origem, row.destino, row.qtd_volumes, row.valor_nf, row.peso_kg, row.confianca) == (
        "São José dos Campos - SP", "Campinas", 4, 200.0, 100.0, 0.9,
    )


def test_resolver_does_not_guess(spark):
    geo_map = spark.createDataFrame(
        [("01001", -23.5505, -46.6333, "sao paulo", "SP"), ("30110", -19.9167, -43.9345, "belo horizonte", "MG")],
        "zip_prefix string, lat double, lng double, city string, state string",
    )
    asked = spark.createDataFrame([("30110-028",), ("São Paulo/SP",), ("Nowhere/SP",)], "p string").withColumns(
        {"fc": F.lit(""), "fu": F.lit("")}
    )
    rows = {r.p: r for r in routing.resolve_place(asked, geo_map, "p", "fc", "fu", "x").collect()}
    assert rows["30110-028"].x_city == "belo horizonte" and rows["São Paulo/SP"].x_source == "cidade_uf"
    assert rows["Nowhere/SP"].x_source == "unresolved" and rows["Nowhere/SP"].x_lat is None


def test_review_motives(spark):
    texts = ["confianca 0.35 abaixo", "confianca 0.60 abaixo de 0.6 para emitir preco", "em quarentena pela curadoria", "boom", None]
    df = spark.createDataFrame([(t,) for t in texts], "e string")
    assert len({r[0] for r in df.select(requests.classify_reason("e")).collect()}) == 4


def test_sheet_needs_its_columns(spark):
    with pytest.raises(ValueError, match="valor_por_volume"):
        map_columns(spark.createDataFrame([(1, "x")], "line_no int, `Cidade Origem` string"))
    sheet = spark.createDataFrame(
        [(2, "Campinas", "sp", "Santos", "sp", "R$ 1.250,50", "", "03/01/2026"), (3, "", "sp", "Santos", "sp", "1", "", "")],
        "line_no int, `Cidade Origem` string, UF_ORIGEM string, CIDADE_DESTINO string, uf_destino string, "
        "`Valor por Volume` string, FRETE_MINIMO string, `Vigência Início` string",
    )
    loaded, dropped = load_tariffs(map_columns(sheet))
    row = loaded.first()
    assert (row.cidade_origem, row.valor_por_volume, row.frete_minimo, row.modal, row.status) == ("CAMPINAS", 1250.5, 0.0, "RODOVIARIO", "ATIVO")
    assert row.vigencia_inicio == dt.date(2026, 1, 3) and dropped.count() == 1


def test_segment_names(spark):
    rows = [(i, float(d), float(w), float(q), float(p), float(n), float(c)) for i, (d, w, q, p, n, c) in enumerate([
        (10, 1, 1, 5, 1, 1), (500, 30, 1, 5, 1, 2), (500, 1, 4, 5, 1, 1), (500, 1, 1, 60, 1, 1), (500, 1, 1, 5, 9, 1), (500, 1, 1, 5, 1, 50),
    ])]
    profile = spark.createDataFrame(rows, "segment int, distance_km double, weight_total_kg double, quantity_mean double, freight_pct_value double, density double, cubic_weight_kg double")
    names = {r.segment: r.name for r in evaluation.name_segments(profile).collect()}
    assert [names[i] for i in range(6)] == [
        "local_metropolitano", "carga_pesada", "multi_item", "miudo_baixo_valor", "denso_compacto", "volumoso_leve",
    ]
