"""Tariffs, requests and logs derived by formula from the TPC-H-like tables.

Tariffs follow the supplier and customer pairs of the order lines and requests follow the
events, so both grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.requests import VOLUME
from haulmark.session import use_utc


#: Added to the line number of the second row of a route; beyond any first one.
SECOND_LINE = 1 << 40


def derive_tariffs(spark: SparkSession, folder: str) -> DataFrame:
    """One tariff per supplier and customer class seen in the lines, with faults every 50 lines."""
    use_utc(spark)

    def table(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    lines = table("lineitem").select("l_orderkey", "l_suppkey")
    orders = table("orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("b"))
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s"), "b").distinct()
    pairs = pairs.join(table("supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("a")), "s")
    n = F.col("s") * 25 + F.col("b")
    base = pairs.withColumn("n", n)
    # Every fiftieth line is followed by a second row for the same route and mode.
    copies = F.when(F.col("n") % 50 == 7, F.array(F.lit(0).cast("long"), F.lit(SECOND_LINE).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    base = base.withColumn("extra", F.explode(copies))
    n, fault, s, b = F.col("n"), F.col("n") % 50, F.col("s"), F.col("b")

    def letters(k):
        return F.concat(F.lit("N"), F.char(65 + k))

    price = F.when(fault == 2, 0.0).otherwise((10 + (s * 7 + b * 3) % 40).cast("double"))
    gris = 0.1 + (n % 9) / 10
    return base.select(
        (n + F.col("extra")).cast("long").alias("line_no"),
        F.when(fault == 11, None).when(fault == 6, F.concat(F.lit("R"), n - 1)).otherwise(F.concat(F.lit("R"), n)).alias("id_rota"),
        F.concat(F.lit("HUB "), s).alias("cidade_origem"),
        F.when(fault == 5, "XXX").otherwise(letters(F.col("a"))).alias("uf_origem"),
        F.concat(F.lit("CITY "), b).alias("cidade_destino"),
        letters(b).alias("uf_destino"),
        price.alias("valor_por_volume"),
        (50 + n % 60).cast("double").alias("frete_minimo"),
        F.when(fault == 10, 90.0).otherwise((n % 9).cast("double")).alias("pedagio_por_volume"),
        F.when(fault == 1, gris * 100).otherwise(gris).alias("gris_percentual"),
        F.lit(0.2003).alias("advalorem_percentual"),
        F.when(n % 3 == 0, 15.0).otherwise(0.0).alias("taxa_entrega_dificil"),
        F.when(n % 13 != 0, (30 + n % 50).cast("double")).alias("peso_maximo_volume_kg"),
        F.when(fault == 9, 60).otherwise((1 + n % 10).cast("int")).alias("prazo_dias"),
        F.when(fault == 4, "FLUVIAL").when(n % 11 == 0, "AEREO").otherwise("RODOVIARIO").alias("modal"),
        (50 + n % 3000).cast("double").alias("distancia_km"),
        F.when(F.col("extra") > 0, F.lit("2024-06-01")).otherwise("2024-01-01").cast("date").alias("vigencia_inicio"),
        F.when(fault == 3, "2023-06-01").when((n % 4 != 0) & (F.col("extra") == 0), "2024-12-31").cast("date").alias("vigencia_fim"),
        F.when(fault == 8, "INATIVO").otherwise("ATIVO").alias("status"),
        F.when(fault == 9, "ana").alias("revisado_por"),
        F.when(fault == 9, "2024-01-05").cast("date").alias("revisado_em"),
        F.lit(None).cast("string").alias("regiao_origem"),
        F.lit(None).cast("string").alias("regiao_destino"),
        F.lit(None).cast("string").alias("tipo_localidade_destino"),
    )


def derive_sheet(tariffs: DataFrame) -> DataFrame:
    """The tariffs as a typed sheet would show them: other headers, Brazilian numbers, gaps."""
    n = F.col("line_no")

    def ptbr(c):
        return F.concat(F.lit("R$ "), F.translate(F.format_number(F.col(c), 2), ",.", ".,"))

    return tariffs.select(
        "line_no",
        F.col("id_rota").alias("ID ROTA"),
        F.when(n % 17 == 0, "  ").otherwise(F.lower("cidade_origem")).alias("Cidade Origem"),
        F.lower("uf_origem").alias("UF_ORIGEM"),
        F.col("cidade_destino").alias("CIDADE_DESTINO"),
        F.col("uf_destino").alias("UF Destino"),
        F.when(n % 19 == 0, "a combinar").otherwise(ptbr("valor_por_volume")).alias("Valor por Volume"),
        ptbr("frete_minimo").alias("FRETE_MINIMO"),
        F.col("prazo_dias").cast("string").alias("Prazo"),
        F.when(n % 2 == 0, F.date_format("vigencia_inicio", "dd/MM/yyyy"))
        .otherwise(F.date_format("vigencia_inicio", "yyyy-MM-dd"))
        .alias("Vigência Início"),
        F.when(n % 5 == 0, "sem data").otherwise(F.date_format("vigencia_fim", "dd-MM-yyyy")).alias("Vigência Fim"),
    )


def derive_requests(events: DataFrame) -> DataFrame:
    """One already-extracted quote request per event, with every kind of gap."""
    k = F.col("event_id")
    hub, city = (k * 7) % 120, k % 25
    volume = F.struct(
        (1 + k % 3).cast("int").alias("quantidade"),
        F.lit(60.0).alias("comprimento_cm"),
        F.lit(40.0).alias("largura_cm"),
        F.when(k % 4 == 0, F.lit(None).cast("double")).otherwise(40.0).alias("altura_cm"),
    )
    dest = (
        F.when(k % 19 == 0, None)
        .when(k % 3 == 0, F.concat(F.lit("city "), city))
        .when(k % 3 == 1, F.concat(F.lit("City "), city, F.lit(" - n"), F.char(97 + city)))
        .otherwise(F.concat(F.lit("CITY "), city, F.lit(" N"), F.char(65 + city)))
    )
    return events.select(
        k.alias("id_email"),
        F.col("user_id").alias("thread_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(k % 41 == 0, None).when(k % 37 == 0, "noreply@loja.com")
        .otherwise(F.concat(F.lit("user"), F.col("user_id"), F.lit("@cliente.com"))).alias("remetente"),
        (F.col("event_type") != "error").alias("e_cotacao"),
        F.when(k % 43 != 0, (k % 101) / 100.0).alias("confianca"),
        F.when(k % 31 != 0, F.concat(F.lit("Hub "), hub)).alias("origem"),
        dest.alias("destino"),
        F.when(k % 7 != 0, (1 + k % 12).cast("int")).alias("qtd_volumes"),
        F.when(k % 23 != 0, F.col("value") * 10).alias("valor_nf"),
        F.when(k % 29 != 0, (5 + k % 400).cast("double")).alias("peso_kg"),
        F.when(k % 2 == 0, F.array(volume)).otherwise(F.array().cast(f"array<{VOLUME}>")).alias("volumes"),
        F.when(k % 5 == 0, 0.5).alias("m3_informado"),
        F.when(k % 10 == 0, "AEREO").alias("modal"),
    )


# Outcome labels and mailbox labels.
OUTCOMES = ["cotado", "erro", "incompleto", "sem_rota", "ignorado"]
LABELS = {"cotado": "IA/Processado", "ignorado": "IA/Processado", "erro": "IA/Revisar", "incompleto": "IA/Incompleto", "sem_rota": "IA/Sem-Rota"}


def derive_log(events: DataFrame) -> DataFrame:
    """Audit log of processed messages."""
    k, kind = F.col("event_id"), F.col("event_type")
    outcome = (
        F.when(kind == "purchase", "cotado").when(kind == "error", "erro").when(kind == "signup", "sem_rota")
        .when(kind == "view", "incompleto").otherwise("ignorado")
    )
    label = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    extraction = (
        F.when(k % 6 == 0, None)
        .when(k % 6 == 1, "{corrupt")
        .otherwise(F.concat(F.lit('{"e_cotacao": true, '), F.when(k % 60 != 8, F.lit('"confianca": 0.5, ')).otherwise(F.lit("")), F.lit('"qtd_volumes": '), (k % 9), F.lit(', "origem": "HUB 1"}')))
    )
    log = events.select(
        k.alias("id_email"),
        F.col("user_id").alias("thread_id"),
        F.col("ts").cast("timestamp").alias("criado_em"),
        outcome.alias("desfecho"),
        extraction.alias("extracao_json"),
    )
    return log.withColumns(
        {"erro": F.when(F.col("desfecho") == "erro", _error_text()), "label": label[F.col("desfecho")]}
    )


def _error_text():
    k = F.col("id_email")
    return (
        F.when(k % 5 == 0, "trecho A -> B em quarentena pela curadoria: linha 3")
        .when(k % 5 == 1, "Confianca 0.20 abaixo de 0.35")
        .when(k % 5 == 2, "confianca 0.50 abaixo de 0.6 para emitir preco")
        .when(k % 5 == 3, "peso medio de 80.0 kg por volume excede o limite")
        .otherwise("TimeoutError()")
    )
