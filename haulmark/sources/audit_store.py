"""Append-only audit tables: schemas, writing, and reading older files with fewer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROCESSED = (
    "id_email string, thread_id string, remetente string, assunto string, desfecho string, origem string, "
    "destino string, id_rota string, qtd_volumes int, valor_nf double, peso_kg double, valor_frete double, "
    "extracao_json string, erro string, criado_em timestamp, label string, tarifa_json string, quote_id string"
)
TABLE_VERSIONS = (
    "hash string, sheet string, rows long, tariffs long, blocks long, fingerprint_json string, loaded_at timestamp"
)
MODEL_QUOTES = (
    "quote_id string, id_email string, thread_id string, payload_json string, p25 double, p50 double, p75 double, "
    "recommended double, distance_km double, structural_outlier boolean, structural_score double, model_version string, "
    "status string, contracted_price double, actual_cost double, notes string, created_at timestamp, "
    "accepted_at timestamp, rejected_at timestamp"
)
QUOTE_EVENTS = "event_id long, quote_id string, event_type string, price double, cost double, details_json string, at timestamp"

SCHEMAS = {
    "processados": PROCESSED,
    "versoes_tabela": TABLE_VERSIONS,
    "cotacoes_modelo": MODEL_QUOTES,
    "eventos_cotacao": QUOTE_EVENTS,
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of the schema in its order; absent ones become null."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def append(df: DataFrame, folder: str, table: str) -> None:
    conform(df, SCHEMAS[table]).write.mode("append").parquet(f"{folder}/{table}")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All files of a log; files written before a column existed give null for it."""
    return conform(spark.read.option("mergeSchema", True).parquet(f"{folder}/{table}"), SCHEMAS[table])
