"""Curation of the delivery table: every rule is a flag and no row is ever dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.config import CurationConfig
from haulmark.functions.base import flag
from haulmark.functions.numbers import SELLER_TIERS, cut
from haulmark.functions.text import simple_form
from haulmark.functions.times import days_between
from haulmark.operators.centroids import zip_centroids
from haulmark.operators.cities import canonical_lookup, city_map, city_pairs
from haulmark.operators.deliveries import build_deliveries
from haulmark.session import written
from haulmark.sources.star import Star

DEFAULT = CurationConfig()

HARD_FLAGS = [
    "qa_delivered_before_carrier",
    "qa_negative_dispatch_lag",
    "qa_invalid_weight",
    "qa_invalid_payment",
    "qa_undefined_channel",
]
FLAGS = [
    "qa_no_item",
    "qa_city_rewritten",
    "qa_branch_state_mismatch",
    "qa_customer_state_mismatch",
    "qa_no_delivery_ts",
    "qa_no_carrier_ts",
    "qa_no_approval_ts",
    "qa_no_weight",
    "qa_delivered_before_carrier",
    "qa_negative_dispatch_lag",
    "qa_invalid_weight",
    "qa_zero_freight",
    "qa_invalid_payment",
    "qa_undefined_channel",
    "qa_zip_no_geo",
    "qa_implausible_lead",
    "qa_implausible_weight",
    "qa_disproportionate_freight",
    "qa_payment_mismatch",
    "qa_near_duplicate",
    "qa_incomplete_tail",
]

# Column names of the published curated table, in its order.
CONTRACT = {
    "order_id": "order_id",
    "order_status": "order_status",
    "active": "ativo",
    "branch": "filial",
    "branch_city": "filial_cidade",
    "branch_zip_state": "filial_uf_cep",
    "seller_id": "seller_id",
    "seller_tier": "origem_registo",
    "customer_id": "customer_id",
    "customer_city_canonical": "cliente_cidade",
    "customer_state": "cliente_uf",
    "customer_zip_state": "cliente_uf_cep",
    "customer_zip": "cliente_cep_prefixo",
    "purchase_ts": "dt_compra",
    "approved_ts": "dt_aprovacao",
    "carrier_ts": "dt_coleta",
    "delivered_ts": "dt_entrega",
    "promised_ts": "dt_prazo",
    "shipping_limit_ts": "dt_limite_expedicao",
    "n_items": "n_itens",
    "product_id": "product_id",
    "weight_g": "peso_g",
    "weight_g_original": "peso_g_original",
    "goods_value": "valor_mercadoria",
    "freight_value": "valor_frete",
    "paid_value": "valor_pago",
    "payment_channel": "canal_pagamento",
    "lead_days": "lead_dias",
    "days_vs_promise": "dias_vs_prazo",
    "measurable": "atraso_mensuravel",
    "late": "atrasado",
    "overdue_no_record": "vencido_sem_registo",
    "honest_late": "atraso_honesto",
}
FLAG_CONTRACT = {
    "qa_undefined_channel": "qa_canal_indefinido",
    "qa_incomplete_tail": "qa_cauda_incompleta",
    "qa_zip_no_geo": "qa_cep_sem_geo",
    "qa_city_rewritten": "qa_cidade_regrafada",
    "qa_delivered_before_carrier": "qa_entrega_antes_coleta",
    "qa_disproportionate_freight": "qa_frete_desproporcional",
    "qa_zero_freight": "qa_frete_zero",
    "qa_negative_dispatch_lag": "qa_lag_despacho_negativo",
    "qa_implausible_lead": "qa_lead_implausivel",
    "qa_payment_mismatch": "qa_pagamento_divergente",
    "qa_invalid_payment": "qa_pagamento_invalido",
    "qa_implausible_weight": "qa_peso_implausivel",
    "qa_invalid_weight": "qa_peso_invalido",
    "qa_near_duplicate": "qa_quase_duplicado",
    "qa_no_approval_ts": "qa_sem_dt_aprovacao",
    "qa_no_carrier_ts": "qa_sem_dt_coleta",
    "qa_no_delivery_ts": "qa_sem_dt_entrega",
    "qa_no_item": "qa_sem_item",
    "qa_no_weight": "qa_sem_peso",
    "qa_customer_state_mismatch": "qa_uf_cliente_incoerente",
    "qa_branch_state_mismatch": "qa_uf_filial_incoerente",
}


def flag_completeness(df: DataFrame) -> DataFrame:
    """What is missing. Runs before an invalid weight is set to null."""
    return df.withColumns(
        {
            "qa_no_item": F.col("seller_id").isNull(),
            "qa_no_delivery_ts": F.col("delivered_ts").isNull(),
            "qa_no_carrier_ts": F.col("carrier_ts").isNull(),
            "qa_no_approval_ts": F.col("approved_ts").isNull(),
            "qa_no_weight": F.col("weight_g").isNull(),
        }
    )


def default_branch(df: DataFrame, sentinel: str = DEFAULT.no_branch) -> DataFrame:
    """An order without a seller gets a branch of its own instead of leaving every GROUP BY."""
    return df.withColumn("branch", F.coalesce("seller_state", F.lit(sentinel)))


def flag_validity(df: DataFrame) -> DataFrame:
    """Outside the possible domain. A weight that is not positive becomes null, the original stays."""
    invalid_weight = flag(F.col("weight_g") <= 0)
    return df.withColumns(
        {
            "qa_delivered_before_carrier": flag(F.col("delivered_ts") < F.col("carrier_ts")),
            "qa_negative_dispatch_lag": flag(F.col("carrier_ts") < F.col("approved_ts")),
            "weight_g_original": F.col("weight_g"),
            "qa_invalid_weight": invalid_weight,
            "weight_g": F.when(~invalid_weight, F.col("weight_g")),
            "qa_zero_freight": flag(F.col("freight_value") == 0),
            "qa_invalid_payment": flag(F.col("paid_value") <= 0),
            "qa_undefined_channel": flag(F.col("payment_channel") == "not_defined"),
        }
    )


def flag_accuracy(df: DataFrame, cfg: CurationConfig = DEFAULT) -> DataFrame:
    """Possible but implausible; marked, never corrected."""
    goods, freight = F.col("goods_value"), F.col("freight_value")
    return df.withColumn("lead_days", F.round(days_between("purchase_ts", "delivered_ts"), 3)).withColumns(
        {
            "qa_implausible_lead": flag(F.col("lead_days") > cfg.lead_max_days),
            "qa_implausible_weight": flag(F.col("weight_g") > cfg.weight_max_g),
            "qa_disproportionate_freight": flag((goods > 0) & (freight > cfg.freight_over_goods * goods)),
            "qa_payment_mismatch": flag(F.abs(F.col("paid_value") - (goods + freight)) > cfg.payment_tolerance),
            "qa_near_duplicate": flag(F.col("near_duplicate")),
        }
    )


def flag_tail(df: DataFrame, window_end, days: int = DEFAULT.tail_days) -> DataFrame:
    """Orders of the last days of the extract, whose record was still arriving."""
    start = F.timestamp_add("DAY", F.lit(-days), window_end)
    return df.withColumn("qa_incomplete_tail", flag(F.col("purchase_ts") >= start))


def seller_tier(df: DataFrame, tiers=SELLER_TIERS, none: str = DEFAULT.no_seller) -> DataFrame:
    """Size class of the seller by number of orders.

    Counted and joined back, not windowed, so a seller with a third of all orders never
    sits in one task.
    """
    sizes = df.filter("seller_id IS NOT NULL").groupBy("seller_id").agg(F.count("*").alias("_orders"))
    # Written, so its size is known before the wide rows would be shuffled for it.
    tiered, _ = written(sizes.select("seller_id", cut("_orders", *tiers).alias("seller_tier")))
    out = df.join(tiered, "seller_id", "left")
    return out.withColumn("seller_tier", F.coalesce("seller_tier", F.lit(none)))


def delivery_kpis(df: DataFrame, window_end) -> DataFrame:
    """Lateness with both denominators; ``late`` and ``honest_late`` are true, false or null."""
    days = F.round(days_between("promised_ts", "delivered_ts"), 3)
    measurable = F.col("delivered_ts").isNotNull()
    active = F.col("order_status") != "canceled"
    overdue = active & ~measurable & flag(F.col("promised_ts") < window_end)
    late = flag(days > 0)
    return df.withColumns(
        {
            "active": active,
            "measurable": measurable,
            "days_vs_promise": days,
            "late": F.when(measurable, late),
            "overdue_no_record": overdue,
            "honest_late": F.when(~active, None).when(measurable, late).otherwise(overdue),
        }
    )


def state_vs_zip(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """State implied by the ZIP prefix next to the declared one; the declared one is kept."""

    def states(key, name):
        return centroids.select(F.col("zip_prefix").alias(key), F.col("state").alias(name), F.lit(True).alias("_" + name))

    out = df.join(states("seller_zip", "branch_zip_state"), "seller_zip", "left").join(
        states("customer_zip", "customer_zip_state"), "customer_zip", "left"
    )
    return out.withColumns(
        {
            "qa_branch_state_mismatch": flag(F.col("seller_state") != F.col("branch_zip_state")),
            "qa_customer_state_mismatch": flag(F.col("customer_state") != F.col("customer_zip_state")),
            "qa_zip_no_geo": F.col("_customer_zip_state").isNull(),
        }
    ).drop("_branch_zip_state", "_customer_zip_state")


def flag_city_rewritten(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Canonical city of both ends, and whether a spelling changed beyond formatting."""

    # Said once per spelling, not per row.
    changed = flag(simple_form("spelling") != simple_form("canonical"))

    def end(spelling, state, name):
        columns = [F.col("spelling").alias(spelling), F.col("state").alias(state), F.col("canonical").alias(name)]
        return lookup.select(*columns, changed.alias("_changed_" + name))

    out = df.join(end("seller_city", "seller_state", "branch_city"), ["seller_city", "seller_state"], "left").join(
        end("customer_city", "customer_state", "customer_city_canonical"), ["customer_city", "customer_state"], "left"
    )
    marks = ["_changed_branch_city", "_changed_customer_city_canonical"]
    return out.withColumn("qa_city_rewritten", flag(F.col(marks[0])) | flag(F.col(marks[1]))).drop(*marks)


def quarantine(df: DataFrame, hard: list[str] = HARD_FLAGS) -> DataFrame:
    """Hard-violation mark, and the reasons joined by a bar."""
    reasons = F.concat_ws("|", *[F.when(F.col(c), FLAG_CONTRACT[c].removeprefix("qa_")) for c in hard])
    return df.withColumns(
        {"qa_quarantine": reduce(lambda a, b: a | b, [F.col(c) for c in hard]), "quarantine_reason": reasons}
    )


def count_flags(df: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    return df.withColumn("qa_flags_total", reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in flags]))


def curate_core(deliveries: DataFrame, cfg: CurationConfig = DEFAULT, window_end=None) -> DataFrame:
    """The rules that need neither geography nor city names; enough for most reports.

    ``window_end`` may be given by the caller; otherwise it is the last purchase, one scalar.
    """
    if window_end is None:
        window_end = deliveries.select(F.max("purchase_ts")).scalar()
    out = default_branch(flag_completeness(deliveries), cfg.no_branch)
    out = flag_accuracy(flag_validity(out), cfg)
    out = flag_tail(out, window_end, cfg.tail_days)
    out = seller_tier(out, none=cfg.no_seller)
    return quarantine(delivery_kpis(out, window_end))


def curate_deliveries(
    deliveries: DataFrame, centroids: DataFrame, lookup: DataFrame, cfg: CurationConfig = DEFAULT, window_end=None
) -> DataFrame:
    """All rules over the delivery table; as many rows out as in."""
    out = curate_core(deliveries, cfg, window_end)
    return count_flags(state_vs_zip(flag_city_rewritten(out, lookup), centroids))


def star_core(star: Star, cfg: CurationConfig = DEFAULT, deliveries: DataFrame | None = None) -> DataFrame:
    """The core rules straight from the star; ``deliveries`` that are written already are taken as they are."""
    deliveries = written(build_deliveries(star))[0] if deliveries is None else deliveries
    return curate_core(deliveries, cfg, star.orders.select(F.max("purchase_ts")).scalar())


def curate_star(star: Star, cfg: CurationConfig = DEFAULT, deliveries: DataFrame | None = None) -> DataFrame:
    """Curated delivery table straight from the star.

    The deliveries are counted by seller and then curated: written once, they are not built twice.
    """
    deliveries = written(build_deliveries(star))[0] if deliveries is None else deliveries
    window_end = star.orders.select(F.max("purchase_ts")).scalar()
    # Both are joined at two ends; as files they have a size, so the wide rows are not shuffled by few cities and prefixes.
    lookup, _ = written(canonical_lookup(city_map(city_pairs(star))))
    centroids, _ = written(zip_centroids(star.geo))
    return curate_deliveries(deliveries, centroids, lookup, cfg, window_end)


def select_contract(df: DataFrame) -> DataFrame:
    """Published column names and order."""
    names = {**CONTRACT, **FLAG_CONTRACT, "qa_flags_total": "qa_flags_total", "qa_quarantine": "qa_quarentena"}
    return df.select(*[F.col(ours).alias(theirs) for ours, theirs in names.items()])


def quarantine_extract(df: DataFrame) -> DataFrame:
    """Copy of the quarantined rows with their reasons; the main table keeps them too."""
    return df.filter("qa_quarantine")
