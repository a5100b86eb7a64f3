"""Audit, quarantine, fingerprint and versions of tariff tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.base import flag
from haulmark.functions.hashing import row_hash

BLOCK, ALERT = "bloqueio", "alerta"


@dataclass(frozen=True)
class Range:
    """Accepted interval of a numeric field."""

    low: float
    high: float
    severity: str
    unit: str
    why: str = ""


# Accepted ranges, and the limits of the rules across fields.
RANGES = {
    "valor_por_volume": Range(1.0, 500.0, BLOCK, "R$", "uma casa decimal a mais aqui multiplica o frete inteiro"),
    "frete_minimo": Range(20.0, 2000.0, BLOCK, "R$", "abaixo de R$ 20 nao cobre custo; acima de R$ 2.000 nao e minimo"),
    "pedagio_por_volume": Range(0.0, 200.0, BLOCK, "R$"),
    "gris_percentual": Range(0.0, 2.0, BLOCK, "%", "0,30 digitado como 30 multiplica a parcela sobre a NF por 100"),
    "advalorem_percentual": Range(0.0, 2.0, BLOCK, "%"),
    "taxa_entrega_dificil": Range(0.0, 1000.0, BLOCK, "R$"),
    "peso_maximo_volume_kg": Range(1.0, 2000.0, ALERT, "kg"),
    "prazo_dias": Range(0.0, 30.0, ALERT, "dias"),
    "distancia_km": Range(1.0, 6000.0, ALERT, "km"),
}
PERCENT_SUM_LIMIT = 3.0
KNOWN_MODES = ["RODOVIARIO", "AEREO"]

# Fields whose change alters a price or the availability of a route.
SENSITIVE = [
    "valor_por_volume", "frete_minimo", "pedagio_por_volume", "gris_percentual", "advalorem_percentual",
    "taxa_entrega_dificil", "peso_maximo_volume_kg", "prazo_dias", "vigencia_inicio", "vigencia_fim", "status",
]


def ptbr(x) -> Column:
    """Two digits, dot for thousands, comma for decimals."""
    return F.translate(F.format_number(x if isinstance(x, Column) else F.lit(float(x)), 2), ",.", ".,")


def _with_unit(x, unit: str) -> Column:
    if unit == "R$":
        return F.concat(F.lit("R$ "), ptbr(x))
    return F.concat(ptbr(x), F.lit(unit if unit == "%" else f" {unit}"))


def _finding(condition: Column, field: str, severity: str, message: Column) -> Column:
    return F.when(
        condition, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), message.alias("message"))
    )


def _range_checks() -> list[Column]:
    out = []
    for field, r in RANGES.items():
        x = F.col(field).cast("double")
        message = F.concat(
            _with_unit(x, r.unit), F.lit(" fora da faixa "), _with_unit(r.low, r.unit), F.lit(" a "),
            _with_unit(r.high, r.unit), F.lit(f" - {r.why}" if r.why else ""),
        )
        out.append(_finding((x < r.low) | (x > r.high), field, r.severity, message))
    return out


def _cross_checks() -> list[Column]:
    c = F.col
    total = c("gris_percentual") + c("advalorem_percentual")
    one = c("valor_por_volume") + c("pedagio_por_volume")
    checks = [
        _finding(
            total > PERCENT_SUM_LIMIT, "gris_percentual+advalorem_percentual", BLOCK,
            F.concat(F.lit("somam "), ptbr(total), F.lit("%, acima do limite de "), ptbr(PERCENT_SUM_LIMIT),
                     F.lit("% sobre o valor da nota fiscal")),
        ),
        _finding(
            c("pedagio_por_volume") > c("valor_por_volume"), "pedagio_por_volume", ALERT,
            F.concat(F.lit("R$ "), ptbr(c("pedagio_por_volume")), F.lit(" maior que o valor por volume (R$ "),
                     ptbr(c("valor_por_volume")), F.lit("); conferir se as colunas nao foram trocadas")),
        ),
        _finding(
            (c("frete_minimo") != 0) & (c("frete_minimo") < one), "frete_minimo", ALERT,
            F.concat(F.lit("R$ "), ptbr(c("frete_minimo")), F.lit(" nunca se aplica: um unico volume ja custa R$ "), ptbr(one)),
        ),
        _finding(
            c("vigencia_fim") < c("vigencia_inicio"), "vigencia_fim", BLOCK,
            F.concat(c("vigencia_fim").cast("string"), F.lit(" anterior ao inicio "), c("vigencia_inicio").cast("string"),
                     F.lit(": a rota fica invisivel sem que ninguem perceba")),
        ),
        _finding(F.coalesce("id_rota", F.lit("")) == "", "id_rota", ALERT, F.lit("vazio: a linha nao e rastreavel na auditoria")),
    ]
    for field in ("uf_origem", "uf_destino"):
        checks.append(
            _finding((F.length(field) > 0) & (F.length(field) != 2), field, ALERT,
                     F.concat(F.lit("'"), c(field), F.lit("' nao parece uma UF de duas letras")))
        )
    checks.append(
        _finding((F.length("modal") > 0) & ~c("modal").isin(*KNOWN_MODES), "modal", ALERT,
                 F.concat(F.lit("'"), c("modal"), F.lit(f"' desconhecido; o agente so escolhe entre {' e '.join(KNOWN_MODES)}")))
    )
    return checks


def _exploded(tariffs: DataFrame, checks: list[Column]) -> DataFrame:
    return tariffs.select("line_no", "id_rota", F.inline(F.array_compact(F.array(*checks))))


def range_findings(tariffs: DataFrame) -> DataFrame:
    """Fields outside their range; a missing optional field is no error."""
    return _exploded(tariffs, _range_checks())


def cross_findings(tariffs: DataFrame) -> DataFrame:
    """Rules between fields of one row."""
    return _exploded(tariffs, _cross_checks())


def signed_off() -> Column:
    """Released by somebody: a name and a date."""
    return flag((F.col("revisado_por") != "") & F.col("revisado_em").isNotNull())


def row_findings(tariffs: DataFrame) -> DataFrame:
    """All rules of one row in one pass; a release silences alerts, never blocks."""
    released = signed_off()
    checks = F.array_compact(F.array(*_range_checks(), *_cross_checks()))
    kept = F.filter(checks, lambda f: (f["severity"] == BLOCK) | ~released)
    return tariffs.select("line_no", "id_rota", F.inline(kept))


def duplicate_id_findings(tariffs: DataFrame) -> DataFrame:
    """Repeated route ids; counted per id and joined back."""
    counted = tariffs.filter("id_rota <> ''").groupBy("id_rota").agg(F.count("*").alias("n")).filter("n > 1")
    return tariffs.select("line_no", "id_rota").join(counted, "id_rota").select(
        "line_no",
        "id_rota",
        F.lit("id_rota").alias("field"),
        F.lit(ALERT).alias("severity"),
        F.concat(F.lit("repetido em "), F.col("n"), F.lit(" linhas")).alias("message"),
    )


ROUTE = ["origin_key", "dest_key", "modal"]


def with_route_keys(tariffs: DataFrame) -> DataFrame:
    return tariffs.withColumns(
        {
            "origin_key": F.concat_ws("/", "cidade_origem", "uf_origem"),
            "dest_key": F.concat_ws("/", "cidade_destino", "uf_destino"),
        }
    )


def overlapping_validity(tariffs: DataFrame) -> DataFrame:
    """Active rows in force at the same time as another row of the same route and mode.

    Rows X and A meet when X starts by the end of A and X ends no earlier than A starts.
    Over the validity periods of a route in order of their start it is enough to know the
    two latest ends so far: the row itself is one of them, so a second one that reaches its
    start is somebody else. Equal periods are counted, not repeated, so what one route holds
    is bounded by the calendar and no pairs are formed.
    """
    keyed = with_route_keys(tariffs).filter(F.upper("status") == "ATIVO").withColumns(
        {
            "s": F.coalesce("vigencia_inicio", F.lit("0001-01-01").cast("date")),
            "e": F.coalesce("vigencia_fim", F.lit("9999-12-31").cast("date")),
        }
    )
    periods = keyed.groupBy(*ROUTE, "s", "e").agg(F.count("*").alias("n"))
    data = periods.select(
        *ROUTE, F.explode(F.array_repeat(F.col("e"), F.least("n", F.lit(2)).cast("int"))).alias("end"),
        F.col("s").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("date").alias("s"), F.lit(None).cast("date").alias("e"),
    )
    asked = periods.select(
        *ROUTE, F.lit(None).cast("date").alias("end"), F.col("e").alias("pos"), F.lit(1).alias("kind"), "s", "e"
    )
    order = Window.partitionBy(*ROUTE).orderBy("pos", "kind", "end", "s")
    latest_before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = data.unionByName(asked).withColumn("runner_up", F.when(latest_before.isNotNull(), F.least("end", latest_before)))
    both = both.withColumn("runner_up", F.when(F.col("kind") == 0, F.col("runner_up")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"first": F.max("end").over(upto), "second": F.max("runner_up").over(upto)})
    # A row that ends before it starts is not among the rows it asks about.
    meets = flag(F.when(F.col("s") <= F.col("e"), F.col("second") >= F.col("s")).otherwise(F.col("first") >= F.col("s")))
    hits = both.filter("kind = 1").filter(meets).select(*ROUTE, "s", "e")
    return keyed.join(hits, [*ROUTE, "s", "e"], "left_semi").drop("s", "e")


def overlap_findings(tariffs: DataFrame) -> DataFrame:
    return overlapping_validity(tariffs).select(
        "line_no",
        "id_rota",
        F.lit("vigencia").alias("field"),
        F.lit(BLOCK).alias("severity"),
        F.concat(
            "origin_key", F.lit(" -> "), "dest_key", F.lit(" ["), "modal",
            F.lit("] tem mais de uma tarifa vigente ao mesmo tempo; o preco enviado dependeria da ordem das linhas"),
        ).alias("message"),
    )


def audit_tariffs(tariffs: DataFrame) -> DataFrame:
    """Every finding of a table: line, route id, field, severity, message."""
    return (
        row_findings(tariffs).unionByName(duplicate_id_findings(tariffs)).unionByName(overlap_findings(tariffs))
    )


def apply_quarantine(tariffs: DataFrame, findings: DataFrame, enforce: bool = True) -> DataFrame:
    """Mark blocked rows and attach their reasons, whole and joined; in report mode nothing is blocked."""
    where = F.concat(F.lit("linha "), F.col("line_no"), F.lit(" "), F.coalesce(F.nullif("id_rota", F.lit("")), F.lit("sem id_rota")))
    reasons = (
        findings.filter(F.col("severity") == BLOCK)
        .select("line_no", F.concat(where, F.lit(" | "), "field", F.lit(": "), "message").alias("reason"))
        .groupBy("line_no")
        .agg(F.array_sort(F.collect_set("reason")).alias("block_reasons"))
        .withColumn("block_reason", F.array_join("block_reasons", "; "))
    )
    out = tariffs.join(reasons, "line_no", "left")
    return out.withColumn("quarantined", F.col("block_reason").isNotNull() & F.lit(enforce))


def in_force(day) -> Column:
    """Active, and the day within bounds that may be open."""
    d = F.lit(day).cast("date") if not isinstance(day, Column) else day
    return (
        (F.upper("status") == "ATIVO")
        & F.coalesce(d >= F.col("vigencia_inicio"), F.lit(True))
        & F.coalesce(d <= F.col("vigencia_fim"), F.lit(True))
    )


def fingerprint(tariffs: DataFrame) -> DataFrame:
    """Comparable snapshot: key, price-sensitive fields as text, row hash.

    The latest line wins when a key repeats.
    """
    keyed = with_route_keys(tariffs).withColumn(
        "key", F.concat_ws("|", F.coalesce("id_rota", F.lit("")), "origin_key", "dest_key", "modal")
    )
    fields = F.struct("line_no", *[F.col(c).cast("string").alias(c) for c in SENSITIVE])
    last = keyed.groupBy("key").agg(F.max_by(fields, "line_no").alias("f"))
    return last.select("key", *[F.col(f"f.{c}").alias(c) for c in SENSITIVE]).withColumn("row_hash", row_hash(["key", *SENSITIVE]))


def diff_snapshots(before: DataFrame, after: DataFrame, fields: list[str] = SENSITIVE) -> DataFrame:
    """New, removed and changed keys; one row per changed field."""
    a = before.select("key", F.struct(*fields).alias("a"))
    b = after.select("key", F.struct(*fields).alias("b"))
    joined = a.join(b, "key", "full_outer")

    def change(kind, field=None, old=None, new=None):
        text = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(field) if field else text).alias("field"),
            (old if old is not None else text).alias("old"),
            (new if new is not None else text).alias("new"),
        )

    changed = [
        F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), change("alterada", f, F.col(f"a.{f}"), F.col(f"b.{f}"))) for f in fields
    ]
    rows = (
        F.when(F.col("a").isNull(), F.array(change("nova")))
        .when(F.col("b").isNull(), F.array(change("removida")))
        .otherwise(F.array_compact(F.array(*changed)))
    )
    return joined.select("key", F.inline(rows))


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Where each key occurs: left only, right only, or both."""
    left = a.select(key).distinct().withColumn("_l", F.lit(True))
    right = b.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return left.join(right, key, "full_outer").select(key, side.alias("side"))


def register_version(log: DataFrame) -> DataFrame:
    """Versions of a sheet from the append-only load log: first and last time each hash was seen."""
    return log.groupBy("sheet", "hash").agg(
        F.min("loaded_at").alias("seen_at"), F.max("loaded_at").alias("seen_until"), F.count("*").alias("loads")
    )


def previous_version(versions: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Per sheet, the last seen version with another content than the current one."""
    order = F.struct("seen_until", "hash")
    if current is None:
        current = versions.groupBy("sheet").agg(F.max_by("hash", order).alias("current_hash"))
    others = versions.join(current, "sheet").filter("hash <> current_hash")
    return others.groupBy("sheet", "current_hash").agg(
        F.max(order)["hash"].alias("previous_hash"), F.max(order)["seen_until"].alias("seen_until")
    )
