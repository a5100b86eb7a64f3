"""Expressions over quote requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.base import col_of, flag

VOLUME = "struct<quantidade:int,comprimento_cm:double,largura_cm:double,altura_cm:double>"
EXTRACTION = (
    "e_cotacao boolean, confianca double, origem string, destino string, qtd_volumes int, valor_nf double, "
    f"peso_kg double, volumes array<{VOLUME}>, m3_informado double, modal string, categoria string, observacoes string"
)

# Text mark of a recorded error and the review reason it stands for, in order.
REVIEW_REASONS = [
    ("quarentena pela curadoria", "tarifa em quarentena (curadoria)"),
    ("sem tarifa vigente", "tarifa inativa ou vencida"),
    ("peso medio", "peso acima do limite da rota"),
    ("fora do dominio historico", "carga fora do domínio histórico"),
    ("modelo historico", "modelo histórico indisponível"),
    ("para emitir preco", "confianca insuficiente para emitir preco"),
    ("confianca", "confianca baixa: nao sabemos o que o email pede"),
]
UNKNOWN_REASON = "falha tecnica"

# Address marks of senders that never get an answer.
ROBOT_MARKS = ["noreply", "no-reply", "nao-responda", "mailer-daemon", "postmaster"]


def classify_reason(error, rules=REVIEW_REASONS, default: str = UNKNOWN_REASON) -> Column:
    """First rule whose mark the error text contains."""
    text, out = F.lower(col_of(error)), None
    for mark, label in rules:
        test = text.contains(mark)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def is_ignored_sender(sender, own: str, marks=ROBOT_MARKS) -> Column:
    """Empty address, our own address, or a robot."""
    address = F.lower(F.coalesce(col_of(sender), F.lit("")))
    return (address == "") | (address == own.lower()) | address.rlike("|".join(marks))


def effective_packages(quantity="qtd_volumes", volumes="volumes") -> Column:
    """The stated number if positive, else the sum over the list, else null."""
    listed = F.aggregate(
        F.coalesce(col_of(volumes), F.array().cast(f"array<{VOLUME}>")),
        F.lit(0),
        lambda acc, v: acc + F.coalesce(v["quantidade"], F.lit(0)),
    )
    return F.when(col_of(quantity) > 0, col_of(quantity)).when(listed != 0, listed)


def total_m3(stated="m3_informado", volumes="volumes") -> Column:
    """The stated volume if positive, else the sum over packages with three positive sides."""
    sides = ("comprimento_cm", "largura_cm", "altura_cm")
    valid = F.filter(
        F.coalesce(col_of(volumes), F.array().cast(f"array<{VOLUME}>")),
        lambda v: flag((v[sides[0]] > 0) & (v[sides[1]] > 0) & (v[sides[2]] > 0) & (v["quantidade"] != 0)),
    )
    listed = F.aggregate(
        valid, F.lit(0.0), lambda acc, v: acc + v[sides[0]] * v[sides[1]] * v[sides[2]] / F.lit(1e6) * v["quantidade"]
    )
    return F.when(col_of(stated) > 0, col_of(stated)).when(F.size(valid) > 0, listed)


def weight_per_package(weight="peso_kg", packages=None) -> Column:
    packages = effective_packages() if packages is None else col_of(packages)
    return F.when(col_of(weight) != 0, col_of(weight) / packages)


def weight_alert(per_package, limit, route) -> Column:
    """Text when the mean weight per package exceeds the limit of the route, else null."""
    per, lim = col_of(per_package), col_of(limit)
    text = F.concat(
        F.lit("peso medio de "), F.format_string("%.1f", per), F.lit(" kg por volume excede o limite de "),
        F.format_string("%.0f", lim), F.lit(" kg da rota "), F.coalesce(col_of(route), F.lit("")),
    )
    return F.when((lim > 0) & (per > lim), text)


def missing_fields(require_weight: bool = True, packages=None) -> Column:
    """Names of the fields a request still lacks."""
    packages = effective_packages() if packages is None else col_of(packages)

    def absent(condition, name):
        return F.when(condition, name)

    checks = [
        absent(F.coalesce("origem", F.lit("")) == "", "origem"),
        absent(F.coalesce("destino", F.lit("")) == "", "destino"),
        absent(packages.isNull(), "qtd_volumes"),
        absent(~flag(F.col("valor_nf") > 0), "valor_nf"),
    ]
    if require_weight:
        checks.append(absent(~flag(F.col("peso_kg") > 0), "peso"))
    return F.array_compact(F.array(*checks))


def parse_extraction(json, schema: str = EXTRACTION) -> Column:
    """Stored extraction as a struct; text that is no JSON gives a struct of nulls, but for a confidence of 0."""
    parsed = F.from_json(col_of(json), schema, {"mode": "PERMISSIVE"})
    return F.when(parsed.isNotNull(), parsed.withField("confianca", confidence(parsed["confianca"])))


def confidence(value="confianca") -> Column:
    """A confidence that is not given, or no number, counts as none at all."""
    return F.coalesce(F.nanvl(col_of(value), F.lit(0.0)), F.lit(0.0))
