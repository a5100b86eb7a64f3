"""Route lookup, price formula and the decision waterfall of quote requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.config import QuotingConfig
from haulmark.functions.base import flag
from haulmark.functions.geo import haversine_km
from haulmark.functions.requests import (
    confidence,
    effective_packages,
    is_ignored_sender,
    missing_fields,
    weight_alert,
    weight_per_package,
)
from haulmark.functions.text import normalize_place, plain_text
from haulmark.operators.ordering import carry_forward, summarise
from haulmark.operators.tariffs import in_force
from haulmark.session import written

_REQUEST_ROUTE = ["origin_norm", "dest_norm", "mode_norm"]
_SPOKEN = {"origem": "_origem", "destino": "_destino", "modal": "_modal"}
DEFAULT = QuotingConfig()


def with_request_route(requests: DataFrame) -> DataFrame:
    """Comparable places and mode of a request."""
    return requests.withColumns(
        {
            "origin_norm": normalize_place("origem"),
            "dest_norm": normalize_place("destino"),
            "mode_norm": F.upper(F.trim(F.coalesce("modal", F.lit("")))),
        }
    )


def _place_keys(tariffs: DataFrame, city: str, uf: str, key: str) -> DataFrame:
    """The three accepted spellings of every place of one end of the tariffs."""
    places = tariffs.select(city, uf).distinct()
    forms = F.array_distinct(F.array(F.col(city), F.concat_ws("/", city, uf), F.concat_ws(" ", city, uf)))
    return places.select(city, uf, F.explode(forms).alias(key)).filter(F.col(key) != "")


def match_routes(requests: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Distinct requested routes with every tariff row of that route, whatever its state.

    Requests shrink to their distinct routes first, so a route asked for by a third of the
    requests is looked up once.
    """
    asked = requests.select("origin_norm", "dest_norm").filter("origin_norm <> '' AND dest_norm <> ''").distinct()
    origins = _place_keys(tariffs, "cidade_origem", "uf_origem", "origin_norm")
    dests = _place_keys(tariffs, "cidade_destino", "uf_destino", "dest_norm")
    places = asked.join(origins, "origin_norm").join(dests, "dest_norm")
    return places.join(tariffs, ["cidade_origem", "uf_origem", "cidade_destino", "uf_destino"])


def find_routes(requests: DataFrame, tariffs: DataFrame, day) -> DataFrame:
    """Rows that may be priced on the day, per distinct requested route."""
    usable = in_force(day)
    if "quarantined" in tariffs.columns:
        usable = usable & ~F.col("quarantined")
    return match_routes(requests, tariffs.filter(usable))


def route_registered(requests: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Requests whose route exists in the table, whatever its status or validity."""
    known = match_routes(requests, tariffs).select("origin_norm", "dest_norm").distinct()
    return requests.join(known, ["origin_norm", "dest_norm"], "left_semi")


def quarantine_reason(requests: DataFrame, audited: DataFrame) -> DataFrame:
    """Why a requested route stopped being priced: distinct block reasons, sorted."""
    blocked = match_routes(requests, audited.filter("quarantined"))
    # A set of whole findings: the rows of one route in the tariff table.
    each = blocked.select("origin_norm", "dest_norm", F.explode("block_reasons").alias("reason"))
    return each.groupBy("origin_norm", "dest_norm").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("quarantine_reason")
    )


def mode_preference(requested: str = "mode_norm", offered: str = "modal", default: str = DEFAULT.default_mode) -> Column:
    """The mode asked for, else the default mode, else any."""
    asked = (F.col(requested) != "") & (F.col(offered) == F.col(requested))
    return F.when(asked, 0).when(F.col(offered) == default, 1).otherwise(2)


def pick_tariff(requests: DataFrame, tariffs: DataFrame, day) -> DataFrame:
    """The one tariff of each distinct route and mode: best mode, then first sheet line."""
    asked = requests.select(*_REQUEST_ROUTE).distinct()
    # A request without a mode may carry the default; the tariff keeps its own column name.
    candidates = asked.join(find_routes(requests, tariffs, day), ["origin_norm", "dest_norm"])
    tariff = F.struct(*[F.col(c) for c in tariffs.columns])
    return candidates.groupBy(*_REQUEST_ROUTE).agg(
        F.min_by(tariff, F.struct(mode_preference().alias("p"), F.col("line_no"))).alias("tariff")
    )


def spoken_routes(requests: DataFrame) -> DataFrame:
    """Every way in which places and mode are written, with the comparable route it stands for."""
    said = requests.select(*[F.coalesce(c, F.lit("")).alias(s) for c, s in _SPOKEN.items()]).distinct()
    return with_request_route(said.withColumnsRenamed({s: c for c, s in _SPOKEN.items()})).withColumnsRenamed(_SPOKEN)


def with_route_status(requests: DataFrame, audited: DataFrame, day, paths: list[str] | None = None) -> DataFrame:
    """Attach the tariff, whether the route is registered, and its quarantine reasons.

    Places are compared once per way they are written, and each distinct route meets the table once; tariff,
    mark and reasons come out of one grouping. Both tables are written, so however often the result is read, a
    request only looks up its own words; ``paths`` takes their paths, for a caller that frees them.
    """
    spoken, first = written(spoken_routes(requests))
    asked = spoken.select(*_REQUEST_ROUTE).distinct()
    met = asked.join(match_routes(asked, audited), ["origin_norm", "dest_norm"])
    usable = in_force(day) & ~F.col("quarantined")
    offer = F.struct(mode_preference().alias("p"), F.col("line_no"), F.struct(*[F.col(c) for c in audited.columns]).alias("tariff"))
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("quarantined"), F.col("block_reasons"))))))
    status = met.groupBy(*_REQUEST_ROUTE).agg(F.min(F.when(usable, offer)).alias("_offer"), reasons.alias("_reasons"))
    status = status.select(
        *_REQUEST_ROUTE, F.col("_offer.tariff").alias("tariff"), F.lit(True).alias("_known"),
        F.when(F.size("_reasons") > 0, F.array_join("_reasons", "; ")).alias("quarantine_reason"),
    )
    told = spoken.join(status, _REQUEST_ROUTE, "left").withColumn("registered", F.coalesce("_known", F.lit(False))).drop("_known")
    told, second = written(told)
    if paths is not None:
        paths += [first, second]
    added = ["tariff", "quarantine_reason", "registered"]
    rest = [c for c in requests.columns if c not in (*_REQUEST_ROUTE, *added)]
    keyed = requests.select(*rest, *[F.coalesce(c, F.lit("")).alias(s) for c, s in _SPOKEN.items()])
    return keyed.join(told, list(_SPOKEN.values()), "left").select(*_REQUEST_ROUTE, *rest, *added)


def price_table(df: DataFrame, packages: str = "packages", tariff: str = "tariff") -> DataFrame:
    """Freight by package with a minimum, charges on the invoice, hard-delivery fee.

    Each part is rounded on its own; the total is rounded from the unrounded parts.
    """
    t = lambda c: F.col(f"{tariff}.{c}")
    volume = F.col(packages) * (t("valor_por_volume") + t("pedagio_por_volume"))
    applied = F.greatest(volume, t("frete_minimo"))
    applied = F.when(volume.isNotNull(), applied)
    charge = F.col("valor_nf") * (t("gris_percentual") + t("advalorem_percentual")) / 100
    fee = t("taxa_entrega_dificil")
    return df.withColumns(
        {
            "freight_packages": F.round(volume, 2),
            "freight_applied": F.round(applied, 2),
            "gris_advalorem": F.round(charge, 2),
            "hard_delivery_fee": F.round(fee, 2),
            "total": F.round(applied + charge + fee, 2),
            "lead_days": t("prazo_dias"),
            "used_minimum": applied > volume,
        }
    )


def weight_check(df: DataFrame, tariff: str = "tariff") -> DataFrame:
    """Weight per package and the alert against the limit of the route."""
    return df.withColumn("kg_per_package", weight_per_package("peso_kg", "packages")).withColumn(
        "weight_alert", weight_alert("kg_per_package", f"{tariff}.peso_maximo_volume_kg", f"{tariff}.id_rota")
    )




_MERGED_NUMBERS = ["qtd_volumes", "valor_nf", "peso_kg", "m3_informado"]
_MERGED_TEXTS = ["origem", "destino", "modal"]


def merge_thread(requests: DataFrame, own_address: str = DEFAULT.own_address) -> DataFrame:
    """Each message completed by what its thread said before.

    A field given now wins, otherwise the last one given; confidence is the highest so far
    and the request mark stays once set. Only messages marked as quote requests take over
    earlier fields. Messages of robots and our own are passed through as they are and tell
    the thread nothing. A thread of any length is scanned by many tasks.
    """
    heard = ~is_ignored_sender("remetente", own_address)
    takes = F.col("e_cotacao") & heard
    given = {c: F.col(c) != 0 for c in _MERGED_NUMBERS} | {c: F.col(c) != "" for c in _MERGED_TEXTS} | {"volumes": F.size("volumes") > 0}
    said = {f"_said_{c}": F.when(heard & present, F.col(c)) for c, present in given.items()}
    told = requests.withColumns(said | {"_sure": F.when(heard, confidence())})
    scanned = carry_forward(told, ["thread_id"], ["ts", "id_email"], list(said), ["_sure"])
    cols = {c: F.when(takes, F.coalesce(f"last__said_{c}", F.col(c))).otherwise(F.col(c)) for c in given}
    cols["confianca"] = F.when(takes, F.col("max__sure")).otherwise(F.col("confianca"))
    return scanned.withColumns(cols).select(*requests.columns)


def route_requests(
    requests: DataFrame, audited: DataFrame, day, cfg: QuotingConfig = DEFAULT, processed: DataFrame | None = None,
    paths: list[str] | None = None,
) -> DataFrame:
    """Decide every request: outcome, label, reason and price, in the fixed order of checks.

    ``processed`` holds the ``id_email`` of messages handled before. With model pricing the
    request must carry ``model_status`` (``ok``, ``missing`` or a reason) and ``model_total``. ``paths`` as in
    ``with_route_status``.
    """
    df = with_route_status(requests, audited, day, paths)
    df = df.withColumn("packages", effective_packages())
    df = weight_check(price_table(df))
    df = df.withColumn("missing", missing_fields(cfg.require_weight, "packages"))
    if processed is None:
        df = df.withColumn("_seen", F.lit(False))
    else:
        seen = processed.select("id_email").distinct().withColumn("_s", F.lit(True))
        df = df.join(seen, "id_email", "left").withColumn("_seen", F.coalesce("_s", F.lit(False))).drop("_s")

    c = F.col
    sure = confidence()
    shown = F.format_string("%.2f", sure)
    place = F.concat(F.lit("trecho "), "origem", F.lit(" -> "), "destino")
    both = flag((F.coalesce("origem", F.lit("")) != "") & (F.coalesce("destino", F.lit("")) != ""))
    no_tariff = both & c("tariff").isNull()
    unpriced = F.when(
        c("quarantine_reason").isNotNull(),
        F.concat(place, F.lit(" em quarentena pela curadoria: "), "quarantine_reason"),
    ).otherwise(F.concat(place, F.lit(" cadastrado, porem sem tarifa vigente (INATIVO ou vigencia expirada)")))

    def step(outcome, reason=None):
        text = F.lit(None).cast("string") if reason is None else reason
        return F.struct(F.lit(outcome).alias("outcome"), text.alias("reason"))

    low = F.concat(F.lit("confianca "), shown, F.lit(f" abaixo de {cfg.confidence_to_ask}"))
    unsure = F.concat(F.lit("confianca "), shown, F.lit(f" abaixo de {cfg.confidence_to_quote} para emitir preco"))
    decided = (
        F.when(c("_seen"), step("ignorado"))
        .when(is_ignored_sender("remetente", cfg.own_address), step("ignorado"))
        .when(~flag(c("e_cotacao")), step("ignorado"))
        .when(sure < cfg.confidence_to_ask, step("erro", low))
        .when(no_tariff & c("registered"), step("erro", unpriced))
        .when(no_tariff, step("sem_rota"))
        .when(F.size("missing") > 0, step("incompleto"))
        .when(sure < cfg.confidence_to_quote, step("erro", unsure))
    )
    if cfg.pricing == "historico":
        road = F.coalesce(F.nullif("mode_norm", F.lit("")), c("tariff.modal")) == cfg.default_mode
        decided = (
            decided.when(~road, step("erro", F.lit("modelo historico ainda não validado para modal aéreo")))
            .when(c("model_status") == "missing", step("erro", F.lit("modelo historico configurado, porém não foi carregado")))
            .when(c("model_status") != "ok", step("erro", c("model_status")))
        )
    decided = decided.when(c("weight_alert").isNotNull(), step("erro", c("weight_alert"))).otherwise(step("cotado"))
    total = c("model_total") if cfg.pricing == "historico" else c("total")
    quoted = c("outcome") == "cotado"
    label = (
        F.when(c("outcome") == "erro", "IA/Revisar").when(c("outcome") == "incompleto", "IA/Incompleto")
        .when(c("outcome") == "sem_rota", "IA/Sem-Rota").otherwise("IA/Processado")
    )
    return (
        df.withColumn("_d", decided)
        .withColumns({"outcome": c("_d.outcome"), "reason": c("_d.reason")})
        .withColumns(
            {
                "label": label,
                "quoted_total": F.when(quoted, total),
                "quoted_tariff": F.when(quoted, F.to_json("tariff")),
            }
        )
        .drop("_d", "_seen")
    )


def resolve_place(df: DataFrame, geo_map: DataFrame, place: str, city_fallback: str, uf_fallback: str, name: str) -> DataFrame:
    """Coordinates of a place: ZIP prefix, else city and state, else the fallback city.

    What is found nowhere stays null with source ``unresolved``; nothing is guessed.
    """
    norm = normalize_place(place)
    digits = F.regexp_replace(F.coalesce(F.col(place), F.lit("")), "\\D", "")
    prefix = F.when(F.length(digits) == 8, F.substring(digits, 1, 5))
    explicit = norm.rlike("/.{2}$") & prefix.isNull()
    has_fallback = flag((F.col(city_fallback) != "") & (F.col(uf_fallback) != ""))
    city = F.when(explicit, F.regexp_replace(norm, "/[^/]*$", "")).when(has_fallback, F.col(city_fallback))
    uf = F.when(explicit, F.regexp_extract(norm, "/([^/]{2})$", 1)).when(has_fallback, F.col(uf_fallback))
    keyed = df.withColumns({"_zip": prefix, "_city": plain_text(city), "_uf": F.upper(uf)})

    cols = ["lat", "lng", "city", "state"]
    by_zip = geo_map.select(F.col("zip_prefix").alias("_zip"), F.struct(*cols).alias("_z"))
    named = geo_map.withColumns({"_city": plain_text("city"), "_uf": F.upper("state")})
    by_city = summarise(
        named, ["_city", "_uf"], {"city": F.min_by("city", "zip_prefix")}, {"lat": ("lat", 0.5), "lng": ("lng", 0.5)}
    ).select("_city", "_uf", F.struct("lat", "lng", "city", F.col("_uf").alias("state")).alias("_c"))
    out = keyed.join(by_zip, "_zip", "left").join(by_city, ["_city", "_uf"], "left")
    source = F.when(F.col("_z").isNotNull(), "cep").when(F.col("_c").isNotNull(), "cidade_uf").otherwise("unresolved")
    found = F.coalesce("_z", "_c")
    added = {f"{name}_{c}": found[c] for c in cols} | {f"{name}_source": source}
    return out.withColumns(added).drop("_zip", "_city", "_uf", "_z", "_c")


def model_features(requests: DataFrame, geo_map: DataFrame, month: int) -> DataFrame:
    """Pricing features of requests with a tariff: both places resolved, tariff distance first.

    Invalid input is named in ``model_status`` and keeps its row. The month is a parameter,
    not the clock.
    """
    from haulmark.functions.geo import geo_profile, route_key, same_state

    flat = requests.withColumns(
        {f"_t_{c}": F.col(f"tariff.{c}") for c in ("cidade_origem", "uf_origem", "cidade_destino", "uf_destino", "distancia_km")}
    )
    out = resolve_place(flat, geo_map, "origem", "_t_cidade_origem", "_t_uf_origem", "origin")
    out = resolve_place(out, geo_map, "destino", "_t_cidade_destino", "_t_uf_destino", "dest")
    measured = haversine_km("origin_lat", "origin_lng", "dest_lat", "dest_lng")
    out = out.withColumns(
        {
            "quantity_items": effective_packages(),
            "weight_total_kg": F.col("peso_kg"),
            "declared_value": F.col("valor_nf"),
            "month": F.lit(month),
            "distance_km": F.when(F.col("_t_distancia_km") > 0, F.col("_t_distancia_km")).otherwise(measured),
            "route": route_key("origin_state", "dest_state"),
            "same_state": same_state("origin_state", "dest_state"),
            "geo_profile": geo_profile("origin_city", "dest_city"),
        }
    )
    bad = (
        F.when(~flag(F.col("quantity_items") > 0), "quantidade de volumes ausente ou inválida")
        .when(~flag(F.col("weight_total_kg") > 0), "peso total deve ser informado e maior que zero")
        .when(~flag(F.col("declared_value") > 0), "valor da mercadoria deve ser maior que zero")
        .when((F.col("origin_source") == "unresolved") | (F.col("dest_source") == "unresolved"),
              "localidade não existe no mapa geográfico do modelo")
    )
    return out.withColumn("model_status", F.coalesce(bad, F.lit("ok"))).drop(*[c for c in out.columns if c.startswith("_t_")])
