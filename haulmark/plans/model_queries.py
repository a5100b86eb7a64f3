"""Queries that fit models; checked by invariants, SQL cannot say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.functions.numbers import PRICE_NUMERIC, prepare_features
from haulmark.operators import centroids, deliveries, ordering, price_model, routing, segments
from haulmark.operators import delay as delay_ops
from haulmark.plans.quoting_queries import DAY, _Q
from haulmark.plans.registry import query
from haulmark.session import written

KEYS = ["order_id", "seller_id"]
#: Rounds and trees of the queries; the operators themselves default to the settings of record (300). README has the times.
ROUNDS, TREES = 60, 100
OUTLIER_INPUTS = ["x_" + c for c in PRICE_NUMERIC]


def _split_shipments(t):
    """Training reads the table many times, so it is written once, as columns: each reader takes those it needs."""
    df, _ = written(deliveries.build_shipments(t.star))
    return ordering.temporal_split(df, ["purchase_ts", *KEYS])


def _sides(t):
    df = _split_shipments(t)
    return tuple(df.filter(F.col("split") == s) for s in ("train", "calib", "test"))


@query("price_band")
def _(t):
    train, calib, test = _sides(t)
    band = price_model.fit_price_band(train, calib)
    return band.transform(test).select(*KEYS, *[F.round(c, 2).alias(c) for c in ("p25", "p50", "p75")])


@query("price_split_optimism")
def _(t):
    return price_model.leakage_check(_split_shipments(t))


@query("structural_outliers")
def _(t):
    df = prepare_features(written(deliveries.build_shipments(t.star))[0])
    forest = price_model.fit_isolation(df, OUTLIER_INPUTS, KEYS)
    return forest.transform(df).select(*KEYS, F.round("structural_score", 4).alias("structural_score"), "structural_outlier")


@query("model_quotes")
def _(t):
    train, calib, _ = _sides(t)
    band = price_model.fit_price_band(train, calib)
    forest = price_model.fit_isolation(prepare_features(train), OUTLIER_INPUTS, KEYS)
    q = _Q(t)
    asked = routing.with_route_status(q.requests, q.audited, DAY).filter("tariff IS NOT NULL")
    out = price_model.price_model(asked, centroids.zip_centroids(t.star.geo, "median"), band, forest, month=7)
    return out.select("id_email", "model_status", "model_total", "p25", "p75", "distance_km")


def _segment_shipments(t):
    return written(deliveries.build_segment_shipments(t.star))[0]


def _delay_split(t):
    return ordering.date_split(written(delay_ops.delay_table(t.star))[0], "purchase_ts")


def _delay_sides(t):
    df = _delay_split(t)
    return df.filter("split = 'train'"), df.filter("split = 'test'")


@query("delay_scores")
def _(t):
    train, test = _delay_sides(t)
    model = delay_ops.fit_delay(train, rounds=ROUNDS)
    return delay_ops.score(model, test, "p").select("order_id", "y", F.round("p", 4).alias("p"))


@query("delay_model_line_up")
def _(t):
    return delay_ops.compare_delay_models(*_delay_sides(t), rounds=ROUNDS, trees=TREES)


@query("delay_tree_rules")
def _(t):
    df = _delay_split(t)
    return delay_ops.tree_rules(delay_ops.small_tree(df.filter("split = 'train'")), df)


@query("delay_leak_proofs")
def _(t):
    return delay_ops.leak_proofs(_delay_split(t), ROUNDS)


@query("delay_permutation_importance")
def _(t):
    train, test = _delay_sides(t)
    model = delay_ops.fit_delay(train, rounds=ROUNDS)
    return delay_ops.permutation_importance(model, test)


@query("delay_setting_sensitivity")
def _(t):
    return delay_ops.param_sensitivity(*_delay_sides(t), settings=[(5, 0.06, 4, 40), (5, 0.2, 3, 20)])


@query("segment_k_sweep")
def _(t):
    _, scaled = segments.scale(_segment_shipments(t))
    return segments.sweep_k(scaled)


@query("shipment_segments")
def _(t):
    df = _segment_shipments(t)
    return segments.segment(df, k=4).transform(df).select(*KEYS, "segment")


@query("segment_stability")
def _(t):
    df = _segment_shipments(t)
    return segments.stability_ari(df, segments.segment(df, k=3), KEYS)


@query("segment_centers")
def _(t):
    df = _segment_shipments(t)
    return segments.segment_centers(segments.segment(df, k=4), t.spark)


@query("segment_pca")
def _(t):
    loadings, _ = segments.project_pca(_segment_shipments(t))
    return loadings
