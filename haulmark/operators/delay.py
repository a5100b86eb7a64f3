"""Late-delivery table, features known at purchase, and the classifiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions.base import flag
from haulmark.functions.geo import EARTH_RADIUS_SHORT_KM, haversine_km
from haulmark.functions.times import calendar_parts, days_between
from haulmark.operators.centroids import city_centroids, zip_centroids
from haulmark.operators.cities import canonical_lookup, city_map, city_pairs
from haulmark.operators.curation import star_core
from haulmark.operators.evaluation import roc_auc, score_models
from haulmark.operators.ordering import random_split
from haulmark.session import written
from haulmark.sources.star import Star

NUMERIC = [
    "promised_days", "dispatch_slack_days", "distance_km", "weight_g", "goods_value", "freight_value", "n_items",
    "month", "weekday", "hour", "same_state_flag",
]
CATEGORICAL = ["branch", "customer_state", "payment_channel"]
# Columns that exist only after the purchase; none may become a feature.
AFTER_PURCHASE = {"approved_ts", "carrier_ts", "delivered_ts", "lead_days", "days_vs_promise", "measurable", "late", "honest_late", "overdue_no_record"}


def assert_known_at_purchase(features: list[str]) -> None:
    leaking = [f for f in features if f in AFTER_PURCHASE or f.startswith("qa_")]
    if leaking:
        raise ValueError(f"not known at purchase: {leaking}")


def attach_city_geo(df: DataFrame, centroids: DataFrame, city: str = "branch_city", state: str = "branch") -> DataFrame:
    """Branch at the grain of its city, customer at the grain of the ZIP prefix.

    City names of the centroids are compared through their canonical spelling in upper case.
    """
    places = city_centroids(centroids).select(
        F.upper("city").alias("_city"), F.col("state").alias("_state"), F.col("lat").alias("branch_lat"), F.col("lng").alias("branch_lng")
    )
    ends = centroids.select(F.col("zip_prefix").alias("customer_zip"), F.col("lat").alias("customer_lat"), F.col("lng").alias("customer_lng"))
    out = df.join(ends, "customer_zip", "left")
    return out.join(places, (F.upper(city) == F.col("_city")) & (F.col(state) == F.col("_state")), "left").drop("_city", "_state")


def delay_features(df: DataFrame) -> DataFrame:
    """The eleven numeric and three categorical features known at purchase, and the target."""
    out = calendar_parts(df).withColumns(
        {
            "y": flag(F.col("honest_late")).cast("int"),
            "promised_days": days_between("purchase_ts", "promised_ts"),
            "dispatch_slack_days": days_between("purchase_ts", "shipping_limit_ts"),
            "distance_km": haversine_km("branch_lat", "branch_lng", "customer_lat", "customer_lng", EARTH_RADIUS_SHORT_KM),
            "same_state_flag": flag(F.col("branch") == F.col("customer_state")).cast("int"),
            "route": F.concat("branch", F.lit(">"), "customer_state"),
        }
    )
    assert_known_at_purchase([*NUMERIC, *CATEGORICAL])
    return out


def delay_table(star: Star) -> DataFrame:
    """Active orders outside the incomplete tail, with features and target."""
    core = star_core(star).filter("active AND NOT qa_incomplete_tail AND promised_ts IS NOT NULL AND purchase_ts IS NOT NULL")
    lookup = canonical_lookup(city_map(city_pairs(star))).select(
        F.col("spelling").alias("seller_city"), F.col("state").alias("seller_state"), F.col("canonical").alias("branch_city")
    )
    # As files both have a size, so the wide orders are not shuffled by few cities and prefixes.
    named = core.join(written(lookup)[0], ["seller_city", "seller_state"], "left")
    return delay_features(attach_city_geo(named, written(zip_centroids(star.geo))[0]))


def collapse_rare(df: DataFrame, train: DataFrame, cols: list[str], min_n: int = 30, other: str = "OTHER", missing: str = "SEM") -> DataFrame:
    """Categories too rare in the training side share one label."""
    out = df
    for c in cols:
        common = train.groupBy(c).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_n).select(c, F.lit(True).alias("_ok"))
        out = out.join(common, c, "left").withColumn(c, F.when(F.col(c).isNull(), missing).when(F.col("_ok"), F.col(c)).otherwise(other)).drop("_ok")
    return out


def _stages(numeric: list[str], marks: list[str], categorical: list[str], onehot: bool) -> list:
    """What comes after the imputer."""
    stages = []
    cols = ["i_" + c for c in numeric] + marks
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=["k_" + c for c in categorical], handleInvalid="keep"))
        if onehot:
            stages.append(OneHotEncoder(inputCols=["k_" + c for c in categorical], outputCols=["o_" + c for c in categorical], handleInvalid="keep"))
        cols += [("o_" if onehot else "k_") + c for c in categorical]
    assembled = "raw_features" if onehot else "features"
    stages.append(VectorAssembler(inputCols=cols, outputCol=assembled))
    if onehot:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=False))
    return stages


def telling_marks(ready: DataFrame, marks: list[str]) -> list[str]:
    """The missing marks that differ among the rows, and of equal ones the first.

    A tree that looks at all its features never splits by the others, so its fit need not count them.
    """
    patterns = ready.groupBy(*marks).agg(F.count("*").alias("_n")).drop("_n").collect()
    seen: dict[tuple, str] = {}
    for c in marks:
        seen.setdefault(tuple(r[c] for r in patterns), c)
    return [c for values, c in seen.items() if len(set(values)) > 1]


def as_model_input(df: DataFrame, numeric: list[str] = NUMERIC) -> DataFrame:
    """Numbers as doubles and one missing mark each: the trees have no native missing value."""
    return df.withColumns({c: F.col(c).cast("double") for c in numeric}).withColumns(
        {"m_" + c: F.col(c).isNull().cast("double") for c in numeric}
    )


def fit_classifier(train: DataFrame, estimator, numeric=NUMERIC, categorical=CATEGORICAL, onehot: bool = False, y: str = "y") -> PipelineModel:
    """Impute, index and fit. The training table is kept while the rounds run over it.

    Boosting reads the rows for each level of each round, so it gets the marks that tell anything. A
    tree over one number gets one row per value, weighted by its rows.
    """
    numeric, categorical = list(numeric), list(categorical)
    marks = ["m_" + c for c in numeric]
    ready = as_model_input(train, numeric).select(y, *numeric, *marks, *categorical)
    ready = ready.fillna("SEM", subset=categorical).cache() if categorical else ready.cache()
    try:
        imputer = Imputer(strategy="median", inputCols=numeric, outputCols=["i_" + c for c in numeric]).fit(ready)
        estimator = estimator.copy({estimator.labelCol: y, estimator.featuresCol: "features"})
        rows = ready
        if isinstance(estimator, GBTClassifier):
            marks = telling_marks(ready, marks)
        if len(numeric) == 1 and not categorical and isinstance(estimator, (GBTClassifier, DecisionTreeClassifier)):
            rows, estimator = _weighted(ready, estimator)
        return Pipeline(stages=[imputer, *_stages(numeric, marks, categorical, onehot), estimator]).fit(rows)
    finally:
        ready.unpersist()


def _weighted(rows: DataFrame, estimator):
    """Equal rows as one with their number as weight, and the estimator with its smallest leaf in weights."""
    n, leaf = rows.count(), estimator.getMinInstancesPerNode()
    if n < 4 * leaf:
        return rows, estimator
    # Half a row below the bound, so that rounding the share does not move it.
    share = (leaf - 0.5) / n
    counted = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("_rows"))
    told = {estimator.weightCol: "_rows", estimator.minInstancesPerNode: 1, estimator.minWeightFractionPerNode: share}
    return counted, estimator.copy(told)


def score(model: PipelineModel, df: DataFrame, name: str, numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Add the probability of being late."""
    ready = as_model_input(df, numeric)
    if categorical:
        ready = ready.fillna("SEM", subset=list(categorical))
    out = model.transform(ready).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def boosted(rounds: int = 300, depth: int = 5, step: float = 0.06, min_leaf: int = 40, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=min_leaf, seed=seed, maxBins=128)


def fit_delay(train: DataFrame, **settings) -> PipelineModel:
    """The chosen classifier: boosted trees over all fourteen features."""
    return fit_classifier(train, boosted(**settings))


def tree_paths(model: PipelineModel, names: list[str]) -> list[list[tuple[str, str, float]]]:
    """The conditions (feature, ``<=`` or ``>``, threshold) on the way to each leaf of a fitted tree over numbers."""
    paths: list[list[tuple[str, str, float]]] = []
    open_: list[tuple[str, str, float]] = []
    for line in model.stages[-1].toDebugString.split("\n")[1:]:
        depth = len(line) - len(line.lstrip()) - 2
        found = re.search(r"\(feature (\d+) (<=|>) ([-0-9.Ee]+)\)", line)
        if found:
            open_ = [*open_[:depth], (names[int(found[1])], found[2], float(found[3]))]
        elif "Predict" in line:
            paths.append(open_[:depth])
    return paths


def tree_rules(model: PipelineModel, df: DataFrame, numeric: list[str] = NUMERIC, y: str = "y") -> DataFrame:
    """Each leaf as a conjunction, with its rows and late rate over the whole of ``df`` in one pass.

    A missing number counts as the median of training, which the condition shows.
    """
    imputed = ["i_" + c for c in numeric] + ["m_" + c for c in numeric]
    ready = model.stages[0].transform(as_model_input(df, numeric))
    medians = model.stages[0].surrogateDF.first().asDict()

    def said(feature, sign, cut):
        name = feature[2:]
        if feature.startswith("m_"):
            return f"{name} {'is given' if sign == '<=' else 'is missing'}"
        return f"coalesce({name}, {medians[name]!r}) {sign} {cut!r}"

    which, texts = F.lit(None).cast("int"), []
    for i, path in enumerate(tree_paths(model, imputed)):
        tests = [F.col(f) <= v if sign == "<=" else F.col(f) > v for f, sign, v in path]
        which = F.when(reduce(lambda a, b: a & b, tests, F.lit(True)), i).otherwise(which)
        texts.append(F.struct(F.lit(i).alias("rule"), F.lit(" AND ".join(said(*c) for c in path)).alias("conditions")))
    late = F.col(y).cast("double")
    counted = ready.groupBy(which.alias("rule")).agg(F.count("*").alias("n"), F.sum(late).cast("long").alias("late"), F.round(100 * F.avg(late), 4).alias("late_pct"))
    rules = df.sparkSession.range(1).select(F.inline(F.array(*texts)))
    return rules.join(counted, "rule", "left").select("rule", "conditions", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("late", F.lit(0)).cast("long").alias("late"), "late_pct")


def small_tree(train: DataFrame) -> PipelineModel:
    """The tree whose rules are printed: three levels over the numbers."""
    return fit_classifier(train, DecisionTreeClassifier(maxDepth=3, minInstancesPerNode=200, seed=42), NUMERIC, [])


def compare_delay_models(train: DataFrame, test: DataFrame, rounds: int = 300, trees: int = 300) -> DataFrame:
    """Line-up from one cut to boosted trees on one test side."""
    one, forest = ["promised_days"], RandomForestClassifier(numTrees=trees, maxDepth=8, minInstancesPerNode=20, seed=42, maxBins=128)
    common = collapse_rare(train, train, CATEGORICAL), collapse_rare(test, train, CATEGORICAL)
    line_up = {
        "stump": (DecisionTreeClassifier(maxDepth=1, seed=42), one, [], False),
        "tree_depth_3": (DecisionTreeClassifier(maxDepth=3, minInstancesPerNode=200, seed=42), NUMERIC, [], False),
        "logistic": (LogisticRegression(maxIter=100), NUMERIC, CATEGORICAL, True),
        "random_forest": (forest, NUMERIC, CATEGORICAL, False),
        "boosted_one_feature": (boosted(rounds), one, [], False),
        "boosted": (boosted(rounds), NUMERIC, CATEGORICAL, False),
    }
    scored = common[1]
    for name, (estimator, numeric, categorical, onehot) in line_up.items():
        model = fit_classifier(common[0], estimator, numeric, categorical, onehot)
        scored = score(model, scored, "s_" + name, numeric, categorical)
    return score_models(scored, {n: "s_" + n for n in line_up}, "y")


def leak_proofs(table: DataFrame, rounds: int = 300) -> DataFrame:
    """Area of the honest set-up next to three that cheat: random split, later column, tautological flag."""
    train, test = table.filter("split = 'train'"), table.filter("split = 'test'")
    share = train.count() / max(table.count(), 1)
    mixed = random_split(table.drop("split"), ["order_id"], (share, 1 - share), names=("train", "test"))
    flagged = [d.withColumn("no_delivery", F.col("qa_no_delivery_ts").cast("double")) for d in (train, test)]
    cases = {
        "temporal": (train, test, NUMERIC),
        "random_split": (mixed.filter("split = 'train'"), mixed.filter("split = 'test'"), NUMERIC),
        "with_lead_days": (train, test, [*NUMERIC, "lead_days"]),
        "with_tautological_flag": (*flagged, [*NUMERIC, "no_delivery"]),
    }
    out = None
    for name, (tr, te, numeric) in cases.items():
        scored = score(fit_classifier(tr, boosted(rounds), numeric), te, "p", numeric)
        row = roc_auc(scored, "p", "y").select(F.lit(name).alias("configuration"), F.round("auc", 4).alias("auc"))
        out = row if out is None else out.unionByName(row)
    return out


def permute_column(df: DataFrame, col: str, keys: list[str], seed: int) -> DataFrame:
    """Shuffle one column among the rows: two seeded orders are joined by position."""
    from haulmark.operators.ordering import row_numbers

    place = row_numbers(df.select(*keys, F.xxhash64(*keys, F.lit(seed)).alias("_h")), ["_h", *keys]).select(*keys, "row_no")
    value = row_numbers(df.select(*keys, F.col(col).alias("_v"), F.xxhash64(*keys, F.lit(seed + 1)).alias("_h")), ["_h", *keys])
    moved = place.join(value.select("row_no", "_v"), "row_no").select(*keys, "_v")
    return df.join(moved, keys).withColumn(col, F.col("_v")).drop("_v")


def permutation_importance(
    model: PipelineModel, test: DataFrame, features: list[str] = NUMERIC + CATEGORICAL, keys=("order_id",), seed: int = 7
) -> DataFrame:
    """Fall of the area when one feature is shuffled; all fourteen unless some are named."""
    base = roc_auc(score(model, test, "p"), "p", "y").select("auc").scalar()
    out = None
    for i, f in enumerate(features):
        shuffled = permute_column(test, f, list(keys), seed + 2 * i)
        row = roc_auc(score(model, shuffled, "p"), "p", "y").select(F.lit(f).alias("feature"), F.col("auc").alias("auc_permuted"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("drop_pp", F.round(100 * (base - F.col("auc_permuted")), 3)).withColumn("auc_permuted", F.round("auc_permuted", 4))


# The four settings compared (rounds, step, depth, smallest leaf).
SETTINGS = [(300, 0.06, 5, 40), (150, 0.10, 5, 40), (600, 0.03, 6, 20), (300, 0.06, 4, 100)]


def param_sensitivity(train: DataFrame, test: DataFrame, settings=SETTINGS) -> DataFrame:
    """Area under each setting and the amplitude between them."""
    out = None
    for rounds, step, depth, leaf in settings:
        model = fit_delay(train, rounds=rounds, step=step, depth=depth, min_leaf=leaf)
        row = roc_auc(score(model, test, "p"), "p", "y").select(
            F.lit(f"rounds={rounds} step={step} depth={depth} leaf={leaf}").alias("settings"), F.round("auc", 4).alias("auc")
        )
        out = row if out is None else out.unionByName(row)
    spread = out.select(F.max("auc") - F.min("auc")).scalar()
    return out.withColumn("amplitude_pp", F.round(100 * spread, 3))
