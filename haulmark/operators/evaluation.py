"""Measures of price bands, delay scores and segments.

Every measure takes a table of predictions, so it does not matter which model made them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.config import DelayCosts
from haulmark.functions.base import count_if, flag
from haulmark.functions.numbers import PRICE_BANDS_KG, cut
from haulmark.functions.times import days_between
from haulmark.operators.ordering import cut_by_reference, prefix_sums, qcut, spearman, summarise

# ---------------------------------------------------------------- price


def price_metrics(df: DataFrame, by: list[str] = (), y: str = "freight_value", pred: str = "p50") -> DataFrame:
    """Mean and median absolute error, median relative error and bias; coverage if a band is present."""
    by = list(by)
    err = F.col(pred) - F.col(y)
    base = df.withColumns({"_abs": F.abs(err), "_rel": F.when(F.col(y) > 0, F.abs(err / F.col(y)) * 100)})
    aggs = {"n": F.count("*"), "mae": F.avg("_abs"), "bias": F.avg(err)}
    if {"p25", "p75"} <= set(df.columns):
        aggs["coverage_pct"] = 100 * F.avg(flag(F.col(y).between(F.col("p25"), F.col("p75"))).cast("double"))
        aggs["below_pct"] = 100 * F.avg(flag(F.col(y) < F.col("p25")).cast("double"))
        aggs["above_pct"] = 100 * F.avg(flag(F.col(y) > F.col("p75")).cast("double"))
    out = summarise(base, by, aggs, {"medae": ("_abs", 0.5), "medape": ("_rel", 0.5)})
    return out.withColumns({c: F.round(c, 3) for c in out.columns if c not in (*by, "n")})


def fallback_lookup(df: DataFrame, levels: list[tuple[list[str], DataFrame]], value: str, default: Column, name: str) -> DataFrame:
    """First value found from the finest level down, else the default; the level used is kept."""
    out, found = df, []
    for i, (keys, table) in enumerate(levels):
        out = out.join(table.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
        found.append(F.col(f"_v{i}"))
    level = reduce(lambda acc, i: acc.when(found[i].isNotNull(), i), range(len(found)), F.when(F.lit(False), -1))
    return (
        out.withColumn(name, F.coalesce(*found, default))
        .withColumn(name + "_level", level.otherwise(len(found)))
        .drop(*[f"_v{i}" for i in range(len(found))])
    )


def price_baselines(train: DataFrame, test: DataFrame, y: str = "freight_value", bands=PRICE_BANDS_KG) -> DataFrame:
    """Medians of the training side as predictions: global, by route, by band, by route and band."""
    tr, te = (d.withColumn("band", cut("weight_total_kg", *bands)) for d in (train, test))
    default = summarise(tr, [], {}, {"m": (y, 0.5)}).select("m").scalar()

    def medians(keys):
        return summarise(tr.dropna(subset=keys), keys, {}, {"m": (y, 0.5)})

    route, band, cell = medians(["route"]), medians(["band"]), medians(["route", "band"])
    out = te.withColumn("b_global", default)
    out = fallback_lookup(out, [(["route"], route)], "m", default, "b_route")
    out = fallback_lookup(out, [(["band"], band)], "m", default, "b_band")
    return fallback_lookup(out, [(["route", "band"], cell), (["route"], route)], "m", default, "b_cell")


def fit_linear_rule(train: DataFrame, y: str = "freight_value", xs=("weight_total_kg", "distance_km")) -> list[float]:
    """Least squares of ``a + b·kg + c·km`` from one aggregate of cross products."""
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    size = len(cols)
    products = [F.sum(cols[i] * cols[j]) for i in range(size) for j in range(size)] + [F.sum(c * F.col(y)) for c in cols]
    row = train.agg(*[p.alias(f"s{i}") for i, p in enumerate(products)]).first()
    a = np.array(row[: size * size], dtype=float).reshape(size, size)
    return [float(v) for v in np.linalg.solve(a, np.array(row[size * size :], dtype=float))]


def apply_linear_rule(df: DataFrame, coef: list[float], xs=("weight_total_kg", "distance_km"), name: str = "b_linear") -> DataFrame:
    return df.withColumn(name, sum((F.lit(b) * F.col(x) for b, x in zip(coef[1:], xs, strict=True)), F.lit(coef[0])))


def compare_price(df: DataFrame, predictions: dict[str, str], against: str, y: str = "freight_value") -> DataFrame:
    """Metrics per named prediction column and the gain in mean error against one of them."""
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p50")) for n, c in predictions.items()])
    out = price_metrics(df.select(F.col(y).alias("freight_value"), F.inline(pairs)), ["model"])
    base = out.filter(F.col("model") == against).select("mae").scalar()
    return out.withColumn("gain_pct", F.round(100 * (base - F.col("mae")) / base, 1))


def error_cost(df: DataFrame, ts: str = "purchase_ts", y: str = "freight_value", pred: str = "p50", cuts=(10, 20, 30)) -> DataFrame:
    """What under- and over-pricing cost: lost margin, excess charged, revenue at risk, per year."""
    err = F.col(pred) - F.col(y)
    rel = F.when(F.col(y) > 0, 100 * err / F.col(y))
    days = F.greatest(F.floor(days_between(F.min(ts), F.max(ts))), F.lit(1))
    cols = {
        "n": F.count("*"),
        "days": days,
        "n_under": count_if(err < 0),
        "lost_margin": F.coalesce(F.sum(F.when(err < 0, -err)), F.lit(0.0)),
        "n_over": count_if(err > 0),
        "excess": F.coalesce(F.sum(F.when(err > 0, err)), F.lit(0.0)),
    }
    for c in cuts:
        cols[f"n_over_{c}pct"] = count_if(rel > c)
        cols[f"at_risk_{c}pct"] = F.coalesce(F.sum(F.when(rel > c, F.col(y))), F.lit(0.0))
    out = df.agg(*[x.alias(n) for n, x in cols.items()])
    money = ["lost_margin", "excess", *[f"at_risk_{c}pct" for c in cuts]]
    return out.withColumn("lost_margin_year", F.col("lost_margin") * 365 / F.col("days")).withColumns(
        {c: F.round(c, 2) for c in [*money, "lost_margin_year"]}
    )


def price_outliers(df: DataFrame, y: str = "freight_value", limit: float = 3.5) -> DataFrame:
    """Robust score of the price inside its band, and whether both kinds of outlier meet."""
    sigma = F.greatest((F.log1p("p75") - F.log1p("p25")) / 1.349, F.lit(0.05))
    z = (F.log1p(y) - F.log1p("p50")) / sigma
    out = df.withColumn("price_z", z).withColumn("price_outlier", flag(F.abs("price_z") > limit))
    if "structural_outlier" in df.columns:
        out = out.withColumn("both_outliers", F.col("structural_outlier") & F.col("price_outlier"))
    return out


def gate_sweep(df: DataFrame, cuts=(0.6, 0.8, 1.0, 1.2), y: str = "freight_value", min_auto: int = 100, min_human: int = 10) -> DataFrame:
    """What goes to a person at each width cut, and the errors on both sides.

    Each row is repeated once per cut inside its task; the cuts are a short list.
    """
    width = F.when(F.col("p50") > 0, (F.col("p75") - F.col("p25")) / F.col("p50"))
    outside = F.col("structural_outlier") if "structural_outlier" in df.columns else F.lit(False)
    long = df.select(
        F.col(y).alias("freight_value"), "p50", width.alias("_w"), outside.alias("_o"), F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut")
    ).withColumn("human", F.col("_o") | flag(F.col("_w") > F.col("cut")))
    sides = price_metrics(long, ["cut", "human"])
    wide = sides.groupBy("cut").agg(
        *[
            F.coalesce(F.max(F.when(F.col("human") == h, F.col("n"))), F.lit(0)).alias(f"n_{name}")
            for h, name in ((False, "auto"), (True, "human"))
        ],
        *[
            F.max(F.when(F.col("human") == h, F.col(m))).alias(f"{m}_{name}")
            for h, name in ((False, "auto"), (True, "human"))
            for m in ("mae", "medape")
        ],
    )
    return wide.filter((F.col("n_auto") >= min_auto) & (F.col("n_human") >= min_human)).withColumn(
        "human_pct", F.round(100 * F.col("n_human") / (F.col("n_human") + F.col("n_auto")), 1)
    )


def fairness_by(df: DataFrame, key: str, y: str = "freight_value", pred: str = "p50", min_n: int = 100) -> DataFrame:
    """Median price and error, and the share priced too high, per group."""
    err = F.col(pred) - F.col(y)
    rel = F.when(F.col(y) > 0, 100 * err / F.col(y))
    base = df.filter(F.col(key).isNotNull()).withColumns({"_rel": rel, "_ape": F.abs(rel)})
    out = summarise(
        base,
        [key],
        {"n": F.count("*"), "over_pct": 100 * F.avg((err > 0).cast("double"))},
        {"freight_p50": (y, 0.5), "error_pct_p50": ("_rel", 0.5), "medape": ("_ape", 0.5)},
    )
    return out.filter(F.col("n") >= min_n).withColumns({c: F.round(c, 3) for c in out.columns if c not in (key, "n")})


# ---------------------------------------------------------------- delay


def _scored(df: DataFrame, score: str, y: str, by: list[str], weight: Column | None = None) -> DataFrame:
    """Weight of late and of punctual rows per distinct score: ties are one step."""
    w = F.lit(1).cast("long") if weight is None else weight
    late = F.col(y).cast("int") == 1
    return df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum(F.when(late, w).otherwise(0)).alias("pos"), F.sum(F.when(late, 0).otherwise(w)).alias("neg")
    )


def roc_auc(df: DataFrame, score: str, y: str, by: list[str] = (), min_n: int = 0) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; groups with one class are left out."""
    by = list(by)
    steps = prefix_sums(_scored(df, score, y, by), ["_s"], ["neg"], by)
    u = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2.0))
    out = steps.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), u.alias("_u"))
    out = out.filter((F.col("positives") > 0) & (F.col("negatives") > 0))
    out = out.filter((F.col("positives") + F.col("negatives")) >= min_n)
    auc = F.col("_u") / (F.col("positives").cast("double") * F.col("negatives"))
    return out.select(*by, "positives", "negatives", auc.alias("auc"))


def avg_precision(df: DataFrame, score: str, y: str, by: list[str] = ()) -> DataFrame:
    """Area under the precision-recall steps."""
    by = list(by)
    steps = _scored(df, score, y, by).withColumn("_d", -F.col("_s"))
    placed = prefix_sums(steps, ["_d"], ["pos", "neg"], by)
    hits = F.col("before_pos") + F.col("pos")
    precision = hits / (hits + F.col("before_neg") + F.col("neg"))
    out = placed.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum(F.col("pos") * precision).alias("_a"))
    return out.filter("positives > 0").select(*by, "positives", (F.col("_a") / F.col("positives")).alias("average_precision"))


def score_models(df: DataFrame, models: dict[str, str], y: str) -> DataFrame:
    """Both areas for several score columns of one table."""
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("score")) for n, c in models.items()])
    long = df.select(y, F.inline(pairs))
    auc = roc_auc(long, "score", y, ["model"]).select("model", F.round("auc", 4).alias("auc"))
    ap = avg_precision(long, "score", y, ["model"]).select("model", F.round("average_precision", 4).alias("pr_auc"))
    return auc.join(ap, "model")


def delay_baselines(train: DataFrame, test: DataFrame, y: str = "y", min_route: int = 30) -> DataFrame:
    """Scores without a model: prevalence, short promise or other state, late rate of the route."""
    prevalence = train.select(F.avg(F.col(y).cast("double"))).scalar()
    short = summarise(train, [], {}, {"q": ("promised_days", 0.25)}).select("q").scalar()
    rule = 0.5 * flag(F.col("promised_days") < short).cast("double") + 0.5 * (1 - F.col("same_state_flag"))
    rates = train.groupBy("route").agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count("*").alias("n"))
    out = test.withColumns({"b_prevalence": prevalence, "b_rule": rule})
    return fallback_lookup(out, [(["route"], rates.filter(F.col("n") >= min_route))], "rate", prevalence, "b_route")


def cost_curve(df: DataFrame, score: str, y: str, costs: DelayCosts = DelayCosts()) -> DataFrame:
    """Alerts, hits, misses and cost at each cut, the cheapest marked, savings per year."""
    late = F.col(y).cast("int") == 1
    aggs, rows = [F.sum(late.cast("long")).alias("late")], []
    for i, t in enumerate(costs.cuts):
        on = F.col(score) >= t
        aggs += [count_if(on & late).alias(f"tp{i}"), count_if(on & ~late).alias(f"fp{i}")]
        rows.append(F.struct(F.lit(t).alias("cut"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col("late").alias("late")))
    out = df.agg(*aggs).select(F.inline(F.array(*rows))).withColumn("fn", F.col("late") - F.col("tp"))
    out = out.withColumn("cost", F.col("fn") * costs.false_negative + F.col("fp") * costs.false_positive)
    nothing = F.col("late") * costs.false_negative
    best = out.select(F.min(F.struct("cost", "cut"))["cut"]).scalar()
    return out.select(
        "cut", "tp", "fp", "fn",
        F.round(F.col("tp") / F.greatest("late", F.lit(1)), 4).alias("recall"),
        F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), 4).alias("precision"),
        F.round("cost", 2).alias("cost"),
        F.round(nothing - F.col("cost"), 2).alias("saving"),
        F.round((nothing - F.col("cost")) * 365 / costs.test_days, 2).alias("saving_year"),
        (F.col("cut") == best).alias("best"),
    )


def signal_shift(df: DataFrame, col: str, y: str, split: str = "split") -> DataFrame:
    """Late rate per quintile frozen on the training side, on both sides, and the change of mix."""
    frozen = cut_by_reference(df, df.filter(F.col(split) == "train"), col, [0, 0.2, 0.4, 0.6, 0.8, 1.0], "quintile")
    late, train = F.col(y).cast("double"), F.col(split) == "train"
    out = summarise(
        frozen.filter("quintile IS NOT NULL"),
        ["quintile"],
        {
            "n_train": count_if(train),
            "n_test": count_if(~train),
            "train_pct": 100 * F.avg(F.when(train, late)),
            "test_pct": 100 * F.avg(F.when(~train, late)),
        },
        {"median": (col, 0.5)},
    )
    totals = {s: df.select(count_if(F.col(split) == s)).scalar() for s in ("train", "test")}
    return out.select(
        "quintile", "n_train", "n_test", F.round("median", 1).alias("median"),
        F.round("train_pct", 3).alias("train_pct"), F.round("test_pct", 3).alias("test_pct"),
        F.round(F.col("test_pct") - F.col("train_pct"), 3).alias("delta_pp"),
        F.round(100 * F.col("n_train") / totals["train"], 2).alias("mix_train_pct"),
        F.round(100 * F.col("n_test") / totals["test"], 2).alias("mix_test_pct"),
    )


def signal_correlation(df: DataFrame, col: str, y: str, split: str = "split") -> DataFrame:
    """Rank correlation of a column with the target on each side of the split."""
    sides = [
        spearman(df.filter(F.col(split) == s), col, y).select(F.lit(s).alias("side"), F.round("spearman", 4).alias("spearman"), "n")
        for s in ("train", "test")
    ]
    return sides[0].unionByName(sides[1])


def recall_by(df: DataFrame, key: str, score: str, y: str, cut_at: float, min_n: int = 100) -> DataFrame:
    """Alerts, recall and precision per group at the chosen cut; a missing key is its own group."""
    late, on = F.col(y).cast("int") == 1, F.col(score) >= cut_at
    out = df.groupBy(key).agg(
        F.count("*").alias("orders"),
        F.round(100 * F.avg(late.cast("double")), 3).alias("late_pct"),
        count_if(on).alias("alerts"),
        count_if(on & late).alias("tp"),
        count_if(late).alias("late"),
    )
    return out.filter(F.col("orders") >= min_n).select(
        key, "orders", "late_pct", "alerts",
        F.round(F.col("tp") / F.greatest("late", F.lit(1)), 4).alias("recall"),
        F.round(F.col("tp") / F.greatest("alerts", F.lit(1)), 4).alias("precision"),
    )


def recall_by_decile(df: DataFrame, col: str, score: str, y: str, cut_at: float) -> DataFrame:
    return recall_by(qcut(df, col, 10, "decile"), "decile", score, y, cut_at, min_n=1)


def regression_loss(df: DataFrame, days: str = "days_vs_promise", y: str = "y") -> DataFrame:
    """What a model of delay days would lose: rows without a delivery date and their late ones."""
    late, missing = F.col(y).cast("int") == 1, F.col(days).isNull()
    return df.agg(
        F.count("*").alias("orders"),
        count_if(~missing).alias("with_days"),
        count_if(missing).alias("without_days"),
        count_if(missing & late).alias("late_lost"),
        F.round(100 * count_if(missing & late) / F.greatest(count_if(late), F.lit(1)), 2).alias("late_lost_pct"),
    )


def bootstrap_auc_delta(df: DataFrame, score_a: str, score_b: str, y: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Paired bootstrap interval of the difference between two areas.

    Each row gets a Poisson(1) weight per replicate, drawn from its own scores, so both
    models see the same resample. Rows with equal scores and class are one row with the
    weight of their count. The table is ordered by each score in range partitions; a task
    keeps three vectors of replicates per run of scores, and only its first run, its last
    run and the sum of the middle leave it, so equal scores may span tasks.
    """
    rows = df.groupBy(
        F.col(score_a).cast("double").alias("a"), F.col(score_b).cast("double").alias("b"), F.col(y).cast("int").alias("y")
    ).agg(F.count("*").alias("n"))
    schema = "pid int, part int, u array<double>, pos array<double>, neg array<double>"

    def area(col: str) -> DataFrame:
        placed = rows.repartitionByRange(F.col(col), F.xxhash64("a", "b", "y")).sortWithinPartitions(col)
        placed = placed.withColumn("h", F.xxhash64("a", "b", "y", F.lit(seed))).withColumn("pid", F.spark_partition_id())

        def task(batches):
            yield from _bootstrap_task(batches, col, replicates)

        pieces = placed.mapInPandas(task, schema)

        def merge(key, pdf):
            return _bootstrap_merge(key, pdf, replicates)

        # Three rows per range partition, each a vector of replicates.
        return pieces.groupBy(F.lit(col).alias("model")).applyInPandas(merge, "model string, replicate int, auc double")

    both = area("a").withColumnsRenamed({"auc": "auc_a"}).drop("model").join(
        area("b").withColumnsRenamed({"auc": "auc_b"}).drop("model"), "replicate"
    )
    delta = both.select((100 * (F.col("auc_a") - F.col("auc_b"))).alias("d")).filter("d IS NOT NULL AND NOT isnan(d)")
    out = summarise(delta, [], {"replicates": F.count("*"), "delta_pp": F.avg("d")}, {"low_pp": ("d", 0.025), "high_pp": ("d", 0.975)})
    return out.withColumn("includes_zero", (F.col("low_pp") <= 0) & (F.col("high_pp") >= 0))


def _poisson(hashes, counts, replicates):
    """Weights of each row for all replicates, fixed by the hash of the row."""
    out = np.empty((len(hashes), replicates))
    for i, (h, n) in enumerate(zip(hashes, counts, strict=True)):
        out[i] = np.random.Generator(np.random.PCG64(int(h) & (2**64 - 1))).poisson(n, replicates)
    return out


def _bootstrap_task(batches, col, replicates):
    zero = np.zeros(replicates)
    first = last = None
    middle = [zero.copy(), zero.copy(), zero.copy()]
    pid = None

    def close(run):
        # A finished run of equal scores joins what lies between the first and the last run.
        middle[0] += run[1] * (middle[2] + run[2] / 2)
        middle[1] += run[1]
        middle[2] += run[2]

    for pdf in batches:
        for chunk in np.array_split(np.arange(len(pdf)), max(1, len(pdf) // 2000)):
            if not len(chunk):
                continue
            part = pdf.iloc[chunk]
            pid = int(part["pid"].iloc[0])
            w = _poisson(part["h"].to_numpy(), part["n"].to_numpy(), replicates)
            late = part["y"].to_numpy() == 1
            for score, idx in part.groupby(col, sort=True).indices.items():
                run = (score, w[idx][late[idx]].sum(axis=0), w[idx][~late[idx]].sum(axis=0))
                if last is not None and last[0] == score:
                    last = (score, last[1] + run[1], last[2] + run[2])
                    continue
                if last is not None:
                    if first is None:
                        first = last
                    else:
                        close(last)
                last = run
    if last is None:
        return
    rows = []
    if first is not None:
        rows.append((pid, 0, [first[0]], first[1], first[2]))
        rows.append((pid, 1, middle[0], middle[1], middle[2]))
    rows.append((pid, 2, [last[0]], last[1], last[2]))
    yield pd.DataFrame(rows, columns=["pid", "part", "u", "pos", "neg"])


def _bootstrap_merge(key, pdf, replicates):
    pdf = pdf.sort_values(["pid", "part"])
    u, pos, neg = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
    open_score, open_pos, open_neg = None, np.zeros(replicates), np.zeros(replicates)
    for _, part, value, p, n in pdf.itertuples(index=False):
        p, n = np.asarray(p, float), np.asarray(n, float)
        if part != 1 and open_score is not None and value[0] == open_score:
            open_pos, open_neg = open_pos + p, open_neg + n
            continue
        if open_score is not None:
            u += open_pos * (neg + open_neg / 2)
            pos, neg, open_score = pos + open_pos, neg + open_neg, None
        if part == 1:
            u += np.asarray(value, float) + p * neg
            pos, neg = pos + p, neg + n
        else:
            open_score, open_pos, open_neg = value[0], p, n
    if open_score is not None:
        u += open_pos * (neg + open_neg / 2)
        pos, neg = pos + open_pos, neg + open_neg
    with np.errstate(invalid="ignore", divide="ignore"):
        auc = u / (pos * neg)
    return pd.DataFrame({"model": key[0], "replicate": np.arange(replicates), "auc": auc})


# ---------------------------------------------------------------- segments


def cluster_quality(df: DataFrame, features: list[str], segment: str = "segment") -> DataFrame:
    """Davies-Bouldin, Calinski-Harabasz, inertia and smallest share, from native aggregates.

    The centres are one row per segment; the pairs compared are pairs of segments.
    """
    centres = df.groupBy(segment).agg(F.count("*").alias("n"), *[F.avg(f).alias("c_" + f) for f in features])
    joined = df.join(centres, segment)
    square = sum((F.pow(F.col(f) - F.col("c_" + f), 2) for f in features), F.lit(0.0))
    spread = joined.withColumn("_d2", square).groupBy(segment, "n", *["c_" + f for f in features]).agg(
        F.avg(F.sqrt("_d2")).alias("s"), F.sum("_d2").alias("w")
    )
    rows = [r.asDict() for r in spread.collect()]  # k rows
    total = sum(r["n"] for r in rows)
    k = len(rows)
    c = np.array([[r["c_" + f] for f in features] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    s, w = np.array([r["s"] for r in rows]), sum(r["w"] for r in rows)
    mean = (c * n[:, None]).sum(axis=0) / total
    dist = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (s[:, None] + s[None, :]) / dist
    np.fill_diagonal(ratio, -np.inf)
    between = float((n * ((c - mean) ** 2).sum(axis=1)).sum())
    db = float(ratio.max(axis=1).mean())
    ch = (between / (k - 1)) / (w / (total - k)) if k > 1 else None
    out = [(k, db, ch, float(w), float(100 * n.min() / total))]
    return df.sparkSession.createDataFrame(out, "k int, davies_bouldin double, calinski_harabasz double, inertia double, smallest_pct double")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings of the same rows, from their contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))

    def pairs(table, col="n"):
        return table.select(F.sum(F.col(col) * (F.col(col) - 1) / 2)).scalar()

    total = cells.select(F.sum("n") * (F.sum("n") - 1) / 2).scalar()
    rows = pairs(cells.groupBy(a).agg(F.sum("n").alias("n")))
    cols = pairs(cells.groupBy(b).agg(F.sum("n").alias("n")))
    one = cells.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("both"), F.sum("n").cast("long").alias("rows"))
    expected = rows * cols / total
    top, bottom = F.col("both") - expected, (rows + cols) / 2 - expected
    return one.select("rows", F.when(bottom == 0, 1.0).otherwise(top / bottom).alias("ari"))


# Names of segments, in order, with the measure that decides and its side.
SEGMENT_RULES = [
    ("local_metropolitano", "distance_km", "min"),
    ("carga_pesada", "weight_total_kg", "max"),
    ("multi_item", "quantity_mean", "max"),
    ("miudo_baixo_valor", "freight_pct_value", "max"),
    ("denso_compacto", "density", "max"),
    ("volumoso_leve", "cubic_weight_kg", "max"),
]


def name_segments(profile: DataFrame, segment: str = "segment", rules=SEGMENT_RULES) -> DataFrame:
    """Names for the rows of a profile (one per segment): each rule in turn names the most extreme one without a name.

    All segments lie in one array, in order of their number, and every rule moves one of them
    from ``free`` to ``named``; what stays free is numbered.
    """
    measures = list(dict.fromkeys(c for _, c, _ in rules))
    entry = F.struct(F.col(segment).cast("int").alias("id"), *[F.col(c).cast("double").alias(c) for c in measures])
    state = profile.agg(F.array_sort(F.collect_list(entry)).alias("free")).withColumn("named", F.array().cast("array<struct<id:int,name:string>>"))

    def fit(column, side):
        # Grows with how well a segment fits; ties go to the smaller number.
        return lambda x: F.struct((x[column] if side == "max" else -x[column]).alias("fit"), (-x["id"]).alias("id"))

    def other_than(best):
        return lambda x: x["id"] != best

    for name, column, side in rules:
        best = -F.array_max(F.transform("free", fit(column, side)))["id"]
        taken = F.when(F.size("free") > 0, F.array(F.struct(best.alias("id"), F.lit(name).alias("name")))).otherwise(F.array().cast("array<struct<id:int,name:string>>"))
        state = state.select(F.filter("free", other_than(best)).alias("free"), F.concat("named", taken).alias("named"))
    rest = F.transform("free", lambda x: F.struct(x["id"].alias("id"), F.concat(F.lit("grupo_"), x["id"]).alias("name")))
    return state.select(F.inline(F.concat("named", rest))).withColumnRenamed("id", segment)
