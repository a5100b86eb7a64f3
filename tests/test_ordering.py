"""Order-dependent operators against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haulmark.operators import evaluation as ev
from haulmark.operators import ordering


@pytest.fixture()
def scattered(spark):
    """A third of the rows share one value."""
    k = F.col("id")
    return spark.range(3000).select(
        k, (k % 3).alias("g"), F.when(k % 3 == 0, 7.0).otherwise((k * 7919) % 1000 / 10.0).alias("v"), (k % 5 == 0).cast("int").alias("y")
    )


def test_quantiles(spark, scattered):
    out = ordering.summarise(scattered, ["g"], {"n": F.count("*")}, {"a": ("v", 0.5), "b": ("v", 0.9)}).toPandas().set_index("g")
    data = scattered.toPandas().groupby("g")["v"]
    assert np.allclose(out["a"].sort_index(), data.quantile(0.5)) and np.allclose(out["b"].sort_index(), data.quantile(0.9))


def test_global_quantiles(spark, scattered):
    row = ordering.summarise(scattered, [], {"n": F.count("*")}, {"a": ("v", 0.25)}).first()
    assert (row.n, row.a) == (3000, pytest.approx(scattered.toPandas()["v"].quantile(0.25)))


def test_a_group_without_values_keeps_its_row(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (1, 2.0), (None, 3.0)], "g int, v double")
    for aggs in ({}, {"n": F.count("*")}):
        got = {r.g: r.q for r in ordering.summarise(df, ["g"], aggs, {"q": ("v", 0.6)}).collect()}
        assert got == {0: None, 1: pytest.approx(1.6), None: 3.0}
    assert ordering.summarise(df.filter("g = 0"), [], {"n": F.count("*")}, {"q": ("v", 0.5)}).first().asDict() == {"n": 1, "q": None}


def test_row_numbers(spark, scattered):
    out = ordering.row_numbers(scattered, ["v", "id"]).toPandas().sort_values("row_no")
    want = scattered.toPandas().sort_values(["v", "id"])
    assert list(out["id"]) == list(want["id"]) and list(out["row_no"]) == list(range(3000))


def test_temporal_split(spark, scattered):
    got = ordering.temporal_split(scattered, ["v", "id"]).toPandas().sort_values(["v", "id"])
    assert list(got["split"]) == ["train"] * 2100 + ["calib"] * 450 + ["test"] * 450


def _auc(p, y):
    ranks = pd.Series(p).rank()
    pos = y == 1
    n = pos.sum()
    return (ranks[pos].sum() - n * (n + 1) / 2) / (n * (~pos).sum())


def test_auc(spark, scattered):
    pdf = scattered.toPandas()
    assert ev.roc_auc(scattered, "v", "y").first().auc == pytest.approx(_auc(pdf["v"], pdf["y"].to_numpy()))
    groups = {r.g: r.auc for r in ev.roc_auc(scattered, "v", "y", ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert groups[g] == pytest.approx(_auc(part["v"].reset_index(drop=True), part["y"].to_numpy()))


def test_spearman(spark, scattered):
    pdf = scattered.toPandas()
    want = pdf["v"].rank().corr(pdf["y"].rank())
    assert ordering.spearman(scattered, "v", "y").first().spearman == pytest.approx(want)


def test_bootstrap_pieces_add_up():
    """Runs of equal scores may be cut anywhere between tasks."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": np.sort(rng.integers(0, 40, 500)) / 40.0, "y": rng.integers(0, 2, 500), "n": 1})
    pdf["h"] = np.arange(500)
    reps = 20
    w = ev._poisson(pdf["h"].to_numpy(), pdf["n"].to_numpy(), reps)
    pieces = []
    for pid, part in enumerate(np.array_split(np.arange(500), 7)):
        chunk = pdf.iloc[part].assign(pid=pid)
        pieces += list(ev._bootstrap_task([chunk], "a", reps))
    got = ev._bootstrap_merge(("a",), pd.concat(pieces), reps)["auc"].to_numpy()
    late = pdf["y"].to_numpy() == 1
    x = pdf["a"].to_numpy()
    for r in range(reps):
        wins = ((x[late][:, None] > x[~late][None, :]) + 0.5 * (x[late][:, None] == x[~late][None, :]))
        weight = w[late, r][:, None] * w[~late, r][None, :]
        assert got[r] == pytest.approx((wins * weight).sum() / weight.sum())


def test_random_split_is_repeatable(spark, scattered):
    a, b = (ordering.random_split(scattered, ["id"]).filter("split = 'test'").count() for _ in range(2))
    assert a == b and 300 < a < 600


def test_isolation_finds_the_far_rows(spark):
    from haulmark.operators.price_model import fit_isolation

    k = F.col("id")
    df = spark.range(2000).select(k, (F.when(k < 10, 500.0).otherwise(0.0) + (k * 37 % 101) / 10.0).alias("a"), ((k * 53 % 97) / 10.0).alias("b"))
    out = fit_isolation(df, ["a", "b"], ["id"], trees=30).transform(df)
    flagged = {r.id for r in out.filter("structural_outlier").collect()}
    assert set(range(10)) <= flagged and len(flagged) <= 40


def test_carry_forward(spark):
    """One group holds a third of the rows and lies over several partitions."""
    k = F.col("id")
    df = spark.range(5000).select(
        k, F.when(k % 3 == 0, 0).when(k % 1000 == 1, None).otherwise(k % 97).alias("g"), ((k * 7919) % 5000).alias("t"),
        F.when(k % 11 == 0, F.array(k, k + 1)).alias("a"), F.when(k % 50 == 7, F.concat(F.lit("s"), k)).alias("s"),
        F.when(k % 13 == 0, (k * 31 % 1009) / 7.0).alias("m"),
    )
    got = ordering.carry_forward(df.repartition(9), ["g"], ["t", "id"], ["a", "s"], ["m"]).toPandas()
    pdf = df.toPandas()
    state, want = {}, {}
    for r in pdf.sort_values(["t", "id"]).itertuples():
        g = None if pd.isna(r.g) else r.g
        a, s, m = state.get(g, (None, None, None))
        a = list(r.a) if r.a is not None else a
        s = r.s if r.s is not None and r.s == r.s else s
        m = m if pd.isna(r.m) else r.m if m is None else max(m, r.m)
        state[g] = want[r.id] = (a, s, m)
    assert len(got) == 5000
    for r in got.itertuples():
        found = (None if r.last_a is None else list(r.last_a), r.last_s if isinstance(r.last_s, str) else None, None if pd.isna(r.max_m) else r.max_m)
        assert found == want[r.id], r.id


def test_quantiles_of_hard_values(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([
        rng.normal(size=20_000), rng.lognormal(0, 30, 5000), -rng.lognormal(0, 30, 5000), np.repeat(1e-310, 50), np.repeat(-0.0, 70),
        np.nextafter(1.0, 2.0) + np.arange(40) * np.finfo(float).eps, [1e308, -1e308, np.inf, -np.inf],
    ])
    rng.shuffle(values)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "g": np.arange(len(values)) % 3}))
    probs = [0, 0.001, 0.25, 0.5, 0.505, 0.75, 0.999, 1]
    wanted = {f"q{i}": ("v", p) for i, p in enumerate(probs)}
    for row in ordering.summarise(df, ["g"], {"n": F.count("*")}, wanted).collect():
        mine = np.sort(values[np.arange(len(values)) % 3 == row.g])
        for i, p in enumerate(probs):
            at = (len(mine) - 1) * p
            lo, hi = mine[int(np.floor(at))], mine[int(np.ceil(at))]
            want = lo if at == int(at) and np.isfinite(lo) else lo + (at - np.floor(at)) * (hi - lo)
            assert row[f"q{i}"] == pytest.approx(want, rel=1e-12, nan_ok=True), (row.g, p)


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 2), ("c", None, 2), ("d", 0.5, 9)], "k string, x double, y int")
    got = {r.k: (r.rx, r.ry) for r in ordering.ranks(df, {"x": "rx", "y": "ry"}).collect()}
    assert got == {"a": (2, 3), "b": (2, 1), "c": (None, 1), "d": (1, 4)}
