"""Fits over fewer rows and columns give what the fits over all of them give."""

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from haulmark.operators import delay
from haulmark.plans import model_queries


@pytest.fixture(scope="module")
def rows(spark):
    """200 rows a value, late more often for small ones; ``b`` and ``c`` are missing together, ``d`` never."""
    df = spark.range(4000).selectExpr("id", "cast(id % 20 as double) a", "cast(pmod(xxhash64(id), 20) > id % 20 as int) y")
    some = F.col("id") % 7 != 0
    return df.select("*", F.when(some, F.col("id") % 11).alias("b"), F.when(some, F.col("id") % 13).alias("c"), (F.col("id") % 5).alias("d")).cache()


def test_only_telling_marks_are_fitted(rows):
    ready = delay.as_model_input(rows, ["a", "b", "c", "d"])
    assert delay.telling_marks(ready, ["m_a", "m_b", "m_c", "m_d"]) == ["m_b"]
    model = delay.fit_classifier(rows, delay.boosted(2, 3), ["a", "b", "c", "d"], [])
    assert model.stages[-2].getInputCols() == ["i_a", "i_b", "i_c", "i_d", "m_b"]
    assert delay.score(model, rows, "p", ["a", "b", "c", "d"], []).filter("p IS NULL").count() == 0


def test_weighted_rows_fit_the_same(rows, monkeypatch):
    seen, real = [], delay._weighted

    def spy(ready, estimator):
        out = real(ready, estimator)
        seen.append(out[0].count())
        return out

    for estimator in (delay.boosted(4, 3, min_leaf=300), DecisionTreeClassifier(maxDepth=1, seed=42)):
        monkeypatch.setattr(delay, "_weighted", spy)
        few = delay.fit_classifier(rows, estimator, ["a"], [])
        monkeypatch.setattr(delay, "_weighted", lambda ready, e: (ready, e))
        every = delay.fit_classifier(rows, estimator, ["a"], [])
        both = delay.score(every, delay.score(few, rows, "p", ["a"], []), "q", ["a"], [])
        assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
        assert both.select(F.round("p", 9)).distinct().count() > 1
    assert max(seen) <= 40


def test_delay_table_is_kept_as_columns(spark, folder):
    from haulmark.plans.registry import Inputs

    df = model_queries._delay_split(Inputs(spark, folder))
    assert df.select("order_id", "y").inputFiles()
