"""Trees as arrays against MLlib's own scores, exact medians in leaves, importance by paths against all copies."""

import numpy as np
import pytest
import pyspark.sql.functions as F

from airloom.operators import models as md
from airloom.operators import trees as tr


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(5)
    a, b, c = random.normal(size=(3, 600)).round(3)
    y = np.where(a > 0.2, 30.0, 10.0) + 4 * b + random.normal(size=600).round(3)
    split = ["train"] * 400 + ["validation"] * 100 + ["test"] * 100
    data = [(i, float(a[i]), float(b[i]), float(c[i]), 1.0, float(y[i]), split[i]) for i in range(600)]
    return spark.createDataFrame(data, "i int, a double, b double, c double, same double, y double, split string").cache()


COLUMNS = ["a", "b", "c", "same"]


def test_arrays_score_like_the_models(spark, rows):
    for model in (
        md.fit_boosted_trees(rows, COLUMNS, "y", rounds=3, depth=3),
        md.fit_random_forest(rows.filter("split = 'train'"), COLUMNS, "y", trees=3, depth=3),
    ):
        plain = {r["i"]: r["prediction"] for r in md.score(model, rows).collect()}
        arrays = {r["i"]: r["prediction"] for r in tr.score_trees(tr.ensemble(model, COLUMNS), rows).collect()}
        assert plain.keys() == arrays.keys() and all(abs(plain[i] - arrays[i]) < 1e-9 for i in plain)


def test_importance_by_paths_equals_scoring_all_copies(spark, rows):
    model = md.fit_boosted_trees(rows, COLUMNS, "y", rounds=3, depth=3)
    test = rows.filter("split = 'test'")
    plain = {r["feature"]: r for r in md.permutation_importance(test, model, COLUMNS, "y", ["i"], 3, 7).collect()}
    paths = {r["feature"]: r for r in tr.permutation_importance_by_paths(test, tr.ensemble(model, COLUMNS), "y", ["i"], 3, 7).collect()}
    assert plain.keys() == paths.keys() == set(COLUMNS)
    for name in COLUMNS:
        for column in ("importance_mean", "importance_std", "importance_positive", "importance_normalized"):
            assert abs(plain[name][column] - paths[name][column]) < 1e-9
    assert paths["same"]["importance_mean"] == 0.0 and paths["a"]["importance_mean"] > paths["c"]["importance_mean"]


def test_leaves_hold_exact_medians(spark):
    """A step with outliers: means would be far off, medians are not."""
    low, high = [1.0, 2.0, 3.0, 4.0, 1000.0], [50.0, 51.0, 52.0, 53.0, -900.0]
    data = [(0.0, v, "train") for v in low] + [(1.0, v, "train") for v in high]
    rows = spark.createDataFrame(data, "x double, y double, split string")
    model = tr.fit_absolute_trees(rows, ["x"], "y", rounds=1, depth=1, rate=1.0)
    assert len(model.trees) == 1
    out = {r["x"]: r["prediction"] for r in tr.score_trees(model, rows).collect()}
    assert out == {0.0: 3.0, 1.0: 51.0}


def test_absolute_boosting_falls_and_stops(spark, rows):
    def error(model):
        return tr.score_trees(model, rows.filter("split = 'validation'")).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]

    start = tr.Ensemble(tuple(COLUMNS), 18.0, ())
    model = tr.fit_absolute_trees(rows, COLUMNS, "y", rounds=4, depth=3, rate=0.7)
    assert error(model) < 0.5 * error(start)
    # No round of a useless column helps: the best round is the first, and the search ends after `patience` more.
    none = tr.fit_absolute_trees(rows, ["same"], "y", rounds=9, depth=2, patience=1)
    assert len(none.trees) == 1
    with pytest.raises(ValueError):
        tr.fit_absolute_trees(rows.filter("split = 'test'"), COLUMNS, "y")
