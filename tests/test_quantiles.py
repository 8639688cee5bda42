"""Quantiles by selection against numpy on awkward distributions, and what their plan may hold."""

import math
import random

import numpy as np
import pytest

from airloom.operators import quantiles as qu
from airloom.operators.quantiles import exact_quantiles

WANTED = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


def groups():
    rng = random.Random(8)
    return {
        "hot": [float(rng.choice([1, 2, 2, 2, 3])) for _ in range(4000)],
        "tiny": [rng.random() * 1e-9 for _ in range(501)],
        "signed": [rng.gauss(0, 30) for _ in range(2000)],
        "near": [1e6 + rng.random() * 1e-3 for _ in range(1500)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(900)],
        "ends": [-1e308, 1e308, 0.0, -0.0, 5e-324, 2.5],
        "one": [4.0],
        "two": [-1.0, 3.0],
    }


def test_equal_numpy(spark):
    data = groups()
    rows = [(k, v) for k, values in data.items() for v in values] + [("hot", None), ("none", None)]
    random.Random(1).shuffle(rows)
    out = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", WANTED).collect()}
    assert set(out) == set(data)
    for k, values in data.items():
        with np.errstate(over="ignore", invalid="ignore"):
            for name, p in WANTED.items():
                assert out[k][name] == pytest.approx(np.quantile(np.array(values), p), rel=1e-12, abs=1e-15), (k, name)


def test_infinities_and_nan_keep_their_places(spark):
    rows = [(float("-inf"),), (1.0,), (float("inf"),), (float("nan"),), (float("nan"),)]
    out = exact_quantiles(spark.createDataFrame(rows, "v double"), [], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}).first()
    assert (out["a"], out["b"], out["c"]) == (float("-inf"), 1.0, float("inf")) and math.isnan(out["d"])


def test_wanted_slices_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(qu, "BROADCAST_ROWS", 0)
    values = [random.Random(i).gauss(0, 5) for i in range(3000)]
    out = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", {"m": 0.5}).first()
    assert out["m"] == pytest.approx(np.median(values), rel=1e-12)


def test_only_values_near_a_rank_are_shuffled(spark):
    df = spark.range(200_000).selectExpr("cast(id % 7 as string) k", "rand(3) * 400 v")
    out = exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "_salt" not in plan
    assert out.count() == 7


def test_no_values(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"m": 0.5}).count() == 0
