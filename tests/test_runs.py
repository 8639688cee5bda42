"""Run outputs: visible together or not at all."""

import json

import pytest

from airloom.sources.artifacts import commit_run, committed_runs, read_run


def outputs(spark, broken=False):
    forecast = spark.createDataFrame([(i, i * 0.5) for i in range(10)], "id int, value double")
    features = spark.createDataFrame([(i, None) for i in range(4)], "id int, f double")
    inputs = spark.range(3).selectExpr("if(id = 2, raise_error('lost'), id) AS id") if broken else spark.range(3)
    return {"forecast": forecast, "features": features, "inputs": inputs}


def test_a_run_is_whole_or_absent(spark, tmp_path):
    root = str(tmp_path)
    assert committed_runs(spark, root).count() == 0
    with pytest.raises(Exception, match="lost"):
        commit_run(outputs(spark, broken=True), root, "2024-01-01", {})
    assert list(tmp_path.glob("attempts/*/*/forecast.parquet"))  # two tables were written
    assert committed_runs(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        read_run(spark, root, "2024-01-01", "forecast")
    # The same run may be written again; only its whole attempt is seen.
    path = commit_run(outputs(spark), root, "2024-01-01", {"model": "m", "rows": 10}, csv=["forecast"])
    run = committed_runs(spark, root).collect()
    assert [r["run_id"] for r in run] == ["2024-01-01"] and path.endswith(run[0]["attempt"])
    assert json.loads(run[0]["metadata"]) == {"model": "m", "rows": 10}
    assert {(t["name"], t["format"]): t["row_count"] for t in run[0]["tables"]} == {
        ("forecast", "parquet"): 10, ("forecast", "csv"): 10, ("features", "parquet"): 4, ("inputs", "parquet"): 3,
    }
    assert read_run(spark, root, "2024-01-01", "features").count() == 4
    assert read_run(spark, root, "2024-01-01", "forecast", "csv").columns == ["id", "value"]


def test_a_run_is_written_once_and_named_plainly(spark, tmp_path):
    root = str(tmp_path)
    commit_run({"forecast": spark.range(2)}, root, "run-1", {})
    with pytest.raises(FileExistsError):
        commit_run({"forecast": spark.range(5)}, root, "run-1", {})
    assert read_run(spark, root, "run-1", "forecast").count() == 2
    for bad in ("", "../up", "a/b", "_hidden", "a b", ".x"):
        with pytest.raises(ValueError):
            commit_run({"forecast": spark.range(1)}, root, bad, {})
        with pytest.raises(FileNotFoundError):
            read_run(spark, root, bad, "forecast")
    with pytest.raises(ValueError):
        commit_run({}, root, "run-2", {})
    with pytest.raises(ValueError):
        commit_run({"forecast": spark.range(1)}, root, "run-2", {}, csv=["other"])


def test_an_unfinished_manifest_is_replaced(spark, tmp_path):
    (tmp_path / "commits" / "run_id=run-1" / "_temporary").mkdir(parents=True)
    assert committed_runs(spark, str(tmp_path)).count() == 0
    commit_run({"forecast": spark.range(2)}, str(tmp_path), "run-1", {})
    assert committed_runs(spark, str(tmp_path)).count() == 1
