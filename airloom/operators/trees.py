"""Regression trees as arrays: scoring, boosting for the absolute loss, importance by re-scoring the trees of a column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.operators.models import assembler, importance_summary, paired_orders
from airloom.operators.quantiles import exact_quantiles
from airloom.session import materialized, remove_path, scratch_path


class Tree(NamedTuple):
    """One tree, a node per position; the root is first and leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


class Ensemble(NamedTuple):
    """A constant and trees whose values are summed."""

    columns: tuple[str, ...]
    start: float
    trees: tuple[Tree, ...]


def unpack(model) -> Tree:
    """Nodes of a fitted MLlib tree, at most 2^(depth + 1)."""
    nodes: list[list] = []

    def visit(node) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            nodes[at][:2] = split.featureIndex(), split.threshold()
            nodes[at][2] = visit(node.leftChild())
            nodes[at][3] = visit(node.rightChild())
        return at

    visit(model._java_obj.rootNode())
    feature, threshold, left, right, value = zip(*nodes)
    return Tree(np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float))


def ensemble(model: Model, columns: Sequence[str]) -> Ensemble:
    """The arrays of a fitted pipeline that ends in boosted trees or a forest."""
    last = model.stages[-1]
    weights = list(last.treeWeights)
    if isinstance(last, RandomForestRegressionModel):
        weights = [w / sum(weights) for w in weights]
    trees = [unpack(t) for t in last.trees]
    return Ensemble(tuple(columns), 0.0, tuple(t._replace(value=t.value * w) for t, w in zip(trees, weights, strict=True)))


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Node at which each row ends: one step down per level, all rows at once; NaN goes right."""
    rows = np.arange(len(x))
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        feature = tree.feature[at]
        if (feature < 0).all():
            return at
        lower = x[rows, np.maximum(feature, 0)] <= tree.threshold[at]
        at = np.where(lower, tree.left[at], tree.right[at])  # a leaf leads to itself


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.array(values.tolist(), dtype=float).reshape(len(values), width)


def features(columns: Sequence[str], prefix: str = "") -> Column:
    """Columns as one array of doubles; a missing value is NaN."""
    return F.array(*[F.coalesce(F.col(f"{prefix}`{c}`").cast("double"), F.lit(float("nan"))) for c in columns])


def score_trees(model: Ensemble, rows: DataFrame) -> DataFrame:
    """Add `prediction`."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = _matrix(batch, len(model.columns))
            out = np.full(len(x), model.start)
            for tree in model.trees:
                out += tree.value[leaves(tree, x)]
            yield pd.Series(out)

    return rows.withColumn("prediction", predict(features(model.columns)))


def _leaf_of(tree: Tree, width: int):
    @F.pandas_udf("int")
    def leaf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(leaves(tree, _matrix(batch, width)), dtype="int32")

    return leaf


def fit_absolute_trees(
    rows: DataFrame, columns: Sequence[str], y: str, rounds: int = 100, depth: int = 5, rate: float = 0.1, patience: int = 20,
    tolerance: float = 1e-4, seed: int = 42,
) -> Ensemble:
    """Boosting for the mean absolute error: trees are grown on the signs of the residuals, leaves hold exact medians.

    MLlib's absolute loss leaves mean signs in the leaves, so each round moves by at most one unit whatever the scale;
    here a leaf moves by `rate` times the median residual of its training rows, found by selection. Rounds end early when
    the validation error has not fallen by `tolerance` (relative) for `patience` rounds; the trees up to the best round
    are returned. Without validation rows all rounds are kept. Per round one table of placed rows is written to the
    shared folder and the one before it removed; the driver sees a median per leaf, at most 2^depth.
    """
    spark = rows.sparkSession
    used = assembler(columns).transform(rows.filter("split IN ('train', 'validation')"))
    state = used.select("features", F.col(y).cast("double").alias("_y"), (F.col("split") == "train").alias("_train"))
    state = materialized(state.filter("_y IS NOT NULL"), "boosting")
    middle = exact_quantiles(state.filter("_train"), [], "_y", {"median": 0.5}).first()
    if middle is None:
        raise ValueError("no training rows")
    start = middle["median"]
    state = state.withColumn("_f", F.lit(start))
    trees: list[Tree] = []
    best, best_at, path = None, 0, None
    for i in range(rounds):
        signs = state.filter("_train").withColumn("_sign", F.signum(F.col("_y") - F.col("_f")))
        tree = unpack(DecisionTreeRegressor(labelCol="_sign", maxDepth=depth, seed=seed + i).fit(signs))

        written = scratch_path(spark, "boosting-round")
        state.withColumn("_leaf", _leaf_of(tree, len(columns))(vector_to_array("features"))).write.parquet(written)
        if path is not None:
            remove_path(spark, path)
        path = written
        placed = spark.read.parquet(written)
        residuals = placed.filter("_train").select("_leaf", (F.col("_y") - F.col("_f")).alias("_residual"))
        medians = {r["_leaf"]: r["median"] for r in exact_quantiles(residuals, ["_leaf"], "_residual", {"median": 0.5}).collect()}
        tree = tree._replace(value=np.array([rate * medians.get(n, 0.0) for n in range(len(tree.value))]))
        trees.append(tree)
        moves = F.array(*[F.lit(float(v)) for v in tree.value])
        state = placed.withColumn("_f", F.col("_f") + F.get(moves, F.col("_leaf"))).drop("_leaf")
        error = state.filter("not _train").agg(F.avg(F.abs(F.col("_y") - F.col("_f")))).first()[0]
        if error is None or best is None or error < best * (1 - tolerance):
            best, best_at = error, len(trees)
        elif len(trees) - best_at >= patience:
            break
    if path is not None:
        remove_path(spark, path)
    return Ensemble(tuple(columns), start, tuple(trees[:best_at]))


def permutation_importance_by_paths(
    df: DataFrame, model: Ensemble, y: str, ids: Sequence[str], repeats: int = 5, seed: int = 42
) -> DataFrame:
    """`permutation_importance` of an ensemble of trees in time linear in the trees that use a column.

    A row is scored by all trees once; for each column only the trees with a split on it are scored again with the
    donor's value, the stored values of the others stay. Columns in no tree have importance zero. Same result as scoring
    all shuffled copies, but for the order of additions; rows are not copied per column.
    """
    columns = list(model.columns)
    using = [[i for i, t in enumerate(model.trees) if (t.feature == c).any()] for c in range(len(columns))]

    @F.pandas_udf("array<double>")
    def variants(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for own, donor in batches:
            x, d = _matrix(own, len(columns)), _matrix(donor, len(columns))
            values = [t.value[leaves(t, x)] for t in model.trees]
            plain = sum(values, np.full(len(x), model.start))
            out = np.repeat(plain[:, None], 1 + len(columns), axis=1)
            for c, trees in enumerate(using):
                if trees:
                    kept = x[:, c].copy()
                    x[:, c] = d[:, c]
                    for i in trees:
                        out[:, 1 + c] += model.trees[i].value[leaves(model.trees[i], x)] - values[i]
                    x[:, c] = kept
            yield pd.Series(list(out))

    paired = paired_orders(df, columns, y, ids, repeats, seed)
    scored = paired.select("repeat", y, variants(features(columns), features(columns, "_d.")).alias("_p"))
    names = F.array(F.lit(""), *[F.lit(c) for c in columns])
    long = scored.select("repeat", y, F.posexplode("_p").alias("_i", "prediction"))
    errors = long.groupBy("_i", "repeat").agg(F.sqrt(F.avg((F.col("prediction") - F.col(y)) * (F.col("prediction") - F.col(y)))).alias("_rmse"))
    return importance_summary(errors.select(F.get(names, F.col("_i")).alias("feature"), "repeat", "_rmse"))
