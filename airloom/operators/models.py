"""Learners on MLlib and their importance measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.operators.series import numbered
from airloom.session import shared_folder


def assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error")


def fit_ridge(train: DataFrame, columns: Sequence[str], y: str, alpha: float = 1.0) -> Model:
    """Standardised ridge with the penalty on the plain sum of squares.

    MLlib scales the label and averages the loss, so the equivalent parameter is
    alpha * stddev_pop(y) / n. Its scaler divides by the sample deviation; the
    factor (n - 1) / n on the penalty makes that the population one.
    """
    facts = train.agg(F.count("*").alias("n"), F.stddev_pop(y).alias("s")).first()
    penalty = alpha * facts["s"] / facts["n"] * (facts["n"] - 1) / facts["n"]
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    line = LinearRegression(
        featuresCol="scaled", labelCol=y, elasticNetParam=0.0, regParam=penalty, standardization=False, solver="normal"
    )
    return Pipeline(stages=[assembler(columns), scaler, line]).fit(train)


def fit_boosted_trees(
    rows: DataFrame, columns: Sequence[str], y: str, rounds: int = 100, depth: int = 5, loss: str = "squared", seed: int = 42
) -> Model:
    """Boosted trees stopped early on the validation split ('squared' or 'absolute' loss)."""
    shared_folder(rows.sparkSession)
    used = rows.filter("split IN ('train', 'validation')").withColumn("_validation", F.col("split") == "validation")
    trees = GBTRegressor(
        labelCol=y, maxIter=rounds, maxDepth=depth, lossType=loss, validationIndicatorCol="_validation", seed=seed,
        checkpointInterval=10,  # the shared folder keeps the lineage short
    )
    return Pipeline(stages=[assembler(columns), trees]).fit(used)


def fit_random_forest(train: DataFrame, columns: Sequence[str], y: str, trees: int = 50, depth: int = 8, seed: int = 42) -> Model:
    forest = RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assembler(columns), forest]).fit(train)


def score(model: Model, rows: DataFrame) -> DataFrame:
    """Add `prediction`; the feature vectors are dropped again."""
    return model.transform(rows).drop("features", "scaled")


def gain_importance(spark: SparkSession, model: Model, columns: Sequence[str]) -> DataFrame:
    """Normalised split importance with its rank; one row per model column."""
    values = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "feature string, gain double")
    return rows.withColumn("gain_rank", F.rank().over(Window.orderBy(F.desc("gain"))))


def paired_orders(df: DataFrame, columns: Sequence[str], y: str, ids: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Every row once per repeat with a donor row `_d`: a join of two numberings of the rows, one in hash order and one
    in seeded hash order per repeat."""

    def order(salt: int):
        return F.xxhash64(F.lit(salt), *ids)

    def number(rows: DataFrame, salt: int) -> DataFrame:
        hashed = rows.withColumn("_hash", order(salt))
        return numbered(hashed, [], F.struct("_hash", *ids), F.shiftright("_hash", 58), "_n").drop("_hash")

    base = number(df.select(*ids, *columns, y), seed)
    donors = None
    for repeat in range(repeats):
        donor = number(df.select(*ids, *columns), seed + 1 + repeat).select(
            "_n", F.lit(repeat).alias("repeat"), F.struct(*columns).alias("_d")
        )
        donors = donor if donors is None else donors.unionByName(donor)
    return base.join(donors, "_n")


def importance_summary(errors: DataFrame) -> DataFrame:
    """Mean, deviation, positive part and share from the errors per feature and repeat; feature '' is the plain error."""
    plain = errors.filter("feature = ''").select("repeat", F.col("_rmse").alias("_base"))
    summary = (
        errors.filter("feature <> ''").join(plain, "repeat")
        .groupBy("feature")
        .agg(F.avg(F.col("_rmse") - F.col("_base")).alias("importance_mean"), F.stddev_pop(F.col("_rmse") - F.col("_base")).alias("importance_std"))
        .withColumn("importance_positive", F.greatest("importance_mean", F.lit(0.0)))
    )
    total = F.sum("importance_positive").over(Window.partitionBy())
    return summary.withColumn(
        "importance_normalized", F.when(total > 0, F.col("importance_positive") / total).otherwise(F.lit(0.0))
    )


def permutation_importance(
    df: DataFrame, model: Model, columns: Sequence[str], y: str, ids: Sequence[str], repeats: int = 5, seed: int = 42
) -> DataFrame:
    """RMSE increase of any model when one column is shuffled: mean, deviation, positive part and share.

    All shuffled copies are scored in one pass; for trees `permutation_importance_by_paths` needs no copies.
    """
    columns = list(columns)
    paired = paired_orders(df, columns, y, ids, repeats, seed)
    variants = [F.struct(F.lit("").alias("feature"), *columns)]
    for c in columns:
        variants.append(F.struct(F.lit(c).alias("feature"), *[F.col("_d")[k].alias(k) if k == c else F.col(k) for k in columns]))
    copies = paired.select("repeat", y, F.inline(F.array(*variants)))
    errors = score(model, copies).groupBy("feature", "repeat").agg(
        F.sqrt(F.avg((F.col("prediction") - F.col(y)) * (F.col("prediction") - F.col(y)))).alias("_rmse")
    )
    return importance_summary(errors)


def importance_ranks(gain: DataFrame, permuted: DataFrame) -> DataFrame:
    """Minimum-method ranks of both measures and their average; one row per model column."""
    ranked = permuted.withColumn("permutation_rank", F.rank().over(Window.orderBy(F.desc("importance_mean"))))
    return gain.join(ranked, "feature").withColumn(
        "average_rank", (F.col("gain_rank") + F.col("permutation_rank")) / F.lit(2.0)
    )
