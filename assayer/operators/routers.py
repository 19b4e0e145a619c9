"""Supervised routing on oracle labels with pyspark.ml."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.policies import action_index

# Declared candidate families and their parameter grids.
GRIDS = {
    "multinomial_logistic": {"C": (0.1, 1.0, 10.0)},
    "decision_tree": {"max_depth": (3, 5, 8), "min_leaf": (5, 10, 20)},
    "gradient_boosting": {"max_depth": (3, 5), "learning_rate": (0.05, 0.1)},
}


def candidates(
    n_rows: int, families: tuple[str, ...] = tuple(GRIDS)
) -> list[tuple[str, object]]:
    """(name, estimator) for every point of the chosen families' grids.

    An inverse penalty C over a summed loss is 1/(C*n) over Spark's mean loss.
    """
    shared = {"featuresCol": "features", "labelCol": "label"}
    found = []
    for family in families:
        names = list(GRIDS[family])
        for values in product(*GRIDS[family].values()):
            p = dict(zip(names, values, strict=True))
            if family == "multinomial_logistic":
                estimator = LogisticRegression(
                    family="multinomial", regParam=1.0 / (p["C"] * max(n_rows, 1)), maxIter=100,
                    weightCol="class_weight", **shared,
                )
            elif family == "decision_tree":
                estimator = DecisionTreeClassifier(
                    maxDepth=p["max_depth"], minInstancesPerNode=p["min_leaf"], **shared
                )
            else:
                base = GBTClassifier(
                    maxDepth=p["max_depth"], stepSize=p["learning_rate"], maxIter=20
                )
                estimator = OneVsRest(classifier=base, **shared)
            label = ",".join(f"{k}={x}" for k, x in p.items())
            found.append((f"{family}({label})", estimator))
    return found


def labelled(features: DataFrame, best: DataFrame) -> DataFrame:
    """Attach the oracle arm as label and inverse-frequency class weights."""
    rows = features.join(best.select("question_id", "best_action"), "question_id").withColumn(
        "label", action_index(F.col("best_action")).cast("double")
    )
    dev = rows.filter("split = 'dev'")
    weights = dev.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = dev.agg(F.count(F.lit(1))).scalar()
    weights = weights.select("label", (total / F.col("n")).alias("class_weight"))
    return rows.join(F.broadcast(weights), "label", "left").fillna({"class_weight": 1.0})


def fit(rows: DataFrame, columns: list[str], estimator: object) -> PipelineModel:
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), estimator]
    return Pipeline(stages=stages).fit(rows.filter("split = 'dev'"))


def routed(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds the chosen arm and, where the model gives one, its confidence."""
    predicted = model.transform(rows).withColumn("arm", F.col("prediction").cast("int"))
    if "probability" in predicted.columns:
        return predicted.withColumn("confidence", F.array_max(vector_to_array("probability")))
    return predicted.withColumn("confidence", F.lit(None).cast("double"))


def select_router(
    rows: DataFrame, columns: list[str], grid: list[tuple[str, object]]
) -> tuple[str, PipelineModel]:
    """The candidate with the highest policy value on validation."""
    scored = []
    for name, estimator in grid:
        model = fit(rows, columns, estimator)
        value = policy_value(routed(model, rows.filter("split = 'validation'")))
        scored.append((value, name, model))
    best = max(scored, key=lambda s: (s[0], s[1]))
    return best[1], best[2]


def policy_value(routed_rows: DataFrame) -> float:
    value = routed_rows.agg(F.avg(F.get("rewards", F.col("arm")))).first()[0]
    return value if value is not None else float("-inf")


def router_report(name: str, routed_rows: DataFrame, *by: str) -> DataFrame:
    """Value, oracle value, regret and accuracy against the oracle."""
    earned, best = F.get("rewards", F.col("arm")), F.array_max("rewards")
    return routed_rows.groupBy(*by).agg(
        F.lit(name).alias("router"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(earned), 6).alias("policy_value"),
        F.round(F.avg(best), 6).alias("oracle_value"),
        F.round(F.avg(best - earned), 6).alias("mean_regret"),
        F.round(F.avg((F.col("arm") == F.col("label")).cast("int")), 6).alias("accuracy"),
    )


def calibrate(
    rows: DataFrame, confidence: str, correct: str, fit_split: str = "validation"
) -> DataFrame:
    """Isotonic calibration of a confidence, fitted on one split."""
    present = rows.filter(F.col(confidence).isNotNull()).withColumn(
        "__label", F.col(correct).cast("double")
    )
    model = IsotonicRegression(
        featuresCol=confidence, labelCol="__label", predictionCol="calibrated"
    ).fit(present.filter(F.col("split") == fit_split))
    return model.transform(present).drop("__label")
