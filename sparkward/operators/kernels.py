"""A classifier with a radial kernel, by random Fourier features and a linear machine, and folds in which each label is spread evenly."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordered import row_numbers

#: Random features, widths of the kernel and penalties that are tried.
FEATURES, GAMMAS, PENALTIES = 128, (0.1, 0.5, 2.0), (0.001, 0.1)


class KernelClassifier(NamedTuple):
    """Scaling of the columns, the random waves of a width, the linear machine on them, and the area under the curve of the folds."""

    names: list[str]
    means: list[float]
    deviations: list[float]
    gamma: float
    model: LinearSVCModel
    auc: float

    def scores(self, df: DataFrame) -> DataFrame:
        """df with kernel_score, positive for label 1."""
        from pyspark.ml.functions import vector_to_array

        waved = df.withColumn("features", waves(self.names, self.means, self.deviations, self.gamma))
        margin = vector_to_array("rawPrediction")[1].alias("kernel_score")
        return self.model.transform(waved).select(*df.columns, margin)


def waves(names: list[str], means: list[float], deviations: list[float], gamma: float, features: int = FEATURES, seed: int = 42):
    """The random Fourier features of scaled columns (nulls count as 0): their products approximate exp(-gamma * distance squared)."""
    rng = np.random.default_rng(seed)
    turns = rng.normal(0, math.sqrt(2 * gamma), (features, len(names)))
    shifts = rng.uniform(0, 2 * math.pi, features)
    x = F.array(*((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, m, s in zip(names, means, deviations, strict=True)))
    rows = F.array(*(F.struct(F.array(*map(F.lit, w.tolist())).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(turns, shifts)))
    scale = math.sqrt(2 / features)
    one = lambda r: scale * F.cos(F.aggregate(F.zip_with(x, r["w"], lambda a, b: a * b), r["b"], lambda a, b: a + b))
    return array_to_vector(F.transform(rows, one))


def stratified(df: DataFrame, label: str, key: str, folds: int, name: str = "fold", seed: int = 42) -> DataFrame:
    """df with a fold (from 0) for each row, in which no label has over one row more than in another, at random by the key's hash.

    Rows of a label are numbered within ranges of the hash, so a label of any number of rows is many tasks.
    """
    placed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    numbered = row_numbers(placed, label, "_hash", key, "_number")
    return numbered.withColumn(name, F.pmod(F.col("_number") - 1, F.lit(folds)).cast("int")).drop("_hash", "_number")


def fit_kernel_classifier(
    df: DataFrame, names: list[str], label: str, key: str, folds: int = 3, gammas: tuple[float, ...] = GAMMAS, penalties: tuple[float, ...] = PENALTIES
) -> KernelClassifier:
    """The classifier of label (0 or 1) whose width and penalty are the best over stratified folds, weighted so that both labels count alike."""
    told = df.agg(*(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in names), *(F.stddev_samp(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in names), F.count("*"), F.sum(label)).first()
    means, deviations = [m or 0.0 for m in told[: len(names)]], [s or 1.0 for s in told[len(names) : 2 * len(names)]]
    n, ones = told[-2], told[-1] or 0
    if not 0 < ones < n:
        raise ValueError("rows of both labels are needed")
    weight = F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    rows = written(stratified(df.select(key, label, *names), label, key, folds).withColumns({"weight": weight, "y": F.col(label).cast("double")}))
    found = []
    for gamma in gammas:
        waved = written(rows.select("y", "weight", "fold", waves(names, means, deviations, gamma).alias("features")))
        machine = LinearSVC(labelCol="y", weightCol="weight", maxIter=50)
        grid = ParamGridBuilder().addGrid(machine.regParam, list(penalties)).build()
        judge = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction")
        fitted = CrossValidator(estimator=machine, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold").fit(waved)
        found.append(KernelClassifier(list(names), means, deviations, gamma, fitted.bestModel, max(fitted.avgMetrics)))
    return max(found, key=lambda c: c.auc)
