"""Rings that no line separates, and folds."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkward.operators import columns, kernels


def rings(spark, n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        label = int(i % 3 == 0)
        turn, radius = rng.uniform(0, 2 * math.pi), rng.gauss(3 if label else 1, 0.25)
        rows.append((i, label, 10 + radius * math.cos(turn), 100 * radius * math.sin(turn)))
    return spark.createDataFrame(rows, "id long, label int, x double, y2 double")


def test_rings_are_separated(spark):
    train, test = rings(spark, 600, 1), rings(spark, 300, 2)
    fitted = kernels.fit_kernel_classifier(train, ["x", "y2"], "label", "id", gammas=(0.01, 1.0), penalties=(0.01,))
    scored = fitted.scores(test).withColumn("right", (F.col("kernel_score") > 0) == (F.col("label") == 1))
    assert fitted.auc > 0.98 and scored.agg(F.avg(F.col("right").cast("int"))).first()[0] > 0.95
    flat = VectorAssembler(inputCols=["x", "y2"], outputCol="features")
    line = LinearSVC(labelCol="label").fit(flat.transform(train)).transform(flat.transform(test))
    assert BinaryClassificationEvaluator(labelCol="label").evaluate(line) < 0.7


@pytest.mark.parametrize("folds", [2, 3, 5])
def test_folds_are_even_for_each_label(spark, folds):
    df = spark.createDataFrame([(i, "rare" if i % 17 == 0 else "common" if i % 2 else None) for i in range(500)], "id long, label string")
    got = kernels.stratified(df, "label", "id", folds).collect()
    assert len(got) == 500 and {r.fold for r in got} == set(range(folds))
    counts = Counter((r.label, r.fold) for r in got)
    for label in ("rare", "common", None):
        sizes = [counts[label, f] for f in range(folds)]
        assert max(sizes) - min(sizes) <= 1
    again = {r.id: r.fold for r in kernels.stratified(df.repartition(7), "label", "id", folds).collect()}
    assert again == {r.id: r.fold for r in got}


def test_one_label_is_an_error(spark):
    with pytest.raises(ValueError, match="both labels"):
        kernels.fit_kernel_classifier(rings(spark, 30, 1).filter("label = 0"), ["x"], "label", "id")


def test_heuristics_need_no_shuffle_of_cells(spark):
    df = spark.createDataFrame([(1, "a@b.c", "x", None), (2, None, "123-45-6789", None), (3, "z", "y", None)], "n int, mail string, code string, e string")
    got = {r.column_name: (r.classification, r.confidence) for r in columns.heuristics(df).collect()}
    assert got["code"] == got["mail"] == ("sensitive", 0.7) and got["n"] == got["e"] == ("non-sensitive", 0.6)
    assert columns.heuristics(df.limit(0)).count() == 4
