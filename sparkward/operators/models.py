"""Models as table operators: isolation forest, reconstruction error, classifiers and training by client."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Trees of a forest and rows of each tree.
TREES, ROWS = 100, 256
#: Steps of training by client between two cuts of lineage.
CUT = 5


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, rng: np.random.Generator, most: int) -> list[tuple[int, float, int, int, float]]:
    """A random tree as nodes (feature, cut, left, right, path length added at a leaf); feature -1 is a leaf."""
    nodes: list = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
        if depth >= most or not len(spread):
            nodes[at] = (-1, 0.0, 0, 0, depth + average_path(len(part)))
            return at
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        low = part[:, f] < cut
        nodes[at] = (f, cut, add(part[low], depth + 1), add(part[~low], depth + 1), 0.0)
        return at

    add(x, 0)
    return nodes


def fit_forest(df: DataFrame, key: str, names: list[str], trees: int = TREES, rows: int = ROWS, seed: int = 42) -> DataFrame:
    """An isolation forest as a table of nodes: tree, node, feature, cut, left, right, depth.

    Hashes deal rows to trees: of a large table a share that is enough for four times as many rows as the
    trees take, each to one tree; in a small table each row goes to several trees. A tree takes the
    rows with the smallest hashes.
    """
    n = max(1, df.count())
    share, copies = min(1.0, 4.0 * rows * trees / n), min(trees, max(1, -(-2 * rows * trees // n)))
    base = df.select(F.col(key).alias("key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))
    h = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30))
    chosen = base.withColumn("first", h).filter(F.col("first") < int(share * (1 << 30)))
    dealt = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    near = dealt.withColumn(
        "tree", ((F.col("first") + F.col("copy")) % trees).cast("int")
    ).drop("copy").withColumn("h", F.xxhash64("key", "tree", F.lit(seed)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key"]).head(rows)
        tree = int(pdf.tree.iloc[0])
        x = pdf[names].to_numpy(float)
        nodes = grow(x, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(2, len(x))))))
        return pd.DataFrame([(tree, i, *node) for i, node in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    return near.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double, left int, right int, depth double")


def forest_scores(df: DataFrame, key: str, names: list[str], forest: DataFrame, rows: int = ROWS) -> DataFrame:
    """Scores of all rows, near 1 for those that are easy to isolate: key, score. The forest's size is fixed by its trees and rows."""
    nodes = forest.toPandas().sort_values(["tree", "node"])
    trees = [t[["feature", "cut", "left", "right", "depth"]].to_numpy() for _, t in nodes.groupby("tree")]
    norm = average_path(min(rows, max(2, int(max((len(t) for t in trees), default=2) + 1) // 2)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, total = pdf[names].to_numpy(float), np.zeros(len(pdf))
            for t in trees:
                at = np.zeros(len(pdf), int)
                while (inner := t[at, 0] >= 0).any():
                    i = np.flatnonzero(inner)
                    f = t[at[i], 0].astype(int)
                    at[i] = np.where(x[i, f] < t[at[i], 1], t[at[i], 2], t[at[i], 3]).astype(int)
                total += t[at, 4]
            yield pd.DataFrame({"key": pdf.key, "score": 2.0 ** (-(total / max(1, len(trees))) / max(norm, 1e-9))})

    return df.select(
        F.col(key).cast("long").alias("key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names)
    ).mapInPandas(run, "key long, score double")


def flagged(scores: DataFrame, contamination: float | None = None) -> DataFrame:
    """Forest scores with is_anomaly: above 0.5, or, with a contamination, the highest so large share of all rows (ties with the last of them aside)."""
    from .ordered import percentile

    cut = 0.5 if contamination is None else percentile(scores, "score", 1 - contamination)
    return scores.withColumn("is_anomaly", F.col("score") > F.lit(cut).cast("double"))


def features(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[Pipeline, list[str]]:
    """Stages that scale numbers and one-hot encode categories into a column features; unknown categories are all zeros."""
    stages = [
        VectorAssembler(inputCols=numeric, outputCol="_numbers", handleInvalid="keep"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)
    ]
    parts = ["_scaled"]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"_{c}", outputCol=f"_{c}_hot")]
        parts.append(f"_{c}_hot")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")]), parts


def reconstruction_errors(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Mean squared error of each row after projection on the main components (a quarter of the features): key, error.

    A linear stand-in for an autoencoder.
    """
    clean = df.select(F.col(key).alias("key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True),
        PCA(k=max(1, len(names) // 4), inputCol="x", outputCol="y")
    ]).fit(clean)
    axes = model.stages[-1].pc.toArray()  # features x components
    projected = model.transform(clean).select("key", vector_to_array("x").alias("x"), vector_to_array("y").alias("y"))
    back = [sum((F.col("y")[k] * float(axes[i, k]) for k in range(1, axes.shape[1])), F.col("y")[0] * float(axes[i, 0])) for i in range(len(names))]
    error = sum(
        ((F.col("x")[i] - back[i]) * (F.col("x")[i] - back[i]) for i in range(1, len(names))),
        (F.col("x")[0] - back[0]) * (F.col("x")[0] - back[0])
    ) / len(names)
    return projected.select("key", error.alias("error"))


def ensemble(scores: DataFrame, errors: DataFrame, weight: float = 0.5) -> DataFrame:
    """Forest score and reconstruction error, each scaled to 0..1, in one: key, score, error, anomaly_score."""
    from .logs import scaled

    both = written(scores.join(errors.withColumnRenamed("key", "other"), F.col("key") == F.col("other")).drop("other"))  # read for its ends, too
    both = scaled(scaled(both, "score", "a"), "error", "b")
    return both.select("key", "score", "error", (weight * F.col("a") + (1 - weight) * F.col("b")).alias("anomaly_score"))


def fit_validator(df: DataFrame, numeric: list[str], categorical: list[str], label: str, least: int = 10) -> PipelineModel | None:
    """A balanced random forest for whether anomalies are real; None with too few rows or one class."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if sum(counts.values()) < least or len(counts) < 2:
        return None
    total = sum(counts.values())
    weight = F.coalesce(*(F.when(F.col(label) == k, total / (len(counts) * n)) for k, n in counts.items()))
    stages, _ = features(df, numeric, categorical)
    forest = RandomForestClassifier(numTrees=TREES, seed=42, labelCol=label, weightCol="_weight")
    return Pipeline(stages=[*stages.getStages(), forest]).fit(df.withColumn("_weight", weight))


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with the probability of the class 1, and the highest of any class."""
    p = vector_to_array("probability")
    return model.transform(df).withColumns({"confidence": p[1], "severity": F.array_max(p)}).select(*df.columns, "confidence", "severity")


def train_by_client(df: DataFrame, client: str, names: list[str], label: str, steps: int = 100, rate: float = 0.5) -> DataFrame:
    """Logistic regression for each client by gradient steps that all clients' rows take part in: client_id, idx, value, samples_count.

    Sums of gradients are partial in each task, so a client of very many rows isn't gathered anywhere. Weights
    are cut from their lineage every CUT steps, so that plans stay small.
    """
    x = F.array(F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names))
    rows = df.select(F.col(client).alias("client_id"), x.alias("x"), F.col(label).cast("double").alias("y"))
    k = len(names) + 1
    weights = rows.groupBy("client_id").agg(F.count("*").alias("n")).select("client_id", "n", F.array(*[F.lit(0.0)] * k).alias("w"))
    for step in range(steps):
        if step and step % CUT == 0:
            weights = written(weights)
        joined = rows.join(weights, "client_id")
        dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        gap = F.col("y") - 1 / (1 + F.exp(-dot))
        sums = joined.select(
            "client_id", "n", "w", *((gap * F.col("x")[i]).alias(f"g{i}") for i in range(k))
        ).groupBy("client_id", "n", "w").agg(*(F.sum(f"g{i}").alias(f"g{i}") for i in range(k)))
        weights = sums.select("client_id", "n", F.array(*(F.col("w")[i] + rate * F.col(f"g{i}") / F.col("n") for i in range(k))).alias("w"))
    return weights.select("client_id", F.posexplode("w").alias("idx", "value"), F.col("n").alias("samples_count"))


def fit_column_classifier(profiles: DataFrame, label: str = "label", search: bool = False, folds: int = 3) -> PipelineModel:
    """A balanced classifier of column profiles (AGG features): gradient-boosted trees, by cross-validation if a search is asked for."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    names = [c for c, kind in profiles.dtypes if kind in ("boolean", "double", "int", "bigint") and c not in (label, "_weight")]
    numbers = profiles.select(label, *(F.col(c).cast("double").alias(c) for c in names))
    n, ones = numbers.agg(F.count("*"), F.sum(label)).first()
    weighted = numbers.withColumn("_weight", F.when(F.col(label) == 1, n / (2.0 * max(1.0, ones))).otherwise(n / (2.0 * max(1.0, n - ones))))
    trees = GBTClassifier(labelCol=label, weightCol="_weight", maxDepth=5, stepSize=0.05, maxIter=20, seed=42)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), trees])
    if not search:
        return pipeline.fit(weighted)
    grid = ParamGridBuilder().addGrid(trees.maxDepth, [3, 5]).addGrid(trees.maxIter, [10, 20]).build()
    return CrossValidator(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=42
    ).fit(weighted).bestModel


def fit_severity(breaches: DataFrame, numeric: list[str], categorical: list[str], label: str) -> PipelineModel:
    """A random forest for the class of a breach; the highest probability is its severity (see probability)."""
    stages, _ = features(breaches, numeric, categorical)
    return Pipeline(stages=[*stages.getStages(), RandomForestClassifier(numTrees=TREES, seed=42, labelCol=label)]).fit(breaches)


def fit_actions(breaches: DataFrame, numeric: list[str], categorical: list[str], action: str) -> PipelineModel:
    """A random forest that recommends an action: column recommended."""
    from pyspark.ml.feature import IndexToString

    index = StringIndexer(inputCol=action, outputCol="_action").fit(breaches)
    stages, _ = features(breaches, numeric, categorical)
    forest = RandomForestClassifier(numTrees=TREES, seed=42, labelCol="_action")
    return Pipeline(stages=[
        index, *stages.getStages(), forest, IndexToString(inputCol="prediction", outputCol="recommended", labels=index.labels)
    ]).fit(breaches)


def weighted_metrics(df: DataFrame, label: str = "label") -> dict[str, float]:
    """Accuracy, precision, recall and F1 of predictions, weighted by support."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    return {m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(df) for m in (
        "accuracy", "weightedPrecision", "weightedRecall", "f1"
    )}


def feature_importance(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Importance of the features of a model of trees, highest first."""
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def divided(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, so that each label has about this share of its rows in training, by a hash of the key."""
    place = F.pmod(F.xxhash64(F.col(key), F.col(label), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    return df.filter(place), df.filter(~place)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_forest(forest: DataFrame, path: str) -> None:
    """Keeps a forest as its table of nodes."""
    forest.write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles (approximate) and maximum of each numeric column: column_name and these. One scan."""
    numeric = [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]
    if not numeric:
        raise ValueError("no numeric column")

    def one(c: str):
        x = F.col(c).cast("double")
        q = F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
        parts = (
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("deviation"), F.min(x).alias("low"), q[0].alias("q1"),
            q[1].alias("median"), q[2].alias("q3"), F.max(x).alias("high")
        )
        return F.struct(F.lit(c).alias("column_name"), *parts)

    return df.agg(*(one(c).alias(f"_{i}") for i, c in enumerate(numeric))).select(F.inline(F.array(*(F.col(f"_{i}") for i in range(len(numeric))))))


def scored_or_ruled(logs: DataFrame, score) -> DataFrame:
    """Anomalies (event_id, anomaly_score) by a model's score (a function from logs to event_id and anomaly_score), or by rules with score 1.0 where score is None."""
    from .logs import above_percentile, rule_anomalies

    if score is None:
        return rule_anomalies(logs).select("event_id", "anomaly_score")
    return above_percentile(written(score(logs)), "anomaly_score").select("event_id", "anomaly_score")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Missing values and kind of each column."""
    kinds = dict(df.dtypes)
    kind = lambda c: "time" if kinds[c].startswith((
        "timestamp", "date"
    )) else "categorical" if kinds[c] in ("string", "boolean") else "numeric"
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns), F.count("*").alias("_n"))
    return counts.select(F.inline(F.array(*(F.struct(
        F.lit(c).alias("column_name"), F.lit(kind(c)).alias("kind"), F.col(c).alias("n_missing"), F.col("_n").alias("n_rows")
    ) for c in df.columns))))


def with_text_model(docs: DataFrame, score, name: str = "model_score") -> DataFrame:
    """docs with the score of a text model: score is a function from a pandas Series of texts to one of doubles, run batch by batch."""
    from pyspark.sql.functions import pandas_udf

    return docs.withColumn(name, pandas_udf(score, "double")(F.coalesce("text", F.lit(""))))


def with_entity_model(docs: DataFrame, find, name: str = "entities") -> DataFrame:
    """docs with the entities of a text model: find is a function from a pandas Series of texts to one of lists of dicts
    (entity_type, value, start, end, confidence), run batch by batch. Unknown labels and names of two characters or less are left out.
    """
    from pyspark.sql.functions import pandas_udf

    from ..functions import pii

    found = pandas_udf(find, pii.ENTITY)(F.coalesce("text", F.lit("")))
    return docs.withColumn(name, pii.plausible(pii.known_entities(found)))
