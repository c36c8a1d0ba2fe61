"""Reconstruction errors of a small network of layers that narrow and widen again, trained by gradients that Spark sums."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Shares of the features that the layers keep, down to the middle one.
SHARES = (0.75, 0.5, 0.25)
#: Steps, rows of a step (about), the rate, and after how many steps weights are saved.
STEPS, BATCH, RATE, SAVED = 150, 4096, 0.02, 25


class Network(NamedTuple):
    """Layers of weights (inputs x outputs) and offsets; all but the last go through tanh. means and deviations scale the columns."""

    names: list[str]
    means: list[float]
    deviations: list[float]
    weights: list[np.ndarray]
    offsets: list[np.ndarray]


def widths(n: int) -> list[int]:
    down = [max(1, int(n * s)) for s in SHARES]
    return [n, *down, *reversed(down[:-1]), n]


def started(n: int, seed: int = 42) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng, sizes = np.random.default_rng(seed), widths(n)
    return [rng.normal(0, (2 / (a + b)) ** 0.5, (a, b)) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]]


def rebuilt(x: np.ndarray, weights: list[np.ndarray], offsets: list[np.ndarray]) -> list[np.ndarray]:
    """What each layer gives for the rows of x, x itself first."""
    out = [x]
    for k, (w, b) in enumerate(zip(weights, offsets, strict=True)):
        z = out[-1] @ w + b
        out.append(z if k == len(weights) - 1 else np.tanh(z))
    return out


def gradient(x: np.ndarray, weights: list[np.ndarray], offsets: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """The sum of the rows' mean squared errors, and its slopes by all weights and offsets, one after the other."""
    layers = rebuilt(x, weights, offsets)
    gap = layers[-1] - x
    back, slopes = 2 * gap / x.shape[1], []
    for k in range(len(weights) - 1, -1, -1):
        slopes += [back.sum(0), (layers[k].T @ back).ravel()]
        if k:
            back = (back @ weights[k].T) * (1 - layers[k] ** 2)
    return float((gap * gap).sum() / x.shape[1]), np.concatenate(slopes[::-1])


def flat(weights: list[np.ndarray], offsets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for pair in zip(weights, offsets, strict=True) for p in pair])


def shaped(values: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    weights, offsets, at, sizes = [], [], 0, widths(n)
    for a, b in zip(sizes, sizes[1:]):
        weights.append(values[at : at + a * b].reshape(a, b))
        offsets.append(values[at + a * b : at + a * b + b])
        at += a * b + b
    return weights, offsets


def summed_gradient(rows: DataFrame, values: np.ndarray, n: int) -> tuple[int, float, np.ndarray]:
    """Rows, loss and slopes, summed over all rows (x, an array): each task sums its own, Spark adds up what tasks give, one row for each number."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(values)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value) + 2)
        layers = shaped(held.value, n)
        for batch in batches:
            x = np.asarray(batch["x"].flatten(), float).reshape(-1, n)
            loss, slopes = gradient(x, *layers)
            total += np.concatenate([[len(x), loss], slopes])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["place", "value"])

    parts = rows.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(len(values) + 2)
    for r in parts.collect():
        total[r.place] = r.value
    held.destroy()
    return int(total[0]), float(total[1]), total[2:]


def fit_network(df: DataFrame, names: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, folder: str | None = None, saved: int = SAVED) -> Network:
    """A network that rebuilds the rows of df from a quarter of their features; nulls count as 0.

    Each step takes the rows of one part by hash, of about batch rows, sums their slopes over tasks and moves the weights (Adam). In
    folder the weights are saved each few steps, as a table, and a fit that finds some there goes on from them.
    """
    spark = df.sparkSession
    clean = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))
    told = clean.agg(*(F.avg(c) for c in names), *(F.stddev_samp(c) for c in names), F.count("*")).first()
    means, deviations, count = [m or 0.0 for m in told[: len(names)]], [s or 1.0 for s in told[len(names) : -1]], told[-1]
    scaled = F.array(*((F.col(c) - m) / s for c, m, s in zip(names, means, deviations, strict=True)))
    n = len(names)
    parts = max(1, round(count / batch))
    rows = written(clean.select(scaled.alias("x")).withColumn("part", F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int")).repartition(min(parts * 4, 200) if parts > 1 else 4, "part"))
    values = flat(*started(n))
    mean, square, first = np.zeros(len(values)), np.zeros(len(values)), 0
    if folder and (known := last_saved(spark, folder)):
        first, values, mean, square = known
    for step in range(first, steps if count else first):
        size, _, slopes = summed_gradient(rows if parts == 1 else rows.filter(F.col("part") == step % parts), values, n)
        if not size:
            continue
        slopes = slopes / size
        mean, square = 0.9 * mean + 0.1 * slopes, 0.99 * square + 0.01 * slopes**2
        values = values - rate * (mean / (1 - 0.9 ** (step + 1))) / (np.sqrt(square / (1 - 0.99 ** (step + 1))) + 1e-8)
        if folder and (step + 1) % saved == 0:
            state = [(step + 1, json.dumps([values.tolist(), mean.tolist(), square.tolist()]))]
            spark.createDataFrame(state, "step int, state string").coalesce(1).write.mode("append").parquet(folder)
    return Network(names, means, deviations, *shaped(values, n))


def last_saved(spark, folder: str) -> tuple | None:
    """The latest state in a folder: steps done, weights, and Adam's two means."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.parquet(folder).orderBy(F.desc("step")).first()
    return (row.step, *map(np.array, json.loads(row.state))) if row else None


def network_errors(df: DataFrame, key: str, network: Network) -> DataFrame:
    """The mean squared error of each row after it went through the network: key, error."""
    n = len(network.names)
    scaled = F.array(*((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, m, s in zip(network.names, network.means, network.deviations, strict=True)))
    rows = df.select(F.col(key).alias("key"), scaled.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch["x"].flatten(), float).reshape(-1, n)
            gap = rebuilt(x, network.weights, network.offsets)[-1] - x
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array((gap * gap).mean(1))], names=["key", "error"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, error double")
