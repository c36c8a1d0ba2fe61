"""Blocks with halos, totals within groups, and the learned sequence score."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkward.operators import alerts, anonymize, logs, ordered, recursive
from sparkward.streaming import streams

ROWS = "event_id long, user_id string, timestamp timestamp, response_time double"


def some_logs(spark, seed=1, n=3000):
    """A user with two thirds of all rows, some others, ties in time and missing values."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", "hot", "hot", "b", "c", None]), rng.randrange(n // 2), None if rng.random() < 0.05 else rng.gauss(10, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, user_id string, s long, response_time double").select(
        "event_id", "user_id", F.timestamp_seconds("s").alias("timestamp"), "response_time"
    )


@pytest.mark.parametrize("rows", [10, 64, 16_384])
def test_sequences_in_blocks_are_those_of_the_whole_user(spark, rows):
    found = some_logs(spark)
    before = Window.partitionBy("user_id").orderBy("timestamp", "event_id").rowsBetween(-10, -1)
    whole = found.filter("response_time IS NOT NULL").withColumn("sequence", F.collect_list("response_time").over(before)).filter(F.size("sequence") == 10)
    expected = {r.event_id: (r.user_id, r.sequence, r.response_time) for r in whole.collect()}
    assert {r.event_id: (r.user_id, r.sequence, r.target) for r in logs.sequences(found, rows=rows).collect()} == expected
    a, b = ({r.event_id: (r.window_mean, r.distance) for r in logs.sequence_windows(found, rows=k).collect()} for k in (rows, 10**6))
    assert a == b and len(a) > 2000


def test_a_hot_user_is_many_tasks(spark):
    found = some_logs(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = logs.sequences(found.filter("user_id = 'hot'"), rows=64).withColumn("task", F.spark_partition_id())
        assert tasks.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_totals_within_groups(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 2 else rng.choice("abc"), i % 3, i, rng.randrange(9)) for i in range(2000)] + [(None, None, -1, 4)]
    df = spark.createDataFrame(rows, "g string, h int, x long, n long")
    got = {(r.g, r.h, r.x): r.cum for r in ordered.running_totals_within(df, ["g", "h"], "x", "n", "cum", 16).collect()}
    assert got == {(g, h, x): sum(r[3] for r in rows if r[:2] == (g, h) and r[2] <= x) for g, h, x, _ in rows}
    names = {(r.g, r.h, r.x): r.cum for r in ordered.running_totals_within(df.withColumn("x", F.lpad(F.col("x").cast("string"), 5, "0")), ["g", "h"], "x", "n", "cum").collect()}
    assert sorted(names.values()) == sorted(got.values())


def test_ks_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    values = [("hot" if i % 2 else "cold", float(v)) for i, v in enumerate(rng.normal(size=2000) + np.tile([0, 0.3], 1000))]
    c = anonymize.Config(quasi_identifiers=("g",), sensitive=("v",))
    got = {r.g: r.statistic for r in anonymize.ks_statistics(spark.createDataFrame(values, "g string, v double"), c, "v").collect()}
    everything = np.sort([v for _, v in values])
    for group in ("hot", "cold"):
        own = np.sort([v for g, v in values if g == group])
        apart = np.abs(np.searchsorted(own, everything, "right") / len(own) - np.arange(1, 2001) / 2000).max()
        assert got[group] == pytest.approx(apart)


def drifting(spark, seed=7, users=6, n=600):
    """Users whose values drift slowly for a while: rows, and which of them drift."""
    rng, rows, planted, k = np.random.default_rng(seed), [], set(), 0
    for user in range(users):
        level = rng.uniform(20, 40)
        for t in range(n):
            drift = 0.25 * (t - 400) if 400 <= t < 440 else 0.0
            rows.append((k, f"u{user}", t, float(level + drift + rng.normal())))
            if drift >= 1.0:
                planted.add(k)
            k += 1
    frame = spark.createDataFrame(rows, "event_id long, user_id string, s long, response_time double")
    return frame.select("event_id", "user_id", F.timestamp_seconds("s").alias("timestamp"), "response_time"), planted


def auc(scores, planted):
    order = sorted(scores, key=scores.get)
    ranks = {e: i + 1 for i, e in enumerate(order)}
    good = len(order) - len(planted)
    return (sum(ranks[e] for e in planted) - len(planted) * (len(planted) + 1) / 2) / (len(planted) * good)


def test_learned_score_finds_drifts_that_the_window_misses(spark):
    found, planted = drifting(spark)
    fitted = recursive.fit_filter(found.filter(F.unix_seconds("timestamp") < 400))  # the history before the drifts
    assert fitted.gain < 0.15 and 0.9 < fitted.spread < 1.3
    learned = {r.event_id: r.level_score for r in recursive.level_scores(found, fitted).collect()}
    window = {r.event_id: r.distance for r in logs.sequence_windows(found).collect()}
    both = {e: learned[e] for e in window}
    assert auc(both, planted) > auc(window, planted) + 0.2


@pytest.mark.parametrize("rows", [2000, 600])
def test_blocks_score_as_one_pass(spark, rows):
    found = some_logs(spark, 9, 6000)
    fitted = recursive.Filter(0.1, 3.0)
    got = {r.event_id: r.level_score for r in recursive.level_scores(found, fitted, rows).collect()}
    by_user = {}
    for r in sorted(found.filter("response_time IS NOT NULL").collect(), key=lambda r: (r.timestamp, r.event_id)):
        by_user.setdefault(r.user_id, []).append(r)
    for own in by_user.values():
        scores, *_ = recursive.followed(np.array([r.response_time for r in own]), 0.1)
        assert np.allclose([got[r.event_id] for r in own], scores, atol=1e-6)


def test_gain_follows_the_data(spark):
    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.normal(size=4000))
    still = 5 + rng.normal(size=4000)
    gains = []
    for values in (walk, still, np.full(100, 3.0)):
        rows = [(i, "u", i, float(v)) for i, v in enumerate(values)]
        frame = spark.createDataFrame(rows, "event_id long, user_id string, s long, response_time double")
        gains.append(recursive.fit_filter(frame.withColumn("timestamp", F.timestamp_seconds("s"))).gain)
    assert gains[0] > 0.8 and gains[1] < 0.15 and gains[2] == recursive.LEAST_GAIN
    empty = spark.createDataFrame([], ROWS)
    assert recursive.level_scores(empty, recursive.fit_filter(empty)).count() == 0


def test_stream_scores_as_the_batch(spark, tmp_path):
    found = some_logs(spark, 11, 400).filter("response_time IS NOT NULL AND user_id IS NOT NULL")
    fitted = recursive.Filter(0.2, 3.0)
    expected = {r.event_id: pytest.approx(r.level_score) for r in recursive.level_scores(found, fitted).collect()}
    middle = F.lit(100)
    for k, part in enumerate((F.unix_seconds("timestamp") < middle, F.unix_seconds("timestamp") >= middle)):
        found.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), found.schema, maxFilesPerTrigger="1").withColumn("at", F.col("timestamp"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}
    try:
        streams.run_available(
            recursive.stream_level_scores(stream, fitted), str(tmp_path / "checkpoint"), lambda df, n: got.update({r.event_id: r.level_score for r in df.collect()})
        )
    finally:
        spark.conf.unset(key)
    assert got == expected and alerts.MINUTES == 60
