"""De-duplication by composed functions against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from sparkward.operators import alerts, silence


def loop(rows, silent, before=()):
    last, kept = dict(before), []
    for key, at in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] or "", r[1])):
        if key not in last or at > last[key] + silent:
            kept.append((key, at))
            last[key] = at
    return sorted(kept, key=str)


def scanned(spark, rows, silent, before=None):
    frame = spark.createDataFrame(rows, "k string, t long").repartition(3)
    old = None if before is None else spark.createDataFrame(list(before.items()), "k string, t long")
    return sorted((tuple(r) for r in silence.after_silence(frame, "k", "t", silent, old).collect()), key=str)


@pytest.mark.parametrize(("silent", "spans", "fan", "most"), [(60, 16, 256, 5000), (60, 2, 3, 20_000), (7, 1, 2, 900), (0, 4, 4, 300), (1000, 3, 2, 5000)])
def test_scan_is_the_loop(spark, monkeypatch, silent, spans, fan, most):
    monkeypatch.setattr(silence, "SPANS", spans)
    monkeypatch.setattr(silence, "FAN", fan)
    rng = random.Random(silent + spans)
    rows = [("hot", rng.randrange(-most, most)) for _ in range(1500)] + [("b", rng.randrange(-most, most)) for _ in range(60)]
    rows += [(None, rng.randrange(most)) for _ in range(200)] + [("one", 5), ("one", 5), ("none", None)] + [("even", k * silent) for k in range(50)]
    assert scanned(spark, rows, silent) == loop(rows, silent)
    before = {"hot": -most - 3, "b": 10 * most, "new": 0, "even": -silent}
    assert scanned(spark, [r for r in rows if r[0]], silent, before) == loop([r for r in rows if r[0]], silent, before)


def test_no_times(spark):
    assert scanned(spark, [], 60) == [] and scanned(spark, [("a", None)], 60) == []


def test_a_message_that_is_never_silent_is_many_tasks(spark):
    """10^6 times of one message, three and a half seconds apart for 41 days: blocks of 16 hours in as many rows, each read in a task of its own."""
    n = 1_000_000
    found = spark.range(n).select(F.lit("same").alias("message"), F.timestamp_micros(F.col("id") * 3_500_000 + F.pmod(F.hash("id"), F.lit(1_000_000))).alias("timestamp"))
    kept = alerts.deduplicated(found)
    got = [r[0] for r in kept.select(F.unix_micros("timestamp").alias("t")).orderBy("t").collect()]
    times = [r[0] for r in found.select(F.unix_micros("timestamp").alias("t")).collect()]
    assert [("m", t) for t in got] == sorted(loop([("m", t) for t in times], 3_600_000_000), key=lambda r: r[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = alerts.deduplicated(found).withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread == int(spark.conf.get("spark.sql.shuffle.partitions"))
