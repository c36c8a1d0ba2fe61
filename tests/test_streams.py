"""The offense source and the monitor's commits."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkward.operators import logs, screening
from sparkward.sources.offenses import offense_source, whole_page
from sparkward.streaming import streams


def landed(folder):
    """A fetch function over a folder of JSON files, which stands in for the SIEM."""

    def fetch(after, until, limit):
        found = []
        for name in os.listdir(folder):
            with open(os.path.join(folder, name)) as f:
                found += [json.loads(line) for line in f]
        found = [o for o in found if o["start_time"] > after and (until is None or o["start_time"] <= until)]
        return sorted(found, key=lambda o: o["start_time"])[:limit]

    return fetch


def land(folder, name, offenses):
    with open(os.path.join(folder, name), "w") as f:
        f.writelines(json.dumps({"id": i, "severity": i % 10, "status": "OPEN" if i % 3 else "CLOSED", "start_time": t, "description": "d"}) + "\n" for i, t in offenses)


def test_pages_end_between_times(tmp_path):
    land(tmp_path, "a", [(i, i // 7) for i in range(100)])
    fetch, seen, after = landed(tmp_path), [], -1
    while page := whole_page(fetch, after, None, 10):
        assert len(page) <= 17
        seen += [o["id"] for o in page]
        after = page[-1]["start_time"]
    assert sorted(seen) == list(range(100))


def test_offenses_come_once_over_restarts(spark, tmp_path):
    folder, checkpoint = tmp_path / "siem", str(tmp_path / "checkpoint")
    folder.mkdir()
    spark.dataSource.register(offense_source(landed(str(folder)), "test_offenses"))
    got, sizes = [], []

    def sink(df, n):
        rows = [r.id for r in df.collect()]
        sizes.append(len(rows))
        got.extend(rows)

    def run(until):
        stream = spark.readStream.format("test_offenses").option("since", 4).option("page", 25).option("status", "OPEN").option("above", 5).load()
        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).start()
        try:
            for _ in range(300):
                if len(got) >= until:
                    break
                query.awaitTermination(0.2)
            query.processAllAvailable()
        finally:
            query.stop()

    land(folder, "a", [(i, 5 + i // 4) for i in range(100)] + [(1007, 4)])
    wanted = [i for i in range(100) if i % 3 and i % 10 > 5]
    run(len(wanted))
    assert sorted(got) == wanted
    land(folder, "b", [(i, 5 + i // 4) for i in range(100, 160)])
    wanted += [i for i in range(100, 160) if i % 3 and i % 10 > 5]
    run(len(wanted))
    assert sorted(got) == wanted and max(sizes) <= 28


def batch_of(spark, start, n, messages=3):
    rows = [(start + i, (start + i) * 60, f"u{i % messages}") for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, s long, user string")
    return df.select(
        "event_id", F.timestamp_seconds("s").alias("timestamp"), "user", F.col("user").alias("user_id"), F.lit("r").alias("resource"), F.lit("r").alias("resource_id"),
        F.lit("unauthorized_access").alias("type"), F.lit("x").alias("system"), F.lit("on_prem").alias("source_type"), F.lit(500).alias("status_code"), F.lit(1.0).alias("response_time")
    )


def monitor_of(spark, folder):
    listed = spark.createDataFrame([("u0", "ofac")], "name string, source string")
    return streams.Monitor(str(folder), listed, screening.default_rules(listed), logs.rule_anomalies)


def files_below(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_a_batch_that_fails_shows_nothing(spark, tmp_path, monkeypatch):
    monitor = monitor_of(spark, tmp_path)
    monitor(batch_of(spark, 0, 30), 0)
    shown = {name: monitor.stored(spark, name).count() for name in monitor.TABLES}
    assert shown["anomalies"] == 30 and shown["alerts"] == 3
    whole = screening.remediation_plan
    monkeypatch.setattr(screening, "remediation_plan", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        monitor(batch_of(spark, 100, 30), 1)
    assert {name: monitor.stored(spark, name).count() for name in monitor.TABLES} == shown
    monkeypatch.setattr(screening, "remediation_plan", whole)
    for _ in range(2):  # the second time as if the checkpoint hadn't got to know
        monitor(batch_of(spark, 100, 30), 1)
    assert monitor.stored(spark, "anomalies").count() == 60 and monitor.stored(spark, "alerts").count() == 6
    assert monitor.stored(spark, "alerts", 1).count() == 3


def test_what_a_batch_reads_of_the_past_stays_flat(spark, tmp_path):
    """Ten batches of an hour each with messages of their own: what is handed on is that of the last two hours, however many there were."""
    monitor, sizes = monitor_of(spark, tmp_path), []
    for k in range(10):
        batch = batch_of(spark, k * 60, 60).withColumn("user", F.concat("user", F.lit(f"-{k}"))).withColumn("user_id", F.col("user"))
        monitor(batch, k)
        sizes.append(monitor.handed_on(spark, k + 1).count())
    assert max(sizes) == sizes[-1] <= 9 and monitor.stored(spark, "alerts").count() == 30


def test_repeated_messages_stay_silent_over_batches(spark, tmp_path):
    monitor = monitor_of(spark, tmp_path)
    for k in range(6):
        monitor(batch_of(spark, k * 30, 30, messages=1), k)  # one message a minute for three hours
    at = [r[0] for r in monitor.stored(spark, "alerts").select(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 60).orderBy("timestamp").collect()]
    assert at == [0, 61, 122]


def test_moving_baseline_is_that_of_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"u{i % 3}", 10_000 + i, None if i % 29 == 0 else rng.gauss(10, 2) * (6 if i % 37 == 0 else 1)) for i in range(600)]
    found = spark.createDataFrame(rows, "event_id long, user_id string, s long, response_time double").select(
        "event_id", "user_id", F.timestamp_seconds("s").alias("timestamp"), F.lit("r").alias("resource"), "response_time"
    )
    expected = {r.event_id: (r.n_before, r.volume_alert) for r in logs.user_baseline(found).collect()}
    for part in ("event_id < 250", "event_id >= 250"):
        found.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), found.schema, maxFilesPerTrigger="1").withColumn("at", F.col("timestamp")).withWatermark("at", "1 hour")
    key, got = "spark.sql.streaming.stateStore.providerClass", {}
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, decay in (("a", 0.0), ("b", 0.1)):
            seen = got.setdefault(name, {})
            streams.run_available(
                streams.moving_baseline(stream, decay), str(tmp_path / name),
                lambda df, n, seen=seen: seen.update({r.event_id: (r.n_before, r.volume_alert) for r in df.collect()})
            )
    finally:
        spark.conf.unset(key)
    assert got["a"] == expected and sum(a for _, a in expected.values()) > 5
    assert got["b"] != expected and {e: n for e, (n, _) in got["b"].items()} == {e: n for e, (n, _) in expected.items()}
