import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from sparkward.operators import actions, alerts, audit, models, screening
from sparkward.sources import readers
from sparkward.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_reports_and_chains_in_files(spark, tmp_path):
    report = spark.createDataFrame([(1, "x")], "n int, t string")
    readers.store_report(report, "gdpr", F.lit(T0), 2, f"{tmp_path}/reports")
    stored = spark.read.parquet(f"{tmp_path}/reports")
    assert readers.reports_of(stored, "gdpr", F.lit(T0), F.lit(T0 + dt.timedelta(1))).count() == 1 and readers.reports_of(stored, "ccpa").count() == 0
    assert [df.count() for df in readers.without_expired(stored, F.lit(T0 + dt.timedelta(800)))] == [0, 1]
    assert spark.read.csv(readers.export_report(report, "gdpr", "1", str(tmp_path)), header=True).count() == 1
    entry = spark.createDataFrame(
        [(1, 1, "e", "k", "t", "u", "o")],
        "log_id long, seq long, entry_id string, entry_type string, timestamp string, user_id string, operation string"
    )
    readers.export_chain(audit.build_chain(entry, b"k"), f"{tmp_path}/chain")
    assert audit.verify_chain(readers.import_chain(spark, f"{tmp_path}/chain"), b"k").count() == 0


def test_actions_and_queues(spark):
    breaches = spark.createDataFrame(
        [(1, "ofac", "high", "ann"), (2, "bis", "low", None)], "breach_id long, breach_type string, confidence string, user string"
    )
    plan = screening.remediation_plan(breaches, screening.default_rules(breaches))
    known = actions.Actions()
    known.register("access_revocation", lambda b: readers.revocations(b, "rule"))
    known.register("email_alert", lambda b: readers.email_outbox(b, (), "me"))
    out = known.run(plan, breaches)
    assert out["access_revocation"].count() == 1 and out["email_alert"].count() == 0
    assert known.status(plan).filter("state = 'skipped'").count() == 2 and actions.counters(
        plan, screening.default_rules(breaches)
    ).first().n_rules == 7
    queue = alerts.review_queue(spark.createDataFrame(
        [(1, 5, "low", 0.9), (2, 3, "high", 0.9)], "review_id long, queued_at long, severity string, confidence double"
    ))
    assert alerts.next_item(queue).first().review_id == 2
    done, left = alerts.submitted(queue, spark.createDataFrame([(2, True, None)], "review_id long, is_true_positive boolean, notes string"))
    assert (done.count(), left.count()) == (1, 1)
    found = spark.createDataFrame([("m", T0), ("n", T0)], "message string, timestamp timestamp")
    stored = spark.createDataFrame(
        [("m", T0 - dt.timedelta(minutes=60)), ("n", T0 - dt.timedelta(minutes=61))], "message string, timestamp timestamp"
    )
    assert [r.message for r in alerts.not_repeated(found, stored).collect()] == ["n"]


def test_classifiers(spark):
    rng = random.Random(1)
    rows = [(float(i % 2), rng.random() + (i % 2), "ab"[i % 2], ["log", "mail"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "label double, x double, k string, action string")
    assert models.weighted_metrics(models.fit_column_classifier(df.select("label", "x")).transform(df))["accuracy"] > 0.9
    out = models.fit_actions(df, ["x"], ["k"], "action").transform(df)
    assert out.filter("recommended = action").count() > 55
    profile = {r.column_name: (r.kind, r.n_missing) for r in models.dataset_profile(df).collect()}
    assert profile["k"] == ("categorical", 0) and profile["x"] == ("numeric", 0)
    texts = spark.createDataFrame([("ab",), (None,)], "text string")
    assert sorted(r.model_score for r in models.with_text_model(texts, length_score).collect()) == [0.0, 2.0]


def length_score(texts: pd.Series) -> pd.Series:
    return texts.str.len().astype(float)


def test_stream_dedup_is_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(minutes=rng.randrange(900))) for _ in range(80)]
    df = spark.createDataFrame(rows, "message string, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = streams.deduplicated(streams.timed(streams.read_files(spark, f"{tmp_path}/in", df.schema)))
        streams.run_available(stream, f"{tmp_path}/state", lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out"))
    finally:
        spark.conf.unset(conf)
    batch = alerts.deduplicated(df.withColumnRenamed("ts", "timestamp")).select("message", F.unix_micros("timestamp"))
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {tuple(r) for r in batch.collect()}
