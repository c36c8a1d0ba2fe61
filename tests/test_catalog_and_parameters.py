"""A walk over all databases, feedback as rows, and parameters by version."""

import datetime as dt

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkward.operators import alerts, catalog
from sparkward.sources import readers


def test_all_schemas_are_walked(spark):
    names = {"walk_a": ["t1", "broken"], "walk_b": ["t2"], "walk_sys": ["t3"]}
    try:
        for schema, tables in names.items():
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
            for t in tables:
                spark.sql(f"DROP TABLE IF EXISTS {schema}.{t}")
                spark.range(3 if t == "t1" else 5).write.saveAsTable(f"{schema}.{t}")
        spark.range(1).createOrReplaceTempView("walk_view")

        def profile(df):
            if df.count() == 5 and "walk_a" in str(df.inputFiles()):
                raise PySparkException("can't be profiled\nfor some reason")
            return df.agg(F.count("*").alias("n"))

        made, told = readers.scan_catalog(spark, profile, system=("walk_sys", "default"))
        assert {(r.schema_name, r.table_name): r.n for r in made.collect()} == {("walk_a", "t1"): 3, ("walk_b", "t2"): 5}
        assert sorted((r.schema_name, r.table_name, r.status) for r in told.collect()) == [
            ("walk_a", "broken", "failed"), ("walk_a", "t1", "profiled"), ("walk_b", "t2", "profiled")
        ]
        assert told.filter("status = 'failed'").first().error == "can't be profiled"
        nothing, none = readers.scan_catalog(spark, profile, system=("walk_sys", "walk_a", "walk_b", "default"))
        assert nothing is None and none.count() == 0
    finally:
        for schema in names:
            spark.sql(f"DROP DATABASE IF EXISTS {schema} CASCADE")


def test_feedback_rows(spark, tmp_path):
    path = str(tmp_path / "feedback")
    readers.record_feedback(spark, path, "a", True, "unusual_transfer", context={"score": 0.7, "user": None})
    readers.record_feedback(spark, path, "b", False, "other", "model", {"score": 0.1})
    readers.record_feedback(spark, path, "a", False, "unusual_transfer", context={"score": 0.8})
    got = {r.anomaly_id: (r.is_true_positive, r.feedback_source, r.score) for r in readers.feedback(spark, path).collect()}
    assert got == {"a": (False, "human", "0.8"), "b": (False, "model", "0.1")}


def test_scan_summary(spark, tmp_path):
    results = spark.createDataFrame([(None, 2, 10), ("no text", 0, None)], "error string, pii_count int, bytes long")
    readers.scan_summary_row(catalog.scan_totals(results, F.lit(2.0))).write.json(str(tmp_path / "summary"))
    row = spark.read.json(str(tmp_path / "summary")).first()
    assert (row.n_files, row.n_success, row.n_failed, row.n_sensitive, row.status) == (2, 1, 1, 1, "completed") and len(row.scan_id) == 14


def test_parameters_by_version(spark, tmp_path):
    path, used = str(tmp_path / "parameters"), str(tmp_path / "used")
    assert readers.latest_parameters(spark, path) == (0, {}) and readers.batch_parameters(spark, path, used, 0) == (0, {})
    assert readers.put_parameters(spark, path, threshold=0.9, contamination=0.1) == 1
    assert readers.batch_parameters(spark, path, used, 1) == (1, {"threshold": 0.9, "contamination": 0.1})
    assert readers.put_parameters(spark, path, threshold=0.8) == 2
    assert readers.latest_parameters(spark, path) == (2, {"threshold": 0.8, "contamination": 0.1})
    # batches that run again have what they had
    assert readers.batch_parameters(spark, path, used, 1)[0] == 1 and readers.batch_parameters(spark, path, used, 0) == (0, {})
    assert readers.batch_parameters(spark, path, used, 2)[0] == 2


def test_parameters_follow_feedback_once_the_gate_is_open(spark, tmp_path):
    path, now = str(tmp_path / "parameters"), dt.datetime(2026, 1, 3)
    rows = [(i, i % 4 == 0, 1.0 if i % 4 == 0 else 0.2, dt.datetime(2026, 1, 2)) for i in range(60)]
    said = spark.createDataFrame(rows, "id int, is_true_positive boolean, error double, timestamp timestamp")
    observed = said.select("error", F.col("is_true_positive").alias("positive"))
    for last, version in ((dt.datetime(2026, 1, 2, 12), None), (dt.datetime(2026, 1, 1), 1)):
        gate = alerts.should_retrain(said, F.lit(last), F.lit(now))
        assert readers.retune(spark, path, gate, alerts.feedback_statistics(said), alerts.best_threshold(observed)) == version
    assert readers.latest_parameters(spark, path) == (1, {"threshold": 1.0, "contamination": 0.25})
