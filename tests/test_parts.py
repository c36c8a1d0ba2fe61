"""Readers, outboxes, reviews, models and streams that no query shows by itself."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkward.functions import pii, protect
from sparkward.operators import actions, alerts, audit, catalog, columns, logs, models, reports, screening
from sparkward.sources import readers
from sparkward.streaming import streams

T0 = dt.datetime(2024, 1, 1)
LIST = "name string, source string"


def at(**kwargs):
    return T0 + dt.timedelta(**kwargs)


def stamp(value):
    return F.lit(value).cast("timestamp")


def test_screening_list_is_read_anew_and_survives_failures(spark, tmp_path):
    path, now = tmp_path / "list.json", [0.0]
    write = lambda *names: path.write_text(json.dumps({"results": [{"name": n, "source": "OFAC - x"} for n in names]}))
    with pytest.raises(Exception):
        readers.ScreeningList(spark, str(path)).current()
    write("Ann", "ANN", "Bob")
    listed = readers.ScreeningList(spark, str(path), 100, lambda: now[0])
    assert listed.size() == 2
    write("Ann")
    assert listed.size() == 2  # not yet old
    now[0] = 101
    assert listed.size() == 1
    path.unlink()
    now[0] = 300
    assert listed.size() == 1 and listed.error


def test_sources_are_ingested_by_state(spark, tmp_path):
    spark.createDataFrame([(at(days=i), f"u{i}") for i in range(5)], "timestamp timestamp, user string").write.json(f"{tmp_path}/a")
    sources = [
        ("on_prem", "a", f"{tmp_path}/a", "json", 30), ("on_prem", "gone", f"{tmp_path}/none", "json", 30),
        ("on_prem", "odd", f"{tmp_path}/a", "xml", 30)
    ]
    registry = spark.createDataFrame(sources, "source_type string, name string, path_pattern string, format string, max_age_days int")
    read = spark.createDataFrame([("a", at(days=1)), ("a", at(days=2))], "name string, last_time timestamp")
    states = readers.source_states(registry, read)
    assert {r.name: r.state for r in states.collect()} == {"a": "known", "gone": "new", "odd": "new"}
    parts, failed = readers.ingest(spark, states, stamp(at(days=10)))
    assert {r.user for r in parts["a"].collect()} == {"u3", "u4"} and set(failed) == {"gone", "odd"}
    assert readers.since(parts["a"], stamp(None), stamp(at(days=33, hours=12)), 30).count() == 1
    results = {r.source: (r.n_rows, r.state) for r in readers.ingestion_results({"a": parts["a"], "b": parts["a"].limit(0)}).collect()}
    assert results == {"a": (2, "success"), "b": (0, "empty")}
    both = logs.united({"x": parts["a"], "y": parts["a"]})
    assert tuple(both.columns) == logs.LOG_COLUMNS and both.filter("source = 'y'").count() == 2


def test_feedback_scans_and_states(spark, tmp_path):
    rows = [{
        "anomaly_id": "a", "is_true_positive": bool(i), "anomaly_type": "t", "feedback_source": "human", "timestamp": f"2024-01-0{1 + i}",
        "context": {"score": i}
    } for i in range(2)]
    for i, row in enumerate([*rows, {**rows[0], "anomaly_id": "b"}]):
        (tmp_path / f"feedback_{i}.json").write_text(json.dumps(row))
    out = {r.anomaly_id: r for r in readers.feedback(spark, f"{tmp_path}/feedback_*.json").collect()}
    assert out["a"].is_true_positive and out["a"].score == 1 and not out["b"].is_true_positive
    assert readers.feedback(spark, f"{tmp_path}/feedback_*.json", 1).first().anomaly_id == "a"
    spark.createDataFrame([(1, "x")], "id int, s string").createOrReplaceTempView("scanned")
    done, failed = readers.scan_tables(spark, ["scanned", "not_there"], columns.profile)
    assert done[0].count() == 2 and list(failed) == ["not_there"]
    history = spark.createDataFrame(
        [("s", "running", T0), ("s", "completed", at(hours=1)), ("t", "b", T0), ("t", "a", T0)],
        "scan_id string, status string, recorded_at timestamp"
    )
    assert {r.scan_id: r.status for r in readers.latest_state(history).collect()} == {"s": "completed", "t": "b"}  # ties by the columns
    readers.append(history, f"{tmp_path}/h")
    readers.cleared(history, f"{tmp_path}/h2")
    assert spark.read.parquet(f"{tmp_path}/h").count() == 4 and spark.read.parquet(f"{tmp_path}/h2").count() == 0


def test_cells_samples_and_offenses(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else f"v{i}") for i in range(10)], "id int, s string")
    assert readers.column_texts(df).count() == 15 and readers.column_texts(df, 3).groupBy("column_name").count().filter("count = 3").count() == 2
    assert readers.sample_query("public.users", 1, 1000) == "SELECT * FROM public.users TABLESAMPLE SYSTEM (1.0) LIMIT 1000"
    with pytest.raises(ValueError):
        readers.sample_query("users; DROP TABLE x", 1, 1)
    offense = [{"id": i, "status": "OPEN" if i % 2 else "CLOSED", "severity": i, "start_time": i * 10} for i in range(12)]
    (tmp_path / "o.json").write_text("\n".join(map(json.dumps, offense)))
    assert sorted(r.id for r in readers.offenses(spark, str(tmp_path), 70).collect()) == [9, 11]
    assert sorted(r.id for r in readers.offenses(spark, str(tmp_path), 0, "CLOSED", 8).collect()) == [10]


def test_outboxes(spark):
    breaches = spark.createDataFrame(
        [(1, "ofac", None, "/d/a.txt"), (2, "bis", "bob", "/d/none.txt")],
        "breach_id long, breach_type string, user string, resource_path string"
    )
    files = spark.createDataFrame([("/d/a.txt",)], "path string")
    moved = readers.quarantine(breaches, files, stamp(T0)).collect()
    assert [(r.breach_id, r.quarantine_name) for r in moved] == [(1, "20240101000000_a.txt")]
    mails = readers.email_outbox(breaches, ("me@example.com",), "from@example.com", test_mode=True)
    assert mails.filter("state = 'test'").count() == 2
    lines = audit.breach_lines(breaches.withColumn("resource", F.col("resource_path")), "rule", stamp(T0)).orderBy("breach_id").collect()
    assert [r.user for r in lines] == ["unknown", "bob"] and lines[0].rule == "rule"
    rows = screening.breach_rows(spark.createDataFrame(
        [(1, None, "", True, False, None), (2, "u", "r", False, True, 0.95)],
        "event_id long, user string, resource string, ofac_match boolean, bis_match boolean, match_score double"
    ))
    assert sorted(map(tuple, rows.collect())) == [(1, "ofac", "unknown", "unknown", "medium"), (2, "bis", "u", "r", "high")]
    plan = spark.createDataFrame([(1, "a", "ai"), (1, "b", "rule"), (2, "b", "rule")], "breach_id long, action string, origin string")
    assert tuple(actions.counters(plan, plan.limit(1)).first()) == (3, 2, 1, 2, 1)


def test_reviews_and_levels(spark):
    items = spark.createDataFrame([(1, T0), (2, at(days=40))], "id int, queued_at timestamp")
    assert [df.count() for df in alerts.expired(items, stamp(at(days=41)))] == [1, 1]
    feedback = spark.createDataFrame([(at(hours=i),) for i in range(60)], "timestamp timestamp")
    assert alerts.should_retrain(feedback, stamp(at(hours=5)), stamp(at(hours=70))).first().retrain
    assert not alerts.should_retrain(feedback, stamp(at(hours=20)), stamp(at(hours=70))).first().retrain
    assert not alerts.should_retrain(feedback, stamp(at(hours=5)), stamp(at(hours=6))).first().retrain
    stored = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, value double")
    expected = spark.createDataFrame([(1, 1.000001), (2, 2.1)], "id int, value double")
    assert {r.id: r.holds for r in alerts.predictions_hold(stored, expected).collect()} == {1: True, 2: False}
    scores = spark.createDataFrame([(x,) for x in (0.7, 0.75, 0.9, 0.99)], "s double")
    assert [r[0] for r in scores.select(alerts.alert_level(F.col("s"))).collect()] == [None, "low", "medium", "high"]
    one = spark.createDataFrame([(7, None, 1.5, T0)], "a int, b string, c double, t timestamp")
    got = one.select(alerts.details_json(one, ["a", "b", "c"]), alerts.review_id(F.col("a"), F.col("t"))).first()
    assert json.loads(got[0]) == {"a": "7", "c": "1.5"} and got[1] == f"7_{int((T0 - dt.datetime(1970, 1, 1)).total_seconds())}"
    tables = [
        spark.createDataFrame(rows, schema) for rows,
        schema in (([("x", True), ("y", False)], "anomaly_id string, predicted boolean"), ([("x", True)], "anomaly_id string, is_true_positive boolean"), ([("x", False), ("z", True)], "anomaly_id string, actual boolean"))
    ]
    assert [tuple(r) for r in alerts.labelled_outcomes(*tables).collect()] == [("x", True, True, False)]


def test_catalog_texts_and_reports(spark):
    found = F.array(*(F.struct(F.lit(t).alias("entity_type"), F.lit("v").alias("value")) for t in ("Email Address", "Nonsense", "Location")))
    assert len(spark.range(1).select(pii.known_entities(found).alias("x")).first().x) == 2
    assert len(spark.range(1).select(pii.truncated(F.repeat(F.lit("x"), 2000)).alias("x")).first().x) == int(512 * 2.2 * 0.92)
    records = spark.createDataFrame([("a", T0), ("b", at(days=1)), ("c", None)], "record_id string, created_at timestamp")
    assert [r.record_id for r in catalog.search(records, newest="created_at").collect()] == ["b", "a", "c"]
    assert spark.range(1).select(reports.expiry(stamp(T0), 2).alias("x")).first().x.replace(tzinfo=None) == at(days=730)
    schedules = spark.createDataFrame(
        [(1, "gdpr", True), (2, "ccpa", True), (3, "gdpr", False)], "schedule_id int, report_type string, active boolean"
    )
    assert reports.active_schedules(schedules, "gdpr").count() == 1 and reports.active_schedules(schedules).count() == 2
    newest = spark.createDataFrame([(1, T0), (2, at(days=1))], "alert_id int, timestamp timestamp")
    assert reports.recent_alerts(newest, 1).first().alert_id == 2
    with pytest.raises(ValueError):
        protect.protected(F.lit("x"), "OTHER", b"k")
    scores = spark.createDataFrame([("a", 0.9), ("b", None)], "column_name string, score double")
    table = spark.createDataFrame([(1, "plain", "x@y.z")], "a int, b string, c string")
    judged = {r.column_name: tuple(r)[1:] for r in columns.judged_columns(table, scores).collect()}
    assert judged == {"a": ("sensitive", 0.9, "model"), "b": ("non-sensitive", 0.6, "heuristic"), "c": ("sensitive", 0.7, "heuristic")}


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps([
        {"name": "low", "actions": ["logging"], "severity": 2},
        {"name": "top", "actions": ["email_alert"], "conditions": {"breach_type": ["ofac", "bis"]}, "severity": 9}
    ]))
    rules = screening.rules_from(spark, str(tmp_path))
    breaches = spark.createDataFrame([(1, "bis", "low"), (2, "x", "low")], "breach_id long, breach_type string, confidence string")
    plan = screening.remediation_plan(breaches, rules).orderBy("breach_id", "step").collect()
    assert [(r.breach_id, r.action) for r in plan] == [(1, "email_alert"), (1, "logging"), (2, "logging")]


def test_audit_fields_cannot_be_moved(spark):
    schema = "log_id long, seq long, entry_id string, entry_type string, timestamp string, user_id string, operation string, details map<string,string>"
    rows = [
        (1, 1, "a|b", "c", "t", "u", "o", {"k": "1"}), (2, 1, "a", "b|c", "t", "u", "o", {"k": "1"}),
        (3, 1, "a", "b|c", "t", "u", "o", {"k": "2"}), (4, 1, "a", "b|c", "t", "u", "o", None)
    ]
    out = {r.log_id: r.row_hash for r in audit.build_chain(spark.createDataFrame(rows, schema), b"k").collect()}
    assert len(set(out.values())) == 4
    weights = spark.createDataFrame(
        [(1, "w", 0, 0.5), (1, "w", 1, 0.25), (2, "w", 0, 0.5), (2, "w", 1, 0.26)], "round int, key string, idx int, value double"
    )
    digests = {r.round: r.digest for r in audit.model_digest(weights).collect()}
    assert len(digests[1]) == 64 and digests[1] != digests[2]
    updates = spark.createDataFrame([(i, "w", 0, 5.0) for i in range(500)], "client_id long, key string, idx int, value double")
    noised = [r.value for r in audit.private_updates(updates, 1.0, 0.1, "s").collect()]
    assert 0.95 < sum(noised) / 500 < 1.05 and len(set(noised)) > 400


def test_models(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, float(i % 2), rng.random() + (i % 2), rng.random(), "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label double, x double, y double, k string")
    train, test = models.divided(df, "label", "id")
    assert train.count() + test.count() == 80 and 50 < train.count() < 76
    model = models.fit_column_classifier(train.select("label", "x", "y"), search=True, folds=2)
    assert models.feature_importance(model, ["x", "y"])[0][0] == "x"
    models.save_model(model, f"{tmp_path}/m")
    again = models.load_model(f"{tmp_path}/m").transform(test)
    assert again.filter("prediction = label").count() >= test.count() - 1
    severe = models.fit_severity(df, ["x"], ["k"], "label")
    assert models.probability(severe, df.select("id", "x", "k")).filter("severity >= 0.5").count() == 80
    forest = models.fit_forest(df, "id", ["x", "y"], trees=5)
    models.save_forest(forest, f"{tmp_path}/f")
    assert models.forest_scores(df, "id", ["x", "y"], models.load_forest(spark, f"{tmp_path}/f")).count() == 80
    stats = {r.column_name: r for r in models.describe(df).collect()}
    assert stats["x"].n == 80 and stats["label"].mean == 0.5 and stats["y"].low <= stats["y"].q1 <= stats["y"].median <= stats["y"].high
    events = spark.createDataFrame([(i, 200, float(i)) for i in range(100)], "event_id long, status_code int, response_time double")
    assert models.scored_or_ruled(events, None).count() == 5
    assert models.scored_or_ruled(events, lambda e: e.select("event_id", (-F.col("response_time")).alias("anomaly_score"))).count() == 5
    assert logs.feature_columns(df, "label") == (["id", "x", "y"], ["k"])
    filled = logs.with_features(df.select("id", "x"), ["x", "z"], ["k"]).first()
    assert (filled.z, filled.k) == (0.0, "unknown") and logs.highest_first(
        events.withColumn("anomaly_score", F.col("response_time")), "event_id"
    ).first().event_id == 99


def test_monitor_counts_each_batch_once(spark, tmp_path):
    rows = [(
        i, at(minutes=i), f"user{i % 4}", "r1", 500 if i % 3 == 0 else 200, float(i), "unauthorized_access", "on_prem", "events", i % 4
    ) for i in range(120)]
    schema = "event_id long, timestamp timestamp, user string, resource_id string, status_code int, response_time double, type string, source_type string, source string, user_id long"
    batch = spark.createDataFrame(rows, schema).withColumn("resource", F.col("resource_id"))
    listed = spark.createDataFrame([("USER1", "OFAC - x")], LIST)
    monitor = streams.Monitor(str(tmp_path), listed, screening.default_rules(batch), logs.rule_anomalies)
    monitor(batch.filter("event_id < 60"), 0)
    monitor(batch.filter("event_id >= 60"), 1)
    counts = {n: monitor.stored(spark, n).count() for n in monitor.TABLES}
    monitor(batch.filter("event_id >= 60"), 1)  # the batch again, as after a lost driver
    assert {n: monitor.stored(spark, n).count() for n in monitor.TABLES} == counts
    times = {}
    for r in monitor.stored(spark, "alerts").orderBy("timestamp").collect():
        times.setdefault(r.message, []).append(r.timestamp)
    assert times and all(b - a > dt.timedelta(minutes=60) for ts in times.values() for a, b in zip(ts, ts[1:], strict=False))
    assert counts["breaches"] == monitor.stored(spark, "anomalies").filter("user = 'user1'").count() > 0 and counts["plan"] == 3 * counts["breaches"]


def test_streams_of_offenses_and_log_ins(spark, tmp_path):
    offense = [{"id": i, "status": "OPEN", "severity": 9, "start_time": i} for i in range(5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, offense)))
    seen = []
    query = streams.poll(
        screening.offense_alerts(streams.polled_offenses(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/state",
        lambda b, _: seen.extend(r.id for r in b.collect()), "1 second"
    )
    query.processAllAvailable()
    (tmp_path / "in" / "b.json").write_text(json.dumps({**offense[0], "id": 9, "start_time": 9}))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [2, 3, 4, 9]
    tries = [("ann", at(minutes=m), False) for m in (0, 1, 2)] + [
        ("ann", at(minutes=5), True), ("ann", at(minutes=30), True), ("bob", at(minutes=5), True), ("bob", at(minutes=4), False)
    ]
    logins = spark.createDataFrame(tries, "user string, at timestamp, successful boolean")
    found = streams.failed_then_success(logins).collect()
    assert [(r.user, r.n_failed) for r in found] == [("ann", 3)]
    logins.write.parquet(f"{tmp_path}/logins")
    stream = streams.read_files(spark, f"{tmp_path}/logins", logins.schema).withWatermark("at", "1 hour")
    streams.run_available(streams.failed_then_success(stream), f"{tmp_path}/s2", lambda b, _: seen.append([tuple(r) for r in b.collect()]))
    rows = [tuple(r) for r in found]
    assert [x for x in seen[4:] if x] in ([rows], [])  # rows come once the watermark has passed them
    per_minute = streams.too_many(streams.counts_by_window(logins, "1 minute", None, "user"), 5)
    assert per_minute.count() == 0
    users = spark.createDataFrame([("ann", at(minutes=i), f"d{i}") for i in range(6)], "user string, at timestamp, dataset string")
    assert streams.distinct_by_window(users, "10 minutes", "5 minutes", "user", "dataset").agg(F.max("n_distinct")).first()[0] == 6
    counts = spark.createDataFrame([("e", 10), ("f", 2)], "endpoint string, n long")
    usual = spark.createDataFrame([("e", 2.0), ("f", 2.0)], "endpoint string, usual double")
    assert [r.endpoint for r in streams.against_baseline(counts, usual, "endpoint").collect()] == ["e"]


def test_flags_training_data_and_tokens(spark, tmp_path):
    scores = spark.createDataFrame([(i, i / 100) for i in range(100)], "key long, score double")
    assert models.flagged(scores).filter("is_anomaly").count() == 49 and models.flagged(scores, 0.1).filter("is_anomaly").count() == 10
    (tmp_path / "t.csv").write_text("x,label\n1,0\n2.5,\n3,1\n")
    rows = readers.training_data(spark, f"{tmp_path}/t.csv", "label")
    assert rows.count() == 2 and dict(rows.dtypes) == {"x": "double", "label": "int"}
    df = spark.createDataFrame([("é",)], "v string")
    key = b"0123456789abcdef"
    hidden = df.select(protect.encrypt(F.col("v"), key).alias("h"), protect.pseudonym(F.col("v"), b"s").alias("p"))
    made = hidden.select(protect.decrypt(F.col("h"), key, strict=True).alias("v"), "p.*").first()
    assert (made.v, made.salt, made.original_length, len(made.pseudonym)) == ("é", "73", 2, 64)
    with pytest.raises(Exception):
        hidden.select(protect.decrypt(F.col("h"), key[::-1], strict=True)).collect()


def test_text_models_are_hooks(spark):
    docs = spark.createDataFrame([(1, "secret"), (2, None)], "doc_id int, text string")
    assert sorted(r.model_score for r in models.with_text_model(docs, lengths).collect()) == [0.0, 6.0]


    found = models.with_entity_model(docs, names).orderBy("doc_id").collect()
    assert [[e.value for e in r.entities] for r in found] == [["secret"], []]
    offense = spark.createDataFrame([(1, "d", "OPEN", 9), (2, "d", "OPEN", 6)], "id long, description string, status string, severity int")
    made = screening.tickets(screening.offense_alerts(offense), "SEC").orderBy("id").collect()
    assert [(r.project, r.issue_type, r.summary, r.priority) for r in made] == [("SEC", "Task", "Compliance Alert: Offense 1", "High"), ("SEC", "Task", "Compliance Alert: Offense 2", "Medium")]


def names(texts: pd.Series) -> pd.Series:
    one = lambda kind, t: {"entity_type": kind, "value": t, "start": 0, "end": len(t), "confidence": 0.9}
    return texts.map(lambda t: [one("Person Name", t), one("Person Name", t[:2]), one("Odd", t)] if t else [])


def lengths(texts: pd.Series) -> pd.Series:
    return texts.str.len().astype(float)
