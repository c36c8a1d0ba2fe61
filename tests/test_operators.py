import datetime as dt
import hashlib
import hmac
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkward.functions import protect
from sparkward.operators import alerts, anonymize, audit, columns, logs, models, reports, screening
from sparkward.sources import readers
from sparkward.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_alerts_by_priority_message_and_window(spark):
    rows = [
        (1, T0, 0.9, "unauthorized_access", "user1", None), (2, T0, 0.6, "unusual_transfer", None, "10GB"),
        (3, T0, 0.4, "suspicious_behavior", "user2", None), (4, T0, 0.95, "unauthorized_access", "user3", None)
    ]
    df = spark.createDataFrame(
        rows, "event_id long, timestamp timestamp, anomaly_score double, type string, user_id string, data_size string"
    ).withColumn("source_type", F.lit("x"))
    found = alerts.alerts(df)
    s = alerts.statistics(found).first()
    assert (s.active, s.n_high, s.n_medium, s.n_low) == (4, 2, 1, 1)
    assert {r.message for r in found.collect()} >= {
        "Unauthorized access attempt by user1 to sensitive resource",
        "Unusual data transfer of 10GB from unknown source to unknown destination"
    }
    assert alerts.alerts(df.withColumn("action_decided", F.when(F.col("user_id") == "user1", "suppress"))).count() == 3
    assert alerts.page(found, "high", limit=1).count() == 1


def test_dedup_is_the_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(minutes=rng.choice((0, 30, 60, 61, 90, rng.randrange(600))))) for _ in range(200)] + [("a", None)]
    kept = set()
    for m in "ab":
        last = None
        for t in sorted({t for k, t in rows if k == m and t}):
            if last is None or t > last + dt.timedelta(minutes=60):
                kept.add((m, t))
                last = t
    assert {tuple(r) for r in alerts.deduplicated(spark.createDataFrame(rows, "message string, timestamp timestamp")).collect()} == kept


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_groups_are_read_in_order_and_not_collected(spark):
    rng = random.Random(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        times = {m: sorted(rng.sample(range(300_000), 400)) for m in (None, "a", "b")}
        times["c"] = [0, 60, 120, 181, 100_000, 100_060, 100_061, 200_000]
        df = spark.createDataFrame(
            [(m, T0 + dt.timedelta(minutes=x)) for m, xs in times.items() for x in xs], "message string, timestamp timestamp"
        ).repartition(3)
        kept = set()
        for m, xs in times.items():
            last = None
            for x in xs:
                if last is None or x > last + 60:
                    kept.add((m, T0 + dt.timedelta(minutes=x)))
                    last = x
        out = alerts.deduplicated(df)
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) == kept and len(rows) == len(kept) and "collect_list" not in plan(out)

        entries = [(log, i, f"e{i}", "data_access", None, "u", f"op{i}") for log, n in ((None, 30), (1, 3000), (2, 1)) for i in range(n)]
        chain = audit.build_chain(
            spark.createDataFrame(entries, "log_id long, seq long, entry_id string, entry_type string, timestamp string, user_id string, operation string").repartition(3),
            b"k"
        )
        expected, last = {}, {}
        for log, i, e, kind, _, user, op in entries:
            fields = {"entry_id": e, "entry_type": kind, "operation": op, "timestamp": "", "user_id": user}
            body = json.dumps(fields, separators=(",", ":"))  # fields can't run into each other
            now = hashlib.sha256(f"{body}|{last.get(log) or ''}".encode()).hexdigest()
            expected[log, i], last[log] = (body, last.get(log), now), now
        assert {(r.log_id, r.seq): (r.body, r.previous_hash, r.row_hash) for r in chain.collect()} == expected and "collect_list" not in plan(chain)
        assert chain.columns == ["log_id", "seq", "body", "previous_hash", "row_hash", "signature"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "long", "string"])
def test_review_queue_is_numbered_within_ranges(spark, kind):
    rng = random.Random(4)
    at = lambda x: x if kind == "long" else f"{x:04d}" if kind == "string" else T0 + dt.timedelta(minutes=x) if kind != "date" else T0.date() + dt.timedelta(days=x)
    items = [(i, None if rng.random() < 0.05 else at(rng.randrange(500)), rng.choice(("high", "medium", "low")), 0.9) for i in range(900)]
    out = alerts.review_queue(spark.createDataFrame(items, f"review_id long, queued_at {kind}, severity string, confidence double"))
    expected = {}
    for severity in ("high", "medium", "low"):
        mine = sorted((x for x in items if x[2] == severity), key=lambda x: (x[1] is not None, x[1] or at(0), x[0]))
        expected |= {x[0]: (severity, n + 1) for n, x in enumerate(mine)}
    assert {r.review_id: (r.queue, r.position) for r in out.collect()} == expected and out.schema["position"].dataType.simpleString() == "int"
    assert kind == "string" or "_range#" in plan(out)


def test_reviews_and_decisions(spark):
    df = spark.createDataFrame([("high", 0.9), ("medium", 0.1), ("medium", 0.9), ("low", 0.1), ("low", 0.5)], "s string, c double")
    assert [r[0] for r in df.select(alerts.review_priority(F.col("s"), F.col("c"))).collect()] == ["high", "high", "medium", "medium", "low"]
    got = spark.createDataFrame([(0.9,), (0.6,), (0.4,), (None,)], "c double").select(*(
        x.alias(n) for x, n in zip(alerts.decide(F.col("c")), "vra", strict=True)
    )).collect()
    assert [tuple(r) for r in got] == [(True, False, "alert"), (True, True, "alert"), (False, True, "suppress"), (True, True, "alert")]


def test_best_threshold(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(40)), rng.random() < 0.4) for _ in range(300)]
    best = max((2 * sum(p for e, p in rows if e >= t) / (sum(p for _, p in rows) + sum(e >= t for e, _ in rows)), -t) for t in {e for e, _ in rows})
    r = alerts.best_threshold(spark.createDataFrame(rows, "error double, positive boolean")).first()
    assert (r.threshold, r.f1) == (-best[1], pytest.approx(best[0], abs=1e-6))
    assert alerts.best_threshold(spark.createDataFrame([(1.0, True)], "error double, positive boolean")).count() == 0


def test_screening_and_plan(spark):
    listed = spark.createDataFrame([("Evil Corp", "OFAC - SDN"), ("Questionable Tech", "BIS - EL"), (None, "OFAC")], "name string, source string")
    rows = [("normal_user", "server-1"), ("EVIL corp", "sensitive-db"), ("another_user", "questionable tech"), (None, None)]
    out = [tuple(r)[2:] for r in screening.screen(spark.createDataFrame(rows, "user string, resource string"), listed).collect()]
    assert sorted(out) == sorted([(False, False, False), (True, False, True), (False, True, True), (False, False, False)])
    breaches = spark.createDataFrame(
        [(1, "ofac", "high"), (2, "bis", "low"), (3, "other", None)], "breach_id long, breach_type string, confidence string"
    )
    plan = screening.remediation_plan(breaches, screening.default_rules(breaches)).orderBy("breach_id", "step").collect()
    assert [(r.breach_id, r.action) for r in plan] == [(1, "email_alert"), (1, "logging"), (1, "access_revocation"), (2, "logging"), (3, "logging")]
    agree = spark.createDataFrame(
        [(["email_alert", "logging"], ["logging", "quarantine"]), ([], [])], "a array<string>, b array<string>"
    ).select(screening.agreement(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in agree] == [0.5, 0.0]


def people(spark):
    rng = random.Random(3)
    return spark.createDataFrame(
        [(i, rng.randrange(6), rng.choice("xy"), rng.choice("pqrs"), float(rng.randrange(1000))) for i in range(300)] + [(900, None, "x", "p", 1.0)],
        "id long, age int, sex string, ill string, pay double"
    )


def test_release_keeps_its_promises(spark):
    df, c = people(spark), anonymize.Config(("age", "sex"), ("ill",), k=20, l=3, t=0.25)
    rows = anonymize.release(df, c, ("k", "l", "t")).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.age, r.sex), []).append(r.ill)
    assert rows and all(len(g) >= 20 and len(set(g)) >= 3 and max(map(g.count, g)) <= len(g) / 3 for g in groups.values())
    hidden = anonymize.suppressed(df, c, ("ill",)).filter("ill = '*'").count()
    assert hidden == int(301 * 0.1)
    noisy = anonymize.noisy(df, c, ("pay", "ill")).collect()
    assert any(a.pay != b.pay for a, b in zip(noisy, df.collect(), strict=True))
    m = anonymize.metrics(df, anonymize.k_anonymous(df, c), c, "pay").first()
    assert m.k_holds and m.min_group >= 20


def test_ks(spark):
    df = people(spark).filter("age IS NOT NULL")
    c = anonymize.Config(("age", "sex"))
    pdf = df.toPandas()
    for r in anonymize.ks_statistics(df, c, "pay").collect():
        g = np.sort(pdf[(pdf.age == r.age) & (pdf.sex == r.sex)].pay)
        x = np.sort(pdf.pay.unique())
        d = np.abs(np.searchsorted(g, x, "right") / len(g) - np.searchsorted(np.sort(pdf.pay), x, "right") / len(pdf)).max()
        assert r.statistic == pytest.approx(d)
        assert 0 <= r.distance <= 1


def test_protect(spark):
    key = b"a key of more than sixty-four bytes, which is hashed before it is used as one"
    df = spark.createDataFrame([("Ann",), ("é",)], "v string")
    assert [r[0] for r in df.select(protect.hmac_sha256(key, F.col("v"))).collect()] == [hmac.new(
        key, v.encode(), hashlib.sha256
    ).hexdigest() for v in ("Ann", "é")]
    r = df.select(protect.decrypt(protect.encrypt(F.col("v"), b"0" * 16), b"0" * 16)).collect()
    assert [x[0] for x in r] == ["Ann", "é"]


def test_audit_chain(spark):
    rows = [(log, i, f"e{i}", "data_access", "t", "u", f"op{i}") for log in (1, 2) for i in range(5)]
    chain = audit.build_chain(
        spark.createDataFrame(rows, "log_id long, seq long, entry_id string, entry_type string, timestamp string, user_id string, operation string"),
        b"k"
    ).cache()
    assert chain.count() == 10 and audit.verify_chain(chain, b"k").count() == 0
    changed = chain.withColumn("body", F.when((F.col("log_id") == 1) & (F.col("seq") == 2), "x").otherwise(F.col("body")))
    assert [tuple(r) for r in audit.verify_chain(changed, b"k").orderBy("seq").collect()] == [(1, 2, "signature mismatch"), (1, 3, "hash mismatch")]
    assert audit.verify_chain(chain, b"other").count() == 10


def test_federated_average(spark):
    rows = [(1, "w", i, float(i), 100) for i in range(3)] + [(2, "w", i, float(2 * i), 150) for i in range(3)] + [
        (3, "w", 0, 9.0, 100), (4, "w", 0, 9.0, 0)
    ]
    updates = spark.createDataFrame(rows, "client_id long, key string, idx int, value double, samples_count long")
    clients = spark.createDataFrame([(1,), (2,), (4,)], "client_id long")
    out = {r.idx: r.value for r in audit.federated_average(audit.accepted_updates(updates, clients)).collect()}
    assert out == {i: pytest.approx((i * 100 + 2 * i * 150) / 250) for i in range(3)}


def test_forest_finds_outliers(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(950, 6)), rng.uniform(-6, 6, (50, 6))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double, e double, f double")
    names = list("abcdef")
    scores = models.forest_scores(df, "id", names, models.fit_forest(df, "id", names)).orderBy(F.desc("score")).limit(50).collect()
    assert sum(r.key >= 950 for r in scores) >= 35
    errors = {r.key: r.error for r in models.reconstruction_errors(df, "id", names).collect()}
    assert np.mean([errors[i] for i in range(950, 1000)]) > 3 * np.mean([errors[i] for i in range(950)])


def test_clients_train(spark):
    rng = random.Random(5)
    rows = [(c, x, float(x > 0)) for c in (1, 2) for x in (rng.uniform(-1, 1) for _ in range(50))]
    out = models.train_by_client(spark.createDataFrame(rows, "client long, x double, y double"), "client", ["x"], "y", steps=5).collect()
    assert {(r.client_id, r.samples_count) for r in out} == {(1, 50), (2, 50)} and all(r.value > 0 for r in out if r.idx == 1)


def test_next_runs_and_sizes(spark):
    monday = dt.datetime(2024, 1, 1, 10)
    df = spark.createDataFrame([(monday, f) for f in ("daily", "weekly", "monthly", "quarterly", "odd")], "now timestamp, f string")
    assert [r[0].strftime("%Y-%m-%d") for r in df.select(reports.next_run(F.col("now"), F.col("f"))).collect()] == [
        "2024-01-02", "2024-01-08", "2024-02-01", "2024-04-01", "2024-01-02"
    ]
    sizes = spark.createDataFrame([(5,), (2048,), (3 << 30,)], "n long").select(reports.size_text(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["5.00 B", "2.00 KB", "3.00 GB"]


def test_logs_and_columns(spark):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "u"), ("bad", None)], "timestamp string, user string")
    rows = logs.normalize(raw).collect()
    assert tuple(rows[0].asDict()) == logs.LOG_COLUMNS and rows[1].timestamp is None and rows[1].user == "" and rows[1].metadata is None
    flat = logs.scaled(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", "y").collect()
    assert [r.y for r in flat] == [0.0, 0.0]
    h = columns.heuristic(spark.createDataFrame([("a@b.c",)], "note string"), "note").first()
    assert (h.classification, h.confidence) == ("sensitive", 0.7)


def test_readers(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/A.TXT").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "in/b.bin").write_bytes(b"x")
    files = readers.scan_folder(spark, str(tmp_path / "in")).collect()
    assert [(r.name, r.extension, r.bytes) for r in files] == [("A.TXT", "txt", 7)] and files[0].text.startswith("café")
    content = spark.createDataFrame([("p", b"1"), ("q", b"2")], "path string, content binary")
    manifest = readers.new_files(content, spark.createDataFrame([], "path string, hash string")).select("path", "hash")
    assert readers.new_files(
        content.withColumn("content", F.when(F.col("path") == "p", F.lit(b"3")).otherwise(F.col("content"))), manifest
    ).count() == 1
    (tmp_path / "s.log").write_text("<34>Jan  1 00:00:01 host sshd[12]: Failed password\nnonsense\n")
    assert [tuple(r) for r in readers.read_logs(spark, str(tmp_path / "s.log"), "syslog").collect()] == [(
        "Jan  1 00:00:01", "host", "sshd", "Failed password"
    )]
    (tmp_path / "l.json").write_text('{"results": [{"name": "A", "source": "OFAC"}, {"name": "A", "source": "OFAC"}]}')
    assert readers.screening_list(spark, str(tmp_path / "l.json")).count() == 1


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "ts timestamp, k string"
    for day in (1, 2):
        spark.createDataFrame([(T0 + dt.timedelta(days=day), "a")] * day, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = readers_stream(spark, tmp_path, schema)
        streams.run_available(stream, f"{tmp_path}/state", lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def readers_stream(spark, tmp_path, schema):
    return streams.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
