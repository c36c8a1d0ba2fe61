"""Queries over scans, reports, schedules, models and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, logs, models, network, reports, screening
from ..session import scratch, table
from ..streaming import streams
from . import documents
from . import logs as log_plans

#: Days of events stand for scans: files are events, sensitive ones are errors.
SCANS = """scans AS (SELECT 'scan_' || strftime(date_trunc('day', ts), '%Y%m%d') AS scan_id, date_trunc('day', ts) AS start_time,
  count(*) AS files_scanned, count(*) FILTER (event_type = 'error') AS sensitive_files_found FROM events GROUP BY date_trunc('day', ts))"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    days = table(spark, sf_dir, "events").groupBy(day.alias("start_time")).agg(
        F.count("*").alias("files_scanned"), F.count_if(F.col("event_type") == "error").alias("sensitive_files_found")
    )
    return days.select(
        F.concat(F.lit("scan_"), F.date_format("start_time", "yyyyMMdd")).alias("scan_id"), "start_time",
        (F.col("start_time") + F.expr("INTERVAL 1 HOUR")).alias("end_time"), F.lit("completed").alias("status"), "files_scanned",
        "sensitive_files_found"
    )


def risk_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").agg(
        F.count_if(F.col("event_type") == "error").alias("sensitive_files"), F.count_if(F.expr("value > 99")).alias("recent_alerts"),
        (100.0 * F.count_if(F.expr("event_type <> 'error'")) / F.count("*")).alias("mean_compliance")
    )
    return reports.risk_overview(facts)


RISK_OVERVIEW = """WITH f AS (SELECT count(*) FILTER (event_type = 'error') AS s, count(*) FILTER (value > 99) AS a,
  100 - 100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*) AS g FROM events),
c AS (SELECT CASE WHEN s >= 50 THEN 85 WHEN s >= 10 THEN 60 WHEN s > 0 THEN 30 ELSE 0 END AS data_exposure, CASE WHEN a >= 15 THEN 85
  WHEN a >= 5 THEN 60 WHEN a > 0 THEN 30 ELSE 0 END AS access, CASE WHEN g >= 30 THEN 85 WHEN g >= 15 THEN 60 WHEN g > 0 THEN 30
  ELSE 0 END AS compliance_gap FROM f),
o AS (SELECT *, CAST(floor(coalesce(list_avg(list_filter([data_exposure, access, compliance_gap], lambda x: x > 0)), 0)) AS INT) AS overall
  FROM c) SELECT *, CASE WHEN overall >= 75 THEN 'High' WHEN overall >= 45 THEN 'Medium' ELSE 'Low' END AS level FROM o"""


def compliance_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compliance_state(scans(spark, sf_dir))


COMPLIANCE_STATE = f"WITH {SCANS} SELECT scan_id, files_scanned, sensitive_files_found, (SELECT count(*) FROM scans) AS n_scans, CASE WHEN sensitive_files_found > 10 THEN 'High' WHEN sensitive_files_found > 3 THEN 'Medium' ELSE 'Low' END AS risk FROM scans ORDER BY start_time DESC LIMIT 1"


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard(scans(spark, sf_dir)).select("scan_id", "files_scanned", "sensitive_files_found")


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trend(scans(spark, sf_dir))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("purpose"), F.col("user_id").alias("subject"),
        F.concat(F.lit("data_class_"), (F.col("event_id") % 7).cast("string")).alias("category")
    )


def gdpr_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.activity_register(activities(spark, sf_dir))


GDPR_REGISTER = "SELECT event_type AS purpose, count(*) AS n_activities, count(DISTINCT user_id) AS n_subjects, array_to_string(list_sort(list(DISTINCT 'Data Class ' || (event_id % 7))), ', ') AS categories FROM events GROUP BY 1"


def category_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_tally(activities(spark, sf_dir))


def ccpa_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority").startswith("1"), "opt_out").when(F.col("o_orderpriority").startswith("2"), "delete").otherwise("access")
    status = F.when(F.col("o_orderstatus") == "F", "fulfilled").when(F.col("o_orderstatus") == "P", "denied").otherwise("open")
    return reports.rights_requests(table(spark, sf_dir, "orders").select(
        kind.alias("kind"), status.alias("status"), (F.col("o_custkey") % 45).alias("days")
    ))


CCPA_REQUESTS = """WITH r AS (SELECT CASE WHEN starts_with(o_orderpriority, '1') THEN 'opt_out' WHEN starts_with(o_orderpriority, '2') THEN 'delete'
  ELSE 'access' END AS kind, o_orderstatus AS s, o_custkey % 45 AS days FROM orders)
SELECT kind, count(*) AS received, count(*) FILTER (s = 'F') AS fulfilled, count(*) FILTER (s = 'P') AS denied, round(avg(days),
  4) AS mean_days, count(*) FILTER (kind = 'opt_out') AS opt_outs FROM r GROUP BY kind"""


def hipaa_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.breach_totals(logs.event_logs(table(spark, sf_dir, "events")).filter("status = 'FAILURE'"))


HIPAA_BREACHES = "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n_breaches, count(DISTINCT user_id) AS affected FROM events WHERE event_type = 'error' GROUP BY 1"


def control_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = table(spark, sf_dir, "orders").select(
        F.substring_index("o_orderpriority", "-", -1).alias("regulation"), (F.col("o_orderstatus") != "P").alias("passed")
    )
    return reports.control_status(controls)


CONTROL_STATUS = """WITH c AS (SELECT string_split(o_orderpriority, '-')[-1] AS regulation, count(*) AS assessed,
  count(*) FILTER (o_orderstatus <> 'P') AS passing FROM orders GROUP BY 1), p AS (SELECT *, round(100.0::DOUBLE * passing / assessed,
  2) AS percent FROM c)
SELECT *, CASE WHEN percent >= 85 THEN 'Compliant' WHEN percent >= 70 THEN 'Partially Compliant' ELSE 'Non-Compliant' END AS status FROM p"""


def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    frequency = F.element_at(F.array(*map(F.lit, ("daily", "weekly", "monthly", "quarterly"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        "o_orderkey", frequency.alias("frequency"),
        F.date_format(reports.next_run(F.col("o_orderdate").cast("timestamp"), frequency), "yyyy-MM-dd HH:mm").alias("next_run")
    )


NEXT_RUNS = """WITH f AS (SELECT o_orderkey, o_orderdate AS d, ['daily', 'weekly', 'monthly', 'quarterly'][o_orderkey % 4 + 1] AS frequency FROM orders)
SELECT o_orderkey, frequency, strftime(CASE frequency WHEN 'weekly' THEN date_trunc('week', d) + INTERVAL 7 DAY
  WHEN 'monthly' THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 'quarterly' THEN date_trunc('quarter', d) + INTERVAL 3 MONTH
  ELSE date_trunc('day', d) + INTERVAL 1 DAY END, '%Y-%m-%d %H:%M') AS next_run FROM f"""


def report_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports of which every third was changed."""
    data, digest = reports.stored_report(F.struct("scan_id", "files_scanned", "sensitive_files_found"))
    stored = scans(spark, sf_dir).select("scan_id", data.alias("data"), digest.alias("digest"), (F.dayofyear("start_time") % 3 == 0).alias("change"))
    changed = stored.withColumn("data", F.when(F.col("change"), F.concat("data", F.lit(" "))).otherwise(F.col("data")))
    return changed.select("scan_id", reports.intact(F.col("data"), F.col("digest")).alias("intact"))


REPORT_INTEGRITY = f"""WITH {SCANS}, r AS (SELECT scan_id, start_time,
  '{{"scan_id":"' || scan_id || '","files_scanned":' || files_scanned || ',"sensitive_files_found":' || sensitive_files_found || '}}' AS data
  FROM scans),
stored AS (SELECT scan_id, sha256(data) AS digest, CASE WHEN dayofyear(start_time) % 3 = 0 THEN data || ' ' ELSE data END AS data FROM r)
SELECT scan_id, sha256(data) = digest AS intact FROM stored"""


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for schedules; those that are fulfilled aren't active any more."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("schedule_id"), F.lower("o_orderpriority").alias("report_type"),
        (F.col("o_orderstatus") != "F").alias("active")
    )


def schedule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.schedule_counts(schedules(spark, sf_dir))


SCHEDULE_COUNTS = "SELECT lower(o_orderpriority) AS report_type, count(*) AS n_active FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1"


def report_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of reports of which every third has no start and every fifth no end."""
    o = table(spark, sf_dir, "orders")
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    start, end = reports.period(
        F.when(k % 3 != 0, at), F.when(k % 5 != 0, at + F.expr("INTERVAL 7 DAYS")), F.to_timestamp(F.lit("1998-12-01 12:00:00"))
    )
    return o.select("o_orderkey", F.date_format(start, "yyyy-MM-dd HH:mm").alias("start"), F.date_format(end, "yyyy-MM-dd HH:mm").alias("end"))


REPORT_PERIODS = """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate ELSE TIMESTAMP '1998-12-01 12:00:00' - INTERVAL 30 DAY END,
  '%Y-%m-%d %H:%M') AS start,
  strftime(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 7 DAY ELSE TIMESTAMP '1998-12-01 12:00:00' END, '%Y-%m-%d %H:%M') AS "end" FROM orders"""


def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of scans, by whether anything sensitive was found."""
    data, _ = reports.stored_report(F.struct("scan_id", "files_scanned", "sensitive_files_found"))
    kind = F.when(F.col("sensitive_files_found") > 0, "incident").otherwise("routine")
    return reports.storage_counters(scans(spark, sf_dir).select(kind.alias("report_type"), data.alias("report_data")))


STORED_COUNTS = f"""WITH {SCANS} SELECT CASE WHEN sensitive_files_found > 0 THEN 'incident' ELSE 'routine' END AS report_type, count(*) AS n_reports,
  CAST(sum(strlen('{{"scan_id":"' || scan_id || '","files_scanned":' || files_scanned || ',"sensitive_files_found":' || sensitive_files_found || '}}')) AS BIGINT) AS n_bytes
    FROM scans GROUP BY 1"""


def live_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.records(spark, sf_dir).filter("pii_count > 0")
    live = reports.live_dashboard(log_plans.found_alerts(spark, sf_dir), found, scans(spark, sf_dir))
    return live.withColumn("newest_alert", F.unix_micros("newest_alert"))


LIVE_DASHBOARD = f"""{documents.CATALOG_SQL}, {log_plans.SCORED}, {SCANS},
a AS (SELECT {log_plans.PRIORITY} AS priority, "timestamp" FROM scored),
c AS (SELECT count(*) FILTER (priority = 'high') AS n_high, count(*) FILTER (priority = 'medium') AS n_medium,
  count(*) FILTER (priority = 'low') AS n_low, epoch_us(max("timestamp")) AS newest_alert FROM a)
SELECT *, CASE WHEN n_high > 0 THEN 'High' WHEN n_medium > 0 THEN 'Medium' ELSE 'Low' END AS risk_level, (SELECT count(*) FROM records
  WHERE pii_count > 0) AS sensitive_files, (SELECT count(*) FROM scans) AS total_scans FROM c"""

NUMBERS = ["response_time", "status_code", "hour", "user_id"]


def numeric_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.event_logs(table(spark, sf_dir, "events")).withColumn("hour", F.hour("timestamp"))


def iforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numeric_logs(spark, sf_dir)
    return models.forest_scores(df, "event_id", NUMBERS, models.fit_forest(df, "event_id", NUMBERS))


def recon_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.reconstruction_errors(numeric_logs(spark, sf_dir), "event_id", NUMBERS)


def network_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the logs' numbers after a network of a few steps."""
    rows = numeric_logs(spark, sf_dir)
    return network.network_errors(rows, "event_id", network.fit_network(rows, NUMBERS, steps=40))


def ensemble_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.above_percentile(models.ensemble(iforest(spark, sf_dir), recon_error(spark, sf_dir)).select("key", "anomaly_score"), "anomaly_score")


def validation_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validator fitted on the labelled documents (true where the quality is good) judges all documents by language, source and counts."""
    low = F.lower("text")
    counts = (
        F.size(F.split("text", r"\s+")).alias("n_words"), F.length(F.regexp_replace("text", "[^A-Z]", "")).alias("n_capitals"),
        F.length(F.regexp_replace(low, "[a-z0-9\\s]", "")).alias("n_signs")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", *counts)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("label"))
    numeric, categorical = logs.feature_columns(docs.drop("doc_id"))
    filled = logs.with_features(docs, numeric, categorical)
    known = filled.join(labels, F.col("doc_id") == F.col("labelled")).drop("labelled")
    model = models.fit_validator(known, numeric, categorical, "label")
    judged = models.probability(model, filled)
    valid, review, action = alerts.decide(F.col("confidence"))
    return judged.select("doc_id", "confidence", "severity", valid.alias("valid"), review.alias("needs_review"), action.alias("action"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema  # the pattern below lets the table be one file or a folder
    return streams.read_files(spark, f"{sf_dir}/events.parque[t]", schema)


def stream_result(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives once it has read all files. Each batch is a table in the shared folder that a repeated one overwrites; of complete results the last counts."""
    path = scratch(spark)
    name = (lambda number: "all") if mode == "complete" else (lambda number: f"batch={number}")
    streams.run_available(
        stream, f"{path}/state", lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/{name(number)}"), mode=mode
    )
    return spark.read.schema(stream.schema).parquet(f"{path}/out/{'all' if mode == 'complete' else '*'}")


#: No row of the events is so late that it is dropped.
LATE = "3650 days"


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.timed(event_stream(spark, sf_dir), lateness=LATE)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_result(spark, streams.counts_by_window(timed_events(spark, sf_dir), "1 hour", None, "event_type"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = timed_events(spark, sf_dir).filter("event_type = 'error'")
    return stream_result(spark, streams.too_many(streams.counts_by_window(errors, "1 hour", "30 minutes", "event_type"), 3))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_result(spark, streams.sessions(timed_events(spark, sf_dir), "30 minutes", "user_id"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that meet more than three kinds of events within a day."""
    counts = streams.distinct_by_window(timed_events(spark, sf_dir), "1 day", "12 hours", "user_id", "event_type")
    return stream_result(spark, counts.filter("n_distinct > 3"))


def stream_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with over one and a half times as many events of a kind as are usual (its events by the number of hours that have any)."""
    events = table(spark, sf_dir, "events")
    hours = events.select(F.date_trunc("hour", "ts")).distinct().count()
    usual = events.groupBy("event_type").agg((F.count("*") / float(max(1, hours))).alias("usual"))
    counts = streams.counts_by_window(timed_events(spark, sf_dir), "1 hour", None, "event_type")
    return stream_result(spark, streams.against_baseline(counts, usual, "event_type", 1.5)).select("start_us", "event_type", "n")


def stream_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by hour and priority, for a live view; the score is the hundredth of the response time."""
    made = timed_events(spark, sf_dir).withColumn("priority", alerts.priority(F.col("value") / 100))
    return stream_result(spark, streams.counts_by_window(made, "1 hour", None, "priority"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts whose message was silent for an hour, with state for each message."""
    found = logs.event_logs(event_stream(spark, sf_dir)).withColumns({"resource_id": F.col("resource"), "anomaly_score": F.lit(1.0)})
    raised = found.select(alerts.message(found).alias("message"), F.col("timestamp").alias("at")).withWatermark("at", LATE)
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        return stream_result(spark, streams.deduplicated(raised), mode="append")
    finally:
        spark.conf.set(key, before)


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screening list: every 97th user of the events."""
    users = table(spark, sf_dir, "events").filter("user_id % 97 = 0").select("user_id").distinct()
    return users.select(
        F.upper(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("name"),
        F.when(F.col("user_id") % 2 == 0, "OFAC - list").otherwise("BIS - list").alias("source")
    )


def stream_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of logs against a list that stands still."""
    found = screening.screen(logs.event_logs(event_stream(spark, sf_dir)), watched(spark, sf_dir)).filter("compliance_breach")
    return stream_result(spark, found.select("event_id", "user", "ofac_match", "bis_match"), mode="append")


def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor loop over all events: what each of its tables holds."""
    path = scratch(spark)
    score = lambda batch: logs.rule_anomalies(batch.withColumn("resource_id", F.col("resource")))
    monitor = streams.Monitor(f"{path}/monitor", watched(spark, sf_dir), screening.default_rules(table(spark, sf_dir, "events")), score)
    streams.run_available(logs.event_logs(event_stream(spark, sf_dir)), f"{path}/state", monitor)
    rows = {"anomalies": "type", "alerts": "priority", "breaches": "breach_type", "plan": "action"}
    parts = [monitor.stored(spark, name).select(F.lit(name).alias("made"), F.col(kind).alias("kind")) for name, kind in rows.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("made", "kind").agg(F.count("*").alias("n"))


STREAM_WINDOWS = "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL"
STREAM_SLIDING = "WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events WHERE event_type = 'error'), s AS (SELECT b AS start FROM w UNION ALL SELECT b - INTERVAL 30 MINUTE FROM w) SELECT epoch_us(start) AS start_us, 'error' AS event_type, count(*) AS n FROM s GROUP BY start HAVING count(*) > 3"
STREAM_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0
  ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k
  FROM g)
SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, user_id, count(*) AS n FROM s GROUP BY user_id, k"""

STREAM_DISTINCT = """WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS b, user_id, event_type FROM events), s AS (SELECT b AS start, user_id, event_type
  FROM w UNION ALL SELECT b - INTERVAL 12 HOUR, user_id, event_type FROM w)
SELECT epoch_us(start) AS start_us, user_id, count(DISTINCT event_type) AS n_distinct FROM s GROUP BY start, user_id HAVING count(DISTINCT event_type) > 3"""
STREAM_BASELINE = """WITH h AS (SELECT count(DISTINCT date_trunc('hour', ts)) AS hours FROM events), u AS (SELECT event_type, count(*) / (SELECT hours
  FROM h)::DOUBLE AS usual FROM events GROUP BY 1),
c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT epoch_us(b) AS start_us,
  event_type, n FROM c JOIN u USING (event_type) WHERE n > 1.5 * usual"""
STREAM_PRIORITIES = """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, CASE WHEN coalesce(value / 100, 0.5) > 0.8 THEN 'high'
  WHEN coalesce(value / 100, 0.5) > 0.5 THEN 'medium' ELSE 'low' END AS priority, count(*) AS n FROM events GROUP BY ALL"""
STREAM_DEDUP = f"""WITH RECURSIVE {log_plans.LOGS}, times AS (SELECT DISTINCT {log_plans.MESSAGE} AS message, "timestamp" AS t FROM logs),
chain AS (SELECT message, min(t) AS t FROM times GROUP BY message UNION ALL SELECT c.message, min(x.t) FROM chain c
  JOIN times x ON x.message = c.message AND x.t > c.t + INTERVAL 60 MINUTE GROUP BY c.message, c.t)
SELECT message, epoch_us(t) AS at_us FROM chain"""
STREAM_SCREENING = """SELECT event_id, 'user' || user_id AS "user", user_id % 2 = 0 AS ofac_match, user_id % 2 = 1 AS bis_match FROM events
  WHERE 'USER' || user_id IN (SELECT 'USER' || user_id FROM events WHERE user_id % 97 = 0)"""
STREAM_MONITOR = f"""WITH RECURSIVE {log_plans.LOGS}, anomalies AS (SELECT *, 1.0::DOUBLE AS anomaly_score FROM logs
  WHERE status_code >= 400 OR response_time > (SELECT quantile_cont(response_time, 0.95) FROM logs)),
times AS (SELECT DISTINCT {log_plans.MESSAGE} AS message, "timestamp" AS t FROM anomalies),
chain AS (SELECT message, min(t) AS t FROM times GROUP BY message UNION ALL SELECT c.message, min(x.t) FROM chain c
  JOIN times x ON x.message = c.message AND x.t > c.t + INTERVAL 60 MINUTE GROUP BY c.message, c.t),
breaches AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'ofac' ELSE 'bis' END AS kind FROM anomalies WHERE user_id % 97 = 0),
steps AS (SELECT unnest(['email_alert', 'logging', 'access_revocation']) AS kind FROM breaches)
SELECT 'anomalies' AS made, type AS kind, count(*) AS n FROM anomalies GROUP BY 2 UNION ALL SELECT 'alerts', 'high', count(*) FROM chain
UNION ALL SELECT 'breaches', kind, count(*) FROM breaches GROUP BY 2 UNION ALL SELECT 'plan', kind, count(*) FROM steps GROUP BY 2"""

QUERIES = {
    "schedule_counts": (schedule_counts, SCHEDULE_COUNTS), "report_periods": (report_periods, REPORT_PERIODS), "stored_counts": (stored_counts, STORED_COUNTS), "live_dashboard": (live_dashboard, LIVE_DASHBOARD),
    "stream_distinct": (stream_distinct, STREAM_DISTINCT), "stream_baseline": (stream_baseline, STREAM_BASELINE), "stream_priorities": (stream_priorities, STREAM_PRIORITIES), "stream_dedup": (stream_dedup, STREAM_DEDUP),
    "stream_screening": (stream_screening, STREAM_SCREENING), "stream_monitor": (stream_monitor, STREAM_MONITOR),
    "risk_overview": (risk_overview, RISK_OVERVIEW), "compliance_state": (compliance_state, COMPLIANCE_STATE), "dashboard": (dashboard, f"WITH {SCANS} SELECT scan_id, files_scanned, sensitive_files_found FROM scans ORDER BY start_time DESC, scan_id LIMIT 5"),
    "trend": (trend, f"WITH {SCANS} SELECT scan_id, strftime(start_time, '%b %d') AS label, sensitive_files_found FROM scans ORDER BY start_time, scan_id LIMIT 12"), "gdpr_register": (gdpr_register, GDPR_REGISTER),
    "category_tally": (category_tally, "SELECT 'Data Class ' || (event_id % 7) AS category, count(*) AS n FROM events GROUP BY 1"), "ccpa_requests": (ccpa_requests, CCPA_REQUESTS), "hipaa_breaches": (hipaa_breaches, HIPAA_BREACHES), "control_status": (control_status, CONTROL_STATUS),
    "next_runs": (next_runs, NEXT_RUNS), "report_integrity": (report_integrity, REPORT_INTEGRITY), "iforest": (iforest, None), "recon_error": (recon_error, None), "network_error": (network_error, None), "ensemble_anomalies": (ensemble_anomalies, None), "validation_model": (validation_model, None),
    "stream_windows": (stream_windows, STREAM_WINDOWS), "stream_sliding": (stream_sliding, STREAM_SLIDING), "stream_sessions": (stream_sessions, STREAM_SESSIONS),
}
