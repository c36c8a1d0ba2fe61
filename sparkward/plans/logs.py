"""Queries over logs, alerts, reviews, screening and remediation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import REMEDIATION_RULES, ROLE_PERMISSIONS
from ..operators import alerts, logs, recursive, screening
from ..session import table
from ..streaming import streams


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.event_logs(table(spark, sf_dir, "events"))


LOGS = """logs AS (SELECT event_id, ts AS "timestamp", 'user' || user_id AS "user", 'res' || json_extract_string(props, '$.k') AS resource,
  upper(event_type) AS action, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS log_level, CASE WHEN event_type = 'error' THEN 500
    ELSE 200 END AS status_code, value AS response_time, user_id,
  CASE event_type WHEN 'error' THEN 'unauthorized_access' WHEN 'purchase' THEN 'unusual_transfer' WHEN 'signup' THEN 'suspicious_behavior'
    WHEN 'click' THEN 'system_activity' ELSE 'compliance_violation' END AS type FROM events)"""


def logs_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = logs.normalize(event_logs(spark, sf_dir))
    return made.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "source", "source_type", "log_level", "user", "resource", "action",
        "status", F.col("metadata")["k"].alias("meta_k")
    )


LOGS_NORMALIZED = f"""WITH {LOGS} SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS at, 'events' AS source, 'on_prem' AS source_type, log_level, "user",
  resource, action, status, substr(resource, 4) AS meta_k FROM logs"""


def anomalies_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rule_anomalies(event_logs(spark, sf_dir)).select("event_id", "user", "status_code", "response_time", "anomaly_score")


ANOMALIES_RULE = f"""WITH {LOGS} SELECT event_id, "user", status_code, response_time, 1.0::DOUBLE AS anomaly_score FROM logs
  WHERE status_code >= 400 OR response_time > (SELECT quantile_cont(response_time, 0.95) FROM logs)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with the scaled response time as their score."""
    return logs.scaled(event_logs(spark, sf_dir).filter("response_time IS NOT NULL"), "response_time", "anomaly_score")


SCORED = LOGS + ', scored AS (SELECT *, coalesce((response_time - min(response_time) OVER ()) / nullif(max(response_time) OVER () - min(response_time) OVER (), 0), 0) AS anomaly_score FROM logs WHERE response_time IS NOT NULL)'


def anomalies_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.above_percentile(scored(spark, sf_dir), "anomaly_score").select(
        "event_id", "user", F.round("anomaly_score", 6).alias("anomaly_score")
    )


ANOMALIES_PERCENTILE = f'WITH {SCORED} SELECT event_id, "user", round(anomaly_score, 6) AS anomaly_score FROM scored WHERE anomaly_score > (SELECT quantile_cont(anomaly_score, 0.95) FROM scored)'


def found_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alerts(scored(spark, sf_dir).withColumn("resource_id", F.col("resource")))


PRIORITY = "CASE WHEN anomaly_score > 0.8 THEN 'high' WHEN anomaly_score > 0.5 THEN 'medium' ELSE 'low' END"
MESSAGE = """CASE type WHEN 'unauthorized_access' THEN 'Unauthorized access attempt by ' || user_id || ' to ' || resource
  WHEN 'unusual_transfer' THEN 'Unusual data transfer of unknown size from events to unknown destination'
  WHEN 'suspicious_behavior' THEN 'Suspicious behavior detected: ' || user_id || ' - suspicious activity'
    WHEN 'system_activity' THEN 'Anomalous system activity detected in unknown system: anomalous activity'
    ELSE 'compliance policy violation detected: policy violation' END"""


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_alerts(spark, sf_dir).select("alert_id", "priority", "message", "status", F.size("resources").alias("n_resources"))


ALERT_MESSAGES = f"WITH {SCORED} SELECT event_id AS alert_id, {PRIORITY} AS priority, {MESSAGE} AS message, 'new' AS status, CAST(2 AS INT) AS n_resources FROM scored"


def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.statistics(found_alerts(spark, sf_dir)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


ALERT_STATS = f"""WITH {SCORED} SELECT count(*) AS active, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max("timestamp"),
  '%Y-%m-%d %H:%M:%S') AS last_at, count(*) FILTER ({PRIORITY} = 'high') AS n_high, count(*) FILTER ({PRIORITY} = 'medium') AS n_medium,
  count(*) FILTER ({PRIORITY} = 'low') AS n_low FROM scored"""


def alerts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.deduplicated(found_alerts(spark, sf_dir)).select("message", F.unix_micros("timestamp").alias("at_us"))


ALERTS_DEDUP = f"""WITH RECURSIVE {SCORED}, times AS (SELECT DISTINCT {MESSAGE} AS message, "timestamp" AS t FROM scored),
chain AS (SELECT message, min(t) AS t FROM times GROUP BY message UNION ALL SELECT c.message, min(x.t) FROM chain c
  JOIN times x ON x.message = c.message AND x.t > c.t + INTERVAL 60 MINUTE GROUP BY c.message, c.t)
SELECT message, epoch_us(t) AS at_us FROM chain"""


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomalies as review items; the fraction of their score's hundreds stands for the validator's confidence."""
    anomalies = scored(spark, sf_dir)
    sure = F.col("anomaly_score") * 100 - F.floor(F.col("anomaly_score") * 100)
    return anomalies.select(
        F.col("event_id").alias("review_id"), F.unix_micros("timestamp").alias("queued_at"),
        alerts.priority(F.col("anomaly_score")).alias("severity"), sure.alias("confidence")
    )


QUEUE = f"""{SCORED}, items AS (SELECT event_id AS review_id, epoch_us("timestamp") AS queued_at, {PRIORITY} AS severity,
  anomaly_score * 100 - floor(anomaly_score * 100) AS confidence FROM scored),
queue AS (SELECT review_id, queued_at, CASE severity WHEN 'high' THEN 'high' WHEN 'medium' THEN CASE WHEN 1 - confidence > 0.8 THEN 'high'
  ELSE 'medium' END ELSE CASE WHEN 1 - confidence > 0.8 THEN 'medium' ELSE 'low' END END AS queue FROM items)"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.review_queue(review_items(spark, sf_dir))


REVIEW_QUEUE = f"WITH {QUEUE} SELECT review_id, queued_at, queue, CAST(row_number() OVER (PARTITION BY queue ORDER BY queued_at, review_id) AS INT) AS position FROM queue"


def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.review_statistics(alerts.queued(review_items(spark, sf_dir)))


REVIEW_STATS = f"WITH {QUEUE} SELECT queue, count(*) AS n_items, min(queued_at) AS oldest FROM queue GROUP BY queue"


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("error"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("error", (F.col("toxic") == 1).alias("positive"))


def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.feedback_statistics(observed(spark, sf_dir).withColumnRenamed("positive", "is_true_positive"))


FEEDBACK_STATS = """WITH f AS (SELECT l.toxic = 1 AS p FROM labels l JOIN documents d USING (doc_id)), s AS (SELECT count(p) AS n, count(*) FILTER (p) AS tp
  FROM f)
SELECT n AS reviewed, tp AS true_positives, n - tp AS false_positives, round(coalesce(tp / nullif(n, 0)::DOUBLE, 0), 6) AS accuracy,
  round(coalesce((n - tp) / nullif(n, 0)::DOUBLE, 0), 6) AS false_positive_rate, round(greatest(0.01::DOUBLE, least(0.5::DOUBLE,
  coalesce(tp / nullif(n, 0)::DOUBLE, 0))), 6) AS contamination FROM s"""


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.best_threshold(observed(spark, sf_dir))


BEST_THRESHOLD = """WITH o AS (SELECT CAST(n_chars AS DOUBLE) AS error, toxic = 1 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT error,
  count(*) FILTER (p) AS tp, count(*) FILTER (NOT p) AS fp FROM o GROUP BY error),
s AS (SELECT error, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(tp) OVER () AS all_tp, sum(fp) OVER () AS all_fp FROM c
  WINDOW w AS (ORDER BY error DESC)), f AS (SELECT error, 2.0::DOUBLE * tp / (all_tp + tp + fp) AS f1 FROM s WHERE all_tp > 0 AND all_fp > 0)
SELECT error AS threshold, round(f1, 6) AS f1 FROM f WHERE f1 > 0 ORDER BY f1 DESC, error LIMIT 1"""


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.confusion(observed(spark, sf_dir).select((F.col("error") >= 2000).alias("predicted"), F.col("positive").alias("actual")))


CONFUSION_METRICS = """WITH o AS (SELECT n_chars >= 2000 AS p, toxic = 1 AS a FROM labels JOIN documents USING (doc_id)),
  c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn,
  count(*) FILTER (NOT p AND NOT a) AS tn FROM o)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0),
  6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c"""


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    listed = customers.filter("c_custkey % 97 = 0").select(
        F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "OFAC - list").otherwise("BIS - list").alias("source")
    )
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return screening.screen(
        orders.select("o_orderkey", "o_totalprice", F.col("c_name").alias("user"), F.col("o_orderpriority").alias("resource")), listed
    )


def screening_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).select("o_orderkey", "user", "ofac_match", "bis_match", "compliance_breach")


SCREENING = """WITH listed AS (SELECT upper(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'OFAC - list' ELSE 'BIS - list' END AS source FROM customer
  WHERE c_custkey % 97 = 0),
names AS (SELECT lower(name) AS name, bool_or(starts_with(source, 'OFAC')) AS ofac, bool_or(starts_with(source, 'BIS')) AS bis FROM listed GROUP BY 1),
o AS (SELECT o_orderkey, c_name AS "user", o_orderpriority AS resource FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT o_orderkey, "user", coalesce(u.ofac, false) OR coalesce(r.ofac, false) AS ofac_match, coalesce(u.bis, false) OR coalesce(r.bis, false) AS bis_match
  FROM o LEFT JOIN names u ON u.name = lower("user") LEFT JOIN names r ON r.name = lower(resource))
SELECT *, ofac_match OR bis_match AS compliance_breach FROM f"""


def remediation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = screened(spark, sf_dir).filter("compliance_breach")
    score = F.col("o_totalprice") / 500000.0
    breaches = hits.select(
        F.col("o_orderkey").alias("breach_id"), F.when(F.col("ofac_match"), "ofac").otherwise("bis").alias("breach_type"),
        screening.confidence_of(score).alias("confidence")
    )
    return screening.remediation_plan(breaches, screening.default_rules(hits))


RULE_VALUES = ", ".join(
    f"('{n}', {repr(k) if k else 'NULL'}, {repr(c) if c else 'NULL'}, '{a}', {s}, {i}, {j})" for i,
    (n, k, c, acts, s) in enumerate(REMEDIATION_RULES) for j, a in enumerate(acts)
)
REMEDIATION_PLAN = f"""WITH b AS (SELECT o_orderkey AS breach_id, CASE WHEN c_custkey % 2 = 0 THEN 'ofac' ELSE 'bis' END AS breach_type, CASE
  WHEN o_totalprice / 500000.0::DOUBLE > 0.9 THEN 'high' WHEN o_totalprice / 500000.0::DOUBLE > 0.7 THEN 'medium' ELSE 'low' END AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 97 = 0),
r(rule_name, kind, sure, action, severity, rule_pos, action_pos) AS (VALUES {RULE_VALUES}),
s AS (SELECT *, row_number() OVER (PARTITION BY breach_id, action ORDER BY severity DESC, rule_pos, action_pos) AS n FROM b
  JOIN r ON (kind IS NULL OR kind = breach_type) AND (sure IS NULL OR sure = confidence))
SELECT breach_id, CAST(row_number() OVER (PARTITION BY breach_id ORDER BY severity DESC, rule_pos, action_pos) AS INT) AS step, action,
  rule_name FROM s WHERE n = 1"""


def siem_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    offenses = events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("description"),
        F.when(F.col("event_type") == "error", "OPEN").otherwise("CLOSED").alias("status"),
        (F.col("event_id") % 11).cast("int").alias("severity")
    )
    return screening.offense_alerts(offenses)


SIEM_ALERTS = """SELECT event_id AS id, 'Offense ' || event_id AS title, CASE WHEN event_id % 11 >= 9 THEN 'Critical' WHEN event_id % 11 >= 7 THEN 'High'
  ELSE 'Medium' END AS severity_name,
'Description: error' || chr(10) || 'Severity: ' || (event_id % 11) || chr(10) || 'Status: OPEN' AS description,
  'Compliance Alert: Offense ' || event_id AS ticket_summary FROM events WHERE event_type = 'error' AND event_id % 11 > 5"""

ROLES = tuple(r for r, _ in ROLE_PERMISSIONS)
PERMISSIONS = ROLE_PERMISSIONS[0][1]


def role_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("user_id") % len(ROLES) + 1).cast("int"))
    permission = F.element_at(F.array(*map(F.lit, PERMISSIONS)), (F.col("event_id") % len(PERMISSIONS) + 1).cast("int"))
    refused = screening.role_violations(table(spark, sf_dir, "events").select(
        "event_id", "user_id", role.alias("role"), permission.alias("permission")
    ))
    return refused.groupBy("role", "permission").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


ROLE_VIOLATIONS = f"""WITH a AS (SELECT event_id, user_id, {list(ROLES)}[user_id % {len(ROLES)} + 1] AS role,
  {list(PERMISSIONS)}[event_id % {len(PERMISSIONS)} + 1] AS permission FROM events),
g(role, permission) AS (VALUES {", ".join(f"('{r}', '{p}')" for r, ps in ROLE_PERMISSIONS for p in ps)})
SELECT role, permission, count(*) AS n, count(DISTINCT user_id) AS n_users FROM a ANTI JOIN g USING (role, permission) GROUP BY role, permission"""


def user_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.user_baseline(event_logs(spark, sf_dir))


USER_BASELINE = f"""WITH {LOGS}, seen AS (SELECT event_id, user_id, "timestamp", response_time, resource, hour("timestamp") AS h,
  count(response_time) OVER w AS n_before, avg(response_time) OVER w AS m, sum(response_time) OVER w AS t,
  stddev_samp(response_time) OVER w AS s FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp",
  event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, n_before, round(t, 2) AS sum_before, coalesce(n_before >= 5 AND response_time > m + 3 * s, false) AS volume_alert,
  row_number() OVER (PARTITION BY user_id, h ORDER BY "timestamp", event_id) = 1 AND n_before >= 5 AS new_hour,
  row_number() OVER (PARTITION BY user_id, resource ORDER BY "timestamp", event_id) = 1 AND n_before >= 5 AS new_location FROM seen"""


def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.sequence_windows(event_logs(spark, sf_dir))


SEQUENCE_WINDOWS = f"""WITH {LOGS}, seen AS (SELECT event_id, user_id, response_time, count(*) OVER w AS n, avg(response_time) OVER w AS m,
  stddev_pop(response_time) OVER w AS s FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp",
  event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, round(m, 6) AS window_mean, round(coalesce(abs(response_time - m) / nullif(s, 0), 0), 6) AS distance FROM seen WHERE n = 10"""

def sequence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of ten rows and their targets; ends and sums stand for the arrays."""
    found = logs.sequences(event_logs(spark, sf_dir))
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    return found.select(
        "event_id", "user_id", F.col("sequence")[0].alias("oldest"), F.col("sequence")[9].alias("newest"), F.round(total, 4).alias("total"),
        "target"
    )


SEQUENCE_ARRAYS = f"""WITH {LOGS}, seen AS (SELECT event_id, user_id, response_time AS target, list(response_time) OVER (PARTITION BY user_id
  ORDER BY "timestamp", event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seq FROM logs WHERE response_time IS NOT NULL)
SELECT event_id, user_id, seq[1] AS oldest, seq[10] AS newest, round(list_sum(seq), 4) AS total, target FROM seen WHERE len(seq) = 10"""


def level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each row is from what its user's level, followed by a filter that is fitted on all rows, leads to expect."""
    found = event_logs(spark, sf_dir)
    return recursive.level_scores(found, recursive.fit_filter(found)).select("event_id", "user_id", F.round("level_score", 4).alias("level_score"))


LEVEL_SCORES = f"""WITH RECURSIVE {LOGS}, seen AS (SELECT event_id, user_id, response_time AS x, row_number() OVER w AS place, response_time - lag(response_time) OVER w AS d
  FROM logs WHERE response_time IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id)),
steps AS (SELECT d, lag(d) OVER (PARTITION BY user_id ORDER BY place) AS e, (SELECT 4 * 1.4826 * quantile_cont(abs(d), 0.5) FROM seen) AS most FROM seen),
cut AS (SELECT greatest(-most, least(most, d)) AS d, CASE WHEN e IS NOT NULL THEN greatest(-most, least(most, e)) END AS e FROM steps WHERE d IS NOT NULL),
moments AS (SELECT avg(d * d) AS v, least(greatest(-avg(d * e), 1e-9 * avg(d * d)), avg(d * d) / 2) AS r FROM cut),
moves AS (SELECT r, greatest(v - 2 * r, 0) AS q FROM moments), levels AS (SELECT r, (q + sqrt(q * q + 4 * q * r)) / 2 AS p FROM moves),
gains AS (SELECT least(0.98::DOUBLE, greatest(0.02::DOUBLE, p / (p + r))) AS gain FROM levels),
walk AS (SELECT event_id, user_id, place, x::DOUBLE AS level, 0::DOUBLE AS spread, 0::DOUBLE AS score FROM seen WHERE place = 1
  UNION ALL
  SELECT event_id, user_id, place, level + w * held, spread + w * (held * held - spread), CASE WHEN sure THEN abs(surprise) / sqrt(spread) ELSE 0 END FROM (
    SELECT s.event_id, s.user_id, s.place, level, spread, s.x - level AS surprise, greatest(gain, 1::DOUBLE / s.place) AS w, s.place > 5 AND spread > 0 AS sure,
      CASE WHEN sure THEN greatest(-4 * sqrt(spread), least(4 * sqrt(spread), surprise)) ELSE surprise END AS held
    FROM walk JOIN seen s ON s.user_id = walk.user_id AND s.place = walk.place + 1, gains))
SELECT event_id, user_id, round(score, 4) AS level_score FROM walk"""


def hybrid_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the row score (the response time) and the sequence score flag."""
    found = logs.sequences(event_logs(spark, sf_dir))
    scores = found.select(
        "event_id", F.col("target").alias("row_score"), logs.sequence_distance(F.col("sequence"), F.col("target")).alias("sequence_score")
    )
    return logs.hybrid_flags(scores)


HYBRID = f"""{LOGS}, seen AS (SELECT event_id, user_id, response_time, count(*) OVER w AS n, avg(response_time) OVER w AS m,
  stddev_pop(response_time) OVER w AS sd
  FROM logs WHERE response_time IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
d AS (SELECT event_id, response_time AS x, coalesce(abs(response_time - m) / nullif(sd, 0), 0) AS y FROM seen WHERE n = 10),
z AS (SELECT event_id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS a, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS b FROM d),
flags AS (SELECT event_id, (a + b) / 2 AS score, a > 0.5 AS row_flag, b > 0.5 AS sequence_flag, (a + b) / 2 > 0.5 AS combined_flag FROM z)"""


def hybrid_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.flag_agreement(hybrid_flags(spark, sf_dir))


HYBRID_AGREEMENT = f"""WITH {HYBRID} SELECT count(*) AS n_rows, count(*) FILTER (row_flag) AS n_row, count(*) FILTER (sequence_flag) AS n_sequence,
  count(*) FILTER (combined_flag) AS n_combined,
  round(coalesce(avg(CAST(row_flag = combined_flag AND sequence_flag = combined_flag AS INT)), 0), 6) AS agreement FROM flags"""


def hybrid_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.hybrid_alerts(event_logs(spark, sf_dir), hybrid_flags(spark, sf_dir))
    return found.select(
        "event_id", "source", "user", "resource", F.unix_micros("timestamp").alias("at_us"),
        F.round("anomaly_score", 6).alias("anomaly_score"), "detection_method"
    )


HYBRID_ALERTS = f"""WITH {HYBRID} SELECT event_id, 'events' AS source, "user", resource, epoch_us("timestamp") AS at_us, round(score, 6) AS anomaly_score,
  'hybrid_ai' AS detection_method
FROM flags JOIN logs USING (event_id) WHERE combined_flag"""


def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for the feedback that was collected, those of toxic documents for updates."""
    valid, review, _ = alerts.decide(F.col("confidence"))
    labels = table(spark, sf_dir, "labels")
    return alerts.validation_counters(
        review_items(spark, sf_dir).select(valid.alias("valid"), review.alias("needs_review")), labels, labels.filter("toxic = 1")
    )


VALIDATION_COUNTS = f"""WITH {QUEUE} SELECT count(*) AS processed, count(*) FILTER (confidence > 0.5) AS validated, count(*) FILTER (confidence < 0.7) AS queued,
  (SELECT count(*) FROM labels) AS collected, (SELECT count(*) FROM labels WHERE toxic = 1) AS updates FROM items"""


def alert_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of every tenth user are suppressed, and alerts of even ids were stored."""
    found = scored(spark, sf_dir).withColumn("action_decided", F.when(F.col("user_id") % 10 == 0, "suppress").otherwise("alert"))
    return alerts.generation_counters(found, found.filter("event_id % 2 = 0").select(F.col("event_id").alias("alert_id")))


ALERT_GENERATION = f"""WITH {SCORED} SELECT {PRIORITY} AS priority, count(*) AS n_anomalies, count(*) FILTER (user_id % 10 = 0) AS filtered,
  count(*) FILTER (user_id % 10 <> 0) AS validated,
  count(*) FILTER (user_id % 10 <> 0 AND event_id % 2 = 0) AS created FROM scored GROUP BY 1"""


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.auroc(observed(spark, sf_dir))


AUROC = """WITH o AS (SELECT n_chars AS error, toxic = 1 AS p FROM labels JOIN documents USING (doc_id)),
r AS (SELECT p, rank() OVER (ORDER BY error) + (count(*) OVER (PARTITION BY error) - 1) / 2.0::DOUBLE AS rk FROM o),
s AS (SELECT sum(rk) FILTER (p) AS ranks, count(*) FILTER (p) AS np, count(*) FILTER (NOT p) AS nn FROM r)
SELECT round((ranks - np * (np + 1) / 2.0::DOUBLE) / nullif(np * nn, 0), 6) AS auroc FROM s"""


def action_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three highest actions for each breach, those that a hybrid decision takes, and how far model and rules agree."""
    hits = screened(spark, sf_dir).filter("compliance_breach")
    severity = F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0)
    words = lambda *xs: F.array(*map(F.lit, xs))
    ai = F.when(F.col("o_totalprice") > 200000, words("access_revocation", "email_alert")).otherwise(words("logging", "email_alert"))
    rule = F.when(F.col("ofac_match"), words("logging", "quarantine")).otherwise(words("logging"))
    top = screening.top_actions(screening.action_scores(ai, rule, severity, F.lit(0.8)))
    chosen = screening.hybrid_actions(ai, rule, severity)
    return hits.select(
        F.col("o_orderkey").alias("breach_id"), F.array_join(top, ",").alias("top"), F.array_join(chosen, ",").alias("chosen"),
        F.round(screening.agreement(ai, rule), 6).alias("agreement")
    )


ACTION_RANKING = """WITH b AS (SELECT o_orderkey AS breach_id, least(1.0::DOUBLE, o_totalprice / 500000.0::DOUBLE) AS severity, CASE
  WHEN o_totalprice > 200000 THEN ['access_revocation', 'email_alert'] ELSE ['logging', 'email_alert'] END AS ai,
  CASE WHEN c_custkey % 2 = 0 THEN ['logging', 'quarantine'] ELSE ['logging'] END AS rule FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_custkey % 97 = 0),
a AS (SELECT *, severity * 0.8::DOUBLE AS w, unnest(list_distinct(list_concat(ai, rule))) AS action FROM b),
s AS (SELECT breach_id, action, CAST(list_contains(ai, action) AS INT)::DOUBLE * w + CAST(list_contains(rule,
  action) AS INT)::DOUBLE * (1 - w) AS score FROM a),
t AS (SELECT breach_id, array_to_string(list_slice(list(action ORDER BY score DESC, action), 1, 3), ',') AS top FROM s GROUP BY 1)
SELECT breach_id, top, array_to_string(CASE WHEN severity >= 0.7 THEN ai ELSE rule END, ',') AS chosen, round(len(list_intersect(ai,
  rule)) / greatest(len(ai), len(rule))::DOUBLE, 6) AS agreement FROM b JOIN t USING (breach_id)"""


def failed_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log-ins, errors as failed ones: successes after two failures or more within a day."""
    e = table(spark, sf_dir, "events")
    logins = e.select(
        F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("successful")
    ).distinct()
    return streams.failed_then_success(logins, 1440, 2).select("user", F.unix_micros("at").alias("at_us"), "n_failed")


FAILED_LOGINS = """WITH l AS (SELECT DISTINCT user_id AS "user", ts AS at, event_type <> 'error' AS ok FROM events)
SELECT g."user", epoch_us(g.at) AS at_us, count(*) AS n_failed FROM l g
  JOIN l b ON b."user" = g."user" AND NOT b.ok AND b.at < g.at AND b.at >= g.at - INTERVAL 1440 MINUTE WHERE g.ok GROUP BY 1, 2
  HAVING count(*) >= 2"""


def sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of two sources as one."""
    chat = table(spark, sf_dir, "conversations").select(F.col("role").alias("user"), F.col("text").alias("message"))
    both = logs.united({"events": event_logs(spark, sf_dir), "chat": chat})
    return both.groupBy("source", "status").agg(
        F.count("*").alias("n_rows"), F.count_distinct("user").alias("n_users"), F.count_if(F.col("timestamp").isNull()).alias("no_time")
    )


SOURCES_UNION = f"""WITH {LOGS} SELECT 'events' AS source, status, count(*) AS n_rows, count(DISTINCT "user") AS n_users,
  count(*) FILTER ("timestamp" IS NULL) AS no_time FROM logs GROUP BY status
UNION ALL SELECT 'chat', '', count(*), count(DISTINCT coalesce(role, '')), count(*) FROM conversations"""

QUERIES = {
    "sequence_arrays": (sequence_arrays, SEQUENCE_ARRAYS), "level_scores": (level_scores, LEVEL_SCORES), "hybrid_agreement": (hybrid_agreement, HYBRID_AGREEMENT), "hybrid_alerts": (hybrid_alerts, HYBRID_ALERTS), "validation_counts": (validation_counts, VALIDATION_COUNTS),
    "alert_generation": (alert_generation, ALERT_GENERATION), "auroc": (auroc, AUROC), "action_ranking": (action_ranking, ACTION_RANKING), "failed_logins": (failed_logins, FAILED_LOGINS), "sources_union": (sources_union, SOURCES_UNION),
    "logs_normalized": (logs_normalized, LOGS_NORMALIZED), "anomalies_rule": (anomalies_rule, ANOMALIES_RULE), "anomalies_percentile": (anomalies_percentile, ANOMALIES_PERCENTILE), "alert_messages": (alert_messages, ALERT_MESSAGES),
    "alert_stats": (alert_stats, ALERT_STATS), "alerts_dedup": (alerts_dedup, ALERTS_DEDUP), "review_queue": (review_queue, REVIEW_QUEUE), "review_stats": (review_stats, REVIEW_STATS), "feedback_stats": (feedback_stats, FEEDBACK_STATS),
    "best_threshold": (best_threshold, BEST_THRESHOLD), "confusion_metrics": (confusion_metrics, CONFUSION_METRICS), "screening": (screening_hits, SCREENING), "remediation_plan": (remediation_plan, REMEDIATION_PLAN), "siem_alerts": (siem_alerts, SIEM_ALERTS),
    "role_violations": (role_violations, ROLE_VIOLATIONS), "user_baseline": (user_baseline, USER_BASELINE), "sequence_windows": (sequence_windows, SEQUENCE_WINDOWS),
}
