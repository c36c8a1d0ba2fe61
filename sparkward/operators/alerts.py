"""Alerts: priority, message, resources, de-duplication; review of anomalies and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import row_numbers, running_totals
from .silence import after_silence

#: Alerts with the same message so soon after the last one are dropped.
MINUTES = 60


def priority(score: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    score = F.coalesce(score, F.lit(0.5))
    return F.when(score > high, "high").when(score > medium, "medium").otherwise("low")


def alert_level(score: Column, low: float = 0.75, medium: float = 0.85, high: float = 0.95) -> Column:
    """The level of a score by three thresholds; null below the lowest, which raises no alert."""
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low")


def review_id(anomaly_id: Column, at: Column) -> Column:
    """The id of a review item: the anomaly's and the seconds at which it was queued."""
    return F.concat(anomaly_id.cast("string"), F.lit("_"), F.unix_seconds(at.cast("timestamp")).cast("string"))


def details_json(df: DataFrame, names: list[str]) -> Column:
    """The named columns as JSON with every value as text, those that are null left out."""
    pairs = F.array_compact(F.array(*(F.when(
        F.col(n).isNotNull(), F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v"))
    ) for n in names)))
    return F.to_json(F.map_from_entries(pairs))


def message(df: DataFrame) -> Column:
    """The text of an alert by the anomaly's type, with what is known of it."""
    have = set(df.columns)
    known = lambda name, other: F.coalesce(F.col(name).cast("string"), F.lit(other)) if name in have else F.lit(other)
    kind = F.lower(F.coalesce("type", F.lit("unknown")))
    return (
        F.when(kind.contains("unauthorized_access"), F.concat(F.lit("Unauthorized access attempt by "), known("user_id", "unknown user"), F.lit(" to "), known("resource_id", "sensitive resource")))
        .when(kind.contains("unusual_transfer"), F.concat(F.lit("Unusual data transfer of "), known("data_size", "unknown size"), F.lit(" from "), known("source", "unknown source"), F.lit(" to "), known("destination", "unknown destination")))
        .when(kind.contains("suspicious_behavior"), F.concat(F.lit("Suspicious behavior detected: "), known("user_id", "unknown user"), F.lit(" - "), known("behavior", "suspicious activity")))
        .when(kind.contains("system_activity"), F.concat(F.lit("Anomalous system activity detected in "), known("system", "unknown system"), F.lit(": "), known("activity", "anomalous activity")))
        .when(kind.contains("compliance_violation"), F.concat(known("regulation", "compliance policy"), F.lit(" violation detected: "), known("violation", "policy violation")))
        .otherwise(F.format_string("Anomaly detected with confidence score %.2f", F.coalesce("anomaly_score", F.lit(0.0))))
    )


def affected(df: DataFrame) -> Column:
    """The user, resource and system that an anomaly names."""
    have = set(df.columns)
    one = lambda kind, name: F.struct(
        F.lit(kind).alias("type"), (F.col(name).cast("string") if name in have else F.lit(None).cast("string")).alias("id")
    )
    return F.filter(F.array(one("user", "user_id"), one("data_resource", "resource_id"), one("system", "system")), lambda r: r["id"].isNotNull())


def alerts(anomalies: DataFrame) -> DataFrame:
    """Anomalies as alerts: id, time, priority, message, status and details. Suppressed anomalies (column action) are left out."""
    if "action_decided" in anomalies.columns:
        anomalies = anomalies.filter(~F.coalesce(F.col("action_decided") == "suppress", F.lit(False)))
    details = details_json(anomalies, [c for c in anomalies.columns if c not in ("event_id", "timestamp", "metadata", "message", "action_decided")])
    return anomalies.select(
        F.col("event_id").alias("alert_id"), "timestamp", priority(F.col("anomaly_score")).alias("priority"),
        message(anomalies).alias("message"), "source_type", F.lit("new").alias("status"), details.alias("details"),
        affected(anomalies).alias("resources")
    )


def deduplicated(found: DataFrame, minutes: int = MINUTES, before: DataFrame | None = None) -> DataFrame:
    """The alerts that stay when each message is silent for so long after an alert that stayed: message, timestamp.

    Times of a message are distinct; one exactly minutes later still counts as a repetition. before has the last
    alert (message, timestamp) that stayed earlier of some messages. A message of any number of alerts is many
    tasks; see after_silence.
    """
    micros = F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at")
    last = None if before is None else before.select("message", micros)
    kept = after_silence(found.select("message", micros), "message", "at", minutes * 60_000_000, last)
    return kept.select("message", F.timestamp_micros("at").alias("timestamp"))


def statistics(found: DataFrame) -> DataFrame:
    """Active alerts, their first and last time, and numbers by priority, as one row."""
    return found.agg(
        F.count_if(F.col("status") == "new").alias("active"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
        *(F.count_if(F.col("priority") == p).alias(f"n_{p}") for p in ("high", "medium", "low"))
    )


def page(found: DataFrame, of: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of alerts, newest first."""
    if of:
        found = found.filter(F.col("priority") == of)
    return found.orderBy(F.desc("timestamp"), "alert_id").offset(offset).limit(limit)


def decide(confidence: Column) -> tuple[Column, Column, Column]:
    """Whether an anomaly is valid, needs review, and what is done; with no model it is valid and reviewed."""
    c = F.coalesce(confidence, F.lit(0.5))
    valid = confidence.isNull() | (c > 0.5)
    return valid, c < 0.7, F.when(valid, "alert").otherwise("suppress")


def review_priority(severity: Column, confidence: Column) -> Column:
    """The queue of a review item: uncertain ones move up."""
    urgent = 1 - confidence > 0.8
    return F.when(severity == "high", "high").when(
        severity == "medium", F.when(urgent, "high").otherwise("medium")
    ).otherwise(F.when(urgent, "medium").otherwise("low"))


def queued(items: DataFrame) -> DataFrame:
    """Items (review_id, queued_at, severity, confidence) with their queue."""
    return items.withColumn("queue", review_priority(F.col("severity"), F.col("confidence")))


def review_queue(items: DataFrame) -> DataFrame:
    """Items (review_id, queued_at, severity, confidence) with their queue and place in it, oldest first."""
    placed = queued(items)
    return row_numbers(placed.select("review_id", "queued_at", "queue"), "queue", "queued_at", "review_id", "position")


def review_statistics(queue: DataFrame) -> DataFrame:
    """Length and oldest item of each queue; places in it aren't needed."""
    return queue.groupBy("queue").agg(F.count("*").alias("n_items"), F.min("queued_at").alias("oldest"))


def validation_counters(judged: DataFrame, feedback: DataFrame, updates: DataFrame) -> DataFrame:
    """Anomalies processed, valid and sent to review (booleans valid, needs_review), feedback collected, and model updates, as one row."""
    counts = judged.agg(F.count("*").alias("processed"), F.count_if("valid").alias("validated"), F.count_if("needs_review").alias("queued"))
    collected, updated = feedback.agg(F.count("*").alias("collected")), updates.agg(F.count("*").alias("updates"))
    return counts.join(F.broadcast(collected)).join(F.broadcast(updated))


def generation_counters(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Anomalies by priority: how many there were, were filtered out (suppressed), were validated (not suppressed) and became stored alerts (alert_id)."""
    suppressed = F.coalesce(F.col("action_decided") == "suppress", F.lit(False))
    kept = stored.select(F.col("alert_id").alias("stored_id")).distinct()
    joined = found.join(kept, F.col("event_id") == F.col("stored_id"), "left")
    created = F.count_if(~suppressed & F.col("stored_id").isNotNull())
    return joined.groupBy(priority(F.col("anomaly_score")).alias("priority")).agg(
        F.count("*").alias("n_anomalies"), F.count_if(suppressed).alias("filtered"), F.count_if(~suppressed).alias("validated"),
        created.alias("created")
    )


def expired(items: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Items that stay, and those older than so many days."""
    old = F.col("queued_at") < as_of - F.make_interval(days=F.lit(days))
    return items.filter(~old), items.filter(old)


def feedback_statistics(feedback: DataFrame) -> DataFrame:
    """Reviewed, true and false positives, accuracy and false positive rate, and the share of anomalies they speak for (0.01 to 0.5)."""
    tp, n = F.count_if("is_true_positive"), F.count("is_true_positive")
    share = F.coalesce(F.try_divide(tp, n), F.lit(0.0))
    return feedback.agg(
        n.alias("reviewed"), tp.alias("true_positives"), (n - tp).alias("false_positives"), F.round(share, 6).alias("accuracy"),
        F.round(F.coalesce(F.try_divide(n - tp, n), F.lit(0.0)), 6).alias("false_positive_rate"),
        F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.5), share)), 6).alias("contamination")
    )


def best_threshold(observed: DataFrame) -> DataFrame:
    """The smallest error that has the highest F1 when errors from it on count as positive: threshold, f1.

    observed has error and positive. Distinct errors are counted first, and summed from the highest on.
    No row comes out where one of the classes is absent or F1 is 0.
    """
    counts = observed.filter("error IS NOT NULL").groupBy("error").agg(F.count_if("positive").alias("tp"), F.count_if(~F.col("positive")).alias("fp"))
    whole = counts.agg(F.sum("tp").alias("all_tp"), F.sum("fp").alias("all_fp"))
    summed = running_totals(counts, "error", {"tp": "sum_tp", "fp": "sum_fp"}, descending=True).join(F.broadcast(whole))
    f1 = 2.0 * F.col("sum_tp") / (F.col("all_tp") + F.col("sum_tp") + F.col("sum_fp"))
    return summed.filter("all_tp > 0 AND all_fp > 0").agg(
        F.max_by("error", F.struct(f1.alias("f1"), (-F.col("error")).alias("order"))).alias("threshold"), F.round(F.max(f1), 6).alias("f1")
    ).filter("f1 > 0")


def confusion(df: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 of predicted against actual (booleans), as one row."""
    p, a = F.col("predicted"), F.col("actual")
    c = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return c.select(
        "*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")
    )


def auroc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve of scores (error, positive), as one row: the share of pairs of a positive and a negative row that are in order, ties for half.

    Counted by distinct error in running totals, so pairs are never made. Null where a class is absent.
    """
    counts = scores.filter("error IS NOT NULL AND positive IS NOT NULL").groupBy("error").agg(
        F.count_if("positive").cast("double").alias("p"), F.count_if(~F.col("positive")).cast("double").alias("n")
    )
    summed = running_totals(counts, "error", {"n": "n_upto"})
    sums = summed.agg(F.sum(F.col("p") * (F.col("n_upto") - F.col("n") / 2)).alias("ordered"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.round(F.try_divide("ordered", F.col("p") * F.col("n")), 6).alias("auroc"))


def labelled_outcomes(anomalies: DataFrame, human: DataFrame, truth: DataFrame) -> DataFrame:
    """Anomalies (anomaly_id, predicted) with what people say (is_true_positive) and what is true (actual); those that all three know."""
    h, t = human.select(F.col("anomaly_id").alias("h_id"), "is_true_positive"), truth.select(F.col("anomaly_id").alias("t_id"), "actual")
    return anomalies.join(h, F.col("anomaly_id") == F.col("h_id")).join(t, F.col("anomaly_id") == F.col("t_id")).select(
        "anomaly_id", "predicted", "is_true_positive", "actual"
    )


def not_repeated(found: DataFrame, stored: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Alerts without a stored one of the same message in the minutes before, or at the same time.

    Times are cut into spans of so many minutes, and a stored alert counts in its own and the next one. So a
    message of very many alerts is spread over its spans, of which the first and last time are enough: an
    alert is repeated if its span has an earlier one, or the span before one late enough.
    """
    width = minutes * 60_000_000
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    old = stored.select("message", at.alias("at")).filter("at IS NOT NULL").withColumn("span", F.floor(F.col("at") / F.lit(width)).cast("long"))
    ends = old.groupBy("message", "span").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    own, before = (
        ends.select(F.col("message").alias(f"{p}_message"), (F.col("span") + k).alias(f"{p}_span"), F.col(c).alias(f"{p}_{c}")) for p, k,
        c in (("own", 0, "first"), ("before", 1, "last"))
    )
    placed = found.withColumn("_at", at).withColumn("_span", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    same = lambda p: (F.col("message") == F.col(f"{p}_message")) & (F.col("_span") == F.col(f"{p}_span"))
    met = placed.join(own, same("own"), "left").join(before, same("before"), "left")
    repeated = F.coalesce(F.col("own_first") <= F.col("_at"), F.lit(False)) | F.coalesce(F.col("before_last") >= F.col("_at") - width, F.lit(False))
    return met.filter(~repeated).select(*found.columns)


def next_item(queue: DataFrame, levels: tuple[str, ...] = ("high",)) -> DataFrame:
    """The oldest item of the first of the levels that has one."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("queue"))
    return queue.filter(F.col("queue").isin(*levels)).orderBy(rank, "position").limit(1)


def submitted(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback on decided items (review_id, is_true_positive, notes), and the queue that is left."""
    decided = decisions.select(F.col("review_id").alias("_id"), "is_true_positive", F.coalesce("notes", F.lit("")).alias("notes"))
    return queue.join(decided, F.col("review_id") == F.col("_id")).drop("_id"), queue.join(decided, F.col("review_id") == F.col("_id"), "left_anti")


def should_retrain(feedback: DataFrame, last: Column, now: Column, least: int = 50, hours: int = 24) -> DataFrame:
    """Whether there is enough feedback since the last training and that is long enough ago, as one row."""
    newer = F.count_if(F.col("timestamp") > last)
    return feedback.agg(newer.alias("n_new"), ((newer >= least) & (F.max(now) >= F.max(last) + F.make_interval(hours=F.lit(hours)))).alias("retrain"))


def predictions_hold(stored: DataFrame, expected: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Whether stored predictions (id, value) are close to expected ones: id, holds."""
    other = expected.select(F.col("id").alias("_id"), F.col("value").alias("_value"))
    return stored.join(other, F.col("id") == F.col("_id")).select(
        "id", (F.abs(F.col("value") - F.col("_value")) <= atol + rtol * F.abs(F.col("_value"))).alias("holds")
    )
