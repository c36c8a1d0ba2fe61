"""Risk overviews, compliance states, regulation reports and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_score(value: Column, medium: float, high: float) -> Column:
    """85 from high on, 60 from medium on, 30 above nothing."""
    return F.when(value >= high, 85).when(value >= medium, 60).when(value > 0, 30).otherwise(0)


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "High").when(score >= 45, "Medium").otherwise("Low")


def risk_overview(facts: DataFrame) -> DataFrame:
    """Scores of data exposure, access and compliance gap from one row of sensitive_files, recent_alerts and mean_compliance (null without data), and the mean of those above 0."""
    gap = F.coalesce(100 - F.col("mean_compliance"), F.lit(0.0))
    scored = facts.select(
        category_score(F.col("sensitive_files"), 10, 50).alias("data_exposure"),
        category_score(F.col("recent_alerts"), 5, 15).alias("access"), category_score(gap, 15, 30).alias("compliance_gap")
    )
    some = F.filter(F.array("data_exposure", "access", "compliance_gap"), lambda x: x > 0)
    overall = F.coalesce(F.try_divide(F.aggregate(some, F.lit(0), lambda a, x: a + x), F.size(some)), F.lit(0.0)).cast("int")
    return scored.withColumn("overall", overall).withColumn("level", risk_level(F.col("overall")))


def latest(scans: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    names = [c for c in scans.columns if c != key]
    return scans.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order, *[n for n in names if n != order])).alias("r")).select(key, "r.*")


def compliance_state(scans: DataFrame) -> DataFrame:
    """State by the latest completed scan (end_time, files_scanned, sensitive_files_found): counts and level, above 10 High, above 3 Medium."""
    done = scans.filter("status = 'completed'")
    last = done.agg(
        F.max_by(F.struct("scan_id", "files_scanned", "sensitive_files_found"), F.struct("end_time", "scan_id")).alias("s"),
        F.count("*").alias("n_scans")
    )
    n = F.col("s.sensitive_files_found")
    return last.select(
        F.col("s.scan_id").alias("scan_id"), F.col("s.files_scanned").alias("files_scanned"), n.alias("sensitive_files_found"), "n_scans",
        F.when(n > 10, "High").when(n > 3, "Medium").otherwise("Low").alias("risk")
    )


def dashboard(scans: DataFrame, n: int = 5) -> DataFrame:
    """The last scans, newest first."""
    return scans.orderBy(F.desc("start_time"), "scan_id").limit(n)


def trend(scans: DataFrame, n: int = 12) -> DataFrame:
    """The first scans by time, with a label of month and day."""
    return scans.orderBy("start_time", "scan_id").limit(n).select(
        "scan_id", F.date_format("start_time", "MMM dd").alias("label"), "sensitive_files_found"
    )


def activity_register(activities: DataFrame) -> DataFrame:
    """Activities (purpose, subject, category) by purpose: number, subjects, and categories in words."""
    words = F.initcap(F.replace("category", F.lit("_"), F.lit(" ")))
    return activities.groupBy("purpose").agg(
        F.count("*").alias("n_activities"), F.count_distinct("subject").alias("n_subjects"),
        F.array_join(F.sort_array(F.collect_set(words)), ", ").alias("categories")
    )


def category_tally(activities: DataFrame) -> DataFrame:
    """How many activities name each category."""
    return activities.groupBy(F.initcap(F.replace("category", F.lit("_"), F.lit(" "))).alias("category")).agg(F.count("*").alias("n"))


def rights_requests(requests: DataFrame) -> DataFrame:
    """Requests (kind, status, days) by kind: received, fulfilled, denied, mean days, and opt-outs."""
    return requests.groupBy("kind").agg(
        F.count("*").alias("received"), F.count_if(F.col("status") == "fulfilled").alias("fulfilled"),
        F.count_if(F.col("status") == "denied").alias("denied"), F.round(F.avg("days"), 4).alias("mean_days"),
        F.count_if(F.col("kind") == "opt_out").alias("opt_outs")
    )


def breach_totals(breaches: DataFrame) -> DataFrame:
    """Breaches and affected persons by month."""
    return breaches.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_breaches"), F.count_distinct("user").alias("affected")
    )


def control_status(controls: DataFrame) -> DataFrame:
    """Controls (regulation, passed) by regulation: assessed, passing, percent and status."""
    percent = 100.0 * F.count_if("passed") / F.count("*")
    return controls.groupBy("regulation").agg(F.count("*").alias("assessed"), F.count_if("passed").alias("passing"), F.round(percent, 2).alias("percent")).withColumn(
        "status", F.when(F.col("percent") >= 85, "Compliant").when(F.col("percent") >= 70, "Partially Compliant").otherwise("Non-Compliant")
    )


def next_run(now: Column, frequency: Column) -> Column:
    """Start of the next day, Monday, month or quarter; unknown frequencies are daily."""
    plus = lambda unit, n: F.date_trunc(unit, now) + F.expr(n)
    return F.when(frequency == "weekly", plus("week", "INTERVAL 7 DAYS")).when(frequency == "monthly", plus("month", "INTERVAL 1 MONTH")).when(
        frequency == "quarterly", plus("quarter", "INTERVAL 3 MONTHS")
    ).otherwise(plus("day", "INTERVAL 1 DAY"))


def period(start: Column, end: Column, now: Column, days: int = 30) -> tuple[Column, Column]:
    """Start and end of a report's period: up to now, and the last so many days, where they aren't given."""
    return F.coalesce(start, now - F.make_interval(days=F.lit(days))), F.coalesce(end, now)


def active_schedules(schedules: DataFrame, report_type: str | None = None) -> DataFrame:
    """Active schedules (schedule_id, report_type, frequency, active), of one type if it is named."""
    on = schedules.filter("active")
    return on if report_type is None else on.filter(F.col("report_type") == report_type)


def schedule_counts(schedules: DataFrame) -> DataFrame:
    """Active schedules by type of report."""
    return active_schedules(schedules).groupBy("report_type").agg(F.count("*").alias("n_active"))


def storage_counters(stored: DataFrame) -> DataFrame:
    """Stored reports (report_type, report_data) by type, and their bytes."""
    return stored.groupBy("report_type").agg(
        F.count("*").alias("n_reports"), F.coalesce(F.sum(F.octet_length("report_data")), F.lit(0)).cast("long").alias("n_bytes")
    )


def live_dashboard(alerts: DataFrame, sensitive_files: DataFrame, scans: DataFrame) -> DataFrame:
    """The live view as one row: alerts by priority, risk (High with any high alert, Medium with any medium, else Low), newest alert, sensitive files (rows of that frame) and scans."""
    count = lambda p: F.count_if(F.col("priority") == p)
    live = alerts.agg(*(count(p).alias(f"n_{p}") for p in ("high", "medium", "low")), F.max("timestamp").alias("newest_alert"))
    risk = F.when(F.col("n_high") > 0, "High").when(F.col("n_medium") > 0, "Medium").otherwise("Low")
    files, total = sensitive_files.agg(F.count("*").alias("sensitive_files")), scans.agg(F.count("*").alias("total_scans"))
    return live.withColumn("risk_level", risk).join(F.broadcast(files)).join(F.broadcast(total))


def recent_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The newest alerts."""
    return alerts.orderBy(F.desc("timestamp"), "alert_id").limit(n)


def expiry(created: Column, years: int) -> Column:
    return created + F.make_interval(days=F.lit(365 * years))


def stored_report(report: Column) -> tuple[Column, Column]:
    """A report as JSON, and its hash."""
    data = F.to_json(report)
    return data, F.sha2(data, 256)


def intact(data: Column, digest: Column) -> Column:
    return F.sha2(data, 256) == digest


def size_text(n: Column) -> Column:
    """A number of bytes in words."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string("%.2f TB", n / float(1 << 40))
    for i in range(3, -1, -1):
        out = F.when(n < float(1 << 10 * (i + 1)), F.format_string(f"%.2f {units[i]}", n / float(1 << 10 * i))).otherwise(out)
    return out
