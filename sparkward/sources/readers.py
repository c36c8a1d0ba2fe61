"""Reading of files, logs, lists and feedback, and writing of outboxes and states."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.logs import normalize
from ..session import written

#: Extensions that a scan takes, if none are named.
EXTENSIONS = ("txt", "csv", "json", "xml", "html", "md")
SYSLOG = r"^(?:<(\d+)>)?(\w{3}\s+\d+ [\d:]{8}) (\S+) ([^:\[]+)(?:\[(\d+)\])?: (.*)$"


def scan_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files below a path by extension in any case: path, name, extension, bytes, modified, mime, text. Bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.when(F.startswith("content", F.lit(b"%PDF-")), "application/pdf").when(
        F.startswith("content", F.lit(b"PK\x03\x04")), "application/zip"
    ).otherwise("text/plain")
    return files.withColumn("extension", extension).filter(F.col("extension").isin(*extensions)).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "extension", F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"), mime.alias("mime"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, content) that aren't in the manifest (path, hash) with the same hash, with their hash."""
    hashed = files.withColumn("hash", F.sha2("content", 256))
    seen = manifest.select(F.col("path").alias("_path"), F.col("hash").alias("_hash"))
    return hashed.join(seen, (F.col("path") == F.col("_path")) & (F.col("hash") == F.col("_hash")), "left_anti")


def syslog(lines: DataFrame) -> DataFrame:
    """Syslog lines (value) as timestamp text, host, program and message."""
    part = lambda i: F.regexp_extract("value", SYSLOG, i)
    return lines.filter(F.col("value").rlike(SYSLOG)).select(
        part(2).alias("at"), part(3).alias("source"), part(4).alias("resource"), part(6).alias("message")
    )


def read_logs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Logs of a format: json, csv or syslog."""
    if kind == "json":
        return spark.read.json(path)
    if kind == "csv":
        return spark.read.option("header", "true").csv(path)
    if kind == "syslog":
        return syslog(spark.read.text(path))
    raise ValueError(f"unknown log format {kind}")


def training_data(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Rows of a CSV file with a header, types by their values; those without a label are left out."""
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path).filter(F.col(label).isNotNull())


def since(logs: DataFrame, last: Column, now: Column, max_age_days: int = 30) -> DataFrame:
    """Rows after the last time read, or of the last days where that is null."""
    return logs.filter(F.col("timestamp") > F.coalesce(last, now - F.make_interval(days=F.lit(max_age_days))))


def screening_list(spark: SparkSession, path: str) -> DataFrame:
    """Names and sources of a list in JSON with a field results."""
    return spark.read.schema("results array<struct<name:string,source:string>>").option(
        "multiLine", "true"
    ).json(path).select(F.inline("results")).distinct()


#: Seconds after which a screening list is read anew.
LIST_SECONDS = 86_400


class ScreeningList:
    """A screening list that is read anew once it is older than seconds; while that fails, the stale copy goes on.

    clock gives the time in seconds. The first read must succeed.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = LIST_SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.seconds, self.clock = spark, path, seconds, clock
        self.names, self.read_at, self.error = None, None, None

    def current(self) -> DataFrame:
        if self.names is None or self.clock() - self.read_at > self.seconds:
            try:
                self.names, self.error = written(screening_list(self.spark, self.path)), None
                self.read_at = self.clock()
            except (PySparkException, Py4JJavaError) as e:
                if self.names is None:
                    raise
                self.error = str(e).splitlines()[0]
        return self.names

    def size(self) -> int:
        return self.current().select(F.lower("name")).distinct().count()


def newest_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest order; of equal ones the last by all its columns."""
    names = [c for c in df.columns if c != key]
    whole = F.struct(F.col(order), F.to_json(F.struct(*df.columns)))
    return df.groupBy(key).agg(F.max_by(F.struct(*names), whole).alias("_row")).select(key, "_row.*").select(*df.columns)


def feedback(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Feedback files; of several for an anomaly the latest counts. Fields of context become columns. With most, the newest so many."""
    latest = newest_of(spark.read.option("multiLine", "true").json(path), "anomaly_id", "timestamp")
    if most is not None:
        latest = latest.orderBy(F.desc("timestamp"), "anomaly_id").limit(most)
    return latest.select("anomaly_id", "is_true_positive", "anomaly_type", "feedback_source", "timestamp", "context.*")


def scan_tables(spark: SparkSession, tables: list[str], profile) -> tuple[list[DataFrame], dict[str, str]]:
    """Profiles tables one by one; those that fail are told by their error and don't stop the others."""
    done, failed = [], {}
    for name in tables:
        try:
            done.append(profile(spark.table(name)).withColumn("table_name", F.lit(name)))
        except (PySparkException, Py4JJavaError) as e:
            failed[name] = str(e).splitlines()[0]
    return done, failed


#: Databases that hold a system's own tables.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "sys", "mysql", "performance_schema")


def scan_catalog(
    spark: SparkSession, profile: Callable[[DataFrame], DataFrame], system: tuple[str, ...] = SYSTEM_SCHEMAS, catalog: str | None = None
) -> tuple[DataFrame | None, DataFrame]:
    """Profiles every table of every database of a catalog (the current one by default) but those of the system.

    Gives the profiles in one frame, with schema_name and table_name (None where no table could be profiled), and a row for each table:
    schema_name, table_name, status (profiled or failed), error. A profile is planned, and its first row computed, when its table's turn comes, so one that
    can't be read is a row, too, and the others are profiled. Temporary views belong to no database and are left out.
    """
    prefix = f"`{catalog}`." if catalog else ""
    parts, status = [], []
    for schema in sorted(r.namespace for r in spark.sql(f"SHOW SCHEMAS{f' IN `{catalog}`' if catalog else ''}").collect()):
        if schema.lower() in system:
            continue
        tables = spark.sql(f"SHOW TABLES IN {prefix}`{schema}`").filter("NOT isTemporary").collect()
        for name in sorted(r.tableName for r in tables):
            try:
                made = profile(spark.table(f"{prefix}`{schema}`.`{name}`"))
                made.limit(1).collect()
                parts.append(made.withColumns({"schema_name": F.lit(schema), "table_name": F.lit(name)}))
                status.append((schema, name, "profiled", None))
            except (PySparkException, Py4JJavaError) as e:
                status.append((schema, name, "failed", str(e).splitlines()[0]))
    told = spark.createDataFrame(status, "schema_name string, table_name string, status string, error string")
    return (reduce(DataFrame.unionByName, parts) if parts else None), told


def record_feedback(
    spark: SparkSession, path: str, anomaly_id: str, is_true_positive: bool, anomaly_type: str, feedback_source: str = "human", context: dict[str, str] | None = None
) -> None:
    """Adds a piece of feedback, with its time and context (without nulls), to a folder; feedback reads the latest one for each anomaly."""
    said = [(anomaly_id, is_true_positive, anomaly_type, feedback_source, {k: str(v) for k, v in (context or {}).items() if v is not None})]
    rows = spark.createDataFrame(said, "anomaly_id string, is_true_positive boolean, anomaly_type string, feedback_source string, context map<string,string>")
    rows.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def scan_summary_row(totals: DataFrame, status: str = "completed") -> DataFrame:
    """A scan's summary for a JSON file: its totals (of catalog.scan_totals), status and time."""
    return totals.select(F.date_format(F.current_timestamp(), "yyyyMMddHHmmss").alias("scan_id"), F.current_timestamp().alias("finished_at"), F.lit(status).alias("status"), *totals.columns)


def put_parameters(spark: SparkSession, path: str, **values: float) -> int:
    """Adds a version of the parameters, such as threshold and contamination; those that aren't given stay as they were. Gives the version."""
    version, now = latest_parameters(spark, path)
    rows = [(version + 1, k, float(v)) for k, v in sorted({**now, **values}.items())]
    spark.createDataFrame(rows, "version long, name string, value double").coalesce(1).withColumn("set_at", F.current_timestamp()).write.mode("append").parquet(path)
    return version + 1


def latest_parameters(spark: SparkSession, path: str, most: int | None = None) -> tuple[int, dict[str, float]]:
    """The last version of the parameters, or the last one up to most: its number (0 without any) and values."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return 0, {}
    rows = spark.read.parquet(path)
    version = (rows if most is None else rows.filter(F.col("version") <= most)).agg(F.max("version")).first()[0]
    return (version, {r.name: r.value for r in rows.filter(F.col("version") == version).collect()}) if version else (0, {})


def batch_parameters(spark: SparkSession, path: str, used: str, batch: int) -> tuple[int, dict[str, float]]:
    """The parameters of a stream's batch: the latest version at its first run, which used remembers, so that a batch that is run again has the same ones."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{used}/batch={batch}")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return latest_parameters(spark, path, spark.read.parquet(f"{used}/batch={batch}").first().version)
    version, values = latest_parameters(spark, path)
    spark.createDataFrame([(version,)], "version long").write.parquet(f"{used}/batch={batch}")
    return version, values


def retune(spark: SparkSession, path: str, gate: DataFrame, statistics: DataFrame, best: DataFrame) -> int | None:
    """A new version of threshold and contamination, if the gate (of alerts.should_retrain) is open; its number.

    statistics and best are what alerts.feedback_statistics and alerts.best_threshold give, a row each; without a best threshold the old one stays.
    """
    if not gate.first().retrain:
        return None
    threshold = best.first()
    return put_parameters(spark, path, contamination=statistics.first().contamination, **({"threshold": threshold.threshold} if threshold else {}))


def email_outbox(breaches: DataFrame, recipients: tuple[str, ...], sender: str, test_mode: bool = False) -> DataFrame:
    """Mails to send about breaches; none without recipients. In test mode they are marked so and not to be sent."""
    body = F.concat(F.lit("<h2>Compliance breach</h2><p>"), F.col("breach_type"), F.lit(" by "), F.coalesce("user", F.lit("unknown")), F.lit("</p>"))
    return breaches.filter(F.lit(bool(recipients))).select(
        "breach_id", F.concat(F.lit("Compliance Alert: "), F.upper("breach_type")).alias("subject"), F.lit(sender).alias("sender"),
        F.array(*map(F.lit, recipients)).cast("array<string>").alias("recipients"), body.alias("html"),
        F.lit("test" if test_mode else "pending").alias("state")
    )


def revocations(breaches: DataFrame, rule: str) -> DataFrame:
    """Temporary revocations, for breaches with a user."""
    return breaches.filter("user IS NOT NULL AND user <> ''").select("breach_id", "user", F.lit(rule).alias("rule"), F.lit(True).alias("temporary"))


def quarantine(breaches: DataFrame, files: DataFrame, at: Column) -> DataFrame:
    """Where files of breaches would go, for those that exist."""
    name = F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit("_"), F.regexp_extract("path", r"([^/]+)$", 1))
    return breaches.join(
        files.select("path").distinct(), F.col("resource_path") == F.col("path")
    ).select("breach_id", "path", name.alias("quarantine_name"))


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Appends to an outbox, a log or a table in files."""
    df.write.mode("append").format(kind).save(path)


def cleared(df: DataFrame, path: str) -> None:
    """Empties a table in files."""
    df.limit(0).write.mode("overwrite").parquet(path)


def latest_state(history: DataFrame) -> DataFrame:
    """The last state of each scan of a history that has a row for each state."""
    return newest_of(history, "scan_id", "recorded_at")


def source_states(sources: DataFrame, read: DataFrame) -> DataFrame:
    """Sources (source_type, name, path_pattern, format, max_age_days) with their state: the last time read (read: name, last_time) and 'new' or 'known'."""
    last = read.groupBy(F.col("name").alias("_name")).agg(F.max("last_time").alias("last_time"))
    joined = sources.join(last, F.col("name") == F.col("_name"), "left").drop("_name")
    return joined.withColumn("state", F.when(F.col("last_time").isNull(), "new").otherwise("known"))


#: Types of sources and the schemes of their paths.
SCHEMES = {"aws_s3": "s3a://", "azure_blob": "abfss://", "on_prem": ""}


def ingest(spark: SparkSession, states: DataFrame, now: Column) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """What is new in each source of source_states (a small table): logs by name, and the errors of those that can't be read.

    A path without a scheme takes that of its type. Rows count as new after the last time read, or within
    max_age_days.
    """
    parts, failed = {}, {}
    for s in states.orderBy("source_type", "name").collect():
        path = s.path_pattern if "://" in s.path_pattern else SCHEMES[s.source_type] + s.path_pattern
        try:
            logs = normalize(read_logs(spark, path, s.format))
            parts[s.name] = since(logs, F.lit(s.last_time).cast("timestamp"), now, s.max_age_days).withColumn("source_type", F.lit(s.source_type))
        except (PySparkException, ValueError) as e:
            failed[s.name] = str(e).splitlines()[0]
    return parts, failed


def column_texts(df: DataFrame, most: int | None = None) -> DataFrame:
    """Non-null cells as text, one row each: column_name, v; of each column most at most, first by hash, if a cap is asked for."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in df.columns))
    rows = df.select(F.inline(cells)).filter("v IS NOT NULL")
    if most is None:
        return rows
    return rows.withColumn(
        "_n", F.row_number().over(Window.partitionBy("column_name").orderBy(F.xxhash64("v")))
    ).filter(F.col("_n") <= most).drop("_n")


def sampled_table(spark: SparkSession, url: str, name: str, percent: float = 1.0, limit: int = 1000, **options: str) -> DataFrame:
    """A sample of a database table by JDBC, drawn by the database itself."""
    reader = spark.read.format("jdbc").option("url", url).option("query", sample_query(name, percent, limit))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def sample_query(name: str, percent: float, limit: int) -> str:
    """The query that the database answers. name is of letters, digits, underscores and dots."""
    if not re.fullmatch(r"\w+(\.\w+)*", name):
        raise ValueError(f"no name of a table: {name}")
    return f"SELECT * FROM {name} TABLESAMPLE SYSTEM ({float(percent)}) LIMIT {int(limit)}"


OFFENSES = "id long, description string, status string, severity int, start_time long, categories array<string>"


def offenses(spark: SparkSession, path: str, since_ms: int, status: str = "OPEN", above: int = 5) -> DataFrame:
    """Landed offenses of a status, above a severity and newer than the last run."""
    return spark.read.schema(OFFENSES).json(path).filter((F.col("status") == status) & (F.col("severity") > above) & (F.col("start_time") > since_ms))


def ingestion_results(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows by source; sources without rows have none."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("source"), "n_rows", F.when(F.col("n_rows") > 0, "success").otherwise("empty").alias("state")
        )
        out = one if out is None else out.unionByName(one)
    return out


def store_report(report: DataFrame, kind: str, created: Column, years: int, path: str) -> None:
    """Appends reports of one row each as JSON with their hash and the time they expire."""
    data = F.to_json(F.struct(*report.columns))
    append(report.select(F.lit(kind).alias("report_type"), data.alias("report_data"), F.sha2(data, 256).alias("digest"), created.alias("created_at"), (created + F.make_interval(days=F.lit(365 * years))).alias("expires_at")), path)


def export_report(report: DataFrame, kind: str, report_id: str, path: str, file_format: str = "csv") -> str:
    """Writes a report as csv or json below a path; gives the place."""
    if file_format not in ("csv", "json"):
        raise ValueError(f"unknown format {file_format}")
    to = f"{path}/{kind}_{report_id}.{file_format}"
    report.write.mode("overwrite").format(file_format).option("header", "true").save(to)
    return to


def reports_of(stored: DataFrame, kind: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Stored reports by type and period."""
    for cond in (
        (F.col("report_type") == kind) if kind else None, (F.col("created_at") >= start) if start is not None else None,
        (F.col("created_at") < end) if end is not None else None
    ):
        if cond is not None:
            stored = stored.filter(cond)
    return stored


def without_expired(stored: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Reports that stay, and those past their time."""
    gone = F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    return stored.filter(~gone), stored.filter(gone)


def export_chain(chain: DataFrame, path: str) -> None:
    chain.write.mode("overwrite").json(path)


def import_chain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("log_id long, seq long, body string, previous_hash string, row_hash string, signature string").json(path)
