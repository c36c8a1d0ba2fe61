"""Streams over logs: incremental reading, windows, sessions, de-duplication and screening."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, screening
from ..operators.silence import LONG_AGO, stayed
from ..sources.readers import OFFENSES

#: How late rows may come.
LATENESS = "1 hour"


def read_files(spark: SparkSession, path: str, schema, file_format: str = "parquet", **options: str) -> DataFrame:
    """A stream of the files of a folder; the checkpoint of the query that reads it remembers which."""
    reader = spark.readStream.format(file_format).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def timed(df: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """df with event time in a column at and a watermark on it."""
    return df.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", lateness)


def counts_by_window(df: DataFrame, window: str, slide: str | None, *keys: str) -> DataFrame:
    """Rows of each key in tumbling or sliding windows."""
    spans = F.window("at", window, slide) if slide else F.window("at", window)
    return df.groupBy(spans.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), *keys, "n")


def too_many(counts: DataFrame, most: int) -> DataFrame:
    """Windows with more rows than allowed."""
    return counts.filter(F.col("n") > most)


def distinct_by_window(df: DataFrame, window: str, slide: str, key: str, value: str) -> DataFrame:
    """About how many values a key meets in sliding windows."""
    return df.groupBy(F.window("at", window, slide).alias("w"), key).agg(F.approx_count_distinct(value).alias("n_distinct")).select(
        F.unix_micros("w.start").alias("start_us"), key, "n_distinct"
    )


def sessions(df: DataFrame, gap: str, key: str) -> DataFrame:
    """Sessions of a key, ended by a gap."""
    return df.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), key, "n"
    )


def first_seen(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def against_baseline(counts: DataFrame, baseline: DataFrame, key: str, factor: float = 3.0) -> DataFrame:
    """Windows with far more rows than a key's baseline (key, usual)."""
    known = baseline.select(F.col(key).alias("_key"), "usual")
    return counts.join(known, F.col(key) == F.col("_key")).filter(F.col("n") > factor * F.col("usual")).drop("_key")


def failed_then_success(logins: DataFrame, minutes: int = 10, least: int = 3) -> DataFrame:
    """Successful log-ins (user, at, successful) after so many failed ones of the user within the minutes before: user, at, n_failed.

    Failures count in their own span of minutes and the next, so that user and span are the key of the join
    and a user of very many log-ins is spread over time. Works on tables and on streams with a watermark on at.
    """
    width = f"{minutes} minutes"
    near = F.expr(f"INTERVAL {minutes} MINUTES")
    span = lambda at: F.window(at, width)["start"]
    good = logins.filter("successful").select("user", "at", span(F.col("at")).alias("span"))
    bad = logins.filter("NOT successful").select(
        F.col("user").alias("f_user"), F.col("at").alias("f_at"),
        F.explode(F.array(span(F.col("at")), span(F.col("at") + near))).alias("f_span")
    )
    within = (F.col("user") == F.col("f_user")) & (F.col("span") == F.col("f_span")) & (F.col("f_at") < F.col("at")) & (F.col("f_at") >= F.col("at") - near)
    met = good.join(bad, within)
    return met.groupBy("user", "at").agg(F.count("*").alias("n_failed")).filter(F.col("n_failed") >= least)


def poll(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str = "60 seconds", name: str | None = None):
    """Starts a query that looks for new rows at each interval, as offenses that are landed; gives the running query. The checkpoint remembers what was read."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sink)
    return (writer.queryName(name) if name else writer).start()


def polled_offenses(spark: SparkSession, path: str, first_ms: int) -> DataFrame:
    """A stream of landed offenses that are open and above severity 5, those since first_ms (24 hours back at the first run)."""
    landed = read_files(spark, path, OFFENSES, "json")
    return landed.filter((F.col("status") == "OPEN") & (F.col("severity") > 5) & (F.col("start_time") > first_ms))


class Monitor:
    """The monitor loop as the sink of one stream: logs are normalized, scored, turned into alerts, screened, and breaches get their remediation steps.

    Each batch adds to four tables below folder: anomalies, alerts, breaches and plan. Its files lie in folders of
    their own, which nobody reads until the batch's manifest names them; a manifest is put in place by one rename. So a
    batch that fails shows nothing, and one that is repeated counts once. Alerts whose message was raised
    within the minutes, in the batch or before it, are left out; of what was raised before, a batch reads only the last time of
    each message that the batch before it handed on, and hands on those within the minutes and lateness of its newest one.
    """

    TABLES = ("anomalies", "alerts", "breaches", "plan")

    def __init__(self, folder: str, listed: DataFrame, rules: DataFrame, score: Callable[[DataFrame], DataFrame], minutes: int = 60, lateness: int = 60):
        self.folder, self.listed, self.rules, self.score, self.minutes, self.lateness = folder, listed, rules, score, minutes, lateness

    def manifests(self, spark: SparkSession) -> str | None:
        """The folder of the manifests, if there is one."""
        path, files = on_store(spark, f"{self.folder}/commits")
        return f"{self.folder}/commits" if files.exists(path) else None

    def stored(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame | None:
        """A table of results, without those of batches from a number on; only batches that are committed show."""
        folder = self.manifests(spark)
        if folder is None:
            return None
        made = spark.read.schema("batch long, attempt string").json(folder)
        made = made if before is None else made.filter(F.col("batch") < before)
        paths = [f"{self.folder}/{name}/batch={r.batch}/attempt={r.attempt}" for r in made.collect()]  # two numbers for each batch
        return spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths).drop("attempt") if paths else None

    def handed_on(self, spark: SparkSession, number: int) -> DataFrame | None:
        """The last times that the batch before this one handed on."""
        path, files = on_store(spark, f"{self.folder}/commits/{number - 1}.json")
        if not files.exists(path):
            return None
        attempt = spark.read.schema("batch long, attempt string").json(f"{self.folder}/commits/{number - 1}.json").first().attempt
        return spark.read.parquet(f"{self.folder}/last/batch={number - 1}/attempt={attempt}")

    def put(self, df: DataFrame, name: str, batch: int, attempt: str) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}/attempt={attempt}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def commit(self, spark: SparkSession, batch: int, attempt: str) -> None:
        """Makes a batch show, by a rename."""
        made, files = on_store(spark, f"{self.folder}/commits/_{attempt}")
        out = files.create(made)
        out.write(bytearray(json.dumps({"batch": batch, "attempt": attempt}).encode()))
        out.close()
        path, _ = on_store(spark, f"{self.folder}/commits/{batch}.json")
        if files.exists(path):  # committed, but the stream's checkpoint didn't get to know
            files.delete(path, False)
        if not files.rename(made, path):
            raise RuntimeError(f"batch {batch} couldn't be committed")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, attempt = batch.sparkSession, uuid.uuid4().hex
        put = lambda df, name: self.put(df, name, number, attempt)
        anomalies = put(self.score(batch), "anomalies")
        raised = alerts.alerts(anomalies)
        before = self.handed_on(spark, number)
        kept = alerts.deduplicated(raised, self.minutes, before).select(F.col("message").alias("_message"), F.col("timestamp").alias("_at"))
        first = raised.join(kept, (F.col("message") == F.col("_message")) & (F.col("timestamp") == F.col("_at")))
        one = first.groupBy("message", "timestamp").agg(F.min_by(F.struct(*raised.columns), "alert_id").alias("_alert")).select("_alert.*")
        made = put(one, "alerts").select("message", F.col("timestamp").cast("timestamp").alias("timestamp"))
        times = made if before is None else made.unionByName(before)
        latest = times.groupBy("message").agg(F.max("timestamp").alias("timestamp"))
        newest = latest.agg((F.max("timestamp") - F.expr(f"INTERVAL {self.minutes + self.lateness} MINUTES")).alias("_oldest"))
        put(latest.join(newest, F.col("timestamp") >= F.col("_oldest")).drop("_oldest"), "last")
        hits = screening.screen(anomalies, self.listed).filter("compliance_breach").withColumn("match_score", F.col("anomaly_score"))
        breaches = put(screening.breach_rows(hits), "breaches")
        put(screening.remediation_plan(breaches, self.rules), "plan")
        self.commit(spark, number, attempt)


def on_store(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, for the few calls that Spark's readers and writers don't make."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes all that has come so far, batch by batch, and stops; goes on from the checkpoint the next time."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def deduplicated(df: DataFrame, minutes: int = 60) -> DataFrame:
    """Alerts (message, at) that come more than minutes after the last one of their message that stayed, with state for each message.

    The last time of a message is all the state there is, and a timer drops it once it can't matter. A batch's times of a
    message are one array of 8 bytes each; where a batch may hold very many of one message (a first run over a long
    history), alerts.deduplicated with the last times before it, as Monitor uses it, spreads them over tasks.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    gap_us = minutes * 60_000_000

    class LastStayed(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.last = handle, handle.getValueState("last", "at_us long")

        def handleInputRows(self, key, rows, timer_values):  # noqa: N802
            last = self.last.get()[0] if self.last.exists() else LONG_AGO
            out = stayed(np.unique(np.concatenate([pdf["at_us"].to_numpy(np.int64) for pdf in rows])), gap_us, last)
            if out:
                last = out[-1]
                self.last.update((last,))
            if last != LONG_AGO:
                self.handle.registerTimer(last // 1000 + 2 * minutes * 60_000)
            yield pd.DataFrame({"message": [key[0]] * len(out), "at_us": out})

        def handleExpiredTimer(self, key, timer_values, expired_timer_info):  # noqa: N802
            if self.last.exists() and self.last.get()[0] // 1000 + 2 * minutes * 60_000 <= expired_timer_info.getExpiryTimeInMs():
                self.last.clear()
            yield pd.DataFrame({"message": [], "at_us": []})

        def close(self) -> None:
            pass

    rows = df.select("message", "at", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("message").transformWithStateInPandas(
        statefulProcessor=LastStayed(), outputStructType="message string, at_us long", outputMode="Append", timeMode="EventTime"
    )


def moving_baseline(rows: DataFrame, decay: float = 0.0, deviations: float = 3.0, least: int = 5, idle_hours: int = 24 * 90) -> DataFrame:
    """Rows of a stream (event_id, user_id, at, response_time) with whether they are far above their user's own earlier ones: event_id, user_id, n_before, volume_alert.

    The state of a user is the weight, mean and sum of squares of the values so far (Welford's update), of which each further value forgets
    the share decay. Without decay the alerts are those of logs.user_baseline. A timer drops users that were idle for so
    long. Rows of a batch are taken by time, then event_id; nulls don't count for the baseline.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Baseline(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.state = handle, handle.getValueState("state", "n long, weight double, mean double, squares double, weights2 double")

        def handleInputRows(self, key, rows, timer_values):  # noqa: N802
            batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
            n, weight, mean, squares, weights2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0)
            before, alerted = [], []
            for x in batch["response_time"].tolist():
                before.append(n)
                known = x == x and x is not None
                spread = weight - (weights2 / weight if weight else 0.0)  # what unbiased variances divide by, n - 1 without decay
                alerted.append(bool(known and n >= least and spread > 0 and x > mean + deviations * max(0.0, squares / spread) ** 0.5))
                if known:
                    weight, weights2, squares = weight * (1 - decay) + 1, weights2 * (1 - decay) ** 2 + 1, squares * (1 - decay)
                    gap = x - mean
                    mean += gap / weight
                    squares += gap * (x - mean)
                    n += 1
            self.state.update((n, float(weight), float(mean), float(squares), float(weights2)))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(int(batch["at"].max().timestamp() * 1000) + idle_hours * 3_600_000)
            yield pd.DataFrame({"event_id": batch["event_id"], "user_id": batch["user_id"], "n_before": before, "volume_alert": alerted})

        def handleExpiredTimer(self, key, timer_values, expired_timer_info):  # noqa: N802
            self.state.clear()
            yield pd.DataFrame({"event_id": [], "user_id": [], "n_before": [], "volume_alert": []})

        def close(self) -> None:
            pass

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    taken = rows.select("event_id", "user_id", "at", F.col("response_time").cast("double").alias("response_time"))
    return taken.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Baseline(), outputMode="Append", timeMode="EventTime",
        outputStructType=f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, n_before long, volume_alert boolean"
    )
