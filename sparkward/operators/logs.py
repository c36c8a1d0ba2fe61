"""The standard log table, and rules and scores for unusual rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_blocks, percentile

#: Rows of a user in a block.
BLOCK = 16_384

#: Columns of the standard log table.
LOG_COLUMNS = ("timestamp", "source", "source_type", "log_level", "message", "user", "resource", "action", "status", "metadata")


def normalize(df: DataFrame) -> DataFrame:
    """Any log frame in the standard columns: missing or unreadable timestamps are null, missing texts empty, missing metadata null."""
    have = set(df.columns)

    def column(name: str) -> Column:
        if name == "timestamp":
            return F.col(name).try_cast("timestamp") if name in have else F.lit(None).cast("timestamp")
        if name == "metadata":
            return F.col(name).cast("map<string,string>") if name in have else F.lit(None).cast("map<string,string>")
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in have else F.lit("")

    return df.select(*(column(name).alias(name) for name in LOG_COLUMNS))


def event_logs(events: DataFrame) -> DataFrame:
    """events as logs, with what the rules and models look at."""
    error = F.col("event_type") == "error"
    resource = F.concat(F.lit("res"), F.get_json_object("props", "$.k"))
    kind = F.when(error, "unauthorized_access").when(F.col("event_type") == "purchase", "unusual_transfer").when(
        F.col("event_type") == "signup", "suspicious_behavior"
    ).when(F.col("event_type") == "click", "system_activity").otherwise("compliance_violation")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.lit("events").alias("source"), F.lit("on_prem").alias("source_type"), F.when(error, "ERROR").otherwise("INFO").alias("log_level"), F.lit("").alias("message"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"), resource.alias("resource"), F.upper("event_type").alias("action"), F.when(error, "FAILURE").otherwise("SUCCESS").alias("status"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"), F.when(error, 500).otherwise(200).alias("status_code"), F.col("value").alias("response_time"), kind.alias("type"), F.col("user_id"),
    )


def with_scalar(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """df with the columns of a frame of one row."""
    return df.join(F.broadcast(scalars))


def rule_anomalies(logs: DataFrame) -> DataFrame:
    """Rows that failed or were slower than the 95th percentile; their score is 1."""
    cut = percentile(logs, "response_time", 0.95)
    slow = F.col("response_time") > F.lit(cut).cast("double")
    return logs.filter((F.col("status_code") >= 400) | slow).withColumn("anomaly_score", F.lit(1.0))


def scaled(df: DataFrame, column: str, out: str) -> DataFrame:
    """A column scaled to 0..1 over the frame; all 0 if it doesn't vary."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return with_scalar(df, ends).withColumn(
        out, F.coalesce(F.try_divide(F.col(column) - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    ).drop("low", "high")


def above_percentile(df: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """The rows strictly above a percentile of a column, in no order."""
    return df.filter(F.col(column) > F.lit(percentile(df, column, share)).cast("double"))


def highest_first(anomalies: DataFrame, key: str, score: str = "anomaly_score") -> DataFrame:
    """Anomalies by score, highest first, then by key."""
    return anomalies.orderBy(F.desc(score), key)


def user_baseline(logs: DataFrame, deviations: float = 3.0, least: int = 5) -> DataFrame:
    """Rows far above their user's own history, and actions at an hour, or on a resource, that is new to the user.

    Sums run within the days of a user and go on from the sums of the days before, so a very busy user is as
    many tasks as days. Values are taken less their mean over all rows, which keeps the sums of squares exact.
    """
    shift = logs.agg(F.avg("response_time")).first()[0] or 0.0
    x, day = F.col("response_time") - shift, F.to_date("timestamp")
    seen = logs.select(
        "event_id", "user_id", "timestamp", "response_time", "resource", day.alias("day"), F.hour("timestamp").alias("hour"), x.alias("x"),
        (x * x).alias("xx")
    )
    totals = {"n": F.count("x"), "s": F.sum("x"), "ss": F.sum("xx"), "t": F.sum("response_time")}
    days = seen.groupBy(F.col("user_id").alias("of_user"), F.col("day").alias("of_day")).agg(*(c.alias(k) for k, c in totals.items()))
    earlier = Window.partitionBy("of_user").orderBy("of_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("of_user", "of_day", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_days") for k in totals))
    so_far = Window.partitionBy("user_id", "day").orderBy("timestamp", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    running = seen.select("*", *(F.coalesce(c.over(so_far), F.lit(0)).alias(f"{k}_today") for k, c in totals.items()))
    joined = running.join(carried, (F.col("user_id") == F.col("of_user")) & F.col("day").eqNullSafe(F.col("of_day")))
    for kind in ("hour", "resource"):
        key = F.min(F.struct("timestamp", "event_id"))["event_id"]
        first = seen.groupBy(F.col("user_id").alias(f"{kind}_user"), F.col(kind).alias(f"at_{kind}")).agg(key.alias(f"{kind}_first"))
        joined = joined.join(first, (F.col("user_id") == F.col(f"{kind}_user")) & F.col(kind).eqNullSafe(F.col(f"at_{kind}")))
    n, s, ss, t = (F.col(f"{k}_days") + F.col(f"{k}_today") for k in totals)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(ss - F.try_divide(s * s, n), n - 1)))
    unusual = (n >= least) & (F.col("x") > F.try_divide(s, n) + deviations * sd)
    new = lambda kind: (F.col(f"{kind}_first") == F.col("event_id")) & (n >= least)
    return joined.select(
        "event_id", "user_id", n.alias("n_before"), F.when(n > 0, F.round(t, 2)).alias("sum_before"), F.coalesce(unusual, F.lit(False)).alias("volume_alert"),
        new("hour").alias("new_hour"), new("resource").alias("new_location"),
    )


def sequence_windows(logs: DataFrame, length: int = 10, rows: int = BLOCK) -> DataFrame:
    """For each row with so many rows of its user before it: how far it lies from their mean, in their deviations.

    A user's rows are cut into blocks that know the last rows of the one before, so a user of any number of rows is many tasks.
    """
    before = Window.partitionBy("user_id", "_block").orderBy("_place").rowsBetween(-length, -1)
    blocks = in_blocks(logs.select("event_id", "user_id", "timestamp", "response_time"), "user_id", "timestamp", "event_id", length, rows)
    seen = blocks.select(
        "event_id", "user_id", "response_time", "_own", F.count("*").over(before).alias("n"), F.avg("response_time").over(before).alias("mean"),
        F.stddev_pop("response_time").over(before).alias("sd")
    )
    distance = F.coalesce(F.try_divide(F.abs(F.col("response_time") - F.col("mean")), F.col("sd")), F.lit(0.0))
    return seen.filter((F.col("n") == length) & F.col("_own")).select(
        "event_id", "user_id", F.round("mean", 6).alias("window_mean"), F.round(distance, 6).alias("distance")
    )


def sequences(logs: DataFrame, length: int = 10, rows: int = BLOCK) -> DataFrame:
    """The values of the so many rows before each row of a user, oldest first, and the row's own as the target: event_id, user_id, sequence, target.

    Cut into blocks as in sequence_windows.
    """
    before = Window.partitionBy("user_id", "_block").orderBy("_place").rowsBetween(-length, -1)
    kept = logs.filter("response_time IS NOT NULL").select("event_id", "user_id", "timestamp", "response_time")
    blocks = in_blocks(kept, "user_id", "timestamp", "event_id", length, rows)
    seen = blocks.select("event_id", "user_id", "_own", F.collect_list("response_time").over(before).alias("sequence"), F.col("response_time").alias("target"))
    return seen.filter((F.size("sequence") == length) & F.col("_own")).drop("_own")


def sequence_distance(sequence: Column, target: Column) -> Column:
    """How far a target lies from the mean of its sequence, in the sequence's deviations."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    n = F.size(sequence)
    mean = total(sequence) / n
    deviation = F.sqrt(total(F.transform(sequence, lambda x: (x - mean) * (x - mean))) / n)
    return F.coalesce(F.try_divide(F.abs(target - mean), deviation), F.lit(0.0))


def hybrid_flags(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Row and sequence scores (row_score, sequence_score) scaled to 0..1, their mean, and what each flags: columns row_flag, sequence_flag, combined_flag."""
    both = scaled(scaled(scores, "row_score", "row_scaled"), "sequence_score", "sequence_scaled")
    both = both.withColumn("combined_score", (F.col("row_scaled") + F.col("sequence_scaled")) / 2)
    flags = {"row_flag": "row_scaled", "sequence_flag": "sequence_scaled", "combined_flag": "combined_score"}
    return both.withColumns({flag: F.col(score) > threshold for flag, score in flags.items()})


def flag_agreement(flags: DataFrame) -> DataFrame:
    """Share of rows for which both detectors say what the combination says, and what each found, as one row."""
    agree = (F.col("row_flag") == F.col("combined_flag")) & (F.col("sequence_flag") == F.col("combined_flag"))
    return flags.agg(
        F.count("*").alias("n_rows"), F.count_if("row_flag").alias("n_row"), F.count_if("sequence_flag").alias("n_sequence"), F.count_if("combined_flag").alias("n_combined"),
        F.round(F.coalesce(F.avg(agree.cast("double")), F.lit(0.0)), 6).alias("agreement"),
    )


def hybrid_alerts(logs: DataFrame, flags: DataFrame) -> DataFrame:
    """The rows of logs that flags combine to anomalies, as alerts of the hybrid detector."""
    found = flags.filter("combined_flag").select(F.col("event_id").alias("flagged"), F.col("combined_score").alias("score"))
    joined = logs.join(found, F.col("event_id") == F.col("flagged"))
    text = lambda name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown")).alias(name)
    return joined.select(
        "event_id", text("source"), text("user"), text("resource"), "timestamp", F.col("score").alias("anomaly_score"),
        F.lit("hybrid_ai").alias("detection_method")
    )


def feature_columns(df: DataFrame, label: str | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of a frame, without times and the label."""
    kinds = {name: kind for name, kind in df.dtypes if name != label}
    numeric = [n for n, k in kinds.items() if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")]
    return numeric, [n for n, k in kinds.items() if k in ("string", "boolean")]


def with_features(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """df with these columns: numbers that are absent or null are 0.0, categories 'unknown'."""
    have = set(df.columns)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in have else F.lit("unknown")
    return df.withColumns({**{c: number(c) for c in numeric}, **{c: word(c) for c in categorical}})


def united(parts: dict[str, DataFrame]) -> DataFrame:
    """The logs of several sources in the standard columns, with the source that each row is from."""
    return reduce(DataFrame.unionByName, (normalize(df).withColumn("source", F.lit(name)) for name, df in parts.items()))
