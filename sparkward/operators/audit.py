"""Hash-chained audit logs and averaging of model updates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.protect import gaussian, hmac_sha256, signature, uniform

#: Fields of an entry that its hash covers, besides the hash of the entry before; in the order of their names.
FIELDS = ("details", "entry_id", "entry_type", "operation", "timestamp", "user_id")


def body_of(entries: DataFrame) -> Column:
    """The fields of an entry as JSON, in the order of their names; details (a map, which may be absent) in the order of its keys."""
    have = set(entries.columns)
    details = F.map_from_entries(F.sort_array(F.map_entries("details"))) if "details" in have else F.lit(None).cast("map<string,string>")
    fields = (details.alias("details"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in FIELDS[1:]))
    return F.to_json(F.struct(*fields))


def link_hash(body: Column, previous: Column) -> Column:
    """The hash of an entry: of its fields and the hash of the one before."""
    return F.sha2(F.concat_ws("|", body, F.coalesce(previous, F.lit(""))), 256)


def build_chain(entries: DataFrame, key: bytes) -> DataFrame:
    """Chains the entries of each log (log_id, seq, FIELDS; details may be absent) in order of seq: log_id, seq, body, previous_hash, row_hash, signature.

    A log is read in order in one task, which holds only the last hash; logs side by side.
    """
    dealt = entries.select(
        "log_id", F.col("seq").cast("long").alias("seq"), body_of(entries).alias("body")
    ).repartition("log_id").sortWithinPartitions("log_id", "seq", "body")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = (), None
        for batch in batches:
            before, hashes = [], []
            for log, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now != (log,):
                    now, last = (log,), None
                before.append(last)
                last = hashlib.sha256(f"{text}|{last or ''}".encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before, pa.string()), pa.array(hashes, pa.string())],
                names=[*batch.schema.names, "previous_hash", "row_hash"]
            )

    linked = dealt.mapInArrow(
        chain, f"log_id {entries.schema['log_id'].dataType.simpleString()}, seq long, body string, previous_hash string, row_hash string"
    )
    return linked.withColumn("signature", signature(key, F.col("row_hash")))


def verify_chain(chain: DataFrame, key: bytes) -> DataFrame:
    """Issues of a chain: log_id, seq, issue (first row has a predecessor, hash doesn't match, signature doesn't match)."""
    computed = link_hash(F.col("body"), F.col("previous_hash"))
    order = Window.partitionBy("log_id").orderBy("seq")
    checked = chain.select(
        "log_id", "seq", F.col("previous_hash"), computed.alias("computed"), F.lag(computed).over(order).alias("before"),
        F.row_number().over(order).alias("n"), (F.col("signature") == signature(key, computed)).alias("signed")
    )
    issue = F.when(
        (F.col("n") == 1) & F.col("previous_hash").isNotNull(), "first entry has a predecessor"
    ).when((F.col("n") > 1) & ~F.col("previous_hash").eqNullSafe(F.col("before")), "hash mismatch").when(~F.coalesce("signed", F.lit(False)), "signature mismatch")
    return checked.select("log_id", "seq", issue.alias("issue")).filter("issue IS NOT NULL")


def accepted_updates(updates: DataFrame, clients: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Updates (client_id, key, idx, value, samples_count) of registered clients with a plausible count and the usual keys."""
    known = updates.filter((F.col("samples_count") > 0) & (F.col("samples_count") <= most)).join(
        clients.select(F.col("client_id").alias("known")).distinct(), F.col("client_id") == F.col("known"), "left_semi"
    )
    keys = known.groupBy("client_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    usual = keys.groupBy("keys").agg(F.count("*").alias("n")).agg(F.max_by("keys", F.struct("n", "keys")).alias("usual"))
    good = keys.join(F.broadcast(usual), F.col("keys") == F.col("usual")).select(F.col("client_id").alias("good"))
    return known.join(good, F.col("client_id") == F.col("good"), "left_semi")


def federated_average(updates: DataFrame) -> DataFrame:
    """Mean of each coordinate, weighted by samples."""
    return updates.groupBy("key", "idx").agg(
        (F.sum(F.col("value") * F.col("samples_count")) / F.sum("samples_count")).alias("value"), F.count("*").alias("n_clients")
    )


def private_updates(updates: DataFrame, clip: float, multiplier: float, seed: str) -> DataFrame:
    """Values clipped to -clip..clip with normal noise."""
    at = F.concat_ws(":", "client_id", "key", "idx")
    clipped = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("value")))
    return updates.withColumn("value", clipped + gaussian(uniform(at, seed + "u"), uniform(at, seed + "v"), F.lit(multiplier * clip)))


def model_digest(weights: DataFrame) -> DataFrame:
    """SHA-256 of each round's weights: of one hash for each key, in order of keys."""
    by_key = weights.groupBy("round", "key").agg(F.sha2(
        F.array_join(F.sort_array(F.collect_list(F.struct("idx", F.format_string("%.6f", F.col("value")).alias("v")))).cast("array<string>"), ","),
        256
    ).alias("h"))
    return by_key.groupBy("round").agg(F.sha2(
        F.array_join(F.sort_array(F.collect_list(F.struct("key", "h"))).cast("array<string>"), ","), 256
    ).alias("digest"))


def client_statistics(history: DataFrame) -> DataFrame:
    """Training of each client (client_id, round, samples_count, seconds, accuracy, loss): rounds, samples, total and mean time, and the last round with its metrics."""
    last = F.max_by(F.struct("accuracy", "loss"), F.struct("round", "accuracy", "loss"))
    stats = history.groupBy("client_id").agg(
        F.max("round").alias("last_round"), F.count("*").alias("n_rounds"), F.sum("samples_count").alias("n_samples"), F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds"), last.alias("last")
    )
    return stats.select(
        "client_id", "last_round", "n_rounds", "n_samples", "total_seconds", "mean_seconds", F.col("last.accuracy").alias("last_accuracy"),
        F.col("last.loss").alias("last_loss")
    )


def federated_round(updates: DataFrame, clients: DataFrame, number: int, clip: float, multiplier: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """One round: verified updates get noise and are averaged. Gives the model (round, key, idx, value, n_clients) and its history row (round, n_clients, n_samples, digest)."""
    accepted = accepted_updates(updates, clients)
    model = federated_average(private_updates(accepted, clip, multiplier, f"{seed}:{number}")).withColumn("round", F.lit(number))
    took = accepted.select("client_id", "samples_count").distinct().agg(
        F.count_distinct("client_id").alias("n_clients"), F.sum("samples_count").alias("n_samples")
    )
    history = model_digest(model).join(F.broadcast(took)).select("round", "n_clients", "n_samples", "digest")
    return model.select("round", "key", "idx", "value", "n_clients"), history


def breach_lines(breaches: DataFrame, rule: str, at: Column) -> DataFrame:
    """A line of the remediation log for each breach: time, rule, breach_id, type, user and resource ('unknown' where they aren't known)."""
    text = lambda name: F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("unknown")).alias(name)
    return breaches.select(at.alias("logged_at"), F.lit(rule).alias("rule"), "breach_id", "breach_type", text("user"), text("resource"))


def pseudonyms(df: DataFrame, name: str, salt: bytes) -> DataFrame:
    return df.withColumn("pseudonym", hmac_sha256(salt, F.col(name)))
