"""The catalog of findings: records, search, statistics and scan summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from .columns import type_of_name


def document_records(docs: DataFrame, types: tuple = pii.PII_TYPES, carry: tuple[Column, ...] = ()) -> DataFrame:
    """A catalog record for each document (doc_id, source, text): type, classification and confidence by its entities.

    A null text counts as having none. Records with a null id stay. Columns in carry, of docs, go along.
    """
    more = docs.select(*carry).columns if carry else []
    counted = docs.select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("source_location"), *carry,
        *(F.size(pii.matches(F.coalesce("text", F.lit("")), kind, pattern)).alias(kind) for kind, _, pattern, _ in types)
    )
    counts = [F.col(kind) for kind, *_ in types]
    total = sum(counts[1:], counts[0])
    labels = F.filter(F.array(*(F.when(F.col(kind) > 0, label) for kind, label, *_ in types)), lambda x: x.isNotNull())
    sure = F.greatest(F.lit(0.0), *(F.when(F.col(kind) > 0, confidence).otherwise(0.0) for kind, _, _, confidence in types))
    return counted.select(
        "record_id", F.lit("unstructured").alias("source_type"), "source_location", pii.data_type(labels).alias("data_type"),
        F.when(total > 0, "SENSITIVE").otherwise("NON_SENSITIVE").alias("classification"), sure.alias("confidence_score"),
        total.alias("pii_count"), *more
    )


def column_records(profiles: DataFrame, table_name: str) -> DataFrame:
    """A catalog record for each column (column_name, classification, confidence) of a table; record_id is table.column.

    Sensitive columns have the data type of their name, others are General.
    """
    sensitive = F.col("classification") == "sensitive"
    return profiles.select(
        F.concat(F.lit(table_name + "."), "column_name").alias("record_id"), F.lit("structured").alias("source_type"), F.lit(table_name).alias("source_location"),
        F.when(sensitive, type_of_name(F.col("column_name"))).otherwise("General").alias("data_type"), F.when(sensitive, "SENSITIVE").otherwise("NON_SENSITIVE").alias("classification"),
        F.col("confidence").alias("confidence_score"), sensitive.cast("int").alias("pii_count"),
    )


def table_result(records: DataFrame) -> DataFrame:
    """Columns, sensitive columns and their names, by table."""
    sensitive = F.col("classification") == "SENSITIVE"
    names = F.sort_array(F.collect_list(F.when(sensitive, F.substring_index("record_id", ".", -1))))
    return records.groupBy("source_location").agg(
        F.count("*").alias("n_columns"), F.count_if(sensitive).alias("n_sensitive"), names.alias("sensitive_columns")
    )


def catalog_of(*parts: DataFrame) -> DataFrame:
    """Structured and unstructured records as one catalog; ids as text."""
    return reduce(DataFrame.unionByName, (p.withColumn("record_id", F.col("record_id").cast("string")) for p in parts))


def search(
    records: DataFrame, source_type: str | None = None, data_type: str | None = None, classification: str | None = None,
    min_confidence: float = 0.0, limit: int = 100, offset: int = 0, newest: str | None = None
) -> DataFrame:
    """A page of the records that fit: newest first by a column of times if one is named, then by id."""
    for name, value in (("source_type", source_type), ("data_type", data_type), ("classification", classification)):
        if value is not None:
            records = records.filter(F.col(name) == value)
    if min_confidence > 0:
        records = records.filter(F.col("confidence_score") >= min_confidence)
    order = [F.desc_nulls_last(newest)] if newest else []
    return records.orderBy(*order, "record_id").offset(offset).limit(limit)


def category(data_type: Column) -> Column:
    return F.when(data_type.startswith("PII"), "PII").when(data_type.isin("Financial", "Health"), data_type).otherwise("Other")


def statistics(records: DataFrame) -> DataFrame:
    """Numbers of records by category and the mean confidence, by source type. No records, no rows."""
    kind = category(F.col("data_type"))
    counts = [F.count_if(kind == k).alias(f"n_{k.lower()}") for k in ("PII", "Financial", "Health", "Other")]
    return records.groupBy("source_type").agg(F.count("*").alias("n_records"), *counts, F.round(F.avg("confidence_score"), 4).alias("avg_confidence"))


def with_entities(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Records with their entities nested and counted; entities has record_id and the entity's columns."""
    fields = [c for c in entities.columns if c != "record_id"]
    nested = entities.groupBy(F.col("record_id").alias("entity_record")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entities"))
    return records.join(
        nested, F.col("record_id") == F.col("entity_record"), "left"
    ).drop("entity_record").withColumn("pii_count", F.coalesce(F.size("entities"), F.lit(0)))


def scan_summary(docs: DataFrame) -> DataFrame:
    """Files, sensitive files, bytes and entities of each place that was scanned, from documents (doc_id, source, text)."""
    records = document_records(docs, carry=(F.octet_length("text").alias("bytes"),))
    return records.groupBy("source_location").agg(
        F.count("*").alias("n_files"), F.count_if(F.col("pii_count") > 0).alias("n_sensitive"),
        F.sum("bytes").cast("long").alias("n_bytes"), F.sum("pii_count").cast("long").alias("n_entities")
    )


def scan_totals(results: DataFrame, seconds: Column) -> DataFrame:
    """Totals of a scan as one row: files, successes, failures (rows with an error), sensitive files, bytes, and files and megabytes a second.

    results has error, pii_count and bytes; seconds is how long the scan took, 0 for not known.
    """
    ok = F.col("error").isNull()
    totals = results.agg(
        F.count("*").alias("n_files"), F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failed"), F.count_if(ok & (F.col("pii_count") > 0)).alias("n_sensitive"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("n_bytes"), F.max(seconds).cast("double").alias("seconds"),
    )
    rate = lambda x: F.round(F.coalesce(F.try_divide(x, F.col("seconds")), F.lit(0.0)), 6)
    return totals.select("*", rate(F.col("n_files")).alias("files_per_second"), rate(F.col("n_bytes") / float(1 << 20)).alias("mb_per_second"))


def risk_of_count(n: Column) -> Column:
    return F.when(n > 5, "High").when(n > 2, "Medium").otherwise("Low")


def risk_of_score(score: Column) -> Column:
    return F.when(score > 0.7, "High").when(score > 0.4, "Medium").otherwise("Low")


def file_risk(records: DataFrame) -> DataFrame:
    """Files by risk."""
    return records.groupBy(risk_of_count(F.col("pii_count")).alias("risk")).agg(F.count("*").alias("n_files"), F.max("pii_count").alias("most"))


def masked_entities(docs: DataFrame) -> DataFrame:
    """Entities of documents in the form they are stored in, masked."""
    found = docs.select(F.col("doc_id").alias("record_id"), F.inline(pii.sweep(pii.entities(F.col("text")))))
    return found.select(
        "record_id", "entity_type", pii.mask(F.col("value"), F.col("entity_type")).alias("entity_value"),
        F.col("start").alias("start_position"), F.col("end").alias("end_position"), F.col("confidence").alias("confidence_score"),
        F.lit(True).alias("is_masked")
    )
