"""Profiles of columns and what personal data their values hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import COLUMN_TYPES, HEURISTIC_NAMES, PROFILE_NAMES, SIMPLE_PATTERNS


def is_string(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def distinct_values(df: DataFrame) -> DataFrame:
    """The different values of all columns as text, with how often each occurs: column_name, v, n. One scan; counts are partial in each task."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in df.columns))
    return df.select(F.inline(cells)).groupBy("column_name", "v").agg(F.count("*").alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """A row of twelve features for each column, from its different values. A table without rows has none."""
    text = F.col("column_name").isin(*(c for c in df.columns if is_string(df, c))) if any(is_string(df, c) for c in df.columns) else F.lit(False)
    named = [c for c in df.columns if any(k in c.lower() for k in PROFILE_NAMES)]
    v, rows = F.col("v"), F.sum("n")
    bare, dashless = F.regexp_replace(v, "[-() ]", ""), F.replace(v, F.lit("-"), F.lit(""))
    digits = lambda x: x.rlike("^[0-9]+$")
    some = lambda cond: F.coalesce(F.bool_or(text & cond), F.lit(False))
    length = F.sum(F.when(text, F.length(F.coalesce(v, F.lit("None"))) * F.col("n")).otherwise(0))
    return distinct_values(df).groupBy("column_name").agg(
        (F.col("column_name").isin(*named) if named else F.lit(False)).alias("sensitive_name"), F.round(F.count("*") / rows, 6).alias("unique_ratio"),
        F.round(F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)) / rows, 6).alias("null_ratio"), (~F.first(text)).alias("is_numeric"), F.first(text).alias("is_string"),
        F.round(length / rows, 6).alias("avg_length"), some(v.contains("@") & F.substring_index(v, "@", -1).contains(".")).alias("has_email"),
        some((F.length(bare) >= 10) & digits(bare)).alias("has_phone"), some((F.length(dashless) == 9) & digits(dashless)).alias("has_ssn"),
        some((F.length(bare) >= 15) & digits(bare)).alias("has_card"), some(F.lower(v).rlike("street|ave|road|dr")).alias("has_address"),
    )


def samples(df: DataFrame, most: int = 3) -> DataFrame:
    """The first different values of each column in their order as text: column_name, sample_values. A tree of partial minima, not a sort."""
    values = distinct_values(df).filter("v IS NOT NULL")
    smallest = values.groupBy(
        "column_name", F.pmod(F.xxhash64("v"), F.lit(64)).alias("salt")
    ).agg(F.slice(F.sort_array(F.collect_set("v")), 1, most).alias("vs"))
    return smallest.groupBy("column_name").agg(F.slice(F.sort_array(F.flatten(F.collect_list("vs"))), 1, most).alias("sample_values"))


def judged_columns(df: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Classification of each column: by a model's score where there is one, else by the heuristic, and sensitive (0.5) where neither gives an answer.

    scores has column_name and score (probability of being sensitive, null where the model failed).
    """
    rules = heuristics(df)
    if scores is None:
        scores = rules.select("column_name", F.lit(None).cast("double").alias("score"))
    known = scores.select(F.col("column_name").alias("scored"), "score")
    joined = rules.join(F.broadcast(known), F.col("column_name") == F.col("scored"), "left")
    score, sure = F.col("score"), F.coalesce("confidence", F.lit(0.5))
    by_model = F.when(score >= 0.5, "sensitive").otherwise("non-sensitive")
    return joined.select(
        "column_name", F.when(score.isNotNull(), by_model).otherwise(F.coalesce("classification", F.lit("sensitive"))).alias("classification"),
        F.when(score.isNotNull(), F.greatest(score, 1 - score)).otherwise(sure).alias("confidence"), F.when(score.isNotNull(), "model").when(F.col("classification").isNotNull(), "heuristic").otherwise("assumed").alias("decided_by"),
    )


def heuristic(df: DataFrame, name: str) -> DataFrame:
    """Whether a column looks sensitive by its name or values, as one row."""
    c = F.col(name).cast("string")
    hit = (c.contains("@") & c.contains(".")) | F.length(F.regexp_replace(c, r"\D", "")).isin(15, 16) | c.rlike(r"^\d{3}-?\d{2}-?\d{4}$")
    named = any(k in name.lower() for k in HEURISTIC_NAMES)
    found = F.lit(True) if named else F.coalesce(F.bool_or(hit), F.lit(False))
    return df.agg(found.alias("s")).select(
        F.lit(name).alias("column_name"), F.when(F.col("s"), "sensitive").otherwise("non-sensitive").alias("classification"),
        F.when(F.col("s"), 0.7).otherwise(0.6).alias("confidence")
    )


def heuristics(df: DataFrame) -> DataFrame:
    """What heuristic() says of every column, in one scan: one yes or no for each column, so no cell travels."""
    def hit(v: Column) -> Column:
        return (v.contains("@") & v.contains(".")) | F.length(F.regexp_replace(v, r"\D", "")).isin(15, 16) | v.rlike(r"^\d{3}-?\d{2}-?\d{4}$")

    hits = df.agg(*(F.coalesce(F.bool_or(hit(as_text(df, c))), F.lit(False)).alias(f"hit_{i}") for i, c in enumerate(df.columns)))
    named = [any(k in c.lower() for k in HEURISTIC_NAMES) for c in df.columns]
    rows = (F.struct(F.lit(c).alias("column_name"), (F.lit(named[i]) | F.col(f"hit_{i}")).alias("sensitive")) for i, c in enumerate(df.columns))
    return hits.select(F.inline(F.array(*rows))).select(
        "column_name", F.when(F.col("sensitive"), "sensitive").otherwise("non-sensitive").alias("classification"),
        F.when(F.col("sensitive"), 0.7).otherwise(0.6).alias("confidence"),
    )


def type_of_name(name: Column) -> Column:
    """Data type by the words in a column's name."""
    out = None
    for words, kind in COLUMN_TYPES:
        cond = reduce(Column.__or__, (F.lower(name).contains(w) for w in words))
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise("General")


def as_text(df: DataFrame, name: str) -> Column:
    """A column's values as text. Floating point numbers from 10^7 on keep all their digits instead of an exponent."""
    text = F.col(name).cast("string")
    if dict(df.dtypes)[name] not in ("double", "float"):
        return text
    long = F.regexp_replace(text.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(name) >= 1e7) & (F.abs(name) < 1e16), long).otherwise(text)


def pii_rollup(frames: dict[str, DataFrame]) -> DataFrame:
    """Cells with personal data by file and column, and by file (column_name null), and the types found (sorted).

    Each table is unpivoted; all columns are looked at, as text. Nulls are skipped.
    """
    parts = []
    for file, df in frames.items():
        cells = F.array(*(F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("v")) for c in df.columns))
        parts.append(df.select(F.lit(file).alias("file"), F.inline(cells)))
    cells = reduce(DataFrame.unionByName, parts)
    counted = cells.select("file", "column_name", *(F.coalesce(F.regexp_count("v", F.lit(p)), F.lit(0)).alias(k) for k, p in SIMPLE_PATTERNS))
    total = sum((F.col(k) for k, _ in SIMPLE_PATTERNS[1:]), F.col(SIMPLE_PATTERNS[0][0]))
    types = F.array_compact(F.array(*(F.when(F.max(F.col(k)) > 0, k) for k, _ in SIMPLE_PATTERNS)))
    return counted.rollup("file", "column_name").agg(
        F.bool_or(total > 0).alias("contains_sensitive"), F.sum(total).cast("long").alias("n_entities"),
        *(F.count_if(F.col(k) > 0).alias(f"n_{k}") for k, _ in SIMPLE_PATTERNS), F.array_join(F.sort_array(types), ",").alias("types")
    ).filter("file IS NOT NULL")
