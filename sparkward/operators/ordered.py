"""Running totals, row numbers and percentiles over the order of a whole column, without one task that orders all rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a column is cut into.
RANGES = 256
#: Distinct values that may come to the driver for an exact percentile.
MOST_VALUES = 100_000


def cut_points(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Values that cut a numeric column into at most so many ranges of about equally many rows, whatever its outliers."""
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, 20 * ranges)).first()[0]
    return sorted({x for x in found or () if math.isfinite(x)})


def in_ranges(df: DataFrame, column: str, name: str, ranges: int = RANGES) -> DataFrame:
    """df with the range (a long that never falls where the numeric column rises; -1 for nulls) of each row."""
    splits = [-math.inf, *cut_points(df, column, ranges), math.inf]
    if len(splits) < 3:
        return df.withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(0).cast("long"))
    filled = df.withColumn("_filled", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
    cut = Bucketizer(splits=splits, inputCol="_filled", outputCol="_bucket").transform(filled)
    return cut.withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(F.col("_bucket")).cast("long")).drop("_filled", "_bucket")


def running_totals(counts: DataFrame, order: str, totals: dict[str, str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """counts with the sums of columns (totals: column to new name) over all rows up to each row's place in the order.

    The column is numeric and has no repeated values. Rows are summed within ranges of about equal
    size, and the totals of the ranges before are added; one row for each range is broadcast.
    """
    placed = in_ranges(counts, order, "_range", ranges)
    way = (lambda c: F.desc(c)) if descending else F.asc
    before = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # over so many ranges at most
    sums = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_sum_{c}") for c in totals))
    sums = sums.select(F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in totals))
    within = Window.partitionBy("_range").orderBy(way(order))
    joined = placed.join(F.broadcast(sums), F.col("_range") == F.col("_of"))
    return joined.select(*counts.columns, *((F.sum(c).over(within) + F.col(f"_before_{c}")).alias(name) for c, name in totals.items()))


def as_number(df: DataFrame, name: str) -> Column | None:
    """A number that never falls where a column of numbers, dates or times rises; none for other types."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind == "timestamp_ntz":
        return F.unix_date(F.to_date(c)) * F.lit(86400.0) + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    same = dict.fromkeys(("bigint", "int", "smallint", "tinyint", "double", "float"), lambda x: x)
    made = {"timestamp": F.unix_micros, "date": F.unix_date, **same}.get(kind)
    return None if made is None else made(c).cast("double")


def running_totals_within(df: DataFrame, keys: list[str], order: str, column: str, name: str, ranges: int = RANGES) -> DataFrame:
    """df with the sum of a column over the rows of its keys up to each row's place in the order, which doesn't repeat within keys.

    Rows are summed within ranges of the whole order; the totals of a key's ranges before are added, so a key of any
    number of rows is as many tasks as ranges. Columns of other types than as_number takes are one range.
    """
    number = as_number(df, order)
    numbered = df.withColumn("_number", F.lit(None).cast("double") if number is None else number)
    placed = in_ranges(numbered, "_number", "_range", ranges)
    own = [f"_key{i}" for i in range(len(keys))]
    sums = placed.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col("_range").alias("_of")).agg(F.sum(column).alias("_sum"))
    before = Window.partitionBy(*own).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # over so many ranges at most
    carried = sums.select(*own, "_of", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    within = Window.partitionBy(*keys, "_range").orderBy(order)
    joined = placed.join(carried, [*same, F.col("_range") == F.col("_of")])
    return joined.select(*df.columns, (F.sum(column).over(within) + F.col("_before")).alias(name))


def row_numbers(df: DataFrame, key: str, order: str, then: str, name: str, ranges: int = RANGES) -> DataFrame:
    """df with the place of each row within its key, by order (null first), then another column.

    Rows are numbered within ranges of order of about equal size, and the counts of the ranges before are
    added in a join, so that no task orders all rows of a key. Columns of other types than as_number takes are one range.
    """
    number = as_number(df, order)
    numbered = df.withColumn("_number", F.lit(None).cast("double") if number is None else number)
    placed = in_ranges(numbered, "_number", "_range", ranges)
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # over so many ranges at most
    counts = placed.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.count("*").alias("_count"))
    counts = counts.select("_key", "_of", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_range").orderBy(order, then)
    joined = placed.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return joined.select(*df.columns, (F.row_number().over(within) + F.col("_before")).cast("int").alias(name))


def in_blocks(df: DataFrame, key: str, order: str, then: str, halo: int, rows: int) -> DataFrame:
    """df cut into blocks of so many rows of a key in order, each with the last rows of the one before, the halo.

    Adds _place (from 0, within the key), _block, and _own, which is false for the halo. A window or a pass over a block that looks
    back no further than the halo gives each own row what one over the whole key would give it.
    """
    placed = row_numbers(df, key, order, then, "_place").withColumn("_place", F.col("_place") - 1)
    block = F.expr(f"_place div {rows}").cast("int")
    also = F.when(F.pmod("_place", F.lit(rows)) >= rows - halo, F.array(block, block + 1)).otherwise(F.array(block))
    return placed.select("*", F.explode(also).alias("_block")).withColumn("_own", F.expr(f"_place div {rows}") == F.col("_block"))


def percentile(df: DataFrame, column: str, share: float, most: int = MOST_VALUES) -> float | None:
    """The exact percentile of a column, linear between the two values around it; None without values.

    A sketch brackets the two values, counts tell what lies before the bracket, and it is narrowed until its
    distinct values are few enough to be counted one by one. No task holds all values.
    """
    v = F.col("_v")
    rows = df.select(F.col(column).cast("double").alias("_v")).filter(v.isNotNull())
    n, low, high = rows.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    if not n:
        return None
    position = share * (n - 1)
    first, last = math.floor(position), math.ceil(position)
    below, inside = 0, n
    while inside > most and low < high:
        bracket = rows.filter(v.between(low, high))
        ends = [max(0.0, (first - below) / inside - 1e-3), min(1.0, (last - below + 1) / inside + 1e-3)]
        a, b = bracket.agg(F.percentile_approx("_v", ends, 10_000)).first()[0]
        before, within = bracket.agg(F.count_if(v < a), F.count_if(v.between(a, b))).first()
        if not (below + before <= first and last < below + before + within) or within == inside:
            break
        low, high, below, inside = a, b, below + before, within
    counts = rows.filter(v.between(low, high)).groupBy("_v").count()
    found = {}
    for value, count in sorted((r._v, r["count"]) for r in counts.toLocalIterator()):
        for rank in (first, last):
            if below <= rank < below + count:
                found[rank] = value
        below += count
    return found[first] if first == last else (last - position) * found[first] + (position - first) * found[last]
