"""Release of tables: k-anonymity, l-diversity, t-closeness, suppression, generalization and noise."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.protect import laplace, uniform
from .ordered import running_totals, running_totals_within


@dataclass(frozen=True)
class Config:
    """Parameters of a release."""

    quasi_identifiers: tuple[str, ...]
    sensitive: tuple[str, ...] = ()
    key: str = "id"
    k: int = 3
    l: int = 2  # noqa: E741
    t: float = 0.2
    epsilon: float = 1.0
    rate: float = 0.1
    seed: str = "0"
    hierarchies: dict[str, tuple[tuple, ...]] = field(default_factory=dict)


def in_groups(df: DataFrame, groups: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The rows of df whose group is among groups. A group of very many rows is a key that Spark can split."""
    renamed = groups.select(*(F.col(n).alias(f"_g_{n}") for n in names))
    return df.join(renamed, reduce(Column.__and__, (F.col(n) == F.col(f"_g_{n}") for n in names)), "left_semi")


def k_anonymous(df: DataFrame, c: Config) -> DataFrame:
    """The rows of groups of k rows at least; rows with a null quasi-identifier go."""
    groups = df.groupBy(*c.quasi_identifiers).agg(F.count("*").alias("_n")).filter(F.col("_n") >= c.k)
    return in_groups(df, groups, c.quasi_identifiers)


def l_diverse(df: DataFrame, c: Config) -> DataFrame:
    """The rows of groups in which each sensitive column has l values at least, none of them in more than 1/l of the rows. Nulls are no value."""
    for name in c.sensitive:
        counts = df.groupBy(*c.quasi_identifiers, name).agg(F.count("*").alias("_n"))
        real = F.col(name).isNotNull()
        groups = counts.groupBy(*c.quasi_identifiers).agg(
            F.count_if(real).alias("_values"), F.max(F.when(real, F.col("_n"))).alias("_top"), F.sum("_n").alias("_size")
        )
        df = in_groups(df, groups.filter((F.col("_values") >= c.l) & (F.col("_top") <= F.col("_size") / c.l)), c.quasi_identifiers)
    return df


def with_sizes(counts: DataFrame, c: Config) -> DataFrame:
    """Counts (_n) of values of groups with the size of the group, in a join that Spark can split where a group has very many values."""
    own = [f"_of{i}" for i in range(len(c.quasi_identifiers))]
    sizes = counts.groupBy(*(F.col(q).alias(o) for q, o in zip(c.quasi_identifiers, own, strict=True))).agg(F.sum("_n").alias("_size"))
    return counts.join(sizes, [F.col(q).eqNullSafe(F.col(o)) for q, o in zip(c.quasi_identifiers, own, strict=True)]).drop(*own)


def category_distances(df: DataFrame, c: Config, name: str) -> DataFrame:
    """Total variation between each group's values of a column and the whole table's: quasi-identifiers, distance.

    Half the sum of |p - q| is the sum of q - p over the values a group has more of, so only values that
    occur in a group are looked at.
    """
    whole = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_value")).agg(F.count("*").alias("_all"))
    total = whole.agg(F.sum("_all").alias("_total"))
    counts = df.filter(F.col(name).isNotNull()).groupBy(*c.quasi_identifiers, name).agg(F.count("*").alias("_n"))
    shares = with_sizes(counts, c).withColumn("_q", F.col("_n") / F.col("_size")).join(whole, F.col(name) == F.col("_value")).join(F.broadcast(total))
    return shares.groupBy(*c.quasi_identifiers).agg(F.sum(F.greatest(F.lit(0.0), F.col("_q") - F.col("_all") / F.col("_total"))).alias("distance"))


def ks_statistics(df: DataFrame, c: Config, name: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of each group against the whole table, and the distance 1 - p.

    Both distributions come from counts of distinct values, summed within ranges of values and carried on from range to
    range, so that neither the table nor a group of very many values is one task; p is the asymptotic series.
    """
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_value")).agg(F.count("*").alias("_all"))
    whole = running_totals(counts, "_value", {"_all": "_upto"})
    total = counts.agg(F.sum("_all").alias("_total"))
    of_group = df.filter(F.col(name).isNotNull()).groupBy(*c.quasi_identifiers, name).agg(F.count("*").alias("_n"))
    cumulated = running_totals_within(of_group, list(c.quasi_identifiers), name, "_n", "_cum")
    steps = with_sizes(cumulated, c).join(whole, F.col(name) == F.col("_value")).join(F.broadcast(total))
    # a group's step function is farthest from the table's at a value of the group, or just before one
    at = F.abs(F.col("_cum") / F.col("_size") - F.col("_upto") / F.col("_total"))
    before = F.abs((F.col("_cum") - F.col("_n")) / F.col("_size") - (F.col("_upto") - F.col("_all")) / F.col("_total"))
    stats = steps.groupBy(*c.quasi_identifiers).agg(
        F.max(F.greatest(at, before)).alias("statistic"), F.max("_size").alias("size"), F.max("_total").alias("_total")
    )
    en = F.sqrt(F.col("size") * F.col("_total") / (F.col("size") + F.col("_total")))
    x = F.col("statistic") * en
    series = sum((2 * (-1) ** (j - 1) * F.exp(-2.0 * j * j * x * x) for j in range(2, 60)), 2 * F.exp(-2.0 * x * x))
    return stats.select(
        *c.quasi_identifiers, "statistic", "size",
        F.when(x < 0.2, 0.0).otherwise(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))).alias("distance")
    )


def t_close(df: DataFrame, c: Config) -> DataFrame:
    """The rows of groups whose sensitive columns are distributed nearly as in the whole table."""
    whole, kinds = df, dict(df.dtypes)
    for name in c.sensitive:
        distances = category_distances(whole, c, name) if kinds[name] == "string" else ks_statistics(whole, c, name)
        df = in_groups(df, distances.filter(F.col("distance") <= c.t), c.quasi_identifiers)
    return df


def suppressed(df: DataFrame, c: Config, columns: tuple[str, ...] = ()) -> DataFrame:
    """Writes '*' over exactly int(n * rate) values of each column, chosen by a hash of the key, then of the row.

    The cut is the hash of the last row that is chosen. Rows that are alike in all columns tie there: as
    many of them are hidden as are wanted.
    """
    names = columns or c.quasi_identifiers or tuple(df.columns)
    n = int(df.count() * c.rate)
    for name in names:
        whole = F.to_json(F.struct(*(F.col(x) for x in df.columns)))
        h = F.concat(F.md5(F.concat(F.coalesce(F.col(c.key).cast("string"), F.lit("")), F.lit(f"|{name}|{c.seed}"))), F.md5(whole))
        hidden, shown = F.lit("*"), F.col(name).cast("string")
        placed = df.withColumn("_h", h)
        if (cut := nth_smallest(placed.select(F.col("_h").alias("h")), n)) is None:
            df = df.withColumn(name, shown)
            continue
        below, tied = placed.agg(F.count_if(F.col("_h") < cut), F.count_if(F.col("_h") == cut)).first()
        if below + tied == n:
            df = placed.withColumn(name, F.when(F.col("_h") <= cut, hidden).otherwise(shown)).drop("_h")
            continue
        sure = placed.filter(F.col("_h") != cut).withColumn(name, F.when(F.col("_h") < cut, hidden).otherwise(shown))
        alike = placed.filter(F.col("_h") == cut).limit(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(tied))))
        alike = alike.withColumn(name, F.when(F.col("_copy") <= n - below, hidden).otherwise(shown))
        df = sure.drop("_h").unionByName(alike.drop("_h", "_copy"))
    return df


#: Hashes that may come to the driver at once.
MOST_HASHES = 10_000


def nth_smallest(hashes: DataFrame, n: int, digits: int = 4, most: int = MOST_HASHES) -> str | None:
    """The n-th smallest of hex strings h of one length; None if there are fewer.

    Rows are counted by their next digits, 65536 counts at most each time, until those that share the
    digits of the one sought are few enough to be sorted.
    """
    if n < 1:
        return None
    prefix = ""
    while True:
        rows = hashes.filter(F.col("h").startswith(prefix)) if prefix else hashes
        counts = rows.groupBy(F.substring("h", 1, len(prefix) + digits).alias("p")).count().collect()
        longest = all(len(r.p) < len(prefix) + digits for r in counts)
        for row in sorted(counts, key=lambda r: r.p):
            if n <= row["count"]:
                break
            n -= row["count"]
        else:
            return None
        prefix = row.p
        if longest:
            return prefix
        if row["count"] <= most:
            return sorted(r.h for r in hashes.filter(F.col("h").startswith(prefix)).collect())[n - 1]


def generalized(df: DataFrame, c: Config, level: int = 1) -> DataFrame:
    """Replaces values by those at the same place of a higher level of their column's hierarchy; others stay."""
    for name, levels in c.hierarchies.items():
        pairs = [x for p in zip(levels[0], levels[min(level, len(levels) - 1)], strict=False) for x in map(F.lit, p)]
        df = df.withColumn(name, F.coalesce(F.create_map(*pairs)[F.col(name)], F.col(name)))
    return df


def noisy(df: DataFrame, c: Config, columns: tuple[str, ...]) -> DataFrame:
    """Adds Laplace noise of scale range / epsilon to numeric columns; whole numbers are rounded half to even. Texts are left alone."""
    kinds = dict(df.dtypes)
    names = [n for n in columns if kinds[n] in ("double", "float", "bigint", "int")]
    if not names:
        return df
    spans = df.agg(*((F.max(n) - F.min(n)).cast("double").alias(f"_range_{n}") for n in names))
    joined = df.join(F.broadcast(spans))
    for n in names:
        value = F.col(n) + laplace(uniform(F.col(c.key), f"{n}:{c.seed}"), F.col(f"_range_{n}") / c.epsilon)
        joined = joined.withColumn(n, F.bround(value, 0).cast(kinds[n]) if kinds[n] in ("bigint", "int") else value)
    return joined.drop(*(f"_range_{n}" for n in names))


STEPS = ("suppression", "generalization", "k", "l", "t", "noise")


def release(df: DataFrame, c: Config, steps: tuple[str, ...] = STEPS, noise: tuple[str, ...] = ()) -> DataFrame:
    """The chosen steps in order."""
    does = {
        "suppression": suppressed, "generalization": generalized, "k": k_anonymous, "l": l_diverse, "t": t_close,
        "noise": lambda d, c: noisy(d, c, noise)
    }
    for step in steps:
        df = does[step](df, c)
    return df


def metrics(original: DataFrame, released: DataFrame, c: Config, *numeric: str) -> DataFrame:
    """Rows and columns that stay, the smallest group, whether k holds, and the mean ratio of columns' variances, as one row."""
    columns = round(len([x for x in original.columns if x in released.columns]) / len(original.columns), 6)
    groups = released.groupBy(*c.quasi_identifiers).agg(F.count("*").alias("n")).agg(F.min("n").alias("min_group"))
    a = original.agg(F.count("*").alias("n_before"), *(F.var_samp(x).alias(f"before_{x}") for x in numeric))
    b = released.agg(F.count("*").alias("n_after"), *(F.var_samp(F.col(x).cast("double")).alias(f"after_{x}") for x in numeric))
    all_in_one = a.join(F.broadcast(b)).join(F.broadcast(groups))
    ratios = F.array_compact(F.array(*(F.try_divide(f"after_{x}", f"before_{x}") for x in numeric)))
    ratio = F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda x, y: x + y), F.size(ratios))
    return all_in_one.select(
        "n_before", "n_after", F.round(F.try_divide("n_after", "n_before"), 6).alias("retention"), F.lit(columns).alias("column_retention"),
        "min_group", (F.col("min_group") >= c.k).alias("k_holds"), F.round(ratio, 6).alias("variance_ratio")
    )


def tradeoff(df: DataFrame, c: Config, ks: tuple[int, ...]) -> DataFrame:
    """Rows that stay for each k."""
    sizes = df.groupBy(*c.quasi_identifiers).agg(F.count("*").alias("n"))
    return sizes.agg(*(F.sum(F.when(F.col("n") >= k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in ks)).select(F.inline(F.array(*(F.struct(
        F.lit(k).alias("k"), F.col(f"k{k}").alias("rows_kept")
    ) for k in ks))))


def sweep(df: DataFrame, c: Config, settings: tuple[tuple[int, float], ...], column: str) -> DataFrame:
    """For each pair of k and epsilon: rows that stay, and the mean distance that noise moves a column in them: k, epsilon, rows_kept, mean_noise."""
    runs = []
    for k, epsilon in settings:
        own = replace(c, k=k, epsilon=epsilon)
        kept = k_anonymous(df, own).withColumn("_value", F.col(column).cast("double"))
        moved = noisy(kept, own, (column,)).agg(F.count("*").alias("rows_kept"), F.avg(F.abs(F.col(column) - F.col("_value"))).alias("mean_noise"))
        runs.append(moved.select(F.lit(k).alias("k"), F.lit(epsilon).alias("epsilon"), "rows_kept", F.round("mean_noise", 4).alias("mean_noise")))
    return reduce(DataFrame.unionByName, runs)
