"""Operators whose work is spread over ranges, digits or spans, against plain ones, on skewed data."""

import datetime as dt
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkward.functions import pii
from sparkward.functions.rules import PII_TYPES, SIMPLE_PATTERNS
from sparkward.operators import alerts, anonymize, columns, ordered, screening
from sparkward.session import shared_folder

T0 = dt.datetime(2024, 1, 1)


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 3) for _ in range(3000)] + [7.0] * 1500 + [1e300, -1e300, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    real = sorted(v for v in values if v is not None)
    for share in (0.0, 0.05, 0.5, 0.731, 0.95, 0.999, 1.0):
        for most in (10, 100_000):
            assert ordered.percentile(df, "v", share, most) == pytest.approx(float(np.quantile(np.asarray(real), share)), rel=1e-12)
    assert ordered.percentile(df.filter("v IS NULL"), "v", 0.5) is None
    assert ordered.percentile(spark.createDataFrame([(3.0,)] * 50, "v double"), "v", 0.9, 1) == 3.0


def test_running_totals_and_row_numbers_with_outliers(spark):
    rng = random.Random(2)
    values = sorted({rng.random() for _ in range(400)} | {1e12, -1e9})
    rows = [(v, rng.randrange(5)) for v in values]
    df = spark.createDataFrame(rows, "v double, n int")
    for descending in (False, True):
        total, expected = 0, {}
        for v, n in sorted(rows, reverse=descending):
            total += n
            expected[v] = total
        out = ordered.running_totals(df, "v", {"n": "upto"}, descending, ranges=16)
        assert {r.v: r.upto for r in out.collect()} == expected
    sizes = Counter(r._range for r in ordered.in_ranges(df, "v", "_range", 16).collect())
    assert len(sizes) == 16 and max(sizes.values()) < 60  # outliers don't put all rows in one range
    items = [(i, rng.choice("abb"), rng.choice([None, rng.randrange(50), 10**12])) for i in range(500)]
    placed = ordered.row_numbers(spark.createDataFrame(items, "id long, k string, at long"), "k", "at", "id", "place", ranges=8).collect()
    for k in "ab":
        order = sorted((i for i in items if i[1] == k), key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
        assert [r.id for r in sorted((r for r in placed if r.k == k), key=lambda r: r.place)] == [i[0] for i in order]


def test_suppression_hides_exactly_so_many(spark):
    config = anonymize.Config(quasi_identifiers=("q",), key="id", rate=0.13, seed="s")
    for rows in ([(i % 5, "x") for i in range(100)], [(1, "x")] * 100, [(i, f"v{i % 3}") for i in range(100)], [(None, "x")] * 50):
        df = spark.createDataFrame(rows, "id int, q string")
        out = anonymize.suppressed(df, config).collect()
        assert len(out) == len(rows) and sum(r.q == "*" for r in out) == int(len(rows) * 0.13)
        assert Counter(r.id for r in out) == Counter(i for i, _ in rows)
    assert {r.q for r in anonymize.suppressed(spark.createDataFrame([(1, "x")], "id int, q string"), config).collect()} == {"x"}


def test_nth_smallest_hash(spark):
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("h"))
    hashes = sorted(r.h for r in df.collect())
    for n in (1, 17, 1500, 3000):
        for most in (1, 50, 10_000):
            assert anonymize.nth_smallest(df, n, 1, most) == hashes[n - 1]
    assert anonymize.nth_smallest(df, 3001) is None and anonymize.nth_smallest(df, 0) is None


def test_prefilters_never_lose_a_match(spark):
    rng = random.Random(3)
    signs = ["0123456789", "0123456789", "-. ", "@.", "abcXYZ", "/", "Jan 5", "(", ")", "+", "4111", "A1234567", " 12 Main St Springfield 12345"]
    texts = ["".join(rng.choice(rng.choice(signs)) if rng.random() < 0.9 else rng.choice(signs) for _ in range(rng.randrange(
        5, 45
    ))) for _ in range(4000)]
    texts += ["ref 123 456 789 012 345 end", "411-111-111-111-111-1", "Jan 5 99", "a@b.co", "1.2.3.4", "x1234567"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, _, pattern, _ in PII_TYPES:
        lost = df.select(
            pii.matches(F.col("t"), kind, pattern).alias("a"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("b")
        ).filter("a <> b")
        assert lost.count() == 0, kind
    plain = sum((F.regexp_count("t", F.lit(p)) for _, p in SIMPLE_PATTERNS[1:]), F.regexp_count("t", F.lit(SIMPLE_PATTERNS[0][1])))
    assert df.filter(pii.simple_count(F.col("t")) != plain).count() == 0


def test_repeated_alerts_are_found_by_spans(spark):
    rng = random.Random(4)
    at = lambda: T0 + dt.timedelta(minutes=rng.randrange(3000), seconds=rng.choice([0, 30]))
    stored, found = ([(m, at()) for m in rng.choices("abbb", k=n)] for n in (60, 200))
    schema = "message string, timestamp timestamp"
    out = alerts.not_repeated(spark.createDataFrame(found, schema), spark.createDataFrame(stored, schema), 60).collect()
    hour = dt.timedelta(minutes=60)
    expected = [(m, t) for m, t in found if not any(m == n and t - hour <= u <= t for n, u in stored)]
    assert sorted((r.message, r.timestamp.replace(tzinfo=None)) for r in out) == sorted(expected)


def test_rules_beyond_the_broadcast_bound_match_alike(spark):
    breaches = spark.createDataFrame(
        [(i, k, c) for i, (k, c) in enumerate((k, c) for k in ("ofac", "bis", "other", None) for c in ("high", "low", None))],
        "breach_id long, breach_type string, confidence string"
    )
    rules = screening.default_rules(breaches)
    few, many = (screening.matching_rules(breaches, rules, most).select("breach_id", "rule_pos") for most in (100, 6))
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() > 12
    with pytest.raises(ValueError):
        screening.matching_rules(breaches, rules.withColumn("conditions", F.from_json(F.lit("{}"), "map<string,array<string>>")), 6)


def test_profiles_and_samples_of_columns(spark):
    rows = [(i, None if i % 7 == 0 else f"user{i % 3}@mail.example.com", 1.5) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, mail string, x double")
    out = {r.column_name: r for r in columns.profile(df).collect()}
    assert out["id"].unique_ratio == 1 and out["mail"].unique_ratio == round(4 / 70, 6) and out["mail"].null_ratio == round(
        10 / 70, 6
    ) and out["x"].unique_ratio == round(1 / 70, 6)
    assert out["mail"].has_email and not out["id"].has_email and out["id"].is_numeric and out["mail"].avg_length == pytest.approx((60 * 22 + 10 * 4) / 70)
    for some in (df, df.limit(0)):  # all columns at once, and one by one
        at_once = sorted(map(tuple, columns.heuristics(some).collect()))
        assert at_once == sorted(tuple(columns.heuristic(some, c).first()) for c in some.columns)
    samples = {r.column_name: r.sample_values for r in columns.samples(df).collect()}
    assert samples["mail"] == [f"user{i}@mail.example.com" for i in range(3)] and samples["id"] == ["0", "1", "10"]
    kinds = spark.createDataFrame([("ssn_code",), ("Card_no",), ("city",), ("email",), ("salary",), ("x",)], "n string")
    assert [r[0] for r in kinds.select(columns.type_of_name(F.col("n"))).collect()] == [
        "PII-SSN", "PII-Financial", "PII-Address", "PII-Contact", "Financial", "General"
    ]


def test_auroc_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(20)), rng.random() < 0.4) for _ in range(150)] + [(None, True), (1.0, None)]
    real = [(e, p) for e, p in rows if e is not None and p is not None]
    pairs = [(a > b) + 0.5 * (a == b) for a, p in real if p for b, q in real if not q]
    assert alerts.auroc(spark.createDataFrame(
        rows, "error double, positive boolean"
    )).first().auroc == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)
    assert alerts.auroc(spark.createDataFrame([(1.0, True)], "error double, positive boolean")).first().auroc is None


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)
    assert re.match("/", shared_folder(spark))
